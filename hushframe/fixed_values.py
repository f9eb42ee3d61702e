"""Values that decide results: word lists, answer codes, patterns, wording of reasons.

Everything here is data. Changing an entry changes what is found, so the tests pin the counts.
"""

# ---------------------------------------------------------------- fixed values: restricted words
# A strict word must equal a column name or label, a fuzzy word must occur inside it.

SURVEY_SYSTEM_STRICT = [
    "deviceid", "subscriberid", "simid", "formdef_version", "devicephonenum", "duration", "bc_rand",
    "key", "starttime", "endtime", "audio_audit_cons_1", "audio_audit_cons_2",
    "audio_audit_cons_positivo", "text_audit", "text_audit_field", "call_log", "caseid",
    "sstrm_pct_conversation", "sstat_sound_level", "sstrm_sound_level", "audio_audit_survey",
    "reschedule_format", "reschedule_2_format",
]

LOCATION_STRICT = ["vill", "lc"]

LOCATION_FUZZY = [
    "district", "country", "subcountry", "parish", "village", "community", "location", "panchayat",
    "compound", "survey_location", "county", "subcounty", "ciudad", "distrito", "villa", "city",
    "town", "neighborhood", "neighbourhood", "barangay", "brgy", "municipio", "colonia", "alcaldia",
    "alcaldía", "upazila", "tribe",
]

ABBREVIATION_STRICT = [
    "nam", "add", "addr", "addr1", "addr2", "dist", "parish", "loc", "acc", "plan", "medic", "insur",
    "num", "resid", "home", "spec", "id", "enum", "info", "data", "comm", "count", "fo",
]

GUIDELINE_STRICT = [
    "gps", "lat", "lon", "coord", "house", "social", "census", "fax", "ip", "url", "specify",
    "enumerator", "random", "name", "enum_name", "rand", "uid", "hh", "age", "gps", "id", "ip", "red",
    "fono", "url", "web", "number", "encuestador", "escuela", "colegio", "edad", "insurance",
    "school", "birth",
]

GUIDELINE_FUZZY = [
    "name", "_name", "fname", "lname", "first_name", "last_name", "birthday", "bday", "address",
    "network", "email", "beneficiary", "mother", "wife", "father", "husband", "enumerator ",
    "enumerator_", "child_age", "latitude", "longitude", "coordinates", "website", "nickname",
    "nick_name", "firstname", "lastname", "sublocation", "alternativecontact", "division",
    "resp_name", "head_name", "headname", "respname", "subvillage",
]

SPANISH_FUZZY = [
    "apellido", "apellidos", "beneficiario", "censo", "comunidad", "contar", "coordenadas",
    "direccion", "edad_nino", "email", "esposa", "esposo", "fecha_nacimiento", "identificador",
    "identidad", "informacion", "latitud", "latitude", "locacion", "longitud", "madre", "medico",
    "nino", "nombre", "numero", "padre", "pag_web", "pais", "parroquia", "primer_nombre", "random",
    "salud", "seguro", "ubicacion",
]

SWAHILI_STRICT = [
    "jina", "simu", "mkoa", "wilaya", "kata", "kijiji", "kitongoji", "vitongoji", "nyumba", "numba",
    "namba", "tarahe ya kuzaliwa", "umri", "jinsi", "jinsia",
]

# ---------------------------------------------------------------- fixed values: answer codes
# Columns: every three-digit number with equal digits, of either sign. Free text: four of them.
COLUMN_MISSING_CODES = [sign + 3 * digit for sign in ("-", "") for digit in "123456789"]
TEXT_MISSING_CODES = ["777", "888", "999", "-888"]

# Spellings that a CSV reader takes as null (the pandas default set).
NA_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---------------------------------------------------------------- fixed values: shapes
PHONE_SHAPES = [
    r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}",
    r"\d{3}[-.\s]?\d{4}",
]
DATE_SHAPES = [
    r"(?:0[1-9]|[12]\d|3[01])[/.-](?:0[1-9]|1[0-2])[/.-][12]\d{3}",
    r"(?:0[1-9]|1[0-2])[/.-](?:0[1-9]|[12]\d|3[01])[/.-][12]\d{3}",
    r"[12]\d{3}[/.-](?:0[1-9]|1[0-2])[/.-](?:0[1-9]|[12]\d|3[01])",
]

# ---------------------------------------------------------------- fixed values: thresholds
SPARSE_STRING_RATIO = 0.2
SPARSE_ENTRY_RATIO = 0.3
MANY_VALUE_LABELS = 10
SAMPLED_VALUES = 10
LOW_POPULATION = 20000
MIN_NAME_INCIDENCE = 50
MIN_TOKEN_LENGTH = 3
MASK = "XXXX"

# ---------------------------------------------------------------- fixed values: word classes
NAME_LIKE_TAGS = ["PROPN", "X", "PER", "LOC", "ORG", "MISC", ""]

# ---------------------------------------------------------------- fixed values: countries
COUNTRY_ISO = {
    "Mexico": "mx", "Bangladesh": "bd", "Myanmar": "mm", "Philippines": "ph", "Bolivia": "bo",
    "Colombia": "co", "Dominican Republic": "do", "Paraguay": "py", "Peru": "pe",
    "Burkina Faso": "bf", "Cote dIvoire": "ci", "Ghana": "gh", "Liberia": "lr", "Mali": "ml",
    "Sierra Leone": "sl", "Kenya": "ke", "Malawi": "mw", "Rwanda": "rw", "Tanzania": "tz",
    "Uganda": "ug", "Zambia": "zm",
}

# ---------------------------------------------------------------- fixed values: wording
REASON_SYSTEM = "SurveyCTO variable"
REASON_WORD = "{on} had {kind} match with restricted word '{word}'"
REASON_SPARSE_STRINGS = " and has sufficiently sparse strings"
REASON_VALUE_LABELS = " and values labels are sparse"
REASON_LOW_POPULATION = " and has a location with population under 20,000: "
REASON_FORMAT = "Column entries have {shape} format"
REASON_SPARSE = "Column entries are too sparse"
