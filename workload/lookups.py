"""Queries on outside knowledge: populations, places, name registries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hushframe import fixed_values as fixed
from hushframe.functions.values import population_number
from hushframe.operators import freetext, places
from hushframe.plans import detect
from hushframe.session import rows_frame
from hushframe.sources import registries
from hushframe.sources.tables import Survey
from workload.shared import quote, table


def population_forms(key: str, comma: str) -> str:
    """Population texts of every form, by key; `comma` prints the key with thousands separators."""
    return f"""CASE {key} % 9
      WHEN 0 THEN concat({comma}, '\n2010') WHEN 1 THEN concat({comma}, ' (2018)') WHEN 2 THEN {comma}
      WHEN 3 THEN concat({key}, ' million people')
      WHEN 4 THEN concat({key} % 100, '.', {key} % 7, ' million (2010)')
      WHEN 5 THEN concat({key}, ' million') WHEN 6 THEN concat({key}, ' thousand people')
      WHEN 7 THEN concat({key}, '.5') ELSE 'n/a x y' END"""


def _spark_forms(key: str) -> str:
    return population_forms(key, f"format_number({key}, 0)").replace("\n2010", "\\n2010")


def _duck_forms(key: str) -> str:
    return population_forms(key, f"format('{{:,}}', {key})").replace("'\n2010'", "chr(10) || '2010'")


def _number_sql(text: str, strict_units: bool = False) -> str:
    """The reading rule as one SQL expression over a text expression."""
    words = f"string_split(string_split(replace({text}, ',', ''), chr(10))[1], ' ')"
    last = f"len({words}) > 1" + (f" AND {words}[-1] <> 'million'" if strict_units else "")
    kept = f"(CASE WHEN {last} THEN {words}[:-2] ELSE {words} END)"
    return f"""CASE WHEN len({kept}) > 1
      THEN CAST(trunc(try_cast({kept}[1] AS DOUBLE) * CASE WHEN {kept}[2] = 'million' THEN 1e6 ELSE 1 END) AS BIGINT)
      WHEN regexp_full_match({kept}[1], '[+-]?[0-9]+') THEN CAST({kept}[1] AS BIGINT) END"""


def population_text(spark, sf_dir):
    texts = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_spark_forms('o_orderkey')} as text")
    return texts.select(
        "o_orderkey",
        population_number(F.col("text")).alias("population"),
        population_number(F.col("text"), strict_units=True).alias("population_strict"),
    )


POPULATION_SQL = f"""
SELECT o_orderkey, {_number_sql("t")} AS population, {_number_sql("t", True)} AS population_strict
FROM (SELECT o_orderkey, {_duck_forms("o_orderkey")} AS t FROM orders)"""

# Places are towns numbered by customer; several customers share a town in different countries.
_TOWN = "concat('Town ', c_custkey % 800)"
_ISO = "CASE c_nationkey % 3 WHEN 0 THEN 'mx' WHEN 1 THEN 'ke' ELSE 'pe' END"
_PEOPLE = """CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 7 = 0 THEN NULL
  ELSE (c_custkey * 37) % 45000 END"""


def gazetteer(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        f"{_TOWN} as name", f"{_ISO} as country_iso", f"cast({_PEOPLE} as bigint) as population"
    )


def second_source(spark, sf_dir):
    texts = table(spark, sf_dir, "supplier").selectExpr(
        "concat('Town ', s_suppkey) as name", f"{_spark_forms('s_suppkey')} as text"
    )
    return registries.ingest_population_answers(texts, "name", "text")


def visited(spark, sf_dir):
    """Distinct places per order priority with the first order that names them."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr("concat('Town ', o_custkey) as place", "o_orderpriority as list_id", "o_orderkey as idx")
        .groupBy("list_id", "place")
        .agg(F.min("idx").alias("idx"))
    )


def _looked_up(spark, sf_dir, country="Mexico", second=True):
    return places.place_lookup(
        visited(spark, sf_dir),
        gazetteer(spark, sf_dir),
        fixed.COUNTRY_ISO.get(country),
        second_source(spark, sf_dir) if second else None,
    )


def place_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir)


def place_lookup_any_country(spark, sf_dir):
    return _looked_up(spark, sf_dir, country="Atlantis", second=False)


def low_population_places(spark, sf_dir):
    return places.low_population_places(_looked_up(spark, sf_dir)).select("list_id", "place")


def low_population_by_list(spark, sf_dir):
    found = _looked_up(spark, sf_dir, second=False)
    return places.low_population_places(found, list_by="list_id").select("list_id", "place")


def low_population_conservative(spark, sf_dir):
    found = _looked_up(spark, sf_dir)
    return places.low_population_places(found, unknown_is_low=True).select("list_id", "place")


def location_first_low(spark, sf_dir):
    return places.first_low_population_place(_looked_up(spark, sf_dir), "idx", list_by=("list_id",))


def location_first_low_conservative(spark, sf_dir):
    return places.first_low_population_place(
        _looked_up(spark, sf_dir), "idx", unknown_is_low=True, list_by=("list_id",)
    )


def _found_ctes(iso: str | None = "mx", second: bool = True) -> str:
    where = f"WHERE country_iso = {quote(iso)}" if iso else ""
    population = "coalesce(k.population, s.population)" if second else "k.population"
    return f"""
gaz AS (SELECT {_TOWN} AS name, {_ISO} AS country_iso, {_PEOPLE} AS population FROM customer),
known AS (SELECT name, max(nullif(population, 0)) AS population FROM gaz {where} GROUP BY name),
second AS (SELECT name, max(nullif(population, 0)) AS population FROM (
  SELECT name, {_number_sql("t")} AS population
  FROM (SELECT concat('Town ', s_suppkey) AS name, {_duck_forms("s_suppkey")} AS t FROM supplier)) GROUP BY name),
visited AS (SELECT o_orderpriority AS list_id, concat('Town ', o_custkey) AS place, min(o_orderkey) AS idx
  FROM orders GROUP BY ALL),
found AS (SELECT v.list_id, v.place, v.idx, k.name IS NOT NULL AS place_exists,
    CASE WHEN k.name IS NOT NULL THEN CAST({population} AS BIGINT) END AS population
  FROM visited v LEFT JOIN known k ON k.name = v.place LEFT JOIN second s ON s.name = v.place)"""


_FIRST_LOW_SQL = f"""
WITH {_found_ctes()},
start AS (SELECT list_id, min(idx) FILTER (population >= 20000) AS first_high FROM found
  WHERE place_exists GROUP BY list_id)
SELECT list_id, arg_min(place, idx) AS place FROM found JOIN start USING (list_id)
WHERE place_exists AND (population < 20000 OR (population IS NULL AND idx > first_high)) GROUP BY list_id"""


def detect_by_location(spark, sf_dir):
    return detect.by_location(
        [_visits(spark, sf_dir)],
        gazetteer(spark, sf_dir),
        country="Mexico",
        second_source=second_source(spark, sf_dir),
    )


def catalog_scan_two_countries(spark, sf_dir):
    """Two surveys of the same places in different countries, in one run."""
    visits = _visits(spark, sf_dir)
    both = [replace(visits, name=name, country=country) for name, country in COUNTRIES]
    return detect.by_location(both, gazetteer(spark, sf_dir), second_source=second_source(spark, sf_dir))


COUNTRIES = [("visits", "Mexico"), ("trips", "Kenya")]


def cascade_with_locations(spark, sf_dir):
    """The cascade with the population check: location words no longer flag a column by themselves."""
    return detect.cascade(
        [_visits(spark, sf_dir)],
        gazetteer=gazetteer(spark, sf_dir),
        country="Mexico",
        second_source=second_source(spark, sf_dir),
    )


def _visits(spark, sf_dir):
    """Orders as a survey of places: two columns hold towns, one has a location name without places."""
    data = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as visit",
        "concat('Town ', o_custkey) as home_village",
        "concat('Town ', o_orderkey % 100) as q7",
        "o_orderpriority as city",
        "o_totalprice as amount",
    )
    labels = rows_frame(spark, [("q7", "Nearest Town")], "column_name string, label string")
    return Survey("visits", data, labels=labels, order_by=("visit",))


def _location_ctes(name: str, iso: str) -> str:
    return f"""
{_found_ctes(iso)},
visits AS (SELECT o_orderkey AS visit, concat('Town ', o_custkey) AS home_village,
  concat('Town ', o_orderkey % 100) AS q7, o_orderpriority AS city FROM orders),
lists AS (
  SELECT 'home_village' AS column_name, home_village AS place, min(visit) AS idx FROM visits GROUP BY ALL
  UNION ALL SELECT 'q7', q7, min(visit) FROM visits GROUP BY ALL
  UNION ALL SELECT 'city', city, min(visit) FROM visits GROUP BY ALL),
checked AS (SELECT l.*, coalesce(k.population, s.population) AS population FROM lists l
  JOIN known k ON k.name = l.place LEFT JOIN second s ON s.name = l.place),
start AS (SELECT column_name, min(idx) FILTER (population >= 20000) AS first_high FROM checked GROUP BY 1),
low AS (SELECT column_name, arg_min(place, idx) AS place FROM checked JOIN start USING (column_name)
  WHERE population < 20000 OR (population IS NULL AND idx > first_high) GROUP BY 1),
hits AS (SELECT * FROM (VALUES ('home_village', 'village', 'name'), ('q7', 'town', 'label'), ('city', 'city', 'name'))
  AS t(column_name, word, matched_on)),
by_location AS (
  SELECT {quote(name)} AS table_name, column_name, 'location' AS method, word, 'fuzzy' AS match_kind, matched_on,
    place AS evidence, CASE matched_on WHEN 'name' THEN 'Name' ELSE 'Label' END
      || ' had fuzzy match with restricted word ''' || word
      || ''' and has a location with population under 20,000: ' || place AS reason
  FROM low JOIN hits USING (column_name))"""


_LOCATION_CTES = _location_ctes("visits", "mx")
_TWO_COUNTRIES_SQL = " UNION ALL ".join(
    f"SELECT * FROM (WITH {_location_ctes(name, fixed.COUNTRY_ISO[country])} SELECT * FROM by_location)" for name, country in COUNTRIES
)

_CASCADE_LOCATION_SQL = f"""
WITH {_LOCATION_CTES},
ratios AS (
  SELECT 'visit' AS column_name, 1.0 AS ratio
  UNION ALL SELECT 'home_village', count(DISTINCT home_village) / count(*) FROM visits
  UNION ALL SELECT 'q7', count(DISTINCT q7) / count(*) FROM visits
  UNION ALL SELECT 'city', count(DISTINCT city) / count(*) FROM visits
  UNION ALL SELECT 'amount', count(DISTINCT o_totalprice) / count(*) FROM orders)
SELECT * FROM by_location
UNION ALL
SELECT 'visits', column_name, 'sparsity', NULL, NULL, NULL, NULL, 'Column entries are too sparse'
FROM ratios WHERE ratio > 0.3 AND column_name NOT IN (SELECT column_name FROM by_location)"""

# Name-registry answers made from the customers: no jurisdiction, an incidence that is no number,
# a result without the fields, an answer without results.
_ANSWER = """CASE WHEN c_custkey % 10 = 9 THEN '{"error": "quota"}' ELSE concat(
  '{"results": [{"name": "', c_name, '", "jurisdictions": [',
  CASE c_custkey % 3 WHEN 0 THEN '' ELSE '{"iso": "mx"}' END, '], "world": {"incidence": ',
  CASE c_custkey % 4 WHEN 0 THEN '"many"' ELSE concat('', c_custkey % 120) END,
  '}}, {"name": "', c_mktsegment, '"}]}') END"""


def _registry(spark, sf_dir):
    answers = table(spark, sf_dir, "customer").selectExpr(f"{_ANSWER} as body")
    return registries.ingest_name_answers(answers, "body", "forename")


def name_registry_ingest(spark, sf_dir):
    return _registry(spark, sf_dir).select(
        "name", "name_type", "incidence", F.size("jurisdictions").cast("bigint").alias("n_jurisdictions")
    )


def known_names(spark, sf_dir):
    """Customers whose name the registry answers confirm."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("token"))
    return freetext.person_names(names, _registry(spark, sf_dir))


_INGEST = f"""
SELECT json_extract_string(r, '$.name') AS name, 'forename' AS name_type,
  try_cast(json_extract_string(r, '$.world.incidence') AS BIGINT) AS incidence,
  CAST(json_array_length(r, '$.jurisdictions') AS BIGINT) AS n_jurisdictions
FROM (SELECT unnest(CAST(json_extract(body, '$.results[*]') AS JSON[])) AS r
  FROM (SELECT {_ANSWER} AS body FROM customer))
WHERE try_cast(json_extract_string(r, '$.world.incidence') AS BIGINT) IS NOT NULL"""

ENTRIES = {
    "population_text": (population_text, POPULATION_SQL),
    "place_lookup": (
        place_lookup,
        f"WITH {_found_ctes()} SELECT * FROM found",
    ),
    "place_lookup_any_country": (
        place_lookup_any_country,
        f"WITH {_found_ctes(None, False)} SELECT * FROM found",
    ),
    "low_population_places": (
        low_population_places,
        f"""WITH {_found_ctes()} SELECT list_id, place FROM found WHERE place_exists AND (population < 20000
  OR (population IS NULL AND (SELECT max(population) >= 20000 FROM found)))""",
    ),
    "low_population_by_list": (
        low_population_by_list,
        f"""WITH {_found_ctes(second=False)} SELECT list_id, place FROM found WHERE place_exists
  AND (population < 20000 OR (population IS NULL AND list_id IN (
    SELECT list_id FROM found WHERE population >= 20000)))""",
    ),
    "low_population_conservative": (
        low_population_conservative,
        f"""WITH {_found_ctes()} SELECT list_id, place FROM found
WHERE place_exists AND (population < 20000 OR population IS NULL)""",
    ),
    "location_first_low": (location_first_low, _FIRST_LOW_SQL),
    "location_first_low_conservative": (
        location_first_low_conservative,
        f"""WITH {_found_ctes()} SELECT list_id, arg_min(place, idx) AS place FROM found
WHERE place_exists AND (population < 20000 OR population IS NULL) GROUP BY list_id""",
    ),
    "detect_by_location": (detect_by_location, f"WITH {_LOCATION_CTES} SELECT * FROM by_location"),
    "catalog_scan_two_countries": (catalog_scan_two_countries, _TWO_COUNTRIES_SQL),
    "cascade_with_locations": (cascade_with_locations, _CASCADE_LOCATION_SQL),
    "name_registry_ingest": (name_registry_ingest, _INGEST),
    "known_names": (
        known_names,
        f"SELECT c_name AS token FROM customer SEMI JOIN ({_INGEST}) n"
        " ON n.name = c_name AND n.incidence > 50 AND n.n_jurisdictions > 0",
    ),
}
