"""The column detectors and their cascade, over one or many tables at once.

A finding is one row (table_name, column_name, method, word, match_kind, matched_on, evidence,
reason). Detectors take `columns`, the names still open per table, so that cheap tests come first
and the expensive ones read only what is left. What reaches the driver is names and findings: a few
rows per column at most, the same order of size as the schemas it already holds.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe import fixed_values as fixed
from hushframe.operators import catalog, formats, freetext, places, profile
from hushframe.session import rows_frame
from hushframe.sources import words as word_lists
from hushframe.sources.tables import Survey

FINDING_SCHEMA = (
    "table_name string, column_name string, method string, word string, match_kind string, "
    "matched_on string, evidence string, reason string"
)
_FIELDS = [part.split()[0] for part in FINDING_SCHEMA.split(", ")]
# Branches of one union; wider catalogs run as several jobs.
_COLUMNS_PER_JOB = 60

Open = dict[str, list[str]]


def all_columns(surveys: list[Survey]) -> Open:
    return {s.name: list(s.data.columns) for s in surveys}


def _session(surveys: list[Survey]):
    return surveys[0].data.sparkSession


def _labels(surveys: list[Survey]) -> DataFrame | None:
    """The labels of all tables as one frame with `table_name`."""
    frames = [s.labels.withColumn("table_name", F.lit(s.name)) for s in surveys if s.labels is not None]
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else None


def _many_value_labels(surveys: list[Survey]) -> DataFrame | None:
    """Columns with many value labels; a frame that several tables share is counted once."""
    shared: dict[int, list[Survey]] = {}
    for s in surveys:
        if s.value_labels is not None:
            shared.setdefault(id(s.value_labels), []).append(s)
    frames = [
        profile.many_value_labels(users[0].value_labels).select(
            F.explode(F.array(*[F.lit(s.name) for s in users])).alias("table_name"),
            "column_name",
            "n_labels",
        )
        for users in shared.values()
    ]
    return reduce(DataFrame.unionAll, frames) if frames else None


def _open_catalog(surveys: list[Survey], columns: Open) -> DataFrame:
    return catalog.column_catalog(
        {s.name: s.data.select([s.data[f"`{c}`"] for c in columns.get(s.name, [])]) for s in surveys}
    )


def _finding(method: str, reason: Column, **known: Column) -> list[Column]:
    known |= {"method": F.lit(method), "reason": reason}
    return [
        (
            F.col(f)
            if f in ("table_name", "column_name")
            else known.get(f, F.lit(None)).cast("string")
        ).alias(f)
        for f in _FIELDS
    ]


def _word_reason(is_name: Column, tail: Column) -> Column:
    side = F.when(is_name, F.lit("Name")).otherwise(F.lit("Label"))
    wording = fixed.REASON_WORD.format(on="%s", kind="%s", word="%s")
    return F.concat(F.format_string(wording, side, "match_kind", "word"), tail)


def by_system(surveys: list[Survey], columns: Open | None = None) -> DataFrame:
    """Columns that the survey platform adds by itself, ignoring case."""
    system = word_lists.system_columns(_session(surveys))
    flagged = catalog.flag_system_columns(_open_catalog(surveys, all_columns(surveys) if columns is None else columns), system)
    return flagged.select(
        _finding("system", F.lit(fixed.REASON_SYSTEM), match_kind=F.lit("strict"), matched_on=F.lit("name"))
    )


def remaining_columns(columns: Open, findings: DataFrame) -> Open:
    """The open columns that no finding names."""
    found = {(r.table_name, r.column_name) for r in findings.select("table_name", "column_name").collect()}
    return _without(columns, found)


def _without(columns: Open, found: set[tuple[str, str]]) -> Open:
    return {t: [c for c in names if (t, c) not in found] for t, names in columns.items()}


def by_name(
    surveys: list[Survey],
    columns: Open | None = None,
    with_locations: bool = True,
    dictionary: DataFrame | None = None,
    mode: str = "approx",
) -> DataFrame:
    """Columns whose name or label hits a restricted word.

    A strict hit is enough. A fuzzy hit needs sparse strings, or else many value labels. One finding
    per column: fuzzy with sparse strings before fuzzy with value labels before strict, name before
    label, then the first word from A to Z.
    """
    columns = all_columns(surveys) if columns is None else columns
    if dictionary is None:
        groups = word_lists.word_groups(_session(surveys))
        dictionary = word_lists.effective_dictionary(groups, with_locations)
    # Hits are metadata: they decide which columns are read at all. Only the first word of each
    # kind, on name and on label, can be reported: four rows per column at most.
    hit_rows = (
        catalog.match_words(_open_catalog(surveys, columns), dictionary, _labels(surveys))
        .groupBy("table_name", "column_name", "match_kind", "matched_on", "is_text")
        .agg(F.min("word").alias("word"))
        .select("table_name", "column_name", "word", "match_kind", "matched_on", "is_text")
        .collect()
    )
    hits = rows_frame(
        _session(surveys),
        [tuple(r)[:5] for r in hit_rows],
        "table_name string, column_name string, word string, match_kind string, matched_on string",
    )
    to_profile: Open = {s.name: [] for s in surveys}
    for table, column in sorted({(r[0], r[1]) for r in hit_rows if r.match_kind == "fuzzy" and r.is_text}):
        to_profile[table].append(column)
    keys = ["table_name", "column_name"]
    seen = profile.sparsity_profile({s.name: s.data for s in surveys}, to_profile, mode)
    sparse = profile.sparse_strings(seen).select(*keys, F.lit(True).alias("sparse"))
    hits = hits.join(sparse, keys, "left")
    labelled = _many_value_labels(surveys)
    if labelled is None:
        hits = hits.withColumn("n_labels", F.lit(None))
    else:
        hits = hits.join(labelled, keys, "left")
    rule = (
        F.when((F.col("match_kind") == "fuzzy") & F.col("sparse"), 1)
        .when((F.col("match_kind") == "fuzzy") & F.col("n_labels").isNotNull(), 2)
        .when(F.col("match_kind") == "strict", 3)
    )
    best = (
        hits.withColumn("rule", rule)
        .where("rule is not null")
        .groupBy(keys)
        .agg(
            F.min(
                F.struct(
                    "rule", (F.col("matched_on") == "label").alias("on_label"), "word", "match_kind", "matched_on"
                )
            ).alias("best")
        )
        .select(*keys, "best.*")
    )
    tail = (
        F.when(F.col("rule") == 1, F.lit(fixed.REASON_SPARSE_STRINGS))
        .when(F.col("rule") == 2, F.lit(fixed.REASON_VALUE_LABELS))
        .otherwise(F.lit(""))
    )
    known = {c: F.col(c) for c in ("word", "match_kind", "matched_on")}
    # A strict hit is worded as a name hit also when it was on the label.
    is_name = (F.col("matched_on") == "name") | (F.col("match_kind") == "strict")
    return best.select(_finding("name", _word_reason(is_name, tail), **known))


def by_location(
    surveys: list[Survey],
    gazetteer: DataFrame,
    country: str | None = None,
    columns: Open | None = None,
    second_source: DataFrame | None = None,
    unknown_is_low: bool = False,
) -> DataFrame:
    """Columns with a location word in name or label that hold a place of low population.

    Places are looked up once per distinct value, in the order in which the values first appear, in
    the country of the survey, or in `country` where the survey names none.
    """
    columns = all_columns(surveys) if columns is None else columns
    words = word_lists.location_dictionary(word_lists.word_groups(_session(surveys)))
    hits = catalog.match_words(_open_catalog(surveys, columns), words, _labels(surveys))
    keys = ["table_name", "column_name"]
    first_hit = F.struct("position", (F.col("matched_on") == "label").alias("on_label"), "word", "match_kind", "matched_on")
    # one row per column with a location word
    named = hits.where("is_scalar").groupBy(keys).agg(F.min(first_hit).alias("hit")).select(*keys, "hit.*").collect()
    if not named:
        return rows_frame(_session(surveys), [], FINDING_SCHEMA)
    hit_rows = rows_frame(
        _session(surveys),
        [(r.table_name, r.column_name, r.word, r.match_kind, r.matched_on) for r in named],
        "table_name string, column_name string, word string, match_kind string, matched_on string",
    )
    found = []
    for s in surveys:
        searched = [r.column_name for r in named if r.table_name == s.name]
        if not searched:
            continue
        if not s.order_by:
            raise ValueError(f"table {s.name!r} needs order_by for the location search")
        lists = profile.distinct_values_of(s.data, searched, s.order_by).select(
            F.lit(s.name).alias("table_name"), "column_name", F.col("value").alias("place"), "first_seen"
        )
        looked_up = places.place_lookup(
            lists, gazetteer, fixed.COUNTRY_ISO.get(s.country or country), second_source
        )
        found.append(
            places.first_low_population_place(
                looked_up, "first_seen", unknown_is_low=unknown_is_low, list_by=tuple(keys)
            )
        )
    low = reduce(DataFrame.unionAll, found).join(hit_rows, keys)
    known = {c: F.col(c) for c in ("word", "match_kind", "matched_on")} | {"evidence": F.col("place")}
    tail = F.concat(F.lit(fixed.REASON_LOW_POPULATION), F.col("place"))
    reason = _word_reason(F.col("matched_on") == "name", tail)
    return low.select(_finding("location", reason, **known))


def by_format(
    surveys: list[Survey], columns: Open | None = None, full_scan: bool = False
) -> DataFrame:
    """Columns with a phone or date among their first ten filled values (or anywhere).

    A column with both is reported as date.
    """
    columns = all_columns(surveys) if columns is None else columns
    open_ = [(s, columns[s.name]) for s in surveys if profile.scalar_fields(s.data, columns.get(s.name, []))]
    if not open_:
        return rows_frame(_session(surveys), [], FINDING_SCHEMA)
    if full_scan:
        shapes = _per_table((s, formats.scan_shapes(s.data, wanted)) for s, wanted in open_)
    else:
        shapes = _sampled_shapes(open_)
    shape = F.when(F.col("is_date"), "date").when(F.col("is_phone"), "phone number")
    reason = F.format_string(fixed.REASON_FORMAT.format(shape="%s"), "shape")
    return (
        shapes.withColumn("shape", shape)
        .where("shape is not null")
        .select(_finding("format", reason, evidence=F.col("shape")))
    )


def _per_table(frames) -> DataFrame:
    return reduce(
        DataFrame.unionAll, [df.select(F.lit(s.name).alias("table_name"), "*") for s, df in frames]
    )


def _sampled_shapes(open_: list[tuple[Survey, list[str]]]) -> DataFrame:
    """Shapes of the first ten values; one job for all tables, a second one for sparsely filled
    columns."""
    keys = ("table_name", "column_name")
    early = _per_table((s, formats.early_values(s.data, s.order_by, wanted)) for s, wanted in open_)
    sampled = F.when(F.col("position") <= fixed.SAMPLED_VALUES, F.col("value"))
    seen = (
        early.withColumn("filled", F.col("value").isNotNull())
        .withColumn("value", sampled)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("filled").alias("filled"), *formats.shape_tests())
        .collect()
    )
    rest = {(r.table_name, r.column_name) for r in seen if formats.needs_whole_table(r.rows, r.filled)}
    shape_rows = [(*(r[k] for k in keys), r.is_phone, r.is_date) for r in seen if (r[0], r[1]) not in rest]
    shapes = rows_frame(
        open_[0][0].data.sparkSession,
        shape_rows,
        "table_name string, column_name string, is_phone boolean, is_date boolean",
    )
    again = [(s, [c for c in wanted if (s.name, c) in rest]) for s, wanted in open_]
    late = [(s, formats.whole_table_values(s.data, s.order_by, cols)) for s, cols in again if cols]
    return shapes.unionAll(formats.sample_shapes(_per_table(late), keys)) if late else shapes


def by_sparsity(
    surveys: list[Survey],
    columns: Open | None = None,
    threshold: float = fixed.SPARSE_ENTRY_RATIO,
    mode: str = "exact",
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Columns of any type whose entries are nearly all different.

    With stored sketches (`operators.sketches.merged`), mode "approx" scans only the columns near the threshold.
    """
    columns = all_columns(surveys) if columns is None else columns
    seen = profile.sparsity_profile({s.name: s.data for s in surveys}, columns, mode, (threshold,), sketches)
    return profile.sparse(seen, threshold).select(
        _finding("sparsity", F.lit(fixed.REASON_SPARSE))
    )


def by_free_text(
    survey: Survey,
    columns: list[str],
    stopwords: DataFrame | None,
    names: DataFrame,
    gazetteer: DataFrame,
    country: str | None = None,
    mode: str = "approx",
    **lookups,
) -> tuple[list[str], DataFrame | None]:
    """The sparse text columns among `columns`, and the personal words (token, kind) in them.

    `lookups` (tags, language, second source) are passed on to `freetext.personal_tokens`.
    """
    seen = profile.sparsity_profile({survey.name: survey.data}, {survey.name: columns}, mode)
    chosen = [r.column_name for r in profile.sparse_strings(seen).select("column_name").collect()]
    if not chosen:
        return [], None
    return chosen, freetext.personal_tokens(
        survey.data, chosen, stopwords, names, gazetteer, fixed.COUNTRY_ISO.get(survey.country or country), **lookups
    )


def _batches(columns: Open):
    """Cut the open columns into groups of at most _COLUMNS_PER_JOB, tables kept together."""
    batch: Open = {}
    room = _COLUMNS_PER_JOB
    for table, names in columns.items():
        while names:
            part, names = names[:room], names[room:]
            batch.setdefault(table, []).extend(part)
            room -= len(part)
            if room == 0:
                yield batch
                batch, room = {}, _COLUMNS_PER_JOB
    if batch:
        yield batch


def searched_columns(surveys: list[Survey], exclude_system: bool = True) -> Open:
    """The columns a cascade starts from: all, or all but those of the survey platform."""
    system = set(fixed.SURVEY_SYSTEM_STRICT) if exclude_system else set()
    return {s.name: [c for c in s.data.columns if c not in system] for s in surveys}


def cascade_with_free_text(
    surveys: list[Survey],
    stopwords: DataFrame | None,
    names: DataFrame,
    gazetteer: DataFrame,
    exclude_system: bool = True,
    with_locations: bool = False,
    country: str | None = None,
    second_source: DataFrame | None = None,
    full_scan: bool = False,
    **lookups,
) -> tuple[DataFrame, dict[str, list[str]], DataFrame | None]:
    """The cascade with a search of open text as its last step instead of sparse entries.

    `with_locations` runs the population check in the cascade too. Returns the findings, the open-text
    columns of each table among the columns left, and the personal words in them (table_name, token,
    kind; see `by_free_text`).
    """
    places_too = {"gazetteer": gazetteer, "country": country, "second_source": second_source} if with_locations else {}
    findings = cascade(surveys, exclude_system, sparsity=False, full_scan=full_scan, **places_too)
    left = remaining_columns(searched_columns(surveys, exclude_system), findings)
    columns, found = {}, []
    for s in surveys:
        columns[s.name], words = by_free_text(
            s, left[s.name], stopwords, names, gazetteer, country, second_source=second_source, **lookups
        )
        if words is not None:
            found.append(words.select(F.lit(s.name).alias("table_name"), "token", "kind"))
    return findings, columns, reduce(DataFrame.unionAll, found) if found else None


# Jobs of one step that run at the same time.
_JOBS_AT_ONCE = 4


def cascade(
    surveys: list[Survey],
    exclude_system: bool = True,
    gazetteer: DataFrame | None = None,
    country: str | None = None,
    second_source: DataFrame | None = None,
    sparsity: bool = True,
    sparsity_mode: str = "approx",
    full_scan: bool = False,
) -> DataFrame:
    """Findings of all detectors: names, places (if a gazetteer is given), formats, sparse entries.

    Every column is reported at most once, by the first detector that finds it, and later detectors
    do not read it. With a gazetteer the location words leave the name detector. `sparsity=False`
    leaves out the last step, for tables whose open text is searched word by word instead.

    Names are matched once for all tables; the steps that read values take wide catalogs in batches,
    some of them at the same time.
    """
    data = {s.name: s for s in surveys}
    columns = searched_columns(surveys, exclude_system)
    named = by_name(surveys, columns, with_locations=gazetteer is None, mode=sparsity_mode)
    found: list[tuple] = [tuple(r) for r in named.collect()]
    columns = _without(columns, {(row[0], row[1]) for row in found})
    steps = []
    if gazetteer is not None:
        steps.append(lambda part, open_: by_location(part, gazetteer, country, open_, second_source))
    steps.append(lambda part, open_: by_format(part, open_, full_scan))
    if sparsity:
        steps.append(lambda part, open_: by_sparsity(part, open_, mode=sparsity_mode))
    for step in steps:
        def run(batch: Open, step=step) -> list[tuple]:
            return [tuple(r) for r in step([data[t] for t in batch], batch).collect()]

        with ThreadPoolExecutor(_JOBS_AT_ONCE) as pool:
            # each thread takes over the job settings of this one
            jobs = [pool.submit(inheritable_thread_target(_session(surveys))(run), batch) for batch in _batches(columns)]
            for job in jobs:
                found += job.result()
        columns = _without(columns, {(row[0], row[1]) for row in found})
    return rows_frame(_session(surveys), found, FINDING_SCHEMA)


def findings_view(findings: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Candidates as shown to a person: `name: label` where there is a label, and the reason."""
    label = F.when(F.col("label") != "", F.col("label"))
    return catalog.with_label(findings, labels).select(
        "table_name",
        "column_name",
        F.concat_ws(": ", "column_name", label).alias("candidate"),
        "reason",
    )


def log_messages(findings: DataFrame) -> DataFrame:
    """One line per finding for the detection log."""
    message = F.format_string("Column '%s' considered possible pii: %s", "column_name", "reason")
    return findings.select("table_name", "column_name", message.alias("message"))
