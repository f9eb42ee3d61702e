"""Queries on finding columns: words, profiles, shapes, cascade, plan, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hushframe import fixed_values as fixed
from hushframe import sinks
from hushframe.operators import catalog, evaluate, formats, profile, sketches
from hushframe.plans import actions, detect
from hushframe.session import rows_frame, shared_folder
from hushframe.sources import words
from hushframe.sources.tables import Survey
from workload.shared import (
    LABELS,
    ORDER,
    SCHEMA,
    VALUE_LABELS_SQL,
    catalog_sql,
    dictionary_sql,
    findings_ctes,
    hits_sql,
    in_list,
    profile_sql,
    quote,
    sample_sql,
    scalar_columns,
    shapes_sql,
    surveys,
    table,
    value_labels,
    values_sql,
)

ALL = tuple(SCHEMA)
PROFILED = ("customer", "orders", "part", "documents")
SHAPED = ("customer", "orders", "events", "documents", "pages")
CASCADED = ("customer", "supplier", "part", "orders", "events", "conversations")
SMALL = ("customer", "orders", "pages")

LAB_SCHEMA = "table_name string, column_name string, label string"


def _data(spark, sf_dir, names):
    return {name: table(spark, sf_dir, name) for name in names}


# ------------------------------------------------------------------------------------ words


def _hits_with_counts(spark, sf_dir, keep, with_labels=False):
    """Word hits of the columns of all tables, with the number of values each column holds."""
    data = _data(spark, sf_dir, ALL)
    dictionary = words.effective_dictionary(words.word_groups(spark), with_locations=True)
    lab = rows_frame(spark, LABELS, LAB_SCHEMA) if with_labels else None
    hits = catalog.match_words(catalog.column_catalog(data), dictionary, lab).where(keep)
    hit_columns = {name: [] for name in ALL}
    for row in hits.select("table_name", "column_name").distinct().collect():
        hit_columns[row.table_name].append(row.column_name)
    counts = profile.value_counts(data, hit_columns)
    keys = ["table_name", "column_name"]
    return hits.join(counts, keys).select(*keys, "word", "match_kind", "n_values")


def name_strict(spark, sf_dir):
    return _hits_with_counts(spark, sf_dir, "match_kind = 'strict'")


def name_fuzzy(spark, sf_dir):
    return _hits_with_counts(spark, sf_dir, "match_kind = 'fuzzy'")


def label_match(spark, sf_dir):
    return _hits_with_counts(spark, sf_dir, "matched_on = 'label'", with_labels=True)


def hits_query_sql(keep: str, labelled: bool = False) -> str:
    return f"""
WITH dictionary AS ({dictionary_sql(True)}), columns_ AS ({catalog_sql(ALL)}),
hits AS ({hits_sql("columns_", "dictionary", labelled)}), profile AS ({profile_sql(ALL)})
SELECT h.table_name, h.column_name, h.word, h.match_kind, p.n_values
FROM hits h JOIN profile p USING (table_name, column_name) WHERE {keep}"""


# A survey export made from the events: platform columns, two of them in other letter case.
SYSTEM_NAMES = {
    "event_id": "key",
    "ts": "starttime",
    "user_id": "CaseID",
    "event_type": "text_audit",
    "value": "answer",
    "props": "Call_Log",
}


def survey_export(spark, sf_dir):
    return table(spark, sf_dir, "events").select([F.col(c).alias(n) for c, n in SYSTEM_NAMES.items()])


def _system(spark, sf_dir, match):
    data = {"export": survey_export(spark, sf_dir)}
    columns = match(catalog.column_catalog(data), words.system_columns(spark)).select("column_name")
    left = [r.column_name for r in columns.collect()]
    return profile.value_counts(data, {"export": left}).select("column_name", "n_values")


def exclude_system_columns(spark, sf_dir):
    return _system(spark, sf_dir, catalog.exclude_system_columns)


def flag_system_columns(spark, sf_dir):
    counts = _system(spark, sf_dir, catalog.flag_system_columns)
    found = detect.by_system([Survey("export", survey_export(spark, sf_dir))])
    return counts.join(found.select("column_name", "reason"), "column_name")


_EXPORT_KINDS = {"event_type": "text", "props": "text"}
_EXPORT_SQL = " UNION ALL ".join(
    f"SELECT {quote(n)} AS column_name, count(*) AS n_values FROM events WHERE {c} IS NOT NULL"
    + (f" AND {c} <> '' AND {c} NOT IN {in_list(fixed.COLUMN_MISSING_CODES)}" if c in _EXPORT_KINDS else "")
    for c, n in SYSTEM_NAMES.items()
)
_SYSTEM_LIST = in_list(fixed.SURVEY_SYSTEM_STRICT)

# ------------------------------------------------------------------------------------ profiles


def sparsity_profile(spark, sf_dir):
    return profile.sparsity_profile(_data(spark, sf_dir, PROFILED))


def sparse_strings(spark, sf_dir):
    seen = profile.sparsity_profile(_data(spark, sf_dir, PROFILED))
    return profile.sparse_strings(seen).select("table_name", "column_name", "ratio")


def value_label_cardinality(spark, sf_dir):
    return profile.many_value_labels(value_labels(spark, sf_dir))


def detect_by_sparsity(spark, sf_dir):
    return detect.by_sparsity(surveys(spark, sf_dir, ALL))


def detect_by_sparsity_approximate(spark, sf_dir):
    return detect.by_sparsity(surveys(spark, sf_dir, PROFILED), mode="approx")


def detect_by_sparsity_merged(spark, sf_dir):
    """Each table arrives in two parts that are sketched and stored on their own; one part is written twice."""
    found = surveys(spark, sf_dir, PROFILED)
    folder = f"{shared_folder(spark).rstrip('/')}/sketches-{uuid.uuid4().hex[:12]}"
    for part in (0, 1, 0):
        halves = {s.name: s.data.where(F.pmod(F.xxhash64(*s.order_by), F.lit(2)) == part) for s in found}
        stored = sinks.write_sketches(sketches.column_sketches(halves, part=str(part)), folder)
    return detect.by_sparsity(found, mode="approx", sketches=sketches.merged(stored))


def distinct_values(spark, sf_dir):
    """Distinct answers of a column with the key of the first row that holds them."""
    found = profile.distinct_values(table(spark, sf_dir, "events"), "props", ("event_id",))
    return found.select("value", F.col("first_seen.event_id").alias("first_seen"))


# ------------------------------------------------------------------------------------ shapes


def format_sample(spark, sf_dir):
    sample = formats.first_values(table(spark, sf_dir, "orders"), ORDER["orders"])
    return sample.withColumn("position", F.col("position").cast("bigint"))


def _sparse_orders(spark, sf_dir):
    """Orders with two columns that are filled in one row of a hundred."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", *[f"CASE WHEN o_orderkey % 100 = {k} THEN {v} END AS {c}" for c, k, v in SPARSE_COLUMNS]
    )


SPARSE_COLUMNS = [("note", 7, "o_orderpriority"), ("answered", 42, "CAST(o_orderkey AS STRING)")]


def format_sample_sparse(spark, sf_dir):
    sample = formats.first_values(_sparse_orders(spark, sf_dir), ("o_orderkey",), [c for c, _, _ in SPARSE_COLUMNS])
    return sample.withColumn("position", F.col("position").cast("bigint"))


_SPARSE_SQL = " UNION ALL ".join(
    f"(SELECT {quote(c)} AS column_name, row_number() OVER (ORDER BY o_orderkey) AS position, {v} AS value"
    f" FROM orders WHERE o_orderkey % 100 = {k} ORDER BY o_orderkey LIMIT 10)"
    for c, k, v in SPARSE_COLUMNS
).replace("AS STRING", "AS VARCHAR")


def format_flags(spark, sf_dir):
    parts = [
        formats.sample_shapes(formats.first_values(s.data, s.order_by)).select(
            F.lit(s.name).alias("table_name"), "*"
        )
        for s in surveys(spark, sf_dir, SHAPED)
    ]
    return _union(parts)


def format_flags_full_scan(spark, sf_dir):
    parts = [
        formats.scan_shapes(s.data).select(F.lit(s.name).alias("table_name"), "*")
        for s in surveys(spark, sf_dir, SHAPED)
    ]
    return _union(parts)


def _union(parts):
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def detect_by_format(spark, sf_dir):
    return detect.by_format(surveys(spark, sf_dir, SHAPED))


def detect_by_format_full_scan(spark, sf_dir):
    return detect.by_format(surveys(spark, sf_dir, SHAPED), full_scan=True)


_ALL_VALUES = " UNION ALL ".join(
    f"SELECT {quote(t)} AS table_name, {quote(c)} AS column_name, CAST({c} AS VARCHAR) AS v FROM {t}"
    f" WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''"
    for t, c, _ in scalar_columns(SHAPED)
)


def _format_findings_sql(values: str) -> str:
    return f"""
WITH v AS ({values}), shapes AS ({shapes_sql("v")})
SELECT table_name, column_name, 'format' AS method, NULL::VARCHAR AS word, NULL::VARCHAR AS match_kind,
  NULL::VARCHAR AS matched_on, CASE WHEN is_date THEN 'date' ELSE 'phone number' END AS evidence,
  'Column entries have ' || CASE WHEN is_date THEN 'date' ELSE 'phone number' END || ' format' AS reason
FROM shapes WHERE is_date OR is_phone"""


# ------------------------------------------------------------------------------------ detectors


def detect_by_name(spark, sf_dir):
    return detect.by_name(surveys(spark, sf_dir, ALL, with_labels=True))


def detect_by_name_without_locations(spark, sf_dir):
    return detect.by_name(surveys(spark, sf_dir, ALL, with_labels=True), with_locations=False)


def cascade(spark, sf_dir):
    return detect.cascade(surveys(spark, sf_dir, CASCADED))


def cascade_without_sparsity(spark, sf_dir):
    """The cascade of a run that searches open text word by word instead of by sparsity."""
    return detect.cascade(surveys(spark, sf_dir, SMALL), sparsity=False)


def catalog_scan(spark, sf_dir):
    return detect.cascade(surveys(spark, sf_dir, ALL, with_labels=True))


def findings_view(spark, sf_dir):
    findings = detect.cascade(surveys(spark, sf_dir, ("customer", "part"), with_labels=True))
    return detect.findings_view(findings, rows_frame(spark, LABELS, LAB_SCHEMA))


def findings_log(spark, sf_dir):
    return detect.log_messages(detect.cascade(surveys(spark, sf_dir, SMALL)))


def findings_log_retried(spark, sf_dir):
    """The log of two runs, the first of which was retried after it had logged a part and then all of its lines."""
    findings = detect.cascade(surveys(spark, sf_dir, SMALL))
    log = f"{shared_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex[:12]}"
    for run, lines in (("a", findings.where("table_name = 'pages'")), ("a", findings), ("a", findings), ("b", findings)):
        sinks.append_log(lines, log, ["customer: Dropped columns: c_name"], run_id=run)
    return sinks.read_log(spark, log)


OVERRIDES = [
    ("customer", "c_name", "Encode"),
    ("customer", "c_acctbal", "Keep"),
    ("orders", "o_totalprice", "Encode"),
    ("pages", "url", "Drop"),
    ("pages", "unknown", "Keep"),
]
TRUTH = [
    ("customer", "c_name"),
    ("customer", "c_mktsegment"),
    ("orders", "o_orderdate"),
    ("orders", "O_CUSTKEY"),
    ("pages", "html"),
]


def action_plan(spark, sf_dir):
    findings = detect.cascade(surveys(spark, sf_dir, SMALL))
    overrides = rows_frame(spark, OVERRIDES, "table_name string, column_name string, action string")
    return actions.action_plan(findings, overrides)


def plan_report(spark, sf_dir):
    return actions.plan_report(action_plan(spark, sf_dir))


def evaluate_findings(spark, sf_dir):
    findings = detect.cascade(surveys(spark, sf_dir, SMALL))
    return evaluate.evaluate(findings, rows_frame(spark, TRUTH, "table_name string, column_name string"))


_SMALL = findings_ctes(SMALL)
_PLAN_SQL = f"""plan AS (
  SELECT f.table_name, f.column_name, coalesce(o.action, 'Drop') AS action FROM findings f
  LEFT JOIN {values_sql(OVERRIDES, "table_name, column_name, action")} o
    ON o.table_name = f.table_name AND o.column_name = f.column_name)"""
_TRUTH_SQL = values_sql(TRUTH, "table_name, column_name")

ENTRIES = {
    "name_strict": (name_strict, hits_query_sql("h.match_kind = 'strict'")),
    "name_fuzzy": (name_fuzzy, hits_query_sql("h.match_kind = 'fuzzy'")),
    "label_match": (label_match, hits_query_sql("h.matched_on = 'label'", labelled=True)),
    "exclude_system_columns": (
        exclude_system_columns,
        f"SELECT * FROM ({_EXPORT_SQL}) WHERE column_name NOT IN {_SYSTEM_LIST}",
    ),
    "flag_system_columns": (
        flag_system_columns,
        f"SELECT *, {quote(fixed.REASON_SYSTEM)} AS reason FROM ({_EXPORT_SQL})"
        f" WHERE lower(column_name) IN {_SYSTEM_LIST}",
    ),
    "sparsity_profile": (
        sparsity_profile,
        f"SELECT *, n_distinct / nullif(n_values, 0) AS ratio FROM ({profile_sql(PROFILED)})",
    ),
    "sparse_strings": (
        sparse_strings,
        f"SELECT table_name, column_name, n_distinct / n_values AS ratio FROM ({profile_sql(PROFILED)})"
        " WHERE is_text AND n_values > 0 AND n_distinct / n_values > 0.2",
    ),
    "value_label_cardinality": (
        value_label_cardinality,
        f"SELECT column_name, count(*) AS n_labels FROM ({VALUE_LABELS_SQL}) GROUP BY 1 HAVING count(*) > 10",
    ),
    "distinct_values": (
        distinct_values,
        "SELECT props AS value, min(event_id) AS first_seen FROM events WHERE props IS NOT NULL"
        f" AND props <> '' AND props NOT IN {in_list(fixed.COLUMN_MISSING_CODES)} GROUP BY 1",
    ),
    "detect_by_sparsity": (
        detect_by_sparsity,
        f"WITH {findings_ctes(ALL)} SELECT * FROM by_sparsity",
    ),
    "detect_by_sparsity_merged": (
        detect_by_sparsity_merged,
        f"WITH {findings_ctes(PROFILED)} SELECT * FROM by_sparsity",
    ),
    "detect_by_sparsity_approximate": (
        detect_by_sparsity_approximate,
        f"WITH {findings_ctes(PROFILED)} SELECT * FROM by_sparsity",
    ),
    "format_sample": (
        format_sample,
        f"SELECT column_name, position, v AS value FROM ({sample_sql(('orders',))})",
    ),
    "format_sample_sparse": (format_sample_sparse, _SPARSE_SQL),
    "format_flags": (
        format_flags,
        f"WITH sample AS ({sample_sql(SHAPED)}) {shapes_sql('sample')}",
    ),
    "format_flags_full_scan": (
        format_flags_full_scan,
        f"WITH v AS ({_ALL_VALUES}) {shapes_sql('v')}",
    ),
    "detect_by_format": (detect_by_format, _format_findings_sql(sample_sql(SHAPED))),
    "detect_by_format_full_scan": (detect_by_format_full_scan, _format_findings_sql(_ALL_VALUES)),
    "detect_by_name": (
        detect_by_name,
        f"WITH {findings_ctes(ALL, with_labels=True)} SELECT * FROM by_name",
    ),
    "detect_by_name_without_locations": (
        detect_by_name_without_locations,
        f"WITH {findings_ctes(ALL, with_labels=True, with_locations=False)} SELECT * FROM by_name",
    ),
    "cascade": (cascade, f"WITH {findings_ctes(CASCADED)} SELECT * FROM findings"),
    "cascade_without_sparsity": (
        cascade_without_sparsity,
        f"WITH {_SMALL} SELECT * FROM findings WHERE method <> 'sparsity'",
    ),
    "catalog_scan": (catalog_scan, f"WITH {findings_ctes(ALL, with_labels=True)} SELECT * FROM findings"),
    "findings_view": (
        findings_view,
        f"""WITH {findings_ctes(("customer", "part"), with_labels=True)}
SELECT f.table_name, f.column_name, f.reason,
  f.column_name || CASE WHEN coalesce(l.label, '') = '' THEN '' ELSE ': ' || l.label END AS candidate
FROM findings f LEFT JOIN {values_sql(LABELS, "table_name, column_name, label")} l
  ON l.table_name = f.table_name AND l.column_name = f.column_name""",
    ),
    "findings_log": (
        findings_log,
        f"""WITH {_SMALL} SELECT table_name, column_name,
  'Column ''' || column_name || ''' considered possible pii: ' || reason AS message FROM findings""",
    ),
    "findings_log_retried": (
        findings_log_retried,
        f"""WITH {_SMALL}, lines AS (
  SELECT table_name || ': Column ''' || column_name || ''' considered possible pii: ' || reason AS line FROM findings
  UNION ALL SELECT 'customer: Dropped columns: c_name')
SELECT run, line FROM lines, (VALUES ('a'), ('b')) r(run)""",
    ),
    "action_plan": (action_plan, f"WITH {_SMALL}, {_PLAN_SQL} SELECT * FROM plan"),
    "plan_report": (
        plan_report,
        f"""WITH {_SMALL}, {_PLAN_SQL}
SELECT table_name, action, 'Columns to ' || lower(action) || ': '
  || string_agg(column_name, ' ' ORDER BY column_name) AS line
FROM plan WHERE action <> 'Keep' GROUP BY table_name, action""",
    ),
    "evaluate": (
        evaluate_findings,
        f"""WITH {_SMALL}
SELECT f.table_name, f.column_name, 'wrongly detected' AS outcome FROM findings f
  ANTI JOIN {_TRUTH_SQL} t ON t.table_name = f.table_name AND t.column_name = f.column_name
UNION ALL SELECT t.table_name, t.column_name, 'not detected' FROM {_TRUTH_SQL} t
  ANTI JOIN findings f ON t.table_name = f.table_name AND t.column_name = f.column_name""",
    ),
}
