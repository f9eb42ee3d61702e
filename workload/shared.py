"""Tables, small word lists and SQL pieces that several queries use on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe import fixed_values as fixed
from hushframe.session import rows_frame
from hushframe.sources.tables import Survey

# Columns that order the rows of each table.
ORDER = {
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
    "nation": ("n_nationkey",),
    "region": ("r_regionkey",),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "pages": ("page_id",),
    "conversations": ("conv_id", "turn"),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "embeddings": ("vec_id",),
}

# Columns by table; text columns end in ":text", nested ones in ":nested".
SCHEMA = {
    "customer": "c_custkey c_name:text c_nationkey c_acctbal c_mktsegment:text",
    "supplier": "s_suppkey s_name:text s_nationkey s_acctbal",
    "part": "p_partkey p_name:text p_brand:text p_type:text p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus:text o_totalprice o_orderdate o_orderpriority:text",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount "
    "l_tax l_returnflag:text l_linestatus:text l_shipdate",
    "nation": "n_nationkey n_name:text n_regionkey",
    "region": "r_regionkey r_name:text",
    "events": "event_id ts user_id event_type:text value props:text",
    "documents": "doc_id text:text lang:text source:text n_chars",
    "pages": "page_id url:text html:text",
    "conversations": "conv_id turn role:text text:text",
    "benchmark": "item_id text:text",
    "labels": "doc_id quality toxic",
    "embeddings": "vec_id embedding:nested label",
}

# Labels for some columns: hits on the label only, an empty label, a strict hit on the label only.
LABELS = [
    ("customer", "c_nationkey", "Country of residence"),
    ("customer", "c_mktsegment", "City of the shop"),
    ("customer", "c_acctbal", ""),
    ("orders", "o_custkey", "ID"),
    ("orders", "o_orderpriority", "District"),
    ("part", "p_size", "Village size class"),
    ("part", "p_brand", "Brand"),
    ("conversations", "text", "Statement of the beneficiary"),
    ("documents", "source", "Web"),
]

SECRET_KEY = "[SECRET KEY]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, name: str) -> DataFrame:
    rows = [(column, label) for t, column, label in LABELS if t == name]
    return rows_frame(spark, rows, "column_name string, label string")


def value_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value labels from the tables themselves: nations, regions, sizes and part names."""
    parts = table(spark, sf_dir, "part")
    return (
        table(spark, sf_dir, "nation")
        .selectExpr("'c_nationkey' as column_name", "cast(n_nationkey as bigint) as code", "n_name as label")
        .unionAll(
            table(spark, sf_dir, "region").selectExpr("'n_regionkey'", "cast(r_regionkey as bigint)", "r_name")
        )
        .unionAll(
            parts.selectExpr("'p_size'", "cast(p_size as bigint)", "concat('size ', p_size)").distinct()
        )
        .unionAll(parts.selectExpr("'p_partkey'", "p_partkey", "p_name"))
    )


VALUE_LABELS_SQL = """
  SELECT 'c_nationkey' AS column_name, CAST(n_nationkey AS BIGINT) AS code, n_name AS label FROM nation
  UNION ALL SELECT 'n_regionkey', CAST(r_regionkey AS BIGINT), r_name FROM region
  UNION ALL SELECT DISTINCT 'p_size', CAST(p_size AS BIGINT), 'size ' || p_size FROM part
  UNION ALL SELECT 'p_partkey', p_partkey, p_name FROM part"""


def surveys(
    spark: SparkSession, sf_dir: str, names, with_labels: bool = False
) -> list[Survey]:
    known = value_labels(spark, sf_dir) if with_labels else None
    return [
        Survey(
            name=name,
            data=table(spark, sf_dir, name),
            labels=labels(spark, name) if with_labels else None,
            value_labels=known,
            order_by=ORDER[name],
        )
        for name in names
    ]


# ------------------------------------------------------------------------------------ SQL pieces


def quote(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def values_sql(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"


def schema_of(name: str) -> list[tuple[str, str]]:
    pairs = [(c.split(":") + ["other"])[:2] for c in SCHEMA[name].split()]
    return [(c, kind) for c, kind in pairs]


def scalar_columns(names) -> list[tuple[str, str, str]]:
    return [(t, c, kind) for t in names for c, kind in schema_of(t) if kind != "nested"]


def clean_sql(column: str, kind: str, codes=tuple(fixed.COLUMN_MISSING_CODES)) -> str:
    if kind != "text":
        return f"{column} IS NOT NULL"
    return f"{column} IS NOT NULL AND {column} <> '' AND {column} NOT IN {in_list(codes)}"


def profile_sql(names) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT {quote(t)} AS table_name, {quote(c)} AS column_name, {str(kind == 'text').lower()} AS is_text,"
        f" count(*) AS n_values, count(DISTINCT {c}) AS n_distinct FROM {t} WHERE {clean_sql(c, kind)}"
        for t, c, kind in scalar_columns(names)
    )


def catalog_sql(names) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT {quote(t)} AS table_name, column_name FROM (DESCRIBE {t})" for t in names
    )


GROUPS = [
    ("location", "strict", fixed.LOCATION_STRICT),
    ("location", "fuzzy", fixed.LOCATION_FUZZY),
    ("other", "strict", fixed.ABBREVIATION_STRICT + fixed.GUIDELINE_STRICT + fixed.SWAHILI_STRICT),
    ("other", "fuzzy", fixed.GUIDELINE_FUZZY + fixed.SPANISH_FUZZY),
]


def words_sql() -> str:
    rows = [(w, kind, group) for group, kind, words in GROUPS for w in words]
    return values_sql(rows, "word, match_kind, word_group")


def dictionary_sql(with_locations: bool) -> str:
    where = "" if with_locations else "WHERE word_group <> 'location'"
    return (
        "SELECT word, CASE WHEN bool_or(match_kind = 'fuzzy') THEN 'fuzzy' ELSE 'strict' END AS match_kind"
        f" FROM {words_sql()} {where} GROUP BY word"
    )


def hits_sql(catalog: str, dictionary: str, labelled: bool) -> str:
    """CTE body: all hits of `dictionary` on the names and labels of `catalog` (names of CTEs)."""
    lab = values_sql(LABELS, "table_name, column_name, label") if labelled else None
    sides = f"SELECT table_name, column_name, 'name' AS matched_on, column_name AS t FROM {catalog}"
    if labelled:
        sides += (
            f" UNION ALL SELECT c.table_name, c.column_name, 'label', l.label FROM {catalog} c"
            f" JOIN {lab} l ON l.table_name = c.table_name AND l.column_name = c.column_name"
        )
    return f"""SELECT s.table_name, s.column_name, d.word, d.match_kind, s.matched_on
      FROM ({sides}) s JOIN {dictionary} d
        ON (d.match_kind = 'strict' AND lower(s.t) = lower(d.word))
        OR (d.match_kind = 'fuzzy' AND contains(lower(s.t), lower(d.word)))"""


PHONE_SQL = r"^[^\n]*(?:" + "|".join(fixed.PHONE_SHAPES) + ")"
PHONE_TOKEN_SQL = "^(?:" + "|".join(fixed.PHONE_SHAPES) + ")"
DATE_SQL = "^(?:" + "|".join(fixed.DATE_SHAPES) + ")"


def sample_sql(names) -> str:
    """CTE body: the first ten values of every column."""
    parts = []
    for t, c, _ in scalar_columns(names):
        order = ", ".join(ORDER[t])
        parts.append(
            f"(SELECT {quote(t)} AS table_name, {quote(c)} AS column_name, CAST({c} AS VARCHAR) AS v,"
            f" row_number() OVER (ORDER BY {order}) AS position FROM {t}"
            f" WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' ORDER BY {order} LIMIT 10)"
        )
    return "\n  UNION ALL ".join(parts)


def shapes_sql(values: str) -> str:
    return (
        f"SELECT table_name, column_name, bool_or(regexp_matches(v, {quote(PHONE_SQL)})) AS is_phone,"
        f" bool_or(regexp_matches(v, {quote(DATE_SQL)})) AS is_date FROM {values} GROUP BY ALL"
    )


def findings_ctes(names, with_labels: bool = False, with_locations: bool = True) -> str:
    """CTEs `by_name`, `by_format`, `by_sparsity` and `findings` (the cascade) for some tables."""
    reason = "format('{} had {} match with restricted word ''{}''{}', "
    return f"""
dictionary AS ({dictionary_sql(with_locations)}),
columns_ AS ({catalog_sql(names)}),
profile AS ({profile_sql(names)}),
hits AS ({hits_sql("columns_", "dictionary", with_labels)}),
value_labels AS ({VALUE_LABELS_SQL}),
many AS (SELECT column_name, count(*) AS n_labels FROM value_labels GROUP BY ALL HAVING count(*) > 10),
ruled AS (
  SELECT h.*, CASE
      WHEN h.match_kind = 'fuzzy' AND p.is_text AND p.n_values > 0 AND p.n_distinct / p.n_values > 0.2 THEN 1
      WHEN h.match_kind = 'fuzzy' AND {str(with_labels).lower()} AND m.n_labels IS NOT NULL THEN 2
      WHEN h.match_kind = 'strict' THEN 3 END AS rule
  FROM hits h LEFT JOIN profile p USING (table_name, column_name) LEFT JOIN many m USING (column_name)),
by_name AS (
  SELECT table_name, column_name, 'name' AS method, word, match_kind, matched_on, NULL::VARCHAR AS evidence,
    {reason}CASE WHEN rule = 3 OR matched_on = 'name' THEN 'Name' ELSE 'Label' END, match_kind, word,
      CASE rule WHEN 1 THEN ' and has sufficiently sparse strings'
                WHEN 2 THEN ' and values labels are sparse' ELSE '' END) AS reason
  FROM ruled WHERE rule IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY table_name, column_name
                             ORDER BY rule, matched_on DESC, word) = 1),
sample AS ({sample_sql(names)}),
shapes AS ({shapes_sql("sample")}),
by_format AS (
  SELECT table_name, column_name, 'format' AS method, NULL::VARCHAR AS word, NULL::VARCHAR AS match_kind,
    NULL::VARCHAR AS matched_on, CASE WHEN is_date THEN 'date' ELSE 'phone number' END AS evidence,
    'Column entries have ' || CASE WHEN is_date THEN 'date' ELSE 'phone number' END || ' format' AS reason
  FROM shapes WHERE is_date OR is_phone),
by_sparsity AS (
  SELECT table_name, column_name, 'sparsity' AS method, NULL::VARCHAR AS word, NULL::VARCHAR AS match_kind,
    NULL::VARCHAR AS matched_on, NULL::VARCHAR AS evidence, 'Column entries are too sparse' AS reason
  FROM profile WHERE n_values > 0 AND n_distinct / n_values > 0.3),
findings AS (
  SELECT * EXCLUDE (priority) FROM (
    SELECT *, 1 AS priority FROM by_name UNION ALL SELECT *, 2 FROM by_format
    UNION ALL SELECT *, 3 FROM by_sparsity)
  QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY priority) = 1)"""
