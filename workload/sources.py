"""Queries on reading, labels, word lists and countries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hushframe import fixed_values as fixed
from hushframe.operators import profile
from hushframe.session import rows_frame, shared_folder
from hushframe.sources import registries, tables, words
from workload.shared import (
    LABELS,
    clean_sql,
    in_list,
    VALUE_LABELS_SQL,
    labels,
    profile_sql,
    quote,
    table,
    value_labels,
    values_sql,
    words_sql,
)

# A survey answer made from the customer key: codes, empty, null, NA spellings, ordinary answers.
ANSWER = """CASE c_custkey % 10 WHEN 0 THEN '-999' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '777'
  WHEN 4 THEN '-888' WHEN 5 THEN 'NA' WHEN 6 THEN 'n/a' ELSE c_mktsegment END"""


def answers(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"{ANSWER} as answer")


ANSWERS_SQL = f"(SELECT c_custkey AS id, {ANSWER} AS answer FROM customer)"


def read_normalised(spark, sf_dir):
    return tables.typed(answers(spark, sf_dir))


def read_typed(spark, sf_dir):
    """Customers and orders as flat files hold them: all text, some cells with NA spellings."""
    parts = []
    for name, key, amount, word in FLAT:
        flat = table(spark, sf_dir, name).selectExpr(
            f"'{name}' as source",
            f"cast({key} as string) as key",
            f"case {key} % 4 when 0 then 'NA' when 1 then '' else cast({amount} as string) end as amount",
            f"case {key} % 3 when 0 then 'n/a' else {word} end as word",
        )
        parts.append(tables.typed(flat))
    return parts[0].unionAll(parts[1])


FLAT = [("customer", "c_custkey", "c_acctbal", "c_mktsegment"), ("orders", "o_orderkey", "o_totalprice", "o_orderpriority")]
_TYPED_SQL = " UNION ALL ".join(
    f"SELECT {quote(name)} AS source, {key} AS key, CASE WHEN {key} % 4 > 1 THEN {amount} END AS amount,"
    f" CASE WHEN {key} % 3 > 0 THEN {word} END AS word FROM {name}"
    for name, key, amount, word in FLAT
)


def _written(df, name):
    """The table as CSV files in a folder of their own."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}.csv"
    df.write.option("header", True).option("escape", '"').csv(folder)
    return folder


def read_quoted_csv(spark, sf_dir):
    """Documents, whose texts hold line breaks and quotes, written as CSV and read by the parity of quotes."""
    data = table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit('\n"'), "lang", F.lit('"')))
    return tables.read_table(spark, _written(data, "documents"), split=True)


def read_bundle(spark, sf_dir):
    """A survey read from three CSV files: per column its values, its label and its number of value labels."""
    survey = tables.read_survey(
        spark,
        _written(table(spark, sf_dir, "customer"), "customer"),
        _written(labels(spark, "customer"), "labels"),
        _written(value_labels(spark, sf_dir), "value-labels"),
        ("c_custkey",),
        split=True,
    )
    counts = survey.value_labels.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_value_labels"))
    per_column = profile.value_counts({"customer": survey.data}).drop("table_name")
    return per_column.join(survey.labels, "column_name", "left").join(counts, "column_name", "left")


_CUSTOMER_LABELS = values_sql([(c, label) for t, c, label in LABELS if t == "customer"], "column_name, label")
READ_BUNDLE_SQL = f"""
SELECT p.column_name, p.n_values, nullif(l.label, '') AS label, v.n AS n_value_labels FROM ({profile_sql(("customer",))}) p
LEFT JOIN {_CUSTOMER_LABELS} l USING (column_name)
LEFT JOIN (SELECT column_name, count(*) AS n FROM ({VALUE_LABELS_SQL}) GROUP BY column_name) v USING (column_name)"""


def clean_values(spark, sf_dir):
    return profile.clean_values(answers(spark, sf_dir), "answer")


def clean_free_text_values(spark, sf_dir):
    return profile.clean_values(answers(spark, sf_dir), "answer", fixed.TEXT_MISSING_CODES)


LABELLED = ("customer", "orders", "part", "conversations", "documents")


def labels_attach(spark, sf_dir):
    data, found = {}, []
    for name in LABELLED:
        data[name] = tables.attach_labels(table(spark, sf_dir, name), labels(spark, name))
        found += [(name, c, text) for c, text in tables.labels_in_schema(data[name].schema).items()]
    attached = rows_frame(spark, found, "table_name string, column_name string, label string")
    return profile.value_counts(data).join(attached, ["table_name", "column_name"], "left")


LABELS_ATTACH_SQL = f"""
SELECT p.table_name, p.column_name, p.n_values, l.label
FROM ({profile_sql(LABELLED)}) p
LEFT JOIN {values_sql(LABELS, "table_name, column_name, label")} l
  ON l.table_name = p.table_name AND l.column_name = p.column_name"""


def dictionary_effective(spark, sf_dir):
    """Built-in words and words that a caller adds, here the part types."""
    own = table(spark, sf_dir, "part").selectExpr(
        "lower(p_type) as word",
        "case when p_size > 25 then 'fuzzy' else 'strict' end as match_kind",
        "'caller' as word_group",
        "1000 as position",
    )
    groups = words.word_groups(spark).unionByName(own)
    both = [
        words.effective_dictionary(groups, flag).select(
            F.lit(flag).alias("with_locations"), "word", "match_kind"
        )
        for flag in (True, False)
    ]
    return both[0].unionByName(both[1])


DICTIONARY_SQL = f"""
WITH groups_ AS (
  SELECT * FROM {words_sql()}
  UNION ALL SELECT lower(p_type), CASE WHEN p_size > 25 THEN 'fuzzy' ELSE 'strict' END, 'caller' FROM part),
flags AS (SELECT * FROM (VALUES (true), (false)) AS f(with_locations))
SELECT with_locations, word,
  CASE WHEN bool_or(match_kind = 'fuzzy') THEN 'fuzzy' ELSE 'strict' END AS match_kind
FROM groups_ JOIN flags ON with_locations OR word_group <> 'location' GROUP BY ALL"""

# A few stop words per language; 'die', 'de' and 'la' stand in several, 'The' differs by case.
STOP = [
    (language, word)
    for language, listed in {
        "english": "the The and that for with this from was are by of die",
        "spanish": "que los las del de la en",
        "french": "des les une pour qui de la",
        "german": "der die und den von das mit auf sich",
    }.items()
    for word in listed.split()
]


def stopwords(spark):
    return rows_frame(spark, STOP, "language string, word string")


STOP_SQL = values_sql(STOP, "language, word")


def _stored_stopwords(spark):
    """The lists written as a folder per language, and read by the loader."""
    folder = f"{shared_folder(spark).rstrip('/')}/stop-{uuid.uuid4().hex[:12]}"
    for language in sorted({x for x, _ in STOP}):
        one = stopwords(spark).where(F.col("language") == language).select("word")
        one.coalesce(1).write.text(f"{folder}/{language}")
    return words.read_stopwords(spark, folder)


def stopwords_by_language(spark, sf_dir):
    """How much of each document language's text the stop words of each list cover."""
    said = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", " ")).alias("word"))
    return (
        said.join(_stored_stopwords(spark), "word")
        .groupBy("lang", "language", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("lang", "language")
        .agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_tokens"))
    )


STOPWORDS_SQL = f"""
SELECT lang, language, count(DISTINCT d.word) AS n_words, CAST(count(*) AS BIGINT) AS n_tokens
FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) d
JOIN {STOP_SQL} s ON s.word = d.word GROUP BY lang, language"""

COUNTRIES = sorted(fixed.COUNTRY_ISO) + ["Freedonia", "Sylvania", "mexico", "Other"]


def country_iso(spark, sf_dir):
    country = F.try_element_at(F.array(*[F.lit(c) for c in COUNTRIES]), F.col("c_nationkey") + 1)
    return (
        table(spark, sf_dir, "customer")
        .groupBy(country.alias("country"))
        .agg(F.count(F.lit(1)).alias("n_customers"))
        .withColumn("iso", registries.country_iso(F.col("country")))
    )


COUNTRY_SQL = f"""
SELECT country, iso, n_customers FROM (
  SELECT [{", ".join(quote(c) for c in COUNTRIES)}][c_nationkey + 1] AS country, count(*) AS n_customers
  FROM customer GROUP BY 1) c
LEFT JOIN {values_sql(fixed.COUNTRY_ISO.items(), "name, iso")} i ON i.name = c.country"""

ENTRIES = {
    "read_typed": (read_typed, _TYPED_SQL),
    "read_normalised": (
        read_normalised,
        f"SELECT id, CASE WHEN answer IN {in_list(fixed.NA_SPELLINGS)} THEN NULL ELSE answer END AS answer"
        f" FROM {ANSWERS_SQL}",
    ),
    "read_quoted_csv": (
        read_quoted_csv,
        "SELECT doc_id, text || chr(10) || '\"' || lang || '\"' AS text, lang, source, n_chars FROM documents",
    ),
    "read_bundle": (read_bundle, READ_BUNDLE_SQL),
    "clean_values": (
        clean_values,
        f"SELECT id, answer FROM {ANSWERS_SQL} WHERE {clean_sql('answer', 'text')}",
    ),
    "clean_free_text_values": (
        clean_free_text_values,
        f"SELECT id, answer FROM {ANSWERS_SQL}"
        f" WHERE {clean_sql('answer', 'text', fixed.TEXT_MISSING_CODES)}",
    ),
    "labels_attach": (labels_attach, LABELS_ATTACH_SQL),
    "dictionary_effective": (dictionary_effective, DICTIONARY_SQL),
    "stopwords_by_language": (stopwords_by_language, STOPWORDS_SQL),
    "country_iso": (country_iso, COUNTRY_SQL),
}
