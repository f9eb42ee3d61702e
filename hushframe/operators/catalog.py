"""Column catalogs, and matching column names and labels against word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.values import is_scalar, is_text
from hushframe.session import rows_frame

CATALOG_SCHEMA = "table_name string, column_name string, is_text boolean, is_scalar boolean, ordinal int"


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of every table, taken from the schemas only."""
    rows = [
        (table, f.name, is_text(f), is_scalar(f), i)
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return rows_frame(next(iter(tables.values())).sparkSession, rows, CATALOG_SCHEMA)


def with_label(columns: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Add each column's label; empty where there is none. Several labels are joined by ` / `.

    Labels carry `table_name` when they describe several tables.
    """
    if labels is None:
        return columns.withColumn("label", F.lit(""))
    keys = [k for k in ("table_name", "column_name") if k in labels.columns]
    one = labels.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("label")), " / ").alias("label"))
    return columns.join(one, keys, "left").withColumn("label", F.coalesce("label", F.lit("")))


def match_words(columns: DataFrame, dictionary: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """All (column, word) hits, on the name and on each label, ignoring case.

    A strict word equals the name or label, a fuzzy word occurs inside it. Each text is cut into its
    substrings up to the longest word, which makes containment an equi-join on the word: no nested
    loop over columns and words, however many there are of either.
    """
    longest = dictionary.agg(F.max(F.char_length("word")).alias("n")).scalar()
    texts = columns.withColumns({"matched_on": F.lit("name"), "text": F.lower("column_name")})
    if labels is not None:
        keys = [k for k in ("table_name", "column_name") if k in labels.columns]
        each = labels.select(*keys, F.lower("label").alias("text")).distinct()
        texts = texts.unionByName(columns.join(each, keys).withColumn("matched_on", F.lit("label")))
    texts = texts.where("text <> ''").withColumn("longest", longest)
    substrings = F.expr(
        """array_distinct(flatten(transform(
             sequence(1, char_length(text)),
             i -> transform(sequence(1, least(longest, char_length(text) - i + 1)),
                            n -> substring(text, i, n)))))"""
    )
    pieces = texts.withColumn("piece", F.explode(substrings)).drop("longest")
    words = dictionary.where("word <> ''").withColumn("piece", F.lower("word"))
    return (
        pieces.join(words, "piece")
        .where("match_kind = 'fuzzy' or piece = text")
        .drop("piece", "text")
        .distinct()
    )


def exclude_system_columns(columns: DataFrame, system: DataFrame) -> DataFrame:
    """Columns without those that the survey platform adds; the comparison is exact."""
    return columns.join(system, "column_name", "left_anti")


def flag_system_columns(columns: DataFrame, system: DataFrame) -> DataFrame:
    """The columns that the survey platform adds, ignoring case."""
    names = system.select(F.lower("column_name").alias("system_name"))
    return columns.join(names, F.lower("column_name") == F.col("system_name"), "left_semi")
