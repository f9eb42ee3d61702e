"""Reading survey tables, variable labels and value labels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.fixed_values import NA_SPELLINGS
from hushframe.functions.values import is_text, quoted
from hushframe.sources import quoted_csv

FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json", "orc": "orc"}


@dataclass(frozen=True)
class Survey:
    """One table with everything the detectors may use.

    `labels(column_name, label)` and `value_labels(column_name, code, label)` are optional.
    `order_by` names the columns that put the rows in file order; they must identify a row.
    `data` should be a stored table: detectors read it column by column, several times. `country`
    is where its places lie, for the population check.
    """

    name: str
    data: DataFrame
    labels: DataFrame | None = None
    value_labels: DataFrame | None = None
    order_by: tuple[str, ...] = field(default=())
    country: str | None = None


def read_table(
    spark: SparkSession,
    path: str,
    file_format: str | None = None,
    multi_line: bool = True,
    stored: str | None = None,
    split: bool = False,
) -> DataFrame:
    """Read a table by its file ending (or by `file_format` for folders without one).

    Spark's reader takes a CSV file whose quotes hold line breaks in one task. `split=True` reads large files
    in many tasks by the parity of their quotes (`quoted_csv`); `multi_line=False` is for files without
    line breaks in quotes. `stored` names a folder of the caller's, a protected one, for a CSV file that is read often:
    it is parsed once, written there as Parquet, and read from there.
    """
    ending = file_format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in FORMATS:
        raise ValueError(f"unsupported file type {ending!r}; supported: {', '.join(sorted(FORMATS))}")
    if ending != "csv":
        return spark.read.format(FORMATS[ending]).load(path)
    raw = quoted_csv.read(spark, path) if split else spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    if stored is not None:
        raw.write.mode("overwrite").parquet(stored)
        raw = spark.read.schema(raw.schema).parquet(stored)
    return typed(raw)


def typed(df: DataFrame) -> DataFrame:
    """Text columns with the NA spellings as null, typed as whole number, number or text.

    Types are decided over all rows, in one pass: Spark's own inference would take one null spelling
    only and would turn dates into timestamps, which flat-file readers leave as text.
    """
    text = null_spellings(df)
    names = [f.name for f in text.schema.fields if is_text(f)]
    if not names:
        return text
    facts = []
    for i, name in enumerate(names):
        value = quoted(name)
        number = value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
        digits = value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("bigint").isNotNull()
        whole = F.when(value.isNotNull(), digits)
        facts += [
            F.bool_and(number).alias(f"number_{i}"),
            F.bool_and(whole).alias(f"whole_{i}"),
        ]
    decided = text.agg(*facts).first()
    kinds = {n: "bigint" if decided[f"whole_{i}"] else "double" if decided[f"number_{i}"] else "" for i, n in enumerate(names)}
    cells = []
    for f in text.schema.fields:
        value = quoted(f.name)
        if kinds.get(f.name):
            value = F.trim(value).cast(kinds[f.name]).alias(f.name, metadata=f.metadata)
        cells.append(value)
    return text.select(cells)


def null_spellings(df: DataFrame, spellings: list[str] = NA_SPELLINGS) -> DataFrame:
    """Turn the NA spellings of every text column into null, in one projection."""
    kept = []
    for f in df.schema.fields:
        value = quoted(f.name)
        if is_text(f):
            value = F.when(~value.isin(spellings), value).alias(f.name, metadata=f.metadata)
        kept.append(value)
    return df.select(kept)


def read_labels(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Variable labels: the first two columns of the file are column name and label."""
    df = read_table(spark, path, file_format)
    return df.select(
        quoted(df.columns[0]).cast("string").alias("column_name"),
        quoted(df.columns[1]).cast("string").alias("label"),
    )


def read_value_labels(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Value labels: the first three columns of the file are column name, code and label."""
    df = read_table(spark, path, file_format)
    return df.select(
        quoted(df.columns[0]).cast("string").alias("column_name"),
        quoted(df.columns[1]).cast("bigint").alias("code"),
        quoted(df.columns[2]).cast("string").alias("label"),
    )


def read_survey(
    spark: SparkSession,
    path: str,
    labels_path: str | None = None,
    value_labels_path: str | None = None,
    order_by: tuple[str, ...] = (),
    country: str | None = None,
    stored: str | None = None,
    split: bool = False,
    file_format: str | None = None,
) -> Survey:
    """Load a table and, where given, its labels and value labels; `stored` and `split` as in `read_table`.

    `file_format` is for folders without an ending, and holds for the labels too.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return Survey(
        name=name,
        data=read_table(spark, path, file_format, stored=stored, split=split),
        labels=read_labels(spark, labels_path, file_format) if labels_path else None,
        value_labels=read_value_labels(spark, value_labels_path, file_format) if value_labels_path else None,
        order_by=order_by,
        country=country,
    )


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Put each column's label into its schema metadata under `label`; several are joined by ` / `.

    Only labels of columns that exist in `df` reach the driver: at most one row per column.
    """
    wanted = labels.where(F.col("column_name").isin(df.columns)).where("label is not null")
    found = wanted.groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_set("label")), " / ").alias("label")).collect()
    text = {row.column_name: row.label for row in found}
    return df.select(
        [
            quoted(f.name).alias(f.name, metadata={**f.metadata, "label": text[f.name]})
            if f.name in text
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def labels_in_schema(schema: T.StructType) -> dict[str, str]:
    """The labels that `attach_labels` left in a schema."""
    return {f.name: f.metadata["label"] for f in schema.fields if "label" in f.metadata}
