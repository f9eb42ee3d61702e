"""Writers: the de-identified table and its labels, the encoding map, the plan report and the log."""

from __future__ import annotations

import posixpath
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.plans.actions import plan_report
from hushframe.plans.detect import log_messages
from hushframe.session import rows_frame
from hushframe.sources.tables import FORMATS, labels_in_schema


def deidentified_path(source_path: str, folder: str) -> str:
    """`<folder>/<stem>_deidentified.<ending>` for an input path."""
    name = source_path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, ending = name.rpartition(".")
    return f"{folder.rstrip('/')}/{stem or ending}_deidentified{dot}{ending if stem else ''}"


def write_deidentified(df: DataFrame, source_path: str, folder: str, file_format: str | None = None) -> str:
    """Write in the format of the input, replacing an earlier result; returns the path.

    Column labels, where there are any, are written beside it into `<path>_labels`.
    """
    path = deidentified_path(source_path, folder)
    ending = file_format or path.rsplit(".", 1)[-1].lower()
    if ending not in FORMATS:
        raise ValueError(f"unsupported file type {ending!r}; supported: {', '.join(sorted(FORMATS))}")
    writer = df.write.mode("overwrite")
    if ending == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(FORMATS[ending]).save(path)
    if labels_in_schema(df.schema):
        write_labels(df, f"{path}_labels")
    return path


def write_labels(df: DataFrame, path: str) -> None:
    """The labels of the columns, as CSV that `tables.read_labels` reads: column_name, label."""
    rows = list(labels_in_schema(df.schema).items())
    labels = rows_frame(df.sparkSession, rows, "column_name string, label string")
    labels.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _apart(path: str, output_path: str) -> None:
    """The map undoes the encoding, so it may not lie inside the published output."""
    if (_plain(path) + "/").startswith(_plain(output_path) + "/"):
        raise ValueError("the encoding map must not be stored inside the published output")


def _plain(path: str) -> str:
    """A path without detours, and without the scheme of local files."""
    scheme, mark, rest = path.rpartition("://")
    if not mark:
        scheme, rest = "", path.removeprefix("file:")
    return ("" if scheme in ("", "file") else f"{scheme}://") + posixpath.normpath(rest)


def write_encoding_map(mapping: DataFrame, path: str, output_path: str) -> DataFrame:
    """Store an encoding map and return it read back, for use in `deidentify`."""
    _apart(path, output_path)
    mapping.write.mode("overwrite").parquet(path)
    return mapping.sparkSession.read.parquet(path)


def export_encoding_map(mapping: DataFrame, path: str, output_path: str) -> None:
    """The map as CSV for people: variable, original value, encoded value."""
    _apart(path, output_path)
    (
        mapping.select("variable", "original_value", "encoded_value")
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )


def write_sketches(rows: DataFrame, path: str) -> DataFrame:
    """Store the column sketches of some parts (`operators.sketches`); returns all parts stored so far.

    Parts that are written again replace their rows, so a retried job adds nothing twice.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _named(lines: DataFrame, column: str) -> Column:
    """The line, after the name of its table where there is one."""
    line = F.col(column)
    return (F.concat(F.col("table_name"), F.lit(": "), line) if "table_name" in lines.columns else line).alias("line")


def write_plan_report(plan: DataFrame, path: str) -> None:
    lines = plan_report(plan)
    lines.select(_named(lines, "line")).coalesce(1).write.mode("overwrite").text(path)


def append_log(findings: DataFrame, path: str, applied: list[str] | None = None, run_id: str | None = None) -> None:
    """Add one line per decision to the log, and the lines of the apply step (`actions.apply_messages`).

    Each run has a folder `run=<id>` of its own in the log. A job that was retried gives the same `run_id`: lines that the
    run has logged before are not added again. A line that a run has several times is there as often. Without a run
    id the lines make a run of their own.
    """
    lines = log_messages(findings)
    said = lines.select(_named(lines, "message"))
    spark = findings.sparkSession
    if applied:
        said = said.unionByName(rows_frame(spark, [(x,) for x in applied], "line string"))
    run = run_id or uuid.uuid4().hex
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"a run id has letters, digits, '.', '_' and '-' only: {run!r}")
    folder = f"{path.rstrip('/')}/run={run}"
    if run_id is not None and _exists(spark, folder):
        known = spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("known"))
        fresh = said.groupBy("line").agg(F.count(F.lit(1)).alias("n")).join(known, "line", "left")
        missing = "explode(sequence(1, cast(greatest(n - coalesce(known, 0), 0) as int)))"
        said = fresh.where("n > coalesce(known, 0)").selectExpr("line", missing).select("line")
    said.write.mode("append").text(folder)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log with their run: run, line."""
    return spark.read.schema("value string, run string").text(path).selectExpr("run", "value as line")


def _exists(spark: SparkSession, folder: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
