"""Comparing found columns with the true ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Wrongly detected and not detected columns, named exactly as spelled.

    Both sides need `column_name`; `table_name` is compared too if both have it.
    """
    keys = [k for k in ("table_name", "column_name") if k in findings.columns and k in truth.columns]
    found, true = findings.select(keys).distinct(), truth.select(keys).distinct()
    wrong = found.join(true, keys, "left_anti").withColumn("outcome", F.lit("wrongly detected"))
    missed = true.join(found, keys, "left_anti").withColumn("outcome", F.lit("not detected"))
    return wrong.unionByName(missed)
