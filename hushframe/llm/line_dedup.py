"""Lines that a site repeats: site-relative frequency, with DataFrame functions alone.

A line's ratio is the number of pages of its host that contain it by the number of pages of that host.
Lines over the ratio, on at least `least` pages, are boilerplate there and are dropped from all pages of
the host; the same line stays where it is rare.

Each page counts a line once, and counts are added up before they are shuffled, so a line or host that
holds a third of all rows is a few rows per task. A host has at most its mean number of lines per page
divided by `ratio` boilerplate lines; this list is joined to its pages (by broadcast where Spark measures
it small, else as a join whose large hosts AQE splits).

Lines are compared without the spaces around them, by MD5. Defined cases: a null text is empty; blank
lines are never boilerplate; a null host is a host of its own; repeated rows are pages of their own; an
empty table gives an empty result; other columns are ignored by `clean_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, settle, text_or_empty


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """host and keys: the MD5 digests of its boilerplate lines. pages: host and lines."""
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _key))
    counted = pages.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.groupBy(F.col("host").alias("its_host")).agg(F.count(F.lit(1)).alias("pages"))
    frequent = counted.where(F.col("n") >= least).join(totals, F.col("host").eqNullSafe(F.col("its_host")))
    over = frequent.where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy(F.col("host").alias("its_host")).agg(F.collect_list("key").alias("keys"))


def clean_lines(
    docs: DataFrame, ratio: float = 0.02, least: int = 3, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, host, text without the boilerplate lines, and how many were dropped."""
    rows = narrow(docs, doc_id=id_col, host=host_col, text=text_col)
    pages = rows.select("doc_id", "host", F.split(text_or_empty("text"), "\n", -1).alias("lines"))
    found = settle(boilerplate(pages.select("host", "lines"), ratio, least), "boilerplate")
    joined = pages.join(found, F.col("host").eqNullSafe(F.col("its_host")), "left")
    stay = F.when(F.col("keys").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("keys"), _key(x)))
    )
    kept = joined.select("doc_id", "host", F.size("lines").alias("n"), stay.alias("stay"))
    return kept.select(
        "doc_id", "host", F.array_join("stay", "\n").alias("text"), (F.col("n") - F.size("stay")).cast("long").alias("lines_dropped")
    )
