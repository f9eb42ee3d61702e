"""Exact dedup by two passes over a Bloom filter, with DataFrame functions alone.

Pass one sets bits for the hash of each text and keeps the bits that two or more rows have set. Pass two
probes that filter: a row whose bits are not all set twice has no equal and passes straight through;
only the others are shuffled and grouped by SHA-256.

The filter has 16 bits a row, and at most 32 MiB in all, which bounds the broadcast (see `bloom`). Beyond
some 16 million rows its share of false hits grows: more rows are shuffled, and the result is the same.

Defined cases: a null text is empty; an empty table gives an empty result; among equal texts the smallest
doc_id stays, and a null doc_id stays only where the group has no other; rows that repeat a doc_id and its
text count in the group, `flag` marks each of them as kept and `drop` leaves one; other columns, of any
name, are carried by `drop` and ignored by `flag`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import by_position, narrow, position, settle, text_or_empty


def normalised(text: str) -> Column:
    """The text with each run of white space as one space.

    The pattern leaves out single spaces, which stay as they are.
    """
    return F.regexp_replace(text_or_empty(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _probe(rows: DataFrame, marks: DataFrame, digest: str) -> DataFrame:
    """The rows with a column `again`: whether another row may have the same digest. marks: all digests."""
    return bloom.probe(rows, digest, bloom.build(marks, digest, repeated=True), "again")


def flag(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    marks = settle(rows.select("doc_id", F.sha2(normalised("text"), 256).alias("text_sha256")), "digests")
    probed = _probe(marks, marks, "text_sha256")
    alone = probed.where("not again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = probed.where("again").drop("again")
    groups = maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = settle(groups, "groups")  # read back, it is a join side of its own, so that a large group can be split
    grouped = maybe.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    ident, text = f"c{position(docs, id_col)}", f"c{position(docs, text_col)}"
    keyed = by_position(docs).withColumn("digest", F.sha2(normalised(text), 256))
    marks = settle(keyed.select(F.col(ident).alias("ident"), "digest"), "digests")
    probed = _probe(keyed, marks, "digest")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    alone = probed.where("not again").select(columns)
    groups = (
        _probe(marks, marks, "digest")
        .where("again")
        .groupBy("digest", "ident")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(F.min(F.struct(F.isnull("ident").alias("no"), "ident", "n")).alias("first"))
        .select("digest", "first.ident", "first.n")
    )
    groups = settle(groups, "groups")
    # a shuffle join at every size: the groups grow with the corpus
    stay = probed.where("again").join(groups.hint("merge"), "digest").where(F.col(ident).eqNullSafe(F.col("ident")))
    single = stay.where("n = 1").select(columns)
    best = F.min_by(F.struct(*columns), text_or_empty(text))
    repeated = stay.where("n > 1").groupBy("digest").agg(best.alias("row"))
    return alone.unionByName(single).unionByName(repeated.select("row.*")).toDF(*docs.columns)
