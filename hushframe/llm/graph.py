"""Connected components of a table of links, by alternating large and small stars.

A large star leads every greater neighbour of a node to the smallest neighbour, a small star every
smaller one. Each round is a handful of joins and groupings; its links are stored, so a lost executor
costs one round at most. No component, list of neighbours or set of links is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _stars(links: DataFrame) -> DataFrame:
    """One large and one small star over links (a > b)."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def smallest_reachable(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches, for every node of links (a long, b long)."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    while True:
        links = settle(links, "links")
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        links = _stars(links)
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
