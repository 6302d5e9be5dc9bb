"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelkeel.llm.common import staged


def _hang(pairs: DataFrame, least: DataFrame, keep) -> DataFrame:
    return pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id`` and ``root`` (the smallest id it is joined to) of every node of ``links`` (a, b) but the roots.

    Each step hangs a node's neighbours on the smallest of them, so no list of neighbours is
    ever gathered; rounds are about the logarithm of the longest chain.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _hang(both, least, F.col("v") > F.col("u")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = _hang(down, least, F.col("v") != F.col("m")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = staged(hung.filter("u <> v").distinct(), "edges")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state
    raise RuntimeError("components did not settle")
