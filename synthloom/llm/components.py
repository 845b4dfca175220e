"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthloom.llm.common import discard, measured, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that a link joins to another one; root is the least node of its component.

    Each round ties every node's larger neighbours, then its smaller ones, to the least of its neighbourhood; it ends when
    only stars around the least nodes are left, after about the logarithm of the longest path. Rounds are written tables.
    """
    up, down = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = written(links.filter(F.col(a) != F.col(b)).select(up, down).distinct(), "edges")
    before = None
    while (now := _digest(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.filter("v > u").join(measured(least), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least_below = written(large.groupBy("u").agg(F.min("v").alias("m")), "least-below")
        tied = large.join(measured(least_below), "u").filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = written(tied.unionByName(least_below.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for done in (edges, least, large, least_below):
            discard(done)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
