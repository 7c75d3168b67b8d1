"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.llm.frames import saved


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least vertex among u and its neighbours ``v``."""
    return edges.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))


def connected(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (vertex, root) for every vertex with an edge; the root is the least vertex reachable.

    Only minima travel, so a hub costs its edges and no more; each half-step is written to
    the shared folder. Loops and repeated edges are harmless, no edges give no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct(), "large")
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = saved(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        state = tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
