"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a map-side combinable ``min`` per node, a join and a distinct, so neither the
edges nor the components pass through the driver or one task; a hub's edges are split by
Spark's skew join.  The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import stored


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    inner = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` (any order, repeats and loops allowed, no nulls) -> ``(node,
    component)``: the smallest node reachable, for every node that has an edge to
    another.  No edges: no rows."""
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 "edges")
    mark = None
    for _ in range(max_rounds):
        state = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == mark or state[0] == 0:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                cur.select(F.col("b"), F.col("b")).distinct())
        mark, cur = state, stored(_stars(cur), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
