"""Connected components of a graph of any size, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import drop, keep


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: longs a, b.  Returns (node, component) for every node, component its smallest reachable node.

    Alternates large-star and small-star steps until nothing changes.  Each step aggregates the smallest
    neighbour and joins it back, so no task ever gathers a node's neighbours; every round is written out.
    """
    e = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        old, e = e, keep(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        drop(old)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError("components don't settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
