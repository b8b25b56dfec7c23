"""Connected components over an edge table, by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from susceptra.storage import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b): orderable ids, nulls ignored -> (node, component): every node of an edge with the smallest id it reaches.

    Each round is two groupings with map-side minima (no neighbour list is ever gathered) and ends in a table in the
    shared folder, so neither lineage nor state grows. Self-loops and repeated edges are harmless; no edges give no rows.
    """
    e = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).filter("a is not null and b is not null")
    loops = e.filter("a = b").select(F.col("a").alias("node")).distinct()
    e = materialise(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is tied to the smallest id around that node
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself are tied to the smallest of them
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        joined = big.join(low, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        e = materialise(small, "edges")
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct()
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    alone = loops.join(stars, "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.unionByName(alone)
