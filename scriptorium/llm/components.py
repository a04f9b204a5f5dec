"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), the component being its smallest node.

    Every step is a shuffle of the edge table, never wider than the edges; the number of steps grows with the logarithm
    of the longest chain.  Each node's neighbours are aggregated to their minimum, so no group is gathered.
    """
    ends = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = written(ends(edges), "edges"), None
    while True:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour (or itself).
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: every smaller neighbour, and the node, is linked to the smallest.
        large = ends(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        now = written(ends(small), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.toDF("node", "component").union(roots)
