"""Connected components by rounds of large-star and small-star joins, keyed by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.session import shared_table


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``edges (a, b)``, component being the smallest node that can be reached.

    Large-star ties each neighbour above a node to the smallest of node and neighbours; small-star does so for those
    below. Both keep the components, and the rounds end when every node hangs on its smallest one, after a number of
    rounds logarithmic in the longest path. Minima are combined before the shuffle; no component meets in one task. Each
    round is a table of its own: a checkpoint hands on the planner's guess of its size, which a round takes to the fourth
    power, and as many partitions as it was written from, so that a few thousand edges kept every round at hundreds of tasks.
    """
    edges, seen = shared_table(edges.filter("a <> b").distinct(), n=F.count(F.lit(1)))
    while seen["n"]:
        pairs = _both_ways(edges)
        low = pairs.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = pairs.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        # Done when each node has one neighbour below and that one is nobody's upper node: a forest of stars.
        new, count = shared_table(new, n=F.count(F.lit(1)), total=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        done = count == {k: seen.get(k) for k in count}
        edges, seen = new, count
        if done:
            break
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
