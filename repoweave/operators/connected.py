"""Connected components of an undirected graph, keyed by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.operators.joins import salted_join
from repoweave.session import shared_table


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges (a, b)``; ``component`` is the smallest node of the component.

    Every node holds a guess, the smallest node that it knows of. A round lowers each guess to the smallest guess of the
    neighbours, then to the guess of the node that is guessed (pointer jumping), so guesses travel twice as far with every
    round. Rounds are rows of nodes and numbers; the guesses of a popular node are dealt out to all that ask for them.
    """
    both = edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct()
    both, seen = shared_table(both, n=F.count(F.lit(1)))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    guesses = shared_table(least.select("node", F.least("node", "least").alias("component")))
    while True:
        of_other = guesses.select(F.col("node").alias("b"), F.col("component").alias("other"))
        # A neighbour's guess lowers that of the node, and of the node that it guesses: whole trees are hooked at once.
        told = salted_join(both, of_other, ["b"], ["a"], rows=seen["n"]).select(F.col("a").alias("node"), "other")
        lowest = told.groupBy("node").agg(F.min("other").alias("other")).join(guesses, "node")
        hooks = lowest.select("node", "other").union(lowest.select(F.col("component").alias("node"), "other"))
        hooks = hooks.union(guesses.select("node", "component")).groupBy("node").agg(F.min("other").alias("component"))
        up = hooks.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = salted_join(hooks, up, ["component"], ["node"], how="left", rows=seen["n"])
        jumped = jumped.select("node", F.coalesce("further", "component").alias("component"))
        old = guesses.select("node", F.col("component").alias("old"))
        guesses, changed = shared_table(
            jumped.join(old, "node").withColumn("moved", F.col("old") != F.col("component")).drop("old"), n=F.count_if("moved")
        )
        guesses = guesses.drop("moved")
        if not changed["n"]:
            return guesses
