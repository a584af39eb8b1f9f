"""Connected components of a graph of links, on the cluster.

Alternating star contraction: every node links its larger neighbours to its
smallest one, then its neighbours to the smallest again, until nothing moves.
A node's links are reduced to a minimum (combined map-side) that is joined
back; adaptive execution splits the join at hubs. Nothing is collected but one
yes or no per round, and rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, release

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node that
    edges (``a``, ``b``: orderable, not null) link. Loops and repeats are fine."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(MAX_ROUNDS):
        # large star: larger neighbours of a node go to the smallest of it and all its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = edges.join(least.withColumnRenamed("n", "b"), "b").select("a", F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large)
        release(edges)
        # small star: smaller neighbours of a node, and itself, go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialize(small)
        release(large)
        # done when every node has one link and no node is both linked and linked to
        open_ends = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        several = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if open_ends.isEmpty() and several.isEmpty():
            edges = small
            break
        edges = small
    else:
        raise RuntimeError(f"links did not contract in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
