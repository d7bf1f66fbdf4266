"""Connected components of an undirected graph, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, save


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), the component named by its smallest node.

    Every round hooks each node to its smallest neighbour, halves the resulting paths twice and
    contracts the graph; edges inside a component vanish, so the rounds grow with the logarithm of
    the longest path. Every round's tables are saved, so lost executors cost one round at most.
    """
    live = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = save(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")))
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("low")).select("at", F.least("at", "low").alias("up"))
        up = save(up)
        for _ in range(2):
            high = up.select(F.col("at").alias("up"), F.col("up").alias("upper"))
            up = up.join(high, "up").select("at", F.col("upper").alias("up"))
        old_up, up = up, save(up)
        old_labels, old_live = labels, live
        labels = save(labels.join(up.select(F.col("at").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        left = up.select(F.col("at").alias("a"), F.col("up").alias("x"))
        right = up.select(F.col("at").alias("b"), F.col("up").alias("y"))
        ends = live.join(left, "a").join(right, "b").filter("x <> y")
        live = save(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(old_live, old_labels, up, old_up)
    discard(live)
    return labels
