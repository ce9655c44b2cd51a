"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import checkpointed


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` of ``nodes(id)`` under undirected ``edges(a, b)``; a component is named by its smallest id.

    A round takes for each node the smallest label around it and then follows that label's own label, so paths halve
    and the rounds grow with the logarithm of a component's width. Each round is a checkpoint; nothing stays cached.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = checkpointed(both)
    label = checkpointed(nodes.select("id").distinct().withColumn("component", F.col("id")))
    while True:
        around = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("low"))
        low = label.join(around, F.col("id") == F.col("a"), "left").select("id", F.col("component").alias("old"), F.least("component", "low").alias("new"))
        hop = label.select(F.col("id").alias("at"), F.col("component").alias("further"))
        moved = low.join(hop, F.col("new") == F.col("at"), "left").select("id", "old", F.least("new", "further").alias("component"))
        moved = checkpointed(moved)
        label = moved.select("id", "component")
        if moved.where("component <> old").isEmpty():
            return label
