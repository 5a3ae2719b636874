"""Connected components of an edge table, without collecting edges or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.base import materialize


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of edges(a, b): the smallest node reachable.

    Each round takes the least label among the neighbours, then jumps to that label's label; labels halve
    their distance to the root, so rounds grow as the logarithm of a path's length. Hubs only cost an
    aggregation with map-side combine and a join whose skewed side adaptive execution splits.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        least = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("mid"))
        above = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        new = materialize(least.join(above, least.mid == above.up).select("node", "old", F.least("mid", "top").alias("component")))
        labels = new.select("node", "component")
        if new.filter(F.col("old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError("components did not settle")
