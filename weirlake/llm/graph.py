"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlake.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for each node of the edges (a, b).

    Each round takes the smallest label of the neighbours, combined before the shuffle, and then the label's
    own label, so paths shorten by more than half. Each round's labels are a table of their own: Spark knows
    its size, can split the partition of a hub, and never goes back to earlier rounds.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        near = written(near, "near")
        lower = written(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")), "lower")
        own = lower.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        after = lower.join(own, "component", "left").select("node", "was", F.coalesce("jump", "component").alias("component"))
        after = written(after, "labels")
        labels = after.drop("was")
        if after.where("was != component").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")
