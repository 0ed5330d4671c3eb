"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of `edges` (a, b); only nodes with an edge appear.

    Each round takes the least label of all neighbours, pre-aggregated before the shuffle, then the
    label of the label. Rounds grow with the logarithm of a component's diameter, and each one ends
    as a written table.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        better = (
            labels.join(near, labels.node == near.a)
            .select("node", "label", F.least("label", "near").alias("via"))
            .join(hop, "via", "left")
            .select("node", F.least("via", F.coalesce("jump", "via")).alias("label"), (F.least("via", F.coalesce("jump", "via")) != F.col("label")).alias("moved"))
        )
        better = stage(better)
        labels = better.select("node", "label")
        if better.where("moved").isEmpty():
            return labels
