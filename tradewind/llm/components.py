"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.stored import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node it is connected to.

    Each round every node takes the least label around it and then the label of that label, so
    the number of rounds grows with the logarithm of the longest path. Labels are written to the
    shared folder in each round; only the number of changes reaches the driver."""
    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(),
        "component-edges",
    )
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("label")
    )
    labels = stored(labels, "component-labels")
    while True:
        around = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(around, labels.node == around.a, "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        target = lower.select(F.col("node").alias("of"), F.col("label").alias("further"))
        jumped = lower.join(target, F.col("label") == F.col("of"), "left").select(
            "node", "old", F.least("label", "further").alias("label")
        )
        jumped = stored(jumped, "component-labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label <> old").count():
            return labels
