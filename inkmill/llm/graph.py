"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import removed, written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes that edges(a, b) touch: label is the least node of the component.

    Each round takes the least label among neighbours, then the label of that label. What a round leaves
    is a table in the shared folder, so plans stay short and a lost executor costs one round's tasks.
    Only one number a round reaches the driver. Links may repeat and point either way: least labels don't change by it. nodes is not read: a node without an edge has no row.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = written(labels.join(near, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("was")), "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(lower.join(jump, "label").select("node", F.col("next").alias("label"), "was"), "labels")
        moved = after.where("label <> was").limit(1).count()
        removed(labels)
        removed(lower)
        labels = after.select("node", "label")
        labels.inkmill_path = after.inkmill_path
        if not moved:
            removed(both)
            return labels
