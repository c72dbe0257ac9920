"""Connected components of an edge table by joins: labels spread to neighbours and jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partflow.llm.common import dropped, salted_join, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), the component being its smallest node.

    Each round takes the smallest label among a node and its neighbours and then that label's own label, so rounds grow with
    the logarithm of the longest chain. Self edges and repeated edges do no harm; an empty table gives no rows.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        near = salted_join(both, labels.select(F.col("node").alias("b"), F.col("component").alias("label")), ["b"])
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        hooked = labels.join(least, "node").select("node", F.col("component").alias("old"), F.least("component", "label").alias("component"))
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = stored(salted_join(hooked, up, ["component"]).select("node", "old", F.col("next").alias("component")), "labels")
        dropped(labels)
        labels = jumped.select("node", "component")
        if jumped.filter("old <> component").isEmpty():
            dropped(both)
            return labels
