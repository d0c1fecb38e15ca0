"""Classes of linked rows: connected components by label propagation with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a long, b long): label is the least node that it is linked to by any path.

    Each round takes the least label among a node's neighbours, then that label's own label, so a path's length halves.
    A node with very many links spreads over tasks: minima are taken before they are exchanged, and the joins have one
    row for each node on one side, so Spark can split the other. Rounds are written to the shared folder, which cuts
    the lineage. It ends when a round changes nothing.
    """
    edges = saved(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        # The label of the label is as of the last round: never above this round's.
        moved = saved(step.join(jump, step.label == jump.via, "left").select("node", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        changed = moved.where("label <> old").limit(1).count()
        discard(labels)
        labels = moved.select("node", "label")
        labels.written_at = moved.written_at
        if not changed:
            discard(edges)
            return labels
