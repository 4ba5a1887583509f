"""Connected components of links between nodes, as joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached, for each node with a link.

    links has the columns a and b. Each round takes the smallest label among a node's
    neighbours and then follows labels once more (halving long chains), until no label
    changes. Links with a null end and links to itself are left out. No group is collected: minima are
    pre-aggregated, and each round is cut with checkpoint().
    """
    shared_folder(links.sparkSession)
    links = links.select("a", "b").where("a <> b")
    edges = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = edges.checkpoint()
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = labels.select("node", F.least("node", "near").alias("label")).checkpoint()
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("before")
        ).checkpoint()
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = step.join(up, "label", "left").select(
            "node", F.least("label", F.coalesce("up", "label")).alias("label"), "before"
        ).checkpoint()
        labels = moved.select("node", "label")
        if moved.where("label <> before").isEmpty():
            return labels
