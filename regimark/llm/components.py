"""Connected components of an edge table by smallest labels and shortcuts, each round a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges(a, b); label: the smallest node that can be reached.

    Each round a label falls to the smallest among the neighbours' labels and then to its own label's label,
    so chains shorten by half a round. Nodes of most edges are met by a broadcast, so that a star is no hot key.
    Nothing is collected but whether a label changed.
    """
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("edges")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), "edges")
    labels = stored(labels, "labels")
    while True:
        near = heavy_join(both.select("a", F.col("b").alias("node")), labels, ["node"], "edges", "a", 0).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "edges", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        new = stored(lower.join(jump, lower.label == jump["at"], "left").select("node", "edges", "was", F.least("label", "beyond").alias("label")), "labels")
        if new.filter("label < was").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label", "edges")
