"""Connected components by label propagation with pointer jumping, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the links; label is the smallest node reachable.

    Each round takes the smallest label of a node and its neighbours (combined per task before the
    shuffle), then the label of that label; rounds grow with the logarithm of a path's length. Every
    round is written to the shared folder. Repeated links and links of a node with itself change nothing; null ends:
    dropped. No links: no rows. Extra columns are ignored.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")  # also drops nulls
    edges = staged(edges.union(edges.select("v", "u")).distinct(), "links")
    labels = staged(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    if labels.isEmpty():
        return labels
    while True:
        offers = edges.join(labels, edges["u"] == labels["node"]).select(F.col("v").alias("node"), "label")
        near = staged(labels.union(offers).groupBy("node").agg(F.min("label").alias("label")), "labels-near")
        up = near.select(F.col("node").alias("over"), F.col("label").alias("above"))
        jumped = near.join(up, near["label"] == up["over"], "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"))
        new = staged(jumped, "labels")
        old = labels.select("node", F.col("label").alias("before"))
        if new.join(old, "node").where("label != before").isEmpty():
            return new
        labels = new
