"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of an edge with the smallest node that it reaches.

    Every round a node takes the smallest label next to it, hands it to the label it had, and jumps to the label of its
    label, so the rounds grow with the logarithm of a component's extent, without a limit."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    while True:
        labels = cut_lineage(labels)
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "seen").alias("low"))
        offers = lower.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("offer"))
        hooked = cut_lineage(lower.join(offers, F.col("label") == F.col("root")).select("node", F.col("label").alias("was"), F.least("low", "offer").alias("label")))
        far = hooked.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = cut_lineage(hooked.join(far, F.col("label") == F.col("at"), "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        if jumped.filter("was <> label").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
