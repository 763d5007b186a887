"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it reaches), for edges a, b of longs. Each round every node takes the smallest label
    of its neighbours and then the label of its label, so the rounds grow with the logarithm of a component's width."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "_near").alias("_new"))
        offered = hooked.groupBy(F.col("label").alias("_root")).agg(F.min("_new").alias("_offer"))  # a label follows its members
        merged = cut_lineage(hooked.join(offered, F.col("label") == F.col("_root")).select("node", F.col("label").alias("_old"), F.least("_new", "_offer").alias("label")))
        jump = merged.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        after = cut_lineage(merged.join(jump, F.col("label") == F.col("_n"), "left").select("node", "_old", F.least("label", F.coalesce("_l", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.filter("_old <> label").isEmpty():
            return labels
