"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of `links` (a, b).

    Each round gives a node the least label among its own and its neighbours',
    then the label of that label; rounds end when nothing changes. Each round is
    written to the shared folder. No links give no rows.
    """
    pairs = links.select("a", "b").where("a <> b")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_heard"))
        near = labels.join(heard, labels["node"] == heard["a"]).select("node", "label", F.least("label", "_heard").alias("_near"))
        of_label = labels.select(F.col("node").alias("_at"), F.col("label").alias("_far"))
        after = near.join(of_label, near["_near"] == of_label["_at"]).select(
            "node", F.least("_near", "_far").alias("_new"), (F.least("_near", "_far") != F.col("label")).alias("_changed")
        )
        after = cut_lineage(after)
        changed = after.where("_changed").limit(1).count()
        labels = after.select("node", F.col("_new").alias("label"))
        if not changed:
            return labels
