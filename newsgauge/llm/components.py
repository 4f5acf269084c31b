"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgauge.session import drop_staged, staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of ``links`` (columns u, v): label is the smallest node reachable.

    Every round takes the smallest label among a node and its neighbours and then the label of that label, so that
    labels run along a path in steps that double. Each round is staged; the driver sees one count a round.
    """
    both = staged(links.select("u", "v").union(links.select("v", "u")).distinct())
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")))
    while True:
        near = (both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near")))
        lowered = (labels.join(near, F.col("node") == F.col("u"))
                   .select("node", F.col("label").alias("old"), F.least("label", "near").alias("low")))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = staged(lowered.join(jump, "low", "left")
                       .select("node", "old", F.least("low", F.coalesce("far", "low")).alias("label")))
        moved = after.where(F.col("old") != F.col("label")).limit(1).count()
        drop_staged(labels)
        labels = after.drop("old")
        labels._staged_path = after._staged_path
        if not moved:
            drop_staged(both)
            return labels
