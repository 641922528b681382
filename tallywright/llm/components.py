"""Connected components of a table of links, by least labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node in links(u, v).

    Each round a node takes the least label among its neighbours and itself, then its label's label. Sums run as
    partial aggregates and inner joins, so a node with very many links is split by adaptive execution."""
    both = cut(links.select("u", "v").union(links.select("v", "u")).distinct())
    labels, rounds = both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")), 0
    while True:
        rounds += 1
        seen = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("least"))
        lower = labels.join(seen.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "least").alias("next"))
        lower = cut(lower)
        if not lower.where("label <> next").limit(1).count():
            return lower.select("node", "label")
        labels = lower.select("node", F.col("next").alias("label"))
        if rounds > 2:  # most components are stars, which two rounds settle; longer ones need jumps
            jumped = labels.join(labels.select(F.col("node").alias("at"), F.col("label").alias("further")), F.col("label") == F.col("at"), "left")
            labels = cut(jumped.select("node", F.least("label", F.coalesce("further", "label")).alias("label")))
