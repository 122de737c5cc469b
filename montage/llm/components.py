"""Connected components of a table of links, by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, label, the label being the smallest node of the component.

    Each round a node takes the least label of its neighbours, then the label of its label. Rounds are tables in the shared folder; the
    number of rounds grows with the logarithm of a path's length in practice. Nothing but a count of changes comes to the driver.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        after = met.join(jump, "label", "left").select("node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "old")
        after = materialize(after.select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "labels")
        remove(labels)
        labels = after
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")
