"""Connected components by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node and label (and a column of the last pass) of every node of ``links`` (a, b); the label is the least node of its component.

    Each pass takes the least label among a node and its neighbours, then follows
    the label's own label, so chains shorten to a fraction in every pass. Labels
    are written after each pass; only the number of changes comes to the driver.
    ``known`` are the labels of some of the links: a start that is near the end.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    start = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))
    if known is not None:
        start = start.join(known.withColumnRenamed("label", "known"), "node", "left").select("node", F.least("label", "known").alias("label"))
    labels = cut(start)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(hooked.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label")))
        drop(labels)
        labels = new
        if new.where("old <> label").limit(1).count() == 0:
            drop(both)
            return labels
