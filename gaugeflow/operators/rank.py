"""Per-time ranking, newest events, and nearest samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(vector: DataFrame, k: int, order) -> DataFrame:
    if not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    place = F.row_number().over(Window.partitionBy("ts").orderBy(order, "labels_sig"))
    return vector.withColumn("place", place).where(F.col("place") <= k).drop("place")


def topk(vector: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest series at each timestamp; ties by label signature; Spark limits groups before the shuffle."""
    return _ranked(vector, k, F.desc("value"))


def bottomk(vector: DataFrame, k: int) -> DataFrame:
    return _ranked(vector, k, F.asc("value"))


def newest(events: DataFrame, limit: int = 200) -> DataFrame:
    """The newest events; equal times by id."""
    return events.orderBy(F.desc("ts"), "id").limit(limit)


def nearest_sample(vector: DataFrame, cursor: int) -> DataFrame:
    """Each series' point nearest to ``cursor``, the earlier of two equally near ones; largest value first."""
    near = F.struct(F.abs(F.col("ts") - cursor).alias("gap"), F.col("ts").alias("ts"), F.col("value").alias("value"))
    return vector.groupBy("metric", "labels_sig").agg(F.min(near).alias("near")).select("metric", "labels_sig", "near.ts", "near.value").orderBy(F.desc("value"), "labels_sig")
