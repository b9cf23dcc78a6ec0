"""Samples stored as series id, time and value beside a dictionary of their series.

Labels are judged once for each series, in the dictionary; samples carry 24 bytes each
and are read by a join on the id. The sample table is partitioned by the day and by a
slot of the id, and sorted by id within its files: the time range prunes days, the
series found prune slots while the query runs, and the ids prune row groups.

Defined results: samples whose value is null are kept as such; labels of a series are
those of its map, so the ids of two maps with one canonical text are told apart by
their fingerprint; an empty table writes no files and reads as no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import fingerprint
from .select import match

DAY, SLOTS = 86_400_000, 16
DICTIONARY = "series_id long, metric string, labels map<string,string>, labels_sig string, slot int"
SAMPLES = "series_id long, ts long, value double, day long, slot int"


def series_id(slots: int = SLOTS) -> dict:
    """The columns ``series_id`` and ``slot`` of a frame with metric and labels."""
    own = F.xxhash64("metric", fingerprint(F.col("labels")))
    return {"series_id": own, "slot": F.pmod(own, F.lit(slots)).cast("int")}


def encode(samples: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(dictionary, samples by id) of a samples frame."""
    named = samples.withColumns(series_id(slots))
    dictionary = named.groupBy("series_id", "metric", "labels", "labels_sig", "slot").agg(F.count("*").alias("n")).drop("n")
    return dictionary, named.select("series_id", "ts", "value", F.expr(f"ts div {DAY}").alias("day"), "slot")


def write(samples: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Write both tables under ``path``; two series that share an id are refused."""
    dictionary, rows = encode(samples, slots)
    dictionary.write.mode("overwrite").parquet(f"{path}/series")
    same = samples.sparkSession.read.schema(DICTIONARY).parquet(f"{path}/series").groupBy("series_id").agg(F.count("*").alias("n")).where("n > 1")
    if not same.isEmpty():
        raise ValueError("two series share an id")
    # A row's time also deals it out, so that one busy series or day is several tasks.
    dealt = rows.repartition("day", "slot", F.pmod(F.xxhash64("ts"), F.lit(4))).sortWithinPartitions("day", "slot", "series_id", "ts")
    dealt.write.mode("overwrite").partitionBy("day", "slot").parquet(f"{path}/samples")


def scan(spark: SparkSession, path: str, metric: str, start: int, end: int, *matchers: tuple[str, str, str]) -> DataFrame:
    """The samples frame of the series of ``metric`` that pass all matchers, within start to end (both included)."""
    series = spark.read.schema(DICTIONARY).parquet(f"{path}/series")
    found = match(series.where(F.col("metric") == metric), *matchers)
    rows = spark.read.schema(SAMPLES).parquet(f"{path}/samples")
    within = rows.where(F.col("day").between(start // DAY, end // DAY) & F.col("ts").between(start, end))
    return within.join(found, ["series_id", "slot"]).select("metric", "labels", "labels_sig", "ts", "value")


def label_names(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """The label names of a metric's series, from the dictionary alone."""
    series = spark.read.schema(DICTIONARY).parquet(f"{path}/series")
    return series.where(F.col("metric") == metric).select(F.explode(F.map_keys("labels")).alias("name")).distinct()
