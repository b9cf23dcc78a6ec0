"""Upkeep of the samples table: upsert, retention, series dictionary, packed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACK_AFTER_MS, LEAST_RUN, MOST_RUN = 2 * 3_600_000, 16, 1000
DAY = 86_400_000


def quarantine_nan(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): NaN and null values may not be stored."""
    bad = F.col("value").isNull() | F.isnan("value")
    return samples.where(~bad), samples.where(bad)


def upsert(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Stored samples with ``batch`` written over them; the greatest ``ingest_seq`` of a series and time wins, of equal ones the greatest value.

    ``ingest_seq`` is a number, or a struct of what orders the samples.
    """
    usable, _ = quarantine_nan(batch)
    rows = usable.withColumn("fresh", F.lit(1))
    if stored is not None:
        rows = stored.withColumns({"ingest_seq": F.lit(None).cast(usable.schema["ingest_seq"].dataType), "fresh": F.lit(0)}).unionByName(rows)
    return rows.groupBy("metric", "labels_sig", "labels", "ts").agg(F.max_by("value", F.struct("fresh", "ingest_seq", "value")).alias("value")).select("metric", "labels", "labels_sig", "ts", "value")


def retain(samples: DataFrame, now: int, keep_ms: int) -> DataFrame:
    return samples.where(F.col("ts") >= now - keep_ms)


def retain_packed(packed: DataFrame, now: int, keep_ms: int) -> DataFrame:
    """Runs that end within the time kept; a run across the limit stays whole."""
    return packed.where(F.col("end_ts") >= now - keep_ms)


def retention_report(samples: DataFrame, packed: DataFrame, events: DataFrame, now: int, keep_ms: int) -> DataFrame:
    """Rows that time retention drops from each table."""
    limit = now - keep_ms
    frames = (("samples", samples, "ts"), ("packed", packed, "end_ts"), ("events", events, "ts"))
    parts = [frame.agg(F.count_if(F.col(at) < limit).alias("dropped")).select(F.lit(name).alias("table"), "dropped") for name, frame, at in frames]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def dropped_days(spark: SparkSession, table: str, before_ms: int) -> list[str]:
    """Drop the partitions of ``table`` (partitioned by ``day``, days since the epoch) that end by ``before_ms``; their days.

    Partitions go through the catalog with their files; no other file is read or written.
    The day across the limit stays whole, ``retain`` hides its older rows.
    """
    days = [r["partition"].split("=", 1) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]  # a name a day
    if any(name != "day" for name, _ in days):
        raise ValueError("the table must be partitioned by day alone")
    gone = sorted((day for _, day in days if day.lstrip("-").isdigit() and (int(day) + 1) * DAY <= before_ms), key=int)
    if gone:
        spark.sql(f"ALTER TABLE {table} DROP " + ", ".join(f"PARTITION (day = {day})" for day in gone))
    return gone


def retain_size(parts: DataFrame, cap_bytes: int) -> DataFrame:
    """Parts (part, bytes) to keep, newest first while their sum stays within the cap; one row a part."""
    newer = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn("held", F.sum("bytes").over(newer)).where(F.col("held") <= cap_bytes)


def series_dictionary(samples: DataFrame) -> DataFrame:
    """One row for each metric and label set with a stable id."""
    distinct = samples.groupBy("metric", "labels_sig", "labels").agg(F.count("*").alias("samples"))
    return distinct.select(F.xxhash64("metric", "labels_sig").alias("series_id"), "metric", "labels", "labels_sig")


def id_collisions(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("series_id").agg(F.count("*").alias("n")).where("n > 1")


def pack(samples: DataFrame, now: int, least: int = LEAST_RUN, most: int = MOST_RUN, after_ms: int = PACK_AFTER_MS) -> tuple[DataFrame, DataFrame]:
    """(packed runs, raw rest): samples older than two hours of series with enough of them, in runs by time.

    Samples are numbered within a day of their series, and days by the sums of their
    counts, so no task sorts a whole series.
    """
    series, day = Window.partitionBy("metric", "labels_sig"), ["metric", "labels_sig", "day"]
    marked = samples.withColumns({"old": F.col("ts") < now - after_ms, "day": F.floor(F.col("ts") / DAY)})
    counts = marked.where("old").groupBy(*day).agg(F.count("*").alias("n"))
    counts = counts.withColumns({"n_old": F.sum("n").over(series), "before": F.sum("n").over(series.orderBy("day")) - F.col("n")}).drop("n")
    marked = marked.join(counts, day, "left")
    ready = F.col("old") & (F.coalesce("n_old", F.lit(0)) >= least)
    at = F.col("before") + F.row_number().over(Window.partitionBy(*day).orderBy("ts")) - 1
    runs = marked.where(ready).withColumn("at", at).withColumn("run", F.expr(f"at div {most}"))
    points = F.array_sort(F.collect_list(F.struct("ts", "value")))  # at most ``most`` of them
    packed = runs.groupBy("metric", "labels_sig", "labels", "run").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").cast("int").alias("count"), points.alias("points")).drop("run")
    return packed, marked.where(~ready).select(*samples.columns)


def unpack(packed: DataFrame, start: int, end: int) -> DataFrame:
    """Samples of the runs that overlap the range, within the range."""
    met = packed.where((F.col("end_ts") >= start) & (F.col("start_ts") <= end)).select("metric", "labels", "labels_sig", F.explode("points").alias("p"))
    return met.select("metric", "labels", "labels_sig", "p.ts", "p.value").where(F.col("ts").between(start, end))


def merge_raw_packed(raw: DataFrame, unpacked: DataFrame) -> DataFrame:
    """Union by series and time; the raw sample wins."""
    both = raw.withColumn("priority", F.lit(1)).unionByName(unpacked.withColumn("priority", F.lit(0)))
    return both.groupBy("metric", "labels_sig", "labels", "ts").agg(F.max_by("value", "priority").alias("value")).select("metric", "labels", "labels_sig", "ts", "value")


def merge_targets(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """Series of several queries in target order, each with its legend template."""
    out = None
    for i, (frame, template) in enumerate(frames):
        part = frame.select(F.lit(i).alias("target_idx"), F.lit(template).alias("legend"), "metric", "labels", "labels_sig", "ts", "value")
        out = part if out is None else out.unionByName(part)
    return out
