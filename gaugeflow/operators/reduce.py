"""Reductions of series to single figures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REDUCTIONS = ("lastNotNull", "last", "first", "max", "min", "mean", "sum")


def choose(calcs: Sequence[str]) -> str:
    """The first supported reduction of a list; ``lastNotNull`` if there is none."""
    return next((c for c in calcs if c in REDUCTIONS), "lastNotNull")


def stat(vector: DataFrame, calc: str = "lastNotNull") -> DataFrame:
    """One value for each series; nulls and NaN are skipped, except that ``last`` takes the last point as it is."""
    calc = choose([calc])
    fine = F.when(~F.isnan("value"), F.col("value"))
    at = F.when(fine.isNotNull(), F.col("ts"))
    value = {
        "lastNotNull": F.max_by(fine, at),
        "last": F.max_by("value", "ts"),
        "first": F.min_by(fine, at),
        "max": F.max(fine),
        "min": F.min(fine),
        "mean": F.avg(fine),
        "sum": F.sum(fine),
    }[calc]
    return vector.groupBy("metric", "labels_sig").agg(value.alias("value"))


def store_stats(samples: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """Number of samples, raw and packed."""
    counts = samples.agg(F.count("*").alias("n"))
    if packed is not None:
        counts = counts.unionByName(packed.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n")))
    return counts.agg(F.sum("n").alias("samples"))


def extent(samples: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """Least and greatest timestamp, raw and packed; null when empty."""
    ends = samples.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    if packed is not None:
        ends = ends.unionByName(packed.agg(F.min("start_ts").alias("low"), F.max("end_ts").alias("high")))
    return ends.agg(F.min("low").alias("min_ts"), F.max("high").alias("max_ts"))


@contextmanager
def _footers(spark: SparkSession) -> Iterator[None]:
    """Settings of the session under which Parquet aggregates are read from file footers."""
    own = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _stored_ends(spark: SparkSession, path: str, schema: str) -> DataFrame:
    stored = spark.read.schema(schema).parquet(path)
    return stored.agg(F.count("*").alias("samples"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def stored_figures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of a stored table: its samples, least and greatest timestamp, from the footers of its Parquet files; no row is read.

    The footers are read at once, by tasks; an empty table has 0 samples and null times. All
    files must carry statistics of ``ts``, as those that Spark writes do, and the columns of
    ``schema`` in its order: Spark finds the column in a footer by its place.
    """
    with _footers(spark):
        samples, low, high = _stored_ends(spark, path, schema).first()  # the figures themselves; counts of no footer add up to null
    return spark.createDataFrame([(samples or 0, low, high)], "samples long, min_ts long, max_ts long")


def panel_extent(vector: DataFrame) -> DataFrame:
    """Least and greatest time and value over all series."""
    return vector.agg(F.min("ts").alias("x_min"), F.max("ts").alias("x_max"), F.min("value").alias("y_min"), F.max("value").alias("y_max"))


def alert_counters(alert_events: DataFrame, deliveries: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Evaluations, deliveries, failures, and the alerts that are firing now, in one row."""
    latest = alert_events.groupBy("rule", "labels_sig").agg(F.max_by("status", F.struct(F.coalesce("resolved_at", "fired_at"), F.col("status"))).alias("status"))
    firing = latest.agg(F.count_if(F.col("status") == "firing").alias("firing")).scalar()
    sent = deliveries.agg(F.count("*").alias("n")).scalar()
    failed = deliveries.agg(F.count_if(~F.col("ok")).alias("n")).scalar()
    return evaluations.agg(F.count("*").alias("evaluations")).select("evaluations", sent.alias("sends"), failed.alias("send_failures"), firing.alias("firing"))


def health(targets: DataFrame, attempts: DataFrame) -> DataFrame:
    """Latest attempt of every target with its status: pending (none yet), down (error) or ok."""
    last = attempts.groupBy("target").agg(F.max_by(F.struct("ts", "samples", "code", "duration_ms", "error"), F.struct("ts", "attempt")).alias("last"))
    joined = targets.join(last, "target", "left")
    status = F.when(F.col("last").isNull(), "pending").when(F.col("last.error") != "", "down").otherwise("ok")
    return joined.select("target", F.col("last.ts").alias("last_ts"), F.col("last.samples").alias("samples"), F.col("last.code").alias("code"), F.col("last.duration_ms").alias("duration_ms"), F.coalesce("last.error", F.lit("")).alias("error"), status.alias("status"))
