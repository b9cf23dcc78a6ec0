"""Alerts over live samples: observation by event time, rules that change while the stream runs, state that ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alert_state import STATE, advance

LOOK_BACK_MS = 60_000
MOVES = "rule string, expr string, op string, threshold double, value double, status string, labels map<string,string>, labels_sig string, fired_at long, resolved_at long"


def observe_stream(samples: DataFrame, expr: str, interval: int, late_ms: int, start: int = 0) -> DataFrame:
    """Ticks (expr, labels, labels_sig, tick, value) of a stream of samples (labels, labels_sig, ts, value), as ``observe`` gives them.

    A tick comes out once the watermark, ``late_ms`` behind the newest sample, has passed
    it; samples may arrive in any order until then, later ones are left out. The state
    holds one value for each series and open tick. Spark applies conditions on the labels
    of the ticks to the samples already, and what they leave out doesn't move the watermark.
    """
    window = interval + LOOK_BACK_MS
    at = F.timestamp_millis("ts")
    # One millisecond longer than the range, so that it is closed at both ends.
    hop = F.window("at", f"{window + 1} milliseconds", f"{interval} milliseconds", f"{(start - window) % interval} milliseconds")
    grouped = samples.withColumn("at", at).withWatermark("at", f"{late_ms} milliseconds").groupBy(hop.alias("w"), "labels_sig")
    seen = grouped.agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.any_value("labels").alias("labels"))
    return seen.select(F.lit(expr).alias("expr"), "labels", "labels_sig", (F.unix_millis("w.end") - 1).alias("tick"), "value")


def run_alerts(ticks: DataFrame, read_rules: Callable[[SparkSession], DataFrame], folder: str, checkpoint: str, keep_ms: int | None = None):
    """Follow ``ticks`` (expr, labels, labels_sig, tick, value), a stream whose batches go on in time; the query is returned.

    ``read_rules`` is asked anew in every batch for (rule, expr, op, threshold, hold_ms,
    generation), so rules may come, change (with a new generation) and go without a
    restart; the state of rules that went, of series back below the threshold and, with
    ``keep_ms``, of vanished series ends. Transitions of batch n are in
    ``folder/transitions/batch=n``, written over when the batch is run again after a crash.
    The state of two batches is kept: one is read, the other written. ``folder`` must be
    one that driver and executors share.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.select("expr", "labels", "labels_sig", "tick", "value").write.mode("overwrite").parquet(f"{folder}/ticks")
        rules = read_rules(spark).select("rule", "expr", "op", "threshold", "hold_ms", "generation")
        rules.write.mode("overwrite").parquet(f"{folder}/rules")
        now = spark.read.schema(batch.select("expr", "labels", "labels_sig", "tick", "value").schema).parquet(f"{folder}/ticks")
        carried = spark.read.schema(STATE).parquet(f"{folder}/state/{(n - 1) % 2}") if n else None
        moves, state = advance(now, spark.read.schema(rules.schema).parquet(f"{folder}/rules"), carried, keep_ms=keep_ms)
        moves.write.mode("overwrite").parquet(f"{folder}/transitions/batch={n}")
        state.write.mode("overwrite").parquet(f"{folder}/state/{n % 2}")

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    """All transitions of ``run_alerts`` so far."""
    return spark.read.schema(f"{MOVES}, batch long").parquet(f"{folder}/transitions").drop("batch")
