"""Threshold alerts with hold times: observation, batch timeline, delivery records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import compare_by
from .range_fn import range_function

EVENT_COLUMNS = ("rule", "expr", "op", "threshold", "value", "status", "labels", "labels_sig", "fired_at", "resolved_at")


@dataclass(frozen=True)
class Rule:
    name: str
    expr: str
    op: str
    threshold: float
    hold_ms: int = 0


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.expr, r.op, float(r.threshold), r.hold_ms) for r in rules], "rule string, expr string, op string, threshold double, hold_ms long")


def observe(vector: DataFrame, rule: str, interval: int, start: int, end: int) -> DataFrame:
    """Value of each series at every tick: its last point within the interval and a minute; none, no row."""
    seen = range_function(vector, "last_over_time", interval + 60_000, start, end, interval)
    return seen.select(F.lit(rule).alias("rule"), "labels", "labels_sig", F.col("ts").alias("tick"), "value")


def timeline(ticks: DataFrame, rules: DataFrame) -> DataFrame:
    """Firing and resolved transitions of ``ticks`` (rule, labels, labels_sig, tick, value).

    Runs of equal crossing state are islands; a run fires at its first tick that lies
    the hold time after the run's start, and resolves at the first tick after a run
    that fired. Unobserved ticks change nothing. Ticks of unknown rules are left out.
    """
    key = Window.partitionBy("rule", "labels_sig").orderBy("tick")
    island = Window.partitionBy("rule", "labels_sig", "island")
    rows = ticks.join(rules, "rule").withColumn("crossed", compare_by(F.col("value"), F.col("op"), F.col("threshold")))
    rows = rows.withColumn("turn", F.coalesce(F.lag("crossed").over(key) != F.col("crossed"), F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("turn").over(key)).withColumn("since", F.min("tick").over(island))
    held = F.when(F.col("crossed") & (F.col("tick") - F.col("since") >= F.col("hold_ms")), F.col("tick"))
    rows = rows.withColumn("fired", F.min(held).over(island))
    rows = rows.withColumn("was_fired", F.when((F.col("turn") == 1) & ~F.col("crossed"), F.lag("fired").over(key)))
    fires, ends = F.col("tick") == F.col("fired"), F.col("was_fired").isNotNull()
    return rows.where(fires | ends).select(
        "rule", "expr", "op", "threshold", "value", F.when(fires, "firing").otherwise("resolved").alias("status"), "labels", "labels_sig",
        F.when(fires, F.col("tick")).otherwise(F.col("was_fired")).alias("fired_at"), F.when(~F.coalesce(fires, F.lit(False)), F.col("tick")).alias("resolved_at"),
    )


def keep_rules(transitions: DataFrame, rules: DataFrame) -> DataFrame:
    """State after a change of the rule set: what belongs to rules that stay, by name."""
    return transitions.join(rules.select("rule"), "rule", "left_semi")


def bodies(transitions: DataFrame) -> DataFrame:
    """One JSON body for each transition; ``resolved_at`` is absent while firing."""
    fields = ("rule", "expr", "op", "threshold", "value", "status", "labels", "fired_at", "resolved_at")
    return transitions.select("rule", "labels_sig", "status", F.to_json(F.struct(*fields)).alias("body"))


def attempt(made: DataFrame, folder: str, log: str) -> None:
    """Write the bodies of ``made`` to ``folder``, one JSON line each, and append what came of it to ``log``.

    The log has (rule, labels_sig, status, ok, error), a row a body. A failed attempt is
    noted and not raised, so that alerting goes on; it isn't repeated.
    """
    error = ""
    try:
        made.select(F.col("body").alias("value")).write.mode("append").text(folder)
    except Exception as e:  # whatever the target raises is the outcome of the attempt
        error = str(e).partition("\n")[0] or type(e).__name__
    made.select("rule", "labels_sig", "status", F.lit(not error).alias("ok"), F.lit(error).alias("error")).write.mode("append").parquet(log)


def deliver(transitions: DataFrame, folder: str, log: str) -> None:
    """One delivery attempt of all transitions."""
    attempt(bodies(transitions), folder, log)


def attempt_each(made: DataFrame, send: Callable[[str], None], log: str) -> None:
    """One attempt for each body of ``made``, in the tasks, each with an outcome of its own in ``log``.

    ``send`` takes a body and raises where it fails; a failure is noted and not raised, so
    it stops neither its task nor the other bodies, and isn't repeated. A task that Spark
    runs again, after an executor is lost, sends its bodies again; the log, written by
    Spark's commit of tasks, has each attempt that counts once. No rows, no attempts.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            errors = []
            for body in part["body"]:
                try:
                    send(body)
                    errors.append("")
                except Exception as e:  # whatever the sender raises is the outcome of the attempt
                    errors.append(str(e).partition("\n")[0] or type(e).__name__)
            yield part[["rule", "labels_sig", "status"]].assign(ok=[not e for e in errors], error=errors)

    outcomes = made.select("rule", "labels_sig", "status", "body").mapInPandas(run, "rule string, labels_sig string, status string, ok boolean, error string")
    outcomes.write.mode("append").parquet(log)
