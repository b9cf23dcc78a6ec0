"""Arithmetic between vectors and scalars, and between vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _apply(op: str, left: Column, right: Column) -> Column:
    """Pointwise operator; division by zero gives 0."""
    if op == "/":
        return F.when(right == 0, F.lit(0.0)).otherwise(left / right)
    return {"+": left + right, "-": left - right, "*": left * right}[op]


def with_scalar(vector: DataFrame, op: str, scalar: float, scalar_left: bool = False) -> DataFrame:
    """``vector op scalar`` or ``scalar op vector``; metric and labels stay."""
    own, other = F.col("value"), F.lit(float(scalar))
    return vector.withColumn("value", _apply(op, other, own) if scalar_left else _apply(op, own, other))


def with_vector(left: DataFrame, op: str, right: DataFrame, broadcast: str = "rhs", right_single: bool | None = None) -> DataFrame:
    """``left op right`` where labels and timestamps are equal; the metric is dropped.

    If the right side has exactly one series, it meets every series of the left
    (``broadcast='rhs'``); with ``'both'`` a single left series also meets every
    series of the right, whose labels then stay. The number of series is a scalar
    subquery, so nothing is collected and one equi-join serves all cases; where the
    caller knows whether the right side has one series (``right_single``), none runs.
    """
    if broadcast not in ("rhs", "both", "none"):
        raise ValueError(f"unknown broadcast {broadcast!r}")
    # One series: least and greatest signature agree; one pair a task meets in the end.
    one = lambda side: side.agg(F.coalesce(F.min("labels_sig") == F.max("labels_sig"), F.lit(False))).scalar()
    any_series = F.lit(False) if broadcast == "none" else one(right) if right_single is None else F.lit(right_single)
    left_single = one(left) if broadcast == "both" else F.lit(False)
    lhs = left.select("ts", F.col("labels").alias("l_labels"), F.col("labels_sig").alias("l_sig"), F.col("value").alias("l_value"), any_series.alias("l_any"), left_single.alias("l_one"))
    rhs = right.select("ts", F.col("labels").alias("r_labels"), F.col("labels_sig").alias("r_sig"), F.col("value").alias("r_value"), any_series.alias("r_any"), left_single.alias("r_one"))
    lhs = lhs.withColumn("key", F.when(F.col("l_any") | F.col("l_one"), "").otherwise(F.col("l_sig")))
    rhs = rhs.withColumn("key", F.when(F.col("r_any") | F.col("r_one"), "").otherwise(F.col("r_sig")))
    theirs = F.col("l_one") & ~F.col("l_any")
    return lhs.join(rhs, ["key", "ts"]).select(
        F.lit("").alias("metric"),
        F.when(theirs, F.col("r_labels")).otherwise(F.col("l_labels")).alias("labels"),
        F.when(theirs, F.col("r_sig")).otherwise(F.col("l_sig")).alias("labels_sig"),
        "ts",
        _apply(op, F.col("l_value"), F.col("r_value")).alias("value"),
    )
