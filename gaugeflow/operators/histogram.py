"""Quantiles of cumulative histogram buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import signature

INF = float("inf")


def _quantile(edges: Column, counts: Column, q: float) -> Column:
    """Interpolated quantile; edges ascend, ``counts`` belong to them; null if there is no observation."""
    n = F.size(edges)
    total = F.get(counts, n - 1)
    finite = F.filter(edges, lambda e: e < INF)
    top = F.get(finite, F.size(finite) - 1)
    if q >= 1:
        return F.when(total > 0, F.coalesce(top, F.lit(INF)))
    target = total * q
    at = (F.array_position(F.transform(counts, lambda c: c >= target), True) - 1).cast("int")
    high, low = F.get(edges, at), F.get(edges, at - 1)
    low = F.when(at > 0, low).otherwise(F.least(F.lit(0.0), high))
    before = F.when(at > 0, F.get(counts, at - 1)).otherwise(0.0)
    span = F.get(counts, at) - before
    inner = F.when(span <= 0, high).otherwise(low + (target - before) / span * (high - low))
    return F.when(total > 0, F.when(high == INF, F.coalesce(top, low)).otherwise(inner))


def histogram_quantile(vector: DataFrame, q: float, strict: bool = True) -> DataFrame:
    """``q``-quantile of every histogram (labels but ``le``) and timestamp; the metric is dropped.

    A bucket of the histogram that is missing at a timestamp counts as 0. A series
    without a readable ``le`` is an error, or left out if not ``strict``. The buckets
    of one histogram and time meet in an array, bounded by the number of buckets.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    text = F.try_element_at("labels", F.lit("le"))
    edge = F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[Ii]nf(inity)?)$"), text.try_cast("double"))
    rest = F.map_filter("labels", lambda k, _: k != "le")
    own = vector.select(rest.alias("labels"), signature(rest).alias("labels_sig"), "ts", "value", edge.alias("edge"), text.alias("le"))
    if strict:
        own = own.withColumn("edge", F.when(F.col("edge").isNull(), F.raise_error(F.concat(F.lit("series without a readable le: "), F.coalesce("le", F.lit("none"))))).otherwise(F.col("edge")))
    else:
        own = own.where(F.col("edge").isNotNull())
    universe = own.groupBy("labels_sig").agg(F.array_sort(F.collect_set("edge")).alias("edges"))
    points = own.groupBy("labels_sig", "labels", "ts").agg(F.collect_list(F.struct("edge", "value")).alias("got"))
    counts = F.transform("edges", lambda e: F.coalesce(F.get(F.filter("got", lambda x: x["edge"] == e), F.lit(0))["value"], F.lit(0.0)))
    full = points.join(universe, "labels_sig").withColumn("counts", counts)
    out = full.select(F.lit("").alias("metric"), "labels", "labels_sig", "ts", _quantile(F.col("edges"), F.col("counts"), q).alias("value"))
    return out.where(F.col("value").isNotNull())
