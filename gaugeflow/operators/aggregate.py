"""Aggregation across series at equal timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label, signature

OPS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.count(c).cast("double")}


def aggregate(vector: DataFrame, op: str, by: Sequence[str] = (), without: Sequence[str] = (), named_in: DataFrame | None = None) -> DataFrame:
    """``op`` over all series, or within groups of equal ``by`` labels, or of all labels but ``without``.

    Absent labels group as empty. With ``without``, the groups keep every label name
    met in the input but the listed ones. ``named_in`` is a frame with the same label
    names that is cheaper to read than the vector (the samples it comes from). Empty
    lists mean no grouping. Rows of different metrics stay apart; an expression's input
    has one metric.
    """
    if by and without:
        raise ValueError("by and without exclude each other")
    value = OPS[op]("value").alias("value")
    if by:
        keys = {f"_by{i}": label(F.col("labels"), name) for i, name in enumerate(by)}
        grouped = vector.select("metric", "ts", "value", *(c.alias(k) for k, c in keys.items())).groupBy("metric", "ts", *keys).agg(value)
        labels = F.create_map(*(x for k, name in zip(keys, by, strict=True) for x in (F.lit(name), F.col(k))))
    elif without:
        names = (vector if named_in is None else named_in).select(F.explode(F.map_keys("labels")).alias("name")).distinct().where(~F.col("name").isin(*without))
        # One short row: the label names of the whole input.
        kept = names.agg(F.array_sort(F.collect_set("name")).alias("names")).scalar()
        own = vector.select("metric", "ts", "value", F.col("labels").alias("given"), kept.alias("names"))
        own = own.select("metric", "ts", "value", F.map_from_arrays("names", F.transform("names", lambda n: F.coalesce(F.try_element_at("given", n), F.lit("")))).alias("labels"))
        grouped = own.groupBy("metric", "ts", "labels").agg(value)
        labels = F.col("labels")
    else:
        grouped = vector.groupBy("metric", "ts").agg(value)
        labels = F.create_map().cast("map<string,string>")
    return grouped.select("metric", labels.alias("labels"), signature(labels).alias("labels_sig"), "ts", "value")
