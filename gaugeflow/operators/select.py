"""Series selection: time range and label matchers over a samples frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label


def scan(samples: DataFrame, metric: str, start: int, end: int) -> DataFrame:
    """Samples of one metric with ``start <= ts <= end``; both conditions reach the Parquet reader."""
    return samples.where((F.col("metric") == metric) & F.col("ts").between(start, end))


def matcher(name: str, op: str, value: str) -> Column:
    """One label condition: ``=``, ``!=``, ``=~`` or ``!~`` (anchored); absent labels read as empty."""
    own = label(F.col("labels"), name)
    pattern = f"^(?:{value.replace('(?P<', '(?<')})\\z"
    tests = {"=": own == value, "!=": own != value, "=~": own.rlike(pattern), "!~": ~own.rlike(pattern)}
    if op not in tests:
        raise ValueError(f"unknown matcher {op!r}")
    return tests[op]


def match(samples: DataFrame, *matchers: tuple[str, str, str]) -> DataFrame:
    """Rows that pass all matchers; none keeps all rows."""
    return samples.where(reduce(lambda a, b: a & b, (matcher(*m) for m in matchers), F.lit(True)))


def series_order(vector: DataFrame) -> DataFrame:
    return vector.orderBy("labels_sig", "ts")
