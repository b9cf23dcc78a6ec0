"""Samples from landed scrape files in the text exposition format."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import signature

#: A name is all up to a brace or blank.
NAME = r"[^{ \t]+"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
NUMBER = r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?))|(?i:nan)"
_PAIR = r'[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*"(?:[^"\\]|\\.)*"'
#: Fields after the time are ignored.
LINE = rf"^\s*({NAME})(?:\{{\s*((?:{_PAIR}\s*,?\s*)*)\}}\s*|\s+)({NUMBER})(?:\s+([+-]?\d+)(?:\s.*)?)?\s*$"


def read(spark, folder: str) -> DataFrame:
    """(file, line) of every text line under ``folder``."""
    return spark.read.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def _unescape(text: Column) -> Column:
    held = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    held = F.replace(F.replace(held, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(held, F.lit("\0"), F.lit("\\"))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, quarantine) of ``lines`` (file, line, ...); a file with any bad line is rejected whole."""
    used = lines.where((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    value = F.regexp_extract("line", LINE, 3)
    endless = value.rlike("(?i)inf")
    text = F.when(endless, F.concat(F.regexp_extract(value, "^[+-]?", 0), F.lit("Infinity"))).when(F.lower(value) == "nan", "NaN").otherwise(value)
    number, own_ts = text.try_cast("double"), F.regexp_extract("line", LINE, 4)
    # A number or time that doesn't fit its type is an error, not an infinity.
    fits = (endless | (F.abs(number) < float("inf")) | F.isnan(number)) & ((own_ts == "") | own_ts.try_cast("long").isNotNull())
    body = F.regexp_extract("line", LINE, 2)
    keys, values = F.regexp_extract_all(body, F.lit(LABEL), F.lit(1)), F.regexp_extract_all(body, F.lit(LABEL), F.lit(2))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), _unescape(v).alias("value")))
    last = F.filter("pairs", lambda x, i: ~F.exists(F.slice("pairs", i + 2, F.greatest(F.size("pairs") - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    parsed = used.withColumns({"good": F.col("line").rlike(LINE) & F.coalesce(fits, F.lit(False)), "pairs": pairs})
    bad = parsed.where(~F.col("good"))
    # Names of files, which the driver has listed, go to the lines: dealt by name, all lines of a file would meet in one task.
    samples = parsed.join(F.broadcast(bad.select("file").distinct()), "file", "left_anti").select(
        *lines.columns, F.regexp_extract("line", LINE, 1).alias("metric"), F.map_from_entries(last).alias("labels"), number.alias("value"), own_ts.try_cast("long").alias("own_ts")
    )
    return samples, bad.select(*lines.columns)


def host_port(url: Column) -> Column:
    """Host and port of a URL as its authority has them."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?([^/?#]+)", 1)


def merge_target_labels(samples: DataFrame, target_labels: str = "target_labels", url: str = "url") -> DataFrame:
    """Static target labels under the sample's own, and ``instance`` from the URL where unset."""
    own = F.col("labels")
    both = F.map_concat(F.map_filter(target_labels, lambda k, _: ~F.map_contains_key(own, k)), own)
    labels = F.when(F.map_contains_key(both, "instance"), both).otherwise(F.map_concat(F.map_filter(both, lambda k, _: k != "instance"), F.create_map(F.lit("instance"), host_port(F.col(url)))))
    out = samples.withColumn("labels", labels)
    return out.withColumn("labels_sig", signature(F.col("labels")))


def keep_metrics(samples: DataFrame, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Allow-list, then deny-list, of patterns searched anywhere in the metric name."""
    found = lambda patterns: reduce(lambda a, b: a | b, (F.col("metric").rlike(p) for p in patterns))
    out = samples.where(found(keep)) if keep else samples
    return out.where(~found(drop)) if drop else out


def default_ts(samples: DataFrame, scrape_ts: str = "scrape_ts") -> DataFrame:
    """The sample's own time, or the time of the scrape where it has none or 0."""
    return samples.withColumn("ts", F.coalesce(F.nullif("own_ts", F.lit(0).cast("long")), F.col(scrape_ts)))
