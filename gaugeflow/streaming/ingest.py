"""Incremental ingest of landed files; the checkpoint is the read position.

The unit is the file: producers rotate files into the folder. Late rows are
upserted or inserted like any others, without a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import insert_new, with_id
from ..operators.upkeep import upsert
from ..sources import exposition

#: Up to so many values of a partition column are named in the condition that prunes a table.
MOST_NAMED = 5000


def text_stream(spark: SparkSession, folder: str, max_files: int | None = None, from_end: bool = False, now_ms: int = 0) -> DataFrame:
    """(file, file_ms, block, line) of files as they land; ``from_end`` leaves out files older than ``now_ms``.

    ``block`` is where the part of the file that the line was read with starts.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(folder)
    if from_end:
        files = files.where(F.unix_millis("_metadata.file_modification_time") >= now_ms)
    return files.select(F.col("_metadata.file_path").alias("file"), F.unix_millis("_metadata.file_modification_time").alias("file_ms"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where none has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _met(table: DataFrame, batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``table`` in the partitions that ``batch`` meets; a column with few values there prunes the files listed."""
    for column in columns:
        named = [row[0] for row in batch.select(column).distinct().limit(MOST_NAMED + 1).collect()]
        if len(named) <= MOST_NAMED:
            table = table.where(F.col(column).isin(named))
    return table.join(batch.select(*columns).distinct(), list(columns), "left_semi")


def ingest_samples(lines: DataFrame, table: str, checkpoint: str, keep: Sequence[str] = (), drop: Sequence[str] = (), target_labels: dict[str, str] | None = None, url: str = ""):
    """Scrape files to the samples table at ``table``: parse, filter, label, upsert.

    The table is partitioned by metric and day; a batch reads and rewrites only the
    partitions it touches. Of several values for a series and time the last line wins.
    What a batch will write is complete under ``checkpoint`` before the table is touched;
    if the batch fails from there on, the next try writes that again, whatever the table
    has lost meanwhile.
    """
    labels = F.create_map(*(F.lit(x) for pair in (target_labels or {}).items() for x in pair)) if target_labels else F.create_map().cast("map<string,string>")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed, _ = exposition.parse(batch.withColumns({"at": F.monotonically_increasing_id(), "scrape_ts": F.col("file_ms"), "url": F.lit(url), "target_labels": labels}))
        rows = exposition.default_ts(exposition.merge_target_labels(exposition.keep_metrics(parsed, keep, drop)))
        day = F.expr("ts div 86400000")
        merged, ready = f"{checkpoint}/merged", f"{checkpoint}/ready"
        complete = _stored(spark, ready)
        if complete is None or complete.where(F.col("batch") == batch_id).isEmpty():
            fresh = rows.select("metric", "labels", "labels_sig", "ts", "value", F.struct("file_ms", "file", "block", "at").alias("ingest_seq"), day.alias("day")).persist()
            stored = _stored(spark, table)
            if stored is not None:
                stored = _met(stored, fresh, ["metric", "day"]).select("metric", "labels", "labels_sig", "ts", "value")
            upsert(stored, fresh.drop("day")).withColumn("day", day).write.mode("overwrite").parquet(merged)
            spark.range(1).select(F.lit(batch_id).alias("batch")).coalesce(1).write.mode("overwrite").parquet(ready)
            fresh.unpersist()
        spark.read.parquet(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric", "day").parquet(table)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_events(lines: DataFrame, to_events: Callable[[DataFrame], DataFrame], table: str, checkpoint: str):
    """Log files to the events table at ``table``: parse and map by ``to_events``, insert what is new.

    The table is partitioned by day and batch. An id covers the time, so only the days
    that a batch meets are compared; a batch that runs again replaces its own rows only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        named = with_id(to_events(batch)).withColumn("day", F.expr("ts div 86400000")).persist()
        stored = _stored(spark, table)
        if stored is not None:
            stored = _met(stored.where(F.col("batch") != batch_id), named, ["day"])
        insert_new(named, stored).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(table)
        named.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
