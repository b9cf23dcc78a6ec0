"""Contiguous shards of near-equal bytes from global prefix sums.

The rows, reduced to id, size and checksum, are range-partitioned by id and
written once, so that partition numbers are fixed; the totals of the partitions
(one row each) are added up and sent back to their partitions, where a running
sum gives each row its global byte offset. Nothing but the totals meets in one task.

Defined results: null and empty texts count 8 bytes; repeated rows each get a
slot; rows with a null id come first; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

ROW_BYTES = 8


def shard(docs: DataFrame, shards: int = 24, overhead: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    A row belongs to the shard of the equal byte target that its middle falls
    into, so a shard misses its target by less than one row on either side.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The last key tells rows apart that are alike, so that many of them don't meet in one partition.
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "text_crc32", "size", "tie").drop("tie")
    placed = cut(spread.withColumn("part", F.spark_partition_id()))
    # One row per partition: their number is a setting and doesn't grow with the rows.
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    bases = totals.select("part", F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("byte_base"), F.coalesce(F.sum("rows").over(over), F.lit(0)).alias("row_base"), F.sum("bytes").over(Window.partitionBy()).alias("whole"))
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    spot = (
        placed.withColumns({"ahead": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"), "nth": F.row_number().over(within) - 1})
        .join(F.broadcast(bases), "part")
        .withColumns({"middle": F.col("byte_base") + F.col("ahead") + F.expr("size div 2"), "row": F.col("row_base") + F.col("nth")})
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(middle * {shards}) div whole")).cast("int"))
    )
    spot = cut(spot.select("doc_id", "size", "text_crc32", "shard", "row"))
    firsts = spot.groupBy("shard").agg(F.min("row").alias("first"))  # at most ``shards`` rows
    return spot.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
