"""Samples, events and log lines derived from the business tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import signature

#: First millisecond of the events table's month, and useful spans.
DAY, HOUR = 86_400_000, 3_600_000
T0 = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(name: str) -> Column:
    """Milliseconds of a time without zone, read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({name} as timestamp_ntz)) div 1000")


def _frame(rows: DataFrame, metric: str, **labels: str) -> DataFrame:
    made = F.create_map(*(x for k, c in labels.items() for x in (F.lit(k), F.col(c).cast("string"))))
    return rows.select(F.lit(metric).alias("metric"), made.alias("labels"), signature(made).alias("labels_sig"), "ts", F.col("value").cast("double").alias("value"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (ms), type, shard, user, amount, props."""
    raw = table(spark, sf_dir, "events")
    return raw.select("event_id", _ms("ts").alias("ts"), F.col("event_type").alias("type"), (F.col("user_id") % 8).alias("shard"), F.col("user_id").alias("user"), F.col("value").alias("amount"), "props")


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge ``event_value{type, shard}``; of events at one time the last counts."""
    rows = event_rows(spark, sf_dir).groupBy("type", "shard", "ts").agg(F.max_by("amount", "event_id").alias("value"))
    return _frame(rows, "event_value", type="type", shard="shard")


def counter(spark: SparkSession, sf_dir: str, modulo: int | None = None) -> DataFrame:
    """Counter ``events_total{type, shard}``: events so far; ``modulo`` makes it reset.

    Numbered within days, with the days before added from a short table of day
    totals, so no series has to pass through one task.
    """
    rows = event_rows(spark, sf_dir).withColumn("day", F.expr(f"ts div {DAY}"))
    before = Window.partitionBy("type", "shard").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("type", "shard", "day").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("type", "shard", "day").orderBy("ts", "event_id")
    numbered = rows.withColumn("nth", F.row_number().over(within)).join(days, ["type", "shard", "day"])
    total = F.col("base") + F.col("nth")
    rows = numbered.withColumn("value", total if modulo is None else total % modulo).groupBy("type", "shard", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return _frame(rows, "events_total", type="type", shard="shard")


EDGES = (5.0, 10.0, 20.0, 30.0, 40.0)


def quantity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram ``order_qty_bucket{flag, le}``: line items by month of shipping and quantity."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.expr("date_trunc('month', cast(l_shipdate as timestamp_ntz))").alias("month"), F.col("l_quantity").alias("qty"))
    counts = rows.groupBy("flag", "month").agg(*(F.count_if(F.col("qty") <= e).alias(f"b{i}") for i, e in enumerate(EDGES)), F.count("*").alias(f"b{len(EDGES)}"))
    pairs = F.array(*(F.struct(F.lit(le).alias("le"), F.col(f"b{i}").alias("value")) for i, le in enumerate([*(f"{e:g}" for e in EDGES), "+Inf"])))
    flat = counts.select("flag", _ms("month").alias("ts"), F.explode(pairs).alias("p")).select("flag", "ts", "p.le", "p.value")
    return _frame(flat, "order_qty_bucket", flag="flag", le="le")


def orders_daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gauges ``orders_price{status}`` and ``orders_count{status}`` by day."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.expr("date_trunc('day', cast(o_orderdate as timestamp_ntz))").alias("day")).agg(F.sum("o_totalprice").alias("price"), F.count("*").alias("n")).withColumn("ts", _ms("day"))
    return _frame(rows.withColumn("value", F.col("price")), "orders_price", status="status"), _frame(rows.withColumn("value", F.col("n")), "orders_count", status="status")


def log_lines(spark: SparkSession, sf_dir: str, style: str) -> DataFrame:
    """event_id and a log line of every event: ``json``, ``logfmt``, ``regex``, ``plain`` or ``stamped``."""
    e = event_rows(spark, sf_dir)
    amount, user = F.format_string("%.2f", "amount"), F.col("user").cast("string")
    iso = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    line = {
        "json": F.concat(F.lit('{"at":{"ms":"'), F.col("ts").cast("string"), F.lit('"},"type":"'), F.col("type"), F.lit('","user":'), user, F.lit(',"amount":"'), amount, F.lit('"}')),
        "logfmt": F.concat(F.lit("ts="), F.col("ts").cast("string"), F.lit(" type="), F.col("type"), F.lit(' msg="user \\"'), user, F.lit('\\" paid" amount='), amount, F.lit(" type=x"), F.col("type"), F.lit(" ok")),
        "regex": F.concat(F.lit("["), F.col("type"), F.lit("] user="), user, F.lit(" amount="), amount),
        "plain": F.concat(F.col("type"), F.lit(" "), user),
        "stamped": F.concat(iso, F.lit("000000Z "), F.col("type"), F.lit(" "), user),
    }[style]
    return e.select("event_id", line.alias("line"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured events: source ``shard<n>``, kind the event type, payload user and amount."""
    e = event_rows(spark, sf_dir)
    return e.select(
        F.col("event_id").cast("string").alias("id"), "ts", F.concat(F.lit("shard"), "shard").alias("source"), F.col("type").alias("kind"),
        F.create_map(F.lit("user"), F.col("user").cast("string"), F.lit("amount"), F.format_string("%.2f", "amount")).alias("payload"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrape attempts, one an event: type ``error`` failed."""
    e = event_rows(spark, sf_dir)
    failed = F.col("type") == "error"
    return e.select(F.concat(F.lit("t"), "shard").alias("target"), F.col("event_id").alias("attempt"), "ts", F.when(failed, 0).otherwise(F.col("user")).cast("long").alias("samples"), F.when(failed, 500).otherwise(200).alias("code"), (F.col("user") % 100).alias("duration_ms"), F.when(failed, "status 500").otherwise("").alias("error"))


def relabel(samples: DataFrame, metric: str, scale: float = 1.0, **names: str) -> DataFrame:
    """The series of ``samples`` as another metric, with labels renamed (new name = old name) and values scaled."""
    labels = F.create_map(*(x for new, old in names.items() for x in (F.lit(new), F.col("labels")[old])))
    return samples.select(F.lit(metric).alias("metric"), labels.alias("labels"), signature(labels).alias("labels_sig"), "ts", (F.col("value") * scale).alias("value"))


def panel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, container and self metrics shaped from the event counter and gauge."""
    c, g = counter(spark, sf_dir), gauge(spark, sf_dir)
    out = relabel(c, "node_cpu_seconds_total", 0.5, cpu="shard", mode="type")
    for i, d in enumerate(("network_receive", "network_transmit", "disk_read", "disk_written"), 1):
        out = out.unionByName(relabel(c, f"node_{d}_bytes_total", 100.0 * i, device="type", host="shard"))
    for i, d in enumerate(("cpu_usage_seconds", "network_receive_bytes", "network_transmit_bytes", "fs_reads_bytes", "fs_writes_bytes"), 1):
        out = out.unionByName(relabel(c, f"container_{d}_total", float(i), name="type", image="shard"))
    out = out.unionByName(relabel(g, "container_memory_usage_bytes", 10.0, name="type", image="shard"))
    out = out.unionByName(relabel(g, "node_memory_MemTotal_bytes", 8.0, type="type", shard="shard")).unionByName(relabel(g, "node_memory_MemAvailable_bytes", 3.0, type="type", shard="shard"))
    for n, kind in ((1, "click"), (5, "view"), (15, "purchase")):
        out = out.unionByName(relabel(g.where(F.col("labels")["type"] == kind), f"node_load{n}", 1.0, shard="shard"))
    return out.unionByName(relabel(c, "http_requests_total", 1.0, status="type", path="shard")).unionByName(relabel(c, "self_scrapes_total", 1.0, type="type", shard="shard"))
