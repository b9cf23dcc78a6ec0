"""Registered queries of the streaming operators.

Each lands rows of the given tables as files, runs the stream over all of them
until none are left, and returns what the stream wrote. The SQL counterparts are
those of the batch definitions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import alerts, encoded, events, reduce
from ..streaming import alert_stream, hopping, ingest, live_alerts, tail
from . import adapters as D
from . import oracles as O
from .adapters import DAY, HOUR, T0
from .oracles import END, START
from .registry import ORACLES, QUERIES, flat

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors see; a temporary one only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a session on a cluster must name spark.checkpoint.dir")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/stream-{uuid.uuid4().hex}"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, for the streams started within."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _register(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


@_register("t1_alert_stream", O.alert_timeline(40.0, 2 * HOUR, HOUR))
def _t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    ticks = alerts.observe(D.gauge(spark, sf_dir), "high", HOUR, START, END)
    ticks.select("rule", "labels", "labels_sig", "tick", "value").write.parquet(f"{folder}/ticks")
    rules = spark.createDataFrame([("high", ">", 40.0, 2 * HOUR, 0)], "rule string, op string, threshold double, hold_ms long, generation long")
    with rocks(spark):
        stream = spark.readStream.schema("rule string, labels map<string,string>, labels_sig string, tick long, value double").parquet(f"{folder}/ticks")
        out = alert_stream.alert_stream(stream, rules)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(alert_stream.OUT).parquet(f"{folder}/out").select("labels_sig", "status", "fired_at", "resolved_at", F.round("value", 6).alias("value"))


@_register("t3_live_alerts", O.alert_timeline(40.0, 2 * HOUR, HOUR))
def _t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, row = scratch(spark), "labels map<string,string>, labels_sig string, ts long, value double"
    samples = D.gauge(spark, sf_dir).where(F.col("ts").between(START - HOUR - live_alerts.LOOK_BACK_MS, END))
    samples.select("labels", "labels_sig", "ts", "value").write.parquet(f"{folder}/samples/part=0")
    # a sample of a series of its own, below the threshold, by which the stream knows that the last tick is over
    closing = spark.createDataFrame([({}, "closing", END + 3 * HOUR, 0.0)], row)
    closing.write.parquet(f"{folder}/samples/part=1")
    stream = spark.readStream.schema(f"{row}, part int").parquet(f"{folder}/samples")
    ticks = live_alerts.observe_stream(stream, "gauge", HOUR, HOUR, START).where(F.col("tick").between(START, END))
    rules = lambda s: s.createDataFrame([("high", "gauge", ">", 40.0, 2 * HOUR, 0)], "rule string, expr string, op string, threshold double, hold_ms long, generation long")
    live_alerts.run_alerts(ticks, rules, folder, f"{folder}/check").awaitTermination()
    return live_alerts.transitions(spark, folder).select("labels_sig", "status", "fired_at", "resolved_at", F.round("value", 6).alias("value"))


@_register("t5_sample_ingest", f"with {O.GAUGE} select 'instance=h:9100,job=app,shard=' || shard || ',type=' || type as labels_sig, ts, round(v, 2) as value from s")
def _t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrape text of the gauge, with a metric that the deny-list drops."""
    folder = scratch(spark)
    g = D.gauge(spark, sf_dir)
    line = F.concat(F.lit('event_value{shard="'), F.col("labels")["shard"], F.lit('",type="'), F.col("labels")["type"], F.lit('"} '), F.format_string("%.2f", "value"), F.lit(" "), F.col("ts").cast("string"))
    g.select(line.alias("value")).unionByName(g.select(F.concat(F.lit("go_gc 1 "), F.col("ts").cast("string")).alias("value"))).write.text(f"{folder}/scrapes")
    ingest.ingest_samples(ingest.text_stream(spark, f"{folder}/scrapes"), f"{folder}/table", f"{folder}/check", drop=["^go_"], target_labels={"job": "app"}, url="http://h:9100/metrics").awaitTermination()
    return flat(spark.read.parquet(f"{folder}/table"))


@_register("t6_event_ingest", f"with {O.EV} select ts, type as kind_type, cast(usr as varchar) as usr, printf('%.2f', amount) as amount from ev where type = 'error'")
def _t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON log lines, landed twice; each event is stored once."""
    folder = scratch(spark)
    lines = D.log_lines(spark, sf_dir, "json").select(F.col("line").alias("value"))
    lines.unionByName(lines).write.text(f"{folder}/logs")

    def to_events(batch: DataFrame) -> DataFrame:
        kept = events.match_records(events.parse_json(batch), [("type", "equals", "error")])
        return events.map_events(kept, "app", "error", {"type": "$.type", "user": "$.user", "amount": "$.amount"}, ts_path="$.at.ms")

    ingest.ingest_events(ingest.text_stream(spark, f"{folder}/logs"), to_events, f"{folder}/table", f"{folder}/check").awaitTermination()
    p = F.col("payload")
    return spark.read.parquet(f"{folder}/table").select("ts", p["type"].alias("kind_type"), p["user"].alias("usr"), p["amount"].alias("amount"))


@_register("s11_log_files", f"with {O.EV} select type || ' ' || usr as line, count(*) as n from ev group by 1")
def _s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    D.log_lines(spark, sf_dir, "plain").select(F.col("line").alias("value")).write.text(f"{folder}/logs")
    stream = ingest.text_stream(spark, f"{folder}/logs", max_files=2)
    stream.select("line").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("line string").parquet(f"{folder}/out").groupBy("line").agg(F.count("*").alias("n"))


@_register("s11_tailed_files", f"with {O.EV} select type || ' ' || usr as line, count(*) as n from ev group by 1")
def _s11_tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines by the tailing source, in two runs with files added between them."""
    folder = scratch(spark)
    for half in (0, 1):
        D.log_lines(spark, sf_dir, "plain").where(F.col("event_id") % 2 == half).select(F.col("line").alias("value")).write.mode("append").text(f"{folder}/logs")
        stream = tail.tail_stream(spark, f"{folder}/logs", pattern="part-*.txt")
        stream.select("line").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("line string").parquet(f"{folder}/out").groupBy("line").agg(F.count("*").alias("n"))


def _encoded(name: str, where: str, start: int, end: int, *matchers: tuple[str, str, str]):
    @_register(name, f"with {O.GAUGE} select sig as labels_sig, ts, round(v, 6) as value from s where {where} and ts between {start} and {end}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark)
        encoded.write(D.gauge(spark, sf_dir), folder)
        return flat(encoded.scan(spark, folder, "event_value", start, end, *matchers))


_encoded("s1_encoded_scan", "true", O.LOW, O.HIGH)
_encoded("f1_encoded_eq", "type = 'click'", START, END, ("type", "=", "click"), ("absent", "=", ""))
_encoded("f2_encoded_ne", "type != 'click'", START, END, ("type", "!=", "click"))
_encoded("f3_encoded_re", "type in ('click', 'view')", START, END, ("type", "=~", "click|v.*"))
_encoded("f4_encoded_nre", "shard not in ('1', '2')", START, END, ("shard", "!~", "[12]"))
_encoded("f5_encoded_conjunction", "type in ('click', 'view') and shard != '3'", O.LOW, O.HIGH, ("type", "=~", "click|view"), ("shard", "!=", "3"))


@_register("a20_stored_figures", f"with {O.GAUGE} select count(*) as samples, min(ts) as min_ts, max(ts) as max_ts from s")
def _a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    encoded.write(D.gauge(spark, sf_dir), folder)
    return reduce.stored_figures(spark, f"{folder}/samples", encoded.SAMPLES)


def _t7(name: str, fn: str, step: int = 6 * HOUR, window: int = 12 * HOUR):
    low, high = T0, T0 + 30 * DAY

    @_register(name, f"with {O.ranged(fn, O.counter(40), start=low, end=high, step=step, window=window)} select sig as labels_sig, t as ts, round(v, 6) as value from r")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark)
        samples = D.counter(spark, sf_dir, 40)
        schema = samples.schema
        samples.write.parquet(f"{folder}/in")
        # one late row moves the watermark past the last window
        samples.limit(1).select("metric", "labels", L.signature(F.col("labels")).alias("labels_sig"), F.lit(T0 + 400 * DAY).alias("ts"), "value").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        out = hopping.streaming_range(stream, fn, window, step, start=low, late_ms=60 * DAY)
        with rocks(spark):
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return flat(spark.read.schema(out.schema).parquet(f"{folder}/out").where(F.col("ts").between(low, high)))

    return run


for _fn in ("rate", "increase", "irate", "delta", "avg_over_time", "sum_over_time", "min_over_time", "max_over_time", "count_over_time"):
    _t7(f"t7_stream_{_fn}", _fn)
_t7("t7_wide_rate", "rate", HOUR)
_t7("t7_sparse_max_over_time", "max_over_time", 6 * HOUR, 2 * HOUR)
