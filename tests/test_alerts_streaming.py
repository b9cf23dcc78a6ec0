"""Alert timelines against an imperative machine and the stream; streaming ingest; hopping windows."""

import os
import random
import shutil

from pyspark.sql import functions as F

from gaugeflow.functions import labels as L
from gaugeflow.operators import alert_state, alerts, events, reduce, upkeep
from gaugeflow.operators import range_fn as R
from gaugeflow.streaming import alert_stream, hopping, ingest, live_alerts

RULES = [("r", "e", ">", 0.5, 30)]
RULE_SCHEMA = "rule string, expr string, op string, threshold double, hold_ms long"
TICK_SCHEMA = "rule string, labels map<string,string>, labels_sig string, tick long, value double"


def machine(ticks, hold):
    since = fired = None
    for t, v in ticks:
        if v > 0.5 and fired is None:
            since = t if since is None else since
            if t - since >= hold:
                fired = t
                yield ("firing", t, None)
        elif v <= 0.5:
            if fired is not None:
                yield ("resolved", fired, t)
            since = fired = None


def make_ticks(seed, keys):
    rng = random.Random(seed)
    return {f"k{i}": [(t, rng.choice([0.1, 0.9, 0.9])) for t in sorted(rng.sample(range(1000), 40))] for i in range(keys)}


def as_rows(series):
    return [("r", {"k": k}, f"k={k}", t, v) for k, p in series.items() for t, v in p]


def got(df):
    return sorted((r["labels_sig"], r["status"], r["fired_at"], r["resolved_at"] or 0) for r in df.collect())


def test_timeline_equals_machine(spark):
    series = make_ticks(1, 20)
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    done = alerts.timeline(spark.createDataFrame(as_rows(series), TICK_SCHEMA), rules)
    want = sorted((f"k={k}", s, f, t or 0) for k, p in series.items() for s, f, t in machine(p, 30))
    assert got(done) == want and len(want) > 50
    assert alerts.keep_rules(done, rules.where("false")).count() == 0
    bodies = [r["body"] for r in alerts.bodies(done).where("status = 'firing'").collect()]
    assert bodies and not any("resolved_at" in b for b in bodies)


def test_hold_repeat_and_gap(spark):
    rules = spark.createDataFrame([("r", "e", ">", 0.5, 30_000)], RULE_SCHEMA)
    run = lambda ticks: got(alerts.timeline(spark.createDataFrame(as_rows({"a": ticks}), TICK_SCHEMA), rules))
    assert run([(0, 0.9), (15_000, 0.9), (31_000, 0.9), (40_000, 0.9)]) == [("k=a", "firing", 31_000, 0)]
    assert run([(0, 0.9), (100_000, 0.9)]) == [("k=a", "firing", 100_000, 0)]
    assert run([(0, 0.9), (10_000, 0.1), (31_000, 0.9)]) == []


def test_stream_equals_timeline(spark, tmp_path):
    series = make_ticks(2, 6)
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    landed = tmp_path / "ticks"
    for part in range(2):
        cut = {k: [x for x in p if (x[0] >= 500) == bool(part)] for k, p in series.items()}
        spark.createDataFrame(as_rows(cut), TICK_SCHEMA).coalesce(1).write.parquet(str(landed / f"p{part}"))
        ticks = spark.readStream.schema(TICK_SCHEMA).option("recursiveFileLookup", "true").parquet(str(landed))
        out = alert_stream.alert_stream(ticks, rules.select("rule", "op", "threshold", "hold_ms", F.lit(0).cast("long").alias("generation")))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = alerts.timeline(spark.createDataFrame(as_rows(series), TICK_SCHEMA), rules)
    assert got(spark.read.parquet(str(tmp_path / "out"))) == got(batch)


def test_replay_by_blocks_equals_machine(spark):
    rng = random.Random(4)
    series = make_ticks(4, 15)
    series |= {f"long{i}": [(t, rng.choice([0.1] + [0.9] * 12)) for t in range(0, 1000, 7)] for i in range(10)}
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    want = sorted((f"k={k}", s, f, t or 0) for k, p in series.items() for s, f, t in machine(p, 30))
    ticks = spark.createDataFrame(as_rows(series), TICK_SCHEMA)
    for block in (1, 50, 300, 10_000):
        assert got(alert_state.replay(ticks, rules, block)) == want
    # in steps, each going on from the state before
    state, found = None, []
    for low in range(0, 1000, 250):
        moves, state = alert_state.advance(ticks.where(F.col("tick").between(low, low + 249)), rules, state, block_ms=100)
        found += got(moves)
        rows = state.collect()
        state = spark.createDataFrame(rows, alert_state.STATE)
    assert sorted(found) == want and 0 < len(rows) < len(series)
    assert alert_state.replay(ticks.where("false"), rules).count() == 0


SAMPLE = "labels map<string,string>, labels_sig string, ts long, value double"


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, SAMPLE).coalesce(1).write.parquet(str(folder / name))


def live(spark, folder):
    stream = spark.readStream.schema(SAMPLE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    return live_alerts.observe_stream(stream, "e", 1000, 100_000)


def test_live_alerts_equal_the_timeline(spark, tmp_path):
    rng = random.Random(6)
    rows = [({"k": k}, f"k={k}", t, rng.choice([0.1, 0.9, 0.9, 0.9])) for k in "abc" for t in rng.sample(range(200_000, 500_000), 30)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[2] + rng.randrange(50_000))
    for i in range(3):
        land(spark, tmp_path / "in", f"p{i}", rows[i * 30 : i * 30 + 30])
    land(spark, tmp_path / "in", "p9", [({}, "closing", 2_000_000, 0.0)])
    asked = lambda s: s.createDataFrame([("r", "e", ">", 0.5, 20_000, 0)], RULE_SCHEMA + ", generation long")
    live_alerts.run_alerts(live(spark, tmp_path / "in"), asked, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    samples = spark.createDataFrame(rows, SAMPLE).withColumn("metric", F.lit("m"))
    want = alerts.timeline(alerts.observe(samples, "r", 1000, 200_000, 600_000), asked(spark))
    assert got(live_alerts.transitions(spark, str(tmp_path / "out"))) == got(want) and want.count() > 5


def test_rules_change_while_the_stream_runs(spark, tmp_path):
    low, high = ({"k": "a"}, "k=a", 0.1), ({"k": "a"}, "k=a", 0.9)
    seen = []

    def asked(s):
        """r fires from the first batch on, is dropped while ticks of 200 s go by and comes again as another one."""
        n = len(seen)
        seen.append(n)
        rules = {0: [("r", "e", ">", 0.5, 0, 0)], 1: [("other", "e", ">", 5.0, 0, 0)]}.get(n, [("r", "e", ">", 0.5, 0, 1)])
        return s.createDataFrame(rules, RULE_SCHEMA + ", generation long")

    for i, (t, (labels, sig, v)) in enumerate([(100, high), (200, high), (300, high), (400, low)]):
        spark.createDataFrame([("e", labels, sig, t, v)], "expr string, " + TICK_SCHEMA.removeprefix("rule string, ")).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        os.utime(next((tmp_path / "in" / f"p{i}").glob("part-*")), (1000 + i, 1000 + i))
    ticks = spark.readStream.schema("expr string, " + TICK_SCHEMA.removeprefix("rule string, ")).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live_alerts.run_alerts(ticks, asked, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    moves = live_alerts.transitions(spark, str(tmp_path / "out"))
    assert got(moves) == [("k=a", "firing", 100, 0), ("k=a", "firing", 300, 0), ("k=a", "resolved", 300, 400)] and len(seen) >= 4
    assert spark.read.schema(alert_state.STATE).parquet(str(tmp_path / "out" / "state" / str((len(seen) - 1) % 2))).count() == 0


def test_vanished_series_lose_their_state(spark):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    ticks = spark.createDataFrame(as_rows({"gone": [(0, 0.9)], "here": [(0, 0.9), (5000, 0.9)]}), TICK_SCHEMA)
    assert [r["labels_sig"] for r in alert_state.advance(ticks, rules, keep_ms=1000)[1].collect()] == ["k=here"]


def test_each_transition_has_its_attempt(spark, tmp_path):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    series = {f"k{i}": [(0, 0.9), (50, 0.9)] for i in range(10)}
    made = alerts.bodies(alerts.timeline(spark.createDataFrame(as_rows(series), TICK_SCHEMA), rules))

    def send(body):
        if '"k3"' in body:
            raise OSError("refused\nby the target")

    alerts.attempt_each(made, send, str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(rows) == 10 and [(r["labels_sig"], r["error"]) for r in rows if not r["ok"]] == [("k=k3", "refused")]


def test_old_days_are_dropped(spark, tmp_path):
    day = upkeep.DAY
    rows = [("m", d * day + i, float(i), d) for d in range(5) for i in range(3)]
    spark.createDataFrame(rows, "metric string, ts long, value double, day int").write.partitionBy("day").option("path", str(tmp_path / "t")).saveAsTable("kept_days")
    files = lambda: {f for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    try:
        assert upkeep.dropped_days(spark, "kept_days", 2 * day + 1) == ["0", "1"]
        assert sorted({r["day"] for r in spark.table("kept_days").collect()}) == [2, 3, 4] and spark.table("kept_days").count() == 9
        left = {f for f in before if int(f.parent.name.removeprefix("day=")) > 1}
        assert left <= files() <= before
        assert upkeep.dropped_days(spark, "kept_days", 2 * day + 1) == []
    finally:
        spark.sql("drop table kept_days")


def test_ingest_samples_and_restart(spark, tmp_path):
    folder, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "cp")
    folder.mkdir()

    def run():
        ingest.ingest_samples(ingest.text_stream(spark, str(folder)), table, check, drop=["^go_"], target_labels={"job": "app"}, url="http://h:9/m").awaitTermination()
        return sorted((r["metric"], r["labels_sig"], r["ts"], r["value"]) for r in spark.read.parquet(table).collect())

    (folder / "a.prom").write_text('x{a="1"} 5 1000\ngo_gc 1 1000\ny 2 1000\n')
    (folder / "bad.prom").write_text("x 5 1000\nbroken\n")
    first = run()
    assert first == [("x", "a=1,instance=h:9,job=app", 1000, 5.0), ("y", "instance=h:9,job=app", 1000, 2.0)]
    assert run() == first
    (folder / "b.prom").write_text('x{a="1"} 6 1000\nx{a="1"} 7 2000\n')
    second = [("x", "a=1,instance=h:9,job=app", 1000, 6.0), ("x", "a=1,instance=h:9,job=app", 2000, 7.0), first[1]]
    assert run() == second
    # a crash after the overwrite removed a partition and before the batch was committed
    shutil.rmtree(tmp_path / "table" / "metric=x")
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    assert run() == second
    (folder / "c.prom").write_text("y 9 1000\n" + "".join(f"y {i % 7} 1000\n" for i in range(500)) + "y 3 1000\n")
    assert run() == [*second[:2], ("y", "instance=h:9,job=app", 1000, 3.0)]


def test_text_stream_from_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, seconds in (("old", 1000), ("new", 2000)):
        (folder / name).write_text(f"{name}\n")
        os.utime(folder / name, (seconds, seconds))

    def lines(name, **how):
        stream = ingest.text_stream(spark, str(folder), **how).select("line")
        stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["line"] for r in spark.read.schema("line string").parquet(str(tmp_path / name)).collect())

    assert lines("all") == ["new", "old"]
    assert lines("end", from_end=True, now_ms=1_500_000) == ["new"]


def test_delivery_log(spark, tmp_path):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    ticks = spark.createDataFrame([("r", {"a": "1"}, "a=1", t, float(t < 60)) for t in range(0, 100, 10)], TICK_SCHEMA)
    moves, log = alerts.timeline(ticks, rules), str(tmp_path / "log")
    alerts.deliver(moves, str(tmp_path / "sink"), log)
    assert sorted(r["status"] for r in spark.read.json(str(tmp_path / "sink")).collect()) == sorted(r["status"] for r in moves.collect())
    (tmp_path / "file").write_text("")
    alerts.deliver(moves, str(tmp_path / "file" / "sink"), log)  # no folder can be made below a file
    rows = spark.read.parquet(log)
    assert {(r["ok"], r["error"] == "") for r in rows.collect()} == {(True, True), (False, False)}
    counts = reduce.alert_counters(moves, rows, ticks).first()
    assert (counts["sends"], counts["send_failures"]) == (2 * moves.count(), moves.count())


def test_ingest_events_once(spark, tmp_path):
    folder, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "cp")
    folder.mkdir()

    def to_events(batch):
        kept = events.match_records(events.parse_json(batch), [("level", "equals", "error")])
        return events.map_events(kept, "app", "error", {"msg": "$.msg"}, ts_path="$.ts")

    def run():
        ingest.ingest_events(ingest.text_stream(spark, str(folder)), to_events, table, check).awaitTermination()
        return sorted((r["ts"], r["payload"]["msg"]) for r in spark.read.parquet(table).collect())

    (folder / "a.log").write_text('{"level":"error","ts":"5","msg":"x"}\n{"level":"info","ts":"6","msg":"y"}\nnoise\n')
    assert run() == [(5, "x")]
    (folder / "b.log").write_text('{"level":"error","ts":"5","msg":"x"}\n{"level":"error","ts":"7","msg":"z"}\n')
    assert run() == [(5, "x"), (7, "z")]


def test_hopping_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [("m", {"s": k}, f"s={k}", t, float(rng.randrange(30))) for k in "ab" for t in rng.sample(range(0, 20_000), 60)]
    schema = "metric string, labels map<string,string>, labels_sig string, ts long, value double"
    flush = [("m", {"s": "z"}, "s=z", 10_000_000, 0.0)]
    (samples := spark.createDataFrame(rows, schema)).coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    spark.createDataFrame(flush, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "p1"))
    for fn in ("rate", "irate", "increase", "delta", "sum_over_time", "count_over_time"):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = f"hop_{fn}"
        q = hopping.streaming_range(stream, fn, 5000, 2000, start=1000, late_ms=1_000_000).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        stream_rows = {(r["labels_sig"], r["ts"]): round(r["value"], 6) for r in spark.table(name).collect() if 5000 <= r["ts"] <= 19_000}
        batch = R.range_function(samples, fn, 5000, 5000, 19_000, 2000)
        assert stream_rows == {(r["labels_sig"], r["ts"]): round(r["value"], 6) for r in batch.collect()}


HOP_SCHEMA = "metric string, labels map<string,string>, labels_sig string, ts long, value double"


def hop(spark, folder, fn, window, step, start, **more):
    """Rows of the stream over the files of a folder, one file a batch."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = spark.readStream.schema(HOP_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"hop_{fn}_{window}_{step}"
    q = hopping.streaming_range(stream, fn, window, step, start=start, **more).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    rows = spark.table(name).collect()
    state = q.lastProgress["stateOperators"]
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return {(r["labels_sig"], r["ts"]): round(r["value"], 6) for r in rows}, len(rows), state


def test_streamed_panes_equal_batch(spark, tmp_path):
    """Wide, off-grid and sparse windows, with samples on both ends of ranges, resets and gaps longer than a window."""
    rng = random.Random(8)
    times = {k: sorted({*rng.sample(range(0, 9_000), 50), *rng.sample(range(14_000, 20_000), 30), *(1000 * i for i in range(3, 8))}) for k in "ab"}
    rows = [("m", {"s": k}, f"s={k}", t, float(rng.randrange(30))) for k in "ab" for t in times[k]]
    (samples := spark.createDataFrame(rows, HOP_SCHEMA)).persist()
    for i, at in enumerate((7_000, 12_000, 40_000)):  # in order of time between the files, in none within
        low = (0, 7_000, 12_000)[i]
        samples.where(F.col("ts").between(low, at - 1)).orderBy(F.rand(3)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    spark.createDataFrame([("m", {"s": "z"}, "s=z", 10_000_000, 0.0)], HOP_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "p3"))
    cases = [("rate", 5000, 500, 1000), ("irate", 4999, 700, 1001), ("avg_over_time", 5000, 500, 1000), ("rate", 900, 2000, 1000)]
    for fn, window, step, start in cases:
        got, n, state = hop(spark, tmp_path / "in", fn, window, step, start, late_ms=8_000)
        end = start + (30_000 - start) // step * step
        batch = R.range_function(samples, fn, window, start, end, step)
        want = {(r["labels_sig"], r["ts"]): round(r["value"], 6) for r in batch.collect()}
        assert {k: v for k, v in got.items() if start <= k[1]} == want, (fn, window, step)
        assert n == len(got)
        # what remains is the sample that moved the watermark
        assert sum(s["numRowsTotal"] for s in state) <= 1, state
    samples.unpersist()


def test_label_fingerprint_keeps_commas_apart(spark):
    row = spark.createDataFrame([({"a": "1,b=2"}, {"a": "1", "b": "2"})], "x map<string,string>, y map<string,string>")
    same = row.select((L.signature(F.col("x")) == L.signature(F.col("y"))).alias("s"), (L.fingerprint(F.col("x")) == L.fingerprint(F.col("y"))).alias("f")).first()
    assert same["s"] and not same["f"]
