"""Small numeric cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import labels as L
from gaugeflow.operators import aggregate as A
from gaugeflow.operators import arith, histogram, rank, reduce, select, upkeep
from gaugeflow.operators import range_fn as R


def frame(spark, rows, metric="m"):
    """rows: (labels dict, ts, value)."""
    raw = spark.createDataFrame([(metric, k, t, float(v)) for k, t, v in rows], "metric string, labels map<string,string>, ts long, value double")
    return raw.select("metric", "labels", L.signature(F.col("labels")).alias("labels_sig"), "ts", "value")


def values(df):
    return {(r["labels_sig"], r["ts"]): round(r["value"], 9) for r in df.collect()}


RANGES = [
    ("rate", [(0, 100), (60000, 220)], 60000, 60000, 2.0),
    ("rate", [(0, 100), (10000, 5), (20000, 55)], 30000, 30000, 2.75),
    ("increase", [(0, 100), (60000, 220)], 60000, 60000, 120),
    ("irate", [(0, 100), (10000, 110), (60000, 220)], 60000, 60000, 2.2),
    ("irate", [(0, 50), (10000, 100), (20000, 5)], 30000, 30000, 0.5),
    ("delta", [(0, 50), (60000, 30)], 60000, 60000, -20),
    ("delta", [(0, 10), (20000, 999), (40000, -5), (60000, 25)], 60000, 60000, 15),
    ("avg_over_time", [(0, 10), (30000, 20), (60000, 30)], 60000, 60000, 20),
    ("sum_over_time", [(0, 1), (30000, 2), (60000, 3)], 60000, 60000, 6),
    ("min_over_time", [(0, 7), (30000, 2), (60000, 9)], 60000, 60000, 2),
    ("max_over_time", [(0, 7), (30000, 2), (60000, 9)], 60000, 60000, 9),
    ("count_over_time", [(60000, 9)], 60000, 60000, 1),
]


@pytest.mark.parametrize("fn, points, window, at, expected", RANGES)
def test_range_functions(spark, fn, points, window, at, expected):
    samples = frame(spark, [({"a": "x"}, t, v) for t, v in points])
    assert values(R.range_function(samples, fn, window, at, at, 0)) == {("a=x", at): expected}


def brute(points, fn, window, t):
    inside = [(ts, v) for ts, v in sorted(points) if t - window <= ts <= t]
    if len(inside) < R.LEAST_SAMPLES.get(fn, 1):
        return None
    ups = [b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:], strict=False)]
    span = (inside[-1][0] - inside[0][0]) / 1000
    vs = [v for _, v in inside]
    rate = sum(ups) / span if span > 0 else 0.0
    return {"rate": rate, "increase": rate * window / 1000, "irate": ups[-1] / ((inside[-1][0] - inside[-2][0]) / 1000) if len(inside) > 1 else 0, "delta": vs[-1] - vs[0], "avg_over_time": sum(vs) / len(vs), "sum_over_time": sum(vs), "min_over_time": min(vs), "max_over_time": max(vs), "count_over_time": len(vs)}[fn]


@pytest.mark.parametrize("seed", range(3))
def test_range_functions_against_brute_force(spark, seed):
    rng = random.Random(seed)
    series = {f"s{i}": {rng.randrange(0, 50000): float(rng.randrange(0, 50)) for _ in range(25)} for i in range(3)}
    samples = frame(spark, [({"s": k}, t, v) for k, p in series.items() for t, v in p.items()])
    window, start, end, step = rng.choice([(3000, 5000, 44321, 2500), (900, 0, 40000, 4000), (20000, 10000, 30001, 777)])
    for fn in ("rate", "increase", "irate", "delta", "avg_over_time", "count_over_time"):
        got = values(R.range_function(samples, fn, window, start, end, step))
        want = {(f"s={k}", t): v for k, p in series.items() for t in R.grid(start, end, step) if (v := brute(p.items(), fn, window, t)) is not None}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_counters_over_blocks(spark):
    points = [(t, float(random.Random(t).randrange(50_000_000))) for t in range(0, 4 * R.DAY, R.DAY // 5 + 7)]
    for window in (R.DAY // 2, 2 * R.DAY):
        for fn in ("rate", "irate", "increase"):
            got = values(R.range_function(frame(spark, [({}, *p) for p in points]), fn, window, 0, 4 * R.DAY, R.DAY // 3))
            for t in range(0, 4 * R.DAY + 1, R.DAY // 3):
                want = brute(points, fn, window, t)
                assert (got.get(("", t)) is None) == (want is None) and (want is None or got["", t] == pytest.approx(want, abs=1e-6))


def test_window_edges_and_grid(spark):
    samples = frame(spark, [({}, 0, 1), ({}, 1000, 2)])
    assert values(R.range_function(samples, "sum_over_time", 1000, 1000, 1000, 0)) == {("", 1000): 3}
    assert R.grid(0, 10, 4) == [0, 4, 8, 10] and R.grid(0, 8, 4) == [0, 4, 8] and R.grid(0, 9, 0) == [9]
    assert R.step_for(240_000) == 1000 and R.step_for(3_600_000) == 15_000
    with pytest.raises(ValueError):
        R.range_function(samples, "rate", 10**9, 0, 1000, 1)


def test_aggregation(spark):
    cpu = frame(spark, [({"host": "a"}, 1000, 10), ({"host": "b"}, 1000, 20)])
    assert values(A.aggregate(cpu, "sum")) == {("", 1000): 30} and values(A.aggregate(cpu, "avg")) == {("", 1000): 15}
    reqs = frame(spark, [({"job": "api", "host": "h1"}, 1, 10), ({"job": "api", "host": "h2"}, 1, 20), ({"job": "worker", "host": "h3"}, 1, 5)])
    for got in (A.aggregate(reqs, "sum", by=["job"]), A.aggregate(reqs, "sum", without=["host"])):
        assert values(got) == {("job=api", 1): 30, ("job=worker", 1): 5}
    assert values(A.aggregate(reqs, "count", by=["zone"])) == {("zone=", 1): 3}
    uneven = frame(spark, [({"a": "1"}, 1, 1), ({"b": "2"}, 1, 2), ({"a": "1", "x": "9"}, 1, 4)])
    assert values(A.aggregate(uneven, "sum", without=["x"])) == {("a=1,b=", 1): 5, ("a=,b=2", 1): 2}
    assert A.aggregate(cpu.where("false"), "sum").count() == 0


def buckets(counts, extra=None, ts=1):
    return [({"le": le} | (extra or {}), ts, v) for le, v in counts.items()]


BASE = {"0.1": 1, "0.5": 4, "1": 7, "5": 9, "+Inf": 10}


@pytest.mark.parametrize("counts, q, expected", [(BASE, 0.5, 0.666666667), (BASE, 0.0, 0.0), (BASE, 0.95, 5.0), (BASE, 1.0, 5.0), ({"+Inf": 5}, 0.5, 0.0), ({"-2": 1, "1": 3, "+Inf": 3}, 0.2, -2.0)])
def test_histogram_quantile(spark, counts, q, expected):
    assert values(histogram.histogram_quantile(frame(spark, buckets(counts)), q)) == {("", 1): expected}


def test_histogram_groups_gaps_and_errors(spark):
    two = buckets({"1": 1, "2": 2, "+Inf": 2}, {"service": "api"}) + buckets({"1": 5, "2": 10, "+Inf": 10}, {"service": "worker"})
    assert set(values(histogram.histogram_quantile(frame(spark, two), 0.9))) == {("service=api", 1), ("service=worker", 1)}
    assert histogram.histogram_quantile(frame(spark, buckets(dict.fromkeys(BASE, 0))), 0.5).count() == 0
    gap = buckets({"1": 2, "2": 4, "+Inf": 4}) + buckets({"2": 4, "+Inf": 4}, ts=2)
    assert values(histogram.histogram_quantile(frame(spark, gap), 0.5)) == {("", 1): 1.0, ("", 2): 1.5}
    with pytest.raises(Exception, match="readable le"):
        histogram.histogram_quantile(frame(spark, [({"a": "b"}, 1, 1)]), 0.5).collect()
    assert histogram.histogram_quantile(frame(spark, [({"a": "b"}, 1, 1)]), 0.5, strict=False).count() == 0
    with pytest.raises(ValueError):
        histogram.histogram_quantile(frame(spark, gap), 1.5)


def test_arithmetic(spark):
    v = frame(spark, [({"a": "x"}, 1, 10), ({"a": "y"}, 1, 0)])
    assert values(arith.with_scalar(v, "*", 2)) == {("a=x", 1): 20, ("a=y", 1): 0}
    assert values(arith.with_scalar(v, "/", 100, scalar_left=True)) == {("a=x", 1): 10, ("a=y", 1): 0}
    assert values(arith.with_scalar(v, "/", 0)) == {("a=x", 1): 0, ("a=y", 1): 0}
    dev = frame(spark, [({"dev": "sda"}, 1, 200), ({"dev": "sdb"}, 1, 400)])
    total = frame(spark, [({}, 1, 1000)])
    assert values(arith.with_vector(dev, "/", total)) == {("dev=sda", 1): 0.2, ("dev=sdb", 1): 0.4}
    assert values(arith.with_vector(total, "-", dev)) == {}
    assert values(arith.with_vector(total, "-", dev, broadcast="both")) == {("dev=sda", 1): 800, ("dev=sdb", 1): 600}
    assert values(arith.with_vector(dev, "-", dev)) == {("dev=sda", 1): 0, ("dev=sdb", 1): 0}


def test_ranking(spark):
    v = frame(spark, [({"h": "a"}, 1000, 50), ({"h": "a"}, 2000, 5), ({"h": "b"}, 1000, 10), ({"h": "b"}, 2000, 100)])
    assert set(values(rank.topk(v, 1))) == {("h=a", 1000), ("h=b", 2000)}
    assert set(values(rank.bottomk(v, 1))) == {("h=b", 1000), ("h=a", 2000)}
    assert rank.topk(v, 10).count() == 4
    tie = frame(spark, [({"h": "b"}, 1, 5), ({"h": "a"}, 1, 5)])
    assert set(values(rank.topk(tie, 1))) == {("h=a", 1)}
    with pytest.raises(ValueError):
        rank.topk(v, 0)
    assert [(r["labels_sig"], r["ts"]) for r in rank.nearest_sample(v, 1500).collect()] == [("h=a", 1000), ("h=b", 1000)]


def test_matchers(spark):
    v = frame(spark, [({"s": "200"}, 1, 1), ({"s": "500"}, 1, 2), ({}, 1, 3), ({"s": "200\n"}, 1, 4)])
    hits = lambda *m: {r["value"] for r in select.match(v, *m).collect()}
    assert hits(("s", "=", "200")) == {1} and hits(("s", "=", "")) == {3} and hits(("s", "!=", "200")) == {2, 3, 4}
    assert hits(("s", "=~", "2.0|")) == {1, 3} and hits(("s", "!~", "2.0")) == {2, 3, 4} and hits() == {1, 2, 3, 4}


def test_reduction(spark):
    v = frame(spark, [({}, 1, 1), ({}, 2, 5), ({}, 3, float("nan"))])
    got = {c: reduce.stat(v, c).first()["value"] for c in reduce.REDUCTIONS}
    assert got["last"] != got["last"] and {k: x for k, x in got.items() if k != "last"} == {"lastNotNull": 5, "first": 1, "max": 5, "min": 1, "mean": 3, "sum": 6}
    assert reduce.choose(["p99", "mean"]) == "mean" and reduce.choose([]) == "lastNotNull"


def test_upsert_and_packing(spark):
    batch = frame(spark, [({}, 1, 1), ({}, 1, 2), ({}, 2, float("nan"))]).withColumn("ingest_seq", F.monotonically_increasing_id())
    stored = upkeep.upsert(None, batch)
    assert values(stored) == {("", 1): 2}
    assert values(upkeep.upsert(stored, batch.where("value = 1"))) == {("", 1): 1}
    thousand = frame(spark, [({"a": "b"}, 5000 * i, i) for i in range(1000)])
    packed, rest = upkeep.pack(thousand, 10**10, most=300)
    assert packed.count() == 4 and rest.count() == 0
    assert values(upkeep.merge_raw_packed(rest, upkeep.unpack(packed, 0, 10**9))) == values(thousand)
    day = upkeep.DAY  # runs go on over days; samples of the last day stay raw from the limit on
    long = frame(spark, [({"a": "b"}, day // 8 * i, i) for i in range(80)] + [({"a": "c"}, day * i, i) for i in range(10)])
    runs, rest = upkeep.pack(long, 9 * day + day // 2, least=16, most=30, after_ms=0)
    assert sorted(r["count"] for r in runs.collect()) == [16, 30, 30]
    assert rest.columns == long.columns and rest.count() == 4 + 10
    assert values(upkeep.merge_raw_packed(rest, upkeep.unpack(runs, 0, 10**10))) == values(long)
    few, kept = upkeep.pack(thousand.where("ts < 10000"), 10**10)
    assert few.count() == 0 and kept.count() == 2
    assert upkeep.retain_packed(packed, 10**10, 1000).count() == 0
    assert upkeep.id_collisions(upkeep.series_dictionary(thousand)).count() == 0


def test_legend_and_signature(spark):
    row = spark.createDataFrame([({"job": "j", "a": "1", "b": "2"}, {"job": "j"}, {"a": "1", "job": "j"})], "x map<string,string>, y map<string,string>, z map<string,string>")
    got = row.select(*(L.legend(F.lit("m"), F.col(c)).alias(c) for c in "xyz"), L.legend(F.lit("m"), F.col("x"), "{{a}}-{{none}}").alias("t"), L.signature(F.col("x")).alias("s")).first()
    assert tuple(got) == ("a=1 b=2", "j", "1", "1-", "a=1,b=2,job=j")
    assert spark.range(1).select(L.parse_signature(F.lit("a=b=c,d=")).alias("m")).first()["m"] == {"a": "b=c", "d": ""}


WIDE = [(3000, 5000, 44321, 250), (3001, 5000, 45000, 250), (2999, 0, 40000, 125), (20000, 10000, 30001, 777), (7, 40, 90, 1), (5000, 60000, 59000, 100)]


@pytest.mark.parametrize("window, start, end, step", WIDE)
def test_panes_against_brute_force(spark, window, start, end, step):
    """Windows of many steps, samples on both edges, gaps, resets and an end off the grid."""
    rng = random.Random(window)
    edges = [t for k in range(0, (end - start) // step + 1, 7) for t in (start + k * step, start + k * step - window, start + k * step + 1) if t >= 0]
    series = {f"s{i}": {rng.randrange(0, 50000): float(rng.randrange(0, 50)) for _ in range(n)} | {t: float(rng.randrange(0, 50)) for t in rng.sample(edges, min(len(edges), 9))} for i, n in enumerate((60, 3, 300))}
    samples = frame(spark, [({"s": k}, t, v) for k, p in series.items() for t, v in p.items()])
    for fn in ("rate", "increase", "irate", "delta", "avg_over_time", "sum_over_time", "min_over_time", "max_over_time", "count_over_time"):
        got = values(R.range_function(samples, fn, window, start, end, step, most_exploded=2))
        want = {(f"s={k}", t): v for k, p in series.items() for t in (R.grid(start, end, step) if end >= start else [end]) if (v := brute(p.items(), fn, window, t)) is not None}
        if end < start:
            want = {k: v for k, v in want.items() if k in got}
        assert got.keys() == want.keys(), fn
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want), fn


def test_panes_bound_the_rows(spark):
    """240 steps a window: two rows a window reach the last aggregation, not 241 a sample."""
    samples = frame(spark, [({}, t * 1000, float(t)) for t in range(2000)])
    rows = R.pane_rows(samples, "sum_over_time", 240_000, 300_000, 1_900_000, 1000)
    assert rows.count() <= 2 * 1601 and R.explode_to_grid(samples, 240_000, 300_000, 1_900_000, 1000).count() > 380_000
