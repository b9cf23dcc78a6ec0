"""Dictionary-encoded samples, and lines of growing files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import labels as L
from gaugeflow.operators import encoded, reduce, select
from gaugeflow.streaming import ingest, tail

DAY = encoded.DAY


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(m, {"type": t, "shard": str(i)}, d * DAY + rng.randrange(DAY), rng.random()) for m in ("a", "b") for t in ("x", "y", "zz") for i in range(6) for d in range(4) for _ in range(3)]
    rows += [("a", {}, 5, 1.0), ("a", {"type": "x,shard=9"}, 6, 2.0), ("a", {"type": "x", "shard": "9"}, 7, None)]
    raw = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts long, value double")
    frame = raw.select("metric", "labels", L.signature(F.col("labels")).alias("labels_sig"), "ts", "value")
    path = str(tmp_path_factory.mktemp("encoded"))
    encoded.write(frame, path, slots=16)
    return frame, path


def plain(df):
    return sorted(map(str, ((r["metric"], sorted(r["labels"].items()), r["labels_sig"], r["ts"], r["value"]) for r in df.collect())))


@pytest.mark.parametrize("matchers", [(), [("type", "=", "x")], [("type", "!=", "x")], [("type", "=~", "x|z+")], [("type", "!~", "z.*"), ("shard", "=", "3")], [("none", "=", "")]])
def test_encoded_scan(spark, stored, matchers):
    frame, path = stored
    for start, end in ((0, 10 * DAY), (DAY + 5, 2 * DAY + 77), (9 * DAY, 10 * DAY)):
        assert plain(encoded.scan(spark, path, "a", start, end, *matchers)) == plain(select.match(select.scan(frame, "a", start, end), *matchers))


def test_encoded_scan_prunes(spark, stored):
    """The days of the range and the slots of the series found are all that is read."""
    _, path = stored
    found = encoded.scan(spark, path, "a", DAY, 2 * DAY - 1, ("type", "=", "x"), ("shard", "=", "3"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.replace("DynamicPruning", "dynamicpruning") and "PartitionFilters: [isnotnull(day" in plan.replace("(day#", "(day")
    files = found.select(F.lit(1)).count(), spark.read.parquet(f"{path}/samples").count()
    assert 0 < files[0] < files[1]
    assert sorted(r["name"] for r in encoded.label_names(spark, path, "b").collect()) == ["shard", "type"]


def test_encoded_of_nothing(spark, stored, tmp_path):
    frame, _ = stored
    encoded.write(frame.where("false"), str(tmp_path / "none"))
    assert encoded.scan(spark, str(tmp_path / "none"), "a", 0, DAY).count() == 0


def follow(spark, folder, tmp_path, **options):
    """Lines that one more run of the query reads."""
    out = tmp_path / "out"
    before = spark.read.schema(tail.SCHEMA).parquet(str(out)).collect() if out.exists() else []
    stream = tail.tail_stream(spark, str(folder), **options)
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination()
    after = spark.read.schema(tail.SCHEMA).parquet(str(out)).collect() if any(f.suffix == ".parquet" for f in out.iterdir()) else []
    new = sorted(r["line"] for r in after)
    for r in before:
        new.remove(r["line"])
    return new


def test_tail_appends_rotation_and_truncation(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log = folder / "app.log"
    log.write_bytes(b"one\ntwo\nhal")
    assert follow(spark, folder, tmp_path) == ["one", "two"]
    with log.open("ab") as f:
        f.write("f\nthrée\r\n".encode())
    assert follow(spark, folder, tmp_path) == ["half", "thrée"]
    assert follow(spark, folder, tmp_path) == []
    # appended, renamed, and a new file under the old name
    with log.open("ab") as f:
        f.write(b"late\n")
    os.rename(log, folder / "app.log.1")
    log.write_bytes(b"fresh\n")
    assert follow(spark, folder, tmp_path) == ["fresh", "late"]
    # cut off and written anew: with another first line, and shorter behind the same one
    with log.open("r+b") as f:
        f.truncate(0)
        f.write(b"anew\nand more than before\n")
    assert follow(spark, folder, tmp_path) == ["and more than before", "anew"]
    with log.open("r+b") as f:
        f.truncate(0)
        f.write(b"anew\n")
    assert follow(spark, folder, tmp_path) == ["anew"]
    os.remove(folder / "app.log.1")
    assert follow(spark, folder, tmp_path) == []


def test_tail_from_the_end_and_pattern(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"old\n")
    (folder / "b.txt").write_bytes(b"other\n")
    assert follow(spark, folder, tmp_path, from_end=True, pattern="*.log") == []
    with (folder / "a.log").open("ab") as f:
        f.write(b"new\n")
    assert follow(spark, folder, tmp_path, from_end=True, pattern="*.log") == ["new"]


def test_tail_splits_at_lines(tmp_path):
    (tmp_path / "big").write_bytes(b"".join(b"line %d\n" % i for i in range(5000)))
    reader = tail.TailReader(str(tmp_path), "*", False, 1000)
    parts = reader.partitions({}, reader.latestOffset())
    got = [x for p in parts for batch in reader.read(p) for x in batch.column("line").to_pylist()]
    assert len(parts) > 30 and got == [f"line {i}" for i in range(5000)]


def test_tail_feeds_the_ingest(spark, tmp_path):
    """Samples of lines appended between two runs both reach the table."""
    folder = tmp_path / "scrapes"
    folder.mkdir()
    args = (str(tmp_path / "table"), str(tmp_path / "check"))
    for i in range(2):
        with (folder / "t.prom").open("ab") as f:
            f.write(b'up{job="a"} %d %d\n' % (i, 1000 * (i + 1)))
        ingest.ingest_samples(tail.tail_stream(spark, str(folder)), *args).awaitTermination()
    got = spark.read.parquet(args[0]).orderBy("ts").collect()
    assert [(r["ts"], r["value"]) for r in got] == [(1000, 0.0), (2000, 1.0)]


def test_figures_from_footers(spark, tmp_path):
    """Count and extent of a stored table without reading rows; settings of the session are put back."""
    path, schema = str(tmp_path / "t"), "series_id long, ts long, value double, day long"
    spark.range(-5, 995, 1, 7).selectExpr("id * 7 as series_id", "id as ts", "cast(id as double) as value", "id % 3 as day").write.partitionBy("day").parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert tuple(reduce.stored_figures(spark, path, schema).first()) == (1000, -5, 994)
    with reduce._footers(spark):
        plan = reduce._stored_ends(spark, path, schema)._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*), MIN(ts), MAX(ts)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    spark.range(0).selectExpr("id as ts").write.parquet(str(tmp_path / "none"))
    assert tuple(reduce.stored_figures(spark, str(tmp_path / "none"), "ts long").first()) == (0, None, None)
