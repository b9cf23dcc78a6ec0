"""Parsers of landed text, records and log lines."""

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import events
from gaugeflow.sources import containers, exposition, host

BODY = r"""# HELP x y
# TYPE x counter
x_total 5
x{a="x,y",b="quoted \"inner\" }"} 1.5e3 1700000000000
up{job="api",} +Inf
neg -2

x{} .5
nan_metric NaN"""


def lines(spark, text, **more):
    return spark.createDataFrame([(x, *more.values()) for x in text.split("\n")], ", ".join(["line string", *(f"{k} string" for k in more)]))


def test_exposition(spark):
    got, bad = exposition.parse(lines(spark, BODY, file="f"))
    rows = {(r["metric"], tuple(sorted(r["labels"].items()))): (r["value"], r["own_ts"]) for r in got.collect()}
    assert rows[("x", (("a", "x,y"), ("b", 'quoted "inner" }')))] == (1500.0, 1700000000000)
    assert rows[("up", (("job", "api"),))][0] == float("inf") and rows[("neg", ())] == (-2.0, None) and rows[("x", ())][0] == 0.5
    assert got.count() == 6 and bad.count() == 0
    got, bad = exposition.parse(lines(spark, BODY + "\nmalformed line with no value", file="f"))
    assert got.count() == 0 and bad.count() == 1
    assert exposition.parse(lines(spark, "x 5d", file="f"))[1].count() == 1


def test_host(spark):
    cpu = host.cpu(lines(spark, "cpu  9 9 9 9\ncpu0 50 0 0 300 0 0 0 0 0 0\ncpu1 0 0 0 400 0 0 0 0 0 0\nbtime 1700000000\nintr 1"))
    assert cpu.count() == 21
    got = {r["labels_sig"]: r["value"] for r in cpu.collect()}
    assert got["cpu=0,job=host,mode=user"] == 0.5 and got["cpu=1,job=host,mode=idle"] == 4.0
    assert [r["value"] for r in host.memory(lines(spark, "MemTotal: 2048000 kB\nDirty: 5 kB")).collect()] == [2048000 * 1024]
    assert {r["metric"]: r["value"] for r in host.load(lines(spark, "0.42 0.55 0.61 1/2 3")).collect()} == {"node_load1": 0.42, "node_load5": 0.55, "node_load15": 0.61}
    net = "Inter-|   Receive\n face |bytes packets\n  eth0: 567890 2 1 0 0 0 0 0 234567 5 0 0 0 0 0 0\ntunl0: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"
    assert {r["metric"]: r["value"] for r in host.network(lines(spark, net)).collect()}["node_network_transmit_bytes_total"] == 234567
    disk = "8 0 sda 10 0 2048 0 20 0 4096 0 0 0 0\n7 0 loop0 1 1 1 1 1 1 1 1 1 1 1\n253 0 dm-0 1 1 1 1 1 1 1 1 1 1 1"
    got = {r["metric"]: r["value"] for r in host.disks(lines(spark, disk)).collect()}
    assert got["node_disk_read_bytes_total"] == 1048576 and got["node_disk_written_bytes_total"] == 4096 * 512 and len(got) == 4


def test_containers(spark):
    text = (
        '{"ts":1,"container":{"name":"web","image":"i","state":"running","labels":{"com.docker.compose.service":"s"}},"stats":{"cpu":{"total":2500000000},"memory":{"usage":10485760,"max_usage":1,"limit":2,"stats":{"inactive_file":2097152,"anon":7}},"networks":{"eth0":{"rx_bytes":3,"tx_bytes":4}},"io":[{"op":"Read","value":5},{"op":"write","value":6}]}}\n'
        '{"ts":1,"container":{"name":"old","image":"i","state":"exited","labels":{}},"stats":null}'
    )
    records = containers.read(lines(spark, text))
    got = {r["metric"]: r["value"] for r in containers.samples(records).collect()}
    assert got["container_cpu_usage_seconds_total"] == 2.5 and got["container_memory_usage_bytes"] == 8 * 1024 * 1024
    assert got["container_memory_anon_bytes"] == 7 and got["container_network_transmit_bytes_total"] == 4 and got["container_fs_writes_bytes_total"] == 6
    assert containers.snapshot(records).first()["name"] == "web"
    p = "metrics.scrape"
    inventory = spark.createDataFrame([("a", {p: "true", f"{p}.port": "9", f"{p}.path": "m"}), ("b", {p: "true"}), ("c", {})], "name string, labels map<string,string>")
    assert [tuple(r) for r in containers.targets(inventory, p).collect()] == [("docker:a", "http://a:9/m", "a", "a")]


def test_records(spark):
    parsed = events.parse_json(lines(spark, '{"level":"error","n":5}\nnot json\n[1]\n{"level":"info"}'))
    assert parsed.count() == 2
    assert events.match_records(parsed, [("level", "equals", "error")]).count() == 1
    assert events.match_records(parsed, [("n", "equals", "5")]).count() == 0 and events.match_records(parsed, [("n", "equals", "")]).count() == 1
    fields = events.parse_logfmt(lines(spark, r'a=1 b="x \"y\" \\n\n" c d= a=2')).first()["fields"]
    assert fields == {"a": "2", "b": 'x "y" \\n\n', "c": "", "d": ""}
    assert events.parse_regex(lines(spark, "GET /x 200\nnope"), r"(?P<verb>[A-Z]+) (?P<path>\S+)").first()["fields"] == {"verb": "GET", "path": "/x"}
    assert events.parse_plain(lines(spark, "x")).first()["fields"] == {"line": "x"}
    stamped = events.split_stamp(lines(spark, "2024-01-01T00:00:00.123456789Z hello world\n2024 no stamp")).collect()
    assert (stamped[0]["stamp_ms"], stamped[0]["line"]) == (1704067200123, "hello world") and stamped[1]["stamp_ms"] is None and stamped[1]["line"] == "2024 no stamp"


def test_mapping_and_ids(spark):
    parsed = events.parse_json(lines(spark, '{"t":"1700000000000","user":{"name":"ann"}}'))
    mapped = events.map_events(parsed, "s", "k", {"who": "$.user.name", "none": "$.x"}, ts_path="$.t", ingest_ms=5)
    row = mapped.withColumn("render", events.render("{{.who}}:{{.none}}{{.what}}!")).first()
    assert row["ts"] == 1700000000000 and row["payload"] == {"who": "ann", "none": ""} and row["render"] == "ann:!"
    named = events.with_id(mapped.unionByName(mapped))
    assert events.insert_new(named).count() == 1 and events.insert_new(named, named).count() == 0
    some = spark.createDataFrame([("a", 10, "s1", "k"), ("b", 20, "s1", "k"), ("c", 30, "s2", "k")], "id string, ts long, source string, kind string")
    assert {r["id"] for r in events.filter_events(some, 15, 40, ["s1", "s2"]).collect()} == {"b", "c"}
    assert {r["id"] for r in events.filter_events(some, 15).where(F.col("source") == "s2").collect()} == {"c"}


@pytest.mark.parametrize(
    "line, metric, value, ts",
    [("foo.bar 1", "foo.bar", 1.0, None), ("a +Infinity", "a", float("inf"), None), ("a -INF 5", "a", float("-inf"), 5), ("a 1 2 3", "a", 1.0, 2), ("a 1e5 +7", "a", 1e5, 7), ('1x-y{b="c"}2', "1x-y", 2.0, None)],
)
def test_exposition_accepts(spark, line, metric, value, ts):
    got, bad = exposition.parse(lines(spark, line, file="f"))
    assert [(r["metric"], r["value"], r["own_ts"]) for r in got.collect()] == [(metric, value, ts)] and bad.count() == 0


def test_exposition_not_a_number_and_errors(spark):
    got, _ = exposition.parse(lines(spark, "a NAN", file="f"))
    assert str(got.first()["value"]) == "nan"
    for line in ("a 1e999", "a +nan", "a 1 99999999999999999999", "a 1 x", 'a {b="c"} 1', "a"):
        assert exposition.parse(lines(spark, line, file="f"))[1].count() == 1, line


def test_lines_of_a_file_stay_in_their_partitions(spark):
    """However large the inputs, one file's lines are not gathered in one task."""
    lines = spark.createDataFrame([("a", f"m {i}") for i in range(400)] + [("b", "m 1"), ("b", "bad line")], "file string, line string").repartition(8, "line")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        samples, _ = exposition.parse(lines)
        plan = samples._jdf.queryExecution().executedPlan().toString()
        files = {r["file"] for r in samples.select("file").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert files == {"a"}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
