"""All registered queries of the metrics engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import aggregate as A
from ..operators import alert_state, alerts, arith, events, histogram, rank, reduce, select, upkeep
from ..operators import range_fn as R
from ..sources import containers, exposition, host
from . import adapters as D
from . import oracles as O
from . import panels
from .adapters import DAY, HOUR, T0
from .oracles import END, HIGH, LOW, START, STEP, WIN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def flat(vector: DataFrame, *more: str, digits: int = 6) -> DataFrame:
    """Scalar columns of a vector frame."""
    return vector.select(*more, "labels_sig", "ts", F.round("value", digits).alias("value"))


def fine(vector: DataFrame) -> DataFrame:
    return flat(vector, digits=O.DIGITS)


def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.range_function(D.gauge(spark, sf_dir), "avg_over_time", WIN, START, END, STEP)


AVG = f"with {O.ranged('avg_over_time', O.GAUGE)}"
PICK = "select sig as labels_sig, ts, round(v, 6) as value from s"

# --- scans, sinks -----------------------------------------------------------------------

query("s1_series_scan", f"with {O.GAUGE} {PICK} where ts between {LOW} and {HIGH}")(lambda s, d: flat(select.scan(D.gauge(s, d), "event_value", LOW, HIGH)))


@query("s2_upsert", f"with {O.EV}, s as (select 'type=' || type as sig, ts // {HOUR} * {HOUR} as ts, arg_max(amount, event_id) as v from ev group by all) {PICK}")
def _s2(s, d):
    e = D.event_rows(s, d).withColumn("ts", F.expr(f"ts div {HOUR} * {HOUR}")).withColumn("labels", F.create_map(F.lit("type"), F.col("type")))
    rows = e.select(F.lit("event_value").alias("metric"), "labels", L.signature(F.col("labels")).alias("labels_sig"), "ts", F.col("amount").alias("value"), F.col("event_id").alias("ingest_seq"))
    half = rows.where(F.col("ingest_seq") % 2 == 0)
    stored = upkeep.upsert(None, half)
    # the second batch holds every event, so its last one wins
    return flat(upkeep.upsert(stored, rows))


def _exposition(s, d):
    """Scrape files of a day and shard, one line an event; every seventh day's file has a broken line."""
    e = D.event_rows(s, d).withColumn("day", F.expr(f"(ts - {T0}) div {DAY}"))
    number = F.format_string("%.2f", "amount")
    line = F.concat(F.lit('event_value{type="'), "type", F.lit('",note="a,\\"}b",user="'), F.col("user").cast("string"), F.lit('"} '), number, F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("ts").cast("string"))))
    good = e.select(F.concat_ws("/", "day", "shard").alias("file"), line.alias("line"), "event_id", F.lit("http://u:p@host:9100/metrics?x=1").alias("url"), F.create_map(F.lit("job"), F.lit("app"), F.lit("type"), F.lit("static")).alias("target_labels"), F.expr(f"{T0} + (day + 1) * {DAY}").alias("scrape_ts"))
    broken = good.where((F.col("event_id") % 97 == 0) & F.col("file").rlike("^(0|7|14|21|28)/")).withColumn("line", F.lit("broken line with no value"))
    comments = good.where(F.col("event_id") % 89 == 0).withColumn("line", F.lit("# HELP event_value x"))
    return good.unionByName(broken).unionByName(comments)


_BAD = "x as (select *, (ts - {t0}) // {day} as day from ev), bad as (select distinct day, shard from x where event_id % 97 = 0 and day in (0, 7, 14, 21, 28)), ok as (select x.* from x anti join bad on x.day = bad.day and x.shard = bad.shard)".format(t0=T0, day=DAY)


@query("s3_exposition", f"with {O.EV}, {_BAD} select event_id, 'event_value' as metric, type, 'a,\"}}b' as note, cast(usr as varchar) as usr, round(amount, 2) as value, case when event_id % 3 = 0 then null else ts end as own_ts from ok")
def _s3(s, d):
    got, _ = exposition.parse(_exposition(s, d))
    label = lambda k: F.col("labels")[k]
    return got.select("event_id", "metric", label("type").alias("type"), label("note").alias("note"), label("user").alias("usr"), "value", "own_ts")


@query("s3_quarantine", f"with {O.EV}, x as (select *, (ts - {T0}) // {DAY} as day from ev) select day || '/' || shard as file, 'broken line with no value' as line from x where event_id % 97 = 0 and day in (0, 7, 14, 21, 28)")
def _s3q(s, d):
    return exposition.parse(_exposition(s, d))[1].select("file", "line")


@query("s4_target_labels", f"with {O.EV}, {_BAD} select event_id, 'instance=host:9100,job=app,note=a,\"}}b,type=' || type || ',user=' || usr as labels_sig from ok")
def _s4(s, d):
    return exposition.merge_target_labels(exposition.parse(_exposition(s, d))[0]).select("event_id", "labels_sig")


@query("s5_metric_filter", f"with {O.EV} select event_id, 'app_' || type || '_total' as metric from ev where type in ('click', 'error', 'purchase')")
def _s5(s, d):
    named = D.event_rows(s, d).select("event_id", F.concat(F.lit("app_"), "type", F.lit("_total")).alias("metric"))
    return exposition.keep_metrics(named, keep=["cli", "err|vie", "purchase_"], drop=["^app_v"])


@query("s6_ts_default", f"with {O.EV}, {_BAD} select event_id, case when event_id % 3 = 0 then {T0} + (day + 1) * {DAY} else ts end as ts from ok")
def _s6(s, d):
    return exposition.default_ts(exposition.parse(_exposition(s, d))[0]).select("event_id", "ts")


def _lines(s, d, line: str, where: str = "true") -> DataFrame:
    return D.table(s, d, "lineitem").where(where).select("l_orderkey", "l_linenumber", F.expr(line).alias("line"))


def _host(rows: DataFrame) -> DataFrame:
    return rows.select("l_orderkey", "l_linenumber", "metric", "labels_sig", F.round("value", 6).alias("value"))


_LI = "select l_orderkey, l_linenumber, metric, labels_sig, round(value, 6) as value from (select l_orderkey, l_linenumber, unnest([{}], recursive := true) from lineitem where {})"


def _host_oracle(entries: list[tuple[str, str, str]], where: str = "true") -> str:
    return _LI.format(", ".join(f"{{'metric': {m}, 'labels_sig': {sig}, 'value': cast({v} as double)}}" for m, sig, v in entries), where)


@query("s7a_host_cpu", _host_oracle([("'node_cpu_seconds_total'", f"'cpu=' || l_linenumber || ',job=host,mode={m}'", v) for m, v in (("user", "l_partkey / 100.0"), ("nice", "l_suppkey / 100.0"), ("system", "l_quantity / 100.0"))]) + " union all select l_orderkey, l_linenumber, 'node_boot_time_seconds', 'job=host', l_partkey from lineitem where l_linenumber = 2")
def _s7a(s, d):
    per = _lines(s, d, "concat('cpu', l_linenumber, ' ', l_partkey, ' ', l_suppkey, ' ', cast(l_quantity as int))")
    total = _lines(s, d, "'cpu  1 2 3'", "l_linenumber = 1")
    boot = _lines(s, d, "concat('btime ', l_partkey)", "l_linenumber = 2")
    return _host(host.cpu(per.unionByName(total).unionByName(boot)))


@query("s7b_host_memory", _host_oracle([("'node_memory_MemFree_bytes'", "'job=host'", "l_partkey * 1024")], "l_linenumber % 3 = 0") + " union all select l_orderkey, l_linenumber, 'node_memory_Cached_bytes', 'job=host', l_suppkey from lineitem where l_linenumber % 3 = 1")
def _s7b(s, d):
    return _host(host.memory(_lines(s, d, "case l_linenumber % 3 when 0 then concat('MemFree:      ', l_partkey, ' kB') when 1 then concat('Cached: ', l_suppkey) else concat('Dirty: ', l_partkey, ' kB') end")))


@query("s7c_host_load", _host_oracle([("'node_load1'", "'job=host'", "l_discount"), ("'node_load5'", "'job=host'", "l_tax"), ("'node_load15'", "'job=host'", "l_quantity")]))
def _s7c(s, d):
    return _host(host.load(_lines(s, d, "concat(l_discount, ' ', l_tax, ' ', l_quantity, ' 1/200 4242')")))


_NET = {"node_network_receive_bytes_total": "l_partkey", "node_network_receive_packets_total": "2", "node_network_receive_errs_total": "l_linenumber", "node_network_transmit_bytes_total": "l_suppkey", "node_network_transmit_packets_total": "10", "node_network_transmit_errs_total": "11"}


@query("s7d_host_network", _host_oracle([(f"'{m}'", "'device=eth' || l_linenumber || ',job=host'", v) for m, v in _NET.items()], "l_linenumber > 1"))
def _s7d(s, d):
    real = _lines(s, d, "concat('  eth', l_linenumber, ': ', l_partkey, ' 2 ', l_linenumber, ' 4 5 6 7 8 ', l_suppkey, ' 10 11 12 13 14 15 16')", "l_linenumber > 1")
    other = _lines(s, d, "case l_orderkey % 3 when 0 then 'tunl0: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16' when 1 then ' face |bytes packets' else 'eth9: 1 2 3' end", "l_linenumber = 1")
    return _host(host.network(real.unionByName(other)))


@query("s7e_host_disks", _host_oracle([("'node_disk_reads_completed_total'", "'device=sd' || l_linenumber || ',job=host'", "l_partkey"), ("'node_disk_read_bytes_total'", "'device=sd' || l_linenumber || ',job=host'", "l_suppkey * 512"), ("'node_disk_writes_completed_total'", "'device=sd' || l_linenumber || ',job=host'", "8"), ("'node_disk_written_bytes_total'", "'device=sd' || l_linenumber || ',job=host'", "l_linenumber * 512")], "l_linenumber > 1"))
def _s7e(s, d):
    return _host(host.disks(_lines(s, d, "concat('   8  0 ', case when l_linenumber = 1 then 'loop0' else concat('sd', l_linenumber) end, ' ', l_partkey, ' 4 ', l_suppkey, ' 6 8 8 ', l_linenumber, ' 10 11 12 13')")))


_CONTAINER = """concat('{"ts":', ts, ',"container":{"name":"c', user % 20, '","image":"img', shard, '","state":"', case when type = 'error' then 'exited' else 'running' end, '","labels":{"com.docker.compose.service":"', type, '"}},',
'"stats":{"cpu":{"total":', event_id * 1000000, '},"memory":{"usage":', user * 1000, ',"max_usage":', user * 2000, ',"limit":1000000,"stats":{', case when shard % 2 = 0 then concat('"inactive_file":', user * 300) else concat('"total_inactive_file":', user * 5000, ',"rss":', user) end, '}},',
'"networks":{"eth0":{"rx_bytes":', event_id, ',"tx_bytes":', user, '}},"io":[{"op":"Read","value":', user, '},{"op":"read","value":1},{"op":"Write","value":', shard, '},{"op":"Sync","value":9}]}}') as line"""


def _records(s, d) -> DataFrame:
    return containers.read(D.event_rows(s, d).selectExpr(_CONTAINER))


_BASE = "'compose_service=' || type || ',image=img' || shard"
_WS = "case when shard % 2 = 0 then usr * 700 else usr * 1000 end"
_STATS = [("cpu_usage_seconds_total", "event_id / 1000.0", ""), ("memory_usage_bytes", _WS, ""), ("memory_max_usage_bytes", "usr * 2000", ""), ("memory_limit_bytes", "1000000", ""), ("memory_anon_bytes", "case when shard % 2 = 1 then usr end", ""), ("network_receive_bytes_total", "event_id", ",interface=eth0"), ("network_transmit_bytes_total", "usr", ",interface=eth0"), ("fs_reads_bytes_total", "usr + 1", ""), ("fs_writes_bytes_total", "shard", "")]
query("s8_container_stats", f"with {O.EV}, l as (select ts, unnest([{', '.join(f'''{{'metric': 'container_{m}', 'labels_sig': {_BASE} || '{extra},job=docker,name=c' || usr % 20, 'value': cast({v} as double)}}''' for m, v, extra in _STATS)}], recursive := true) from ev where type != 'error') select metric, labels_sig, ts, round(value, 6) as value from l where value is not null")(lambda s, d: flat(containers.samples(_records(s, d)), "metric"))
query("s8a_working_set", f"with {O.EV} select ts, cast({_WS} as bigint) as bytes from ev where type != 'error'")(lambda s, d: _records(s, d).select("ts", containers.working_set(F.col("stats.memory.usage"), F.col("stats.memory.stats")).alias("bytes")))
query("s8b_anon_memory", f"with {O.EV} select ts, usr as bytes from ev where type != 'error' and shard % 2 = 1")(lambda s, d: _records(s, d).select("ts", containers.anon_memory(F.col("stats.memory.stats")).alias("bytes")).where("bytes is not null"))
query("s9_container_snapshot", f"with {O.EV} select 'c' || usr % 20 as name, 'img' || arg_max(shard, ts) as image, 'running' as state, cast(arg_max({_WS}, ts) as bigint) as memory, max(ts) as last_seen from ev where type != 'error' group by usr % 20")(lambda s, d: containers.snapshot(_records(s, d)))


@query("s10_scrape_targets", "select 'docker:' || c_name as target, 'http://' || c_name || ':' || (8000 + c_nationkey) || case when c_nationkey % 3 = 0 then '/metrics' else '/stats' end as url, case when c_nationkey % 2 = 0 then 'app' || c_nationkey else c_mktsegment end as job, c_name as instance from customer where c_custkey % 2 = 0 and c_nationkey % 5 != 0")
def _s10(s, d):
    p = "metrics.scrape"
    labels = f"map('{p}', case when c_custkey % 2 = 0 then 'true' else 'no' end, '{p}.port', case when c_nationkey % 5 = 0 then '' else cast(8000 + c_nationkey as string) end, '{p}.path', case c_nationkey % 3 when 0 then '' when 1 then 'stats' else '/stats' end, '{p}.job', case when c_nationkey % 2 = 0 then concat('app', c_nationkey) else '' end, 'com.docker.compose.service', c_mktsegment) as labels"
    return containers.targets(D.table(s, d, "customer").selectExpr("c_name as name", labels))


query("s12_container_log", f"with {O.EV} select event_id, ts as stamp_ms, type || ' ' || usr as line from ev")(lambda s, d: events.split_stamp(D.log_lines(s, d, "stamped")))
query("s13a_json", f"with {O.EV} select event_id, type, printf('%.2f', amount) as amount from ev where event_id % 10 != 0")(
    lambda s, d: events.parse_json(D.log_lines(s, d, "json").withColumn("line", F.when(F.col("event_id") % 20 == 0, "{bad").when(F.col("event_id") % 10 == 0, "[1]").otherwise(F.col("line")))).select("event_id", L.path(F.col("record"), "$.type").alias("type"), L.path(F.col("record"), "$.amount").alias("amount"))
)
query("s13b_logfmt", f"with {O.EV} select event_id, cast(ts as varchar) as ts, 'x' || type as type, 'user \"' || usr || '\" paid' as msg, printf('%.2f', amount) as amount, '' as ok from ev")(
    lambda s, d: events.parse_logfmt(D.log_lines(s, d, "logfmt")).select("event_id", *(F.col("fields")[k].alias(k) for k in ("ts", "type", "msg", "amount", "ok")))
)
query("s13c_regex", f"with {O.EV} select event_id, type as kind, cast(usr as varchar) as usr from ev where type != 'view'")(
    lambda s, d: events.parse_regex(D.log_lines(s, d, "regex"), r"\[(?P<kind>[a-u]\w+)\] user=(?P<usr>\d+)").select("event_id", F.col("fields")["kind"].alias("kind"), F.col("fields")["usr"].alias("usr"))
)
query("s13d_plain", f"with {O.EV} select event_id, type || ' ' || usr as line from ev")(lambda s, d: events.parse_plain(D.log_lines(s, d, "plain")).select("event_id", F.col("fields")["line"].alias("line")))
# a JSON number reads as empty in match rules, so the rule on ``user`` can only match ""
query("s14_match", f"with {O.EV} select event_id from ev where contains(type, 'i')")(lambda s, d: events.match_records(events.parse_json(D.log_lines(s, d, "json")), [("type", "contains", "i"), ("user", "equals", "")]).select("event_id"))


def _mapped(s, d) -> DataFrame:
    parsed = events.parse_json(D.log_lines(s, d, "json"))
    return events.map_events(parsed, "app", "pay", {"user": "$.user", "amount": "$.amount", "none": "$.x.y"}, ts_path="$.at.ms")


query("s15_mapping", f"with {O.EV} select ts, 'app' as source, 'pay' as kind, cast(usr as varchar) as usr, printf('%.2f', amount) as amount, '' as none from ev")(lambda s, d: _mapped(s, d).select("ts", "source", "kind", F.col("payload")["user"].alias("usr"), F.col("payload")["amount"].alias("amount"), F.col("payload")["none"].alias("none")))
query("s16_render", f"with {O.EV} select ts, 'user ' || usr || ' paid ' || printf('%.2f', amount) || '!' as render from ev")(lambda s, d: _mapped(s, d).select("ts", events.render("user {{.user}} paid {{.amount}}{{.nothing}}!").alias("render")))


@query("s17_event_ids", f"with {O.EV} select type, count(distinct (usr, shard)) as n from ev where usr % 4 != 0 group by type")
def _s17(s, d):
    e = D.event_rows(s, d).select(F.lit(0).cast("long").alias("ts"), F.lit("s").alias("source"), F.col("type").alias("kind"), F.create_map(F.lit("u"), F.col("user").cast("string")).alias("payload"))
    named = events.with_id(e)
    stored = named.where(F.col("payload")["u"].cast("long") % 4 == 0)
    return events.insert_new(named, stored).groupBy(F.col("kind").alias("type")).agg(F.count("*").alias("n"))


# --- filters ----------------------------------------------------------------------------


def _filter(name: str, where: str, *matchers: tuple[str, str, str]) -> None:
    query(name, f"with {O.GAUGE} {PICK} where {where}")(lambda s, d: flat(select.match(D.gauge(s, d), *matchers)))


_filter("f1_label_eq", "type = 'click'", ("type", "=", "click"), ("absent", "=", ""))
_filter("f2_label_ne", "type != 'click'", ("type", "!=", "click"), ("absent", "!=", "x"))
_filter("f3_label_re", "type in ('click', 'view')", ("type", "=~", "cl.*|view"), ("absent", "=~", ".*"))
_filter("f4_label_nre", "type not in ('click', 'view')", ("type", "!~", "cl.*|view"))
_filter("f5_conjunction", "type in ('click', 'view') and shard != '3'", ("type", "=~", "click|view"), ("shard", "!=", "3"))
query("f6_time_range", f"with {O.GAUGE} {PICK} where ts between {T0 + DAY} and {T0 + 3 * DAY}")(lambda s, d: flat(D.gauge(s, d).where(F.col("ts").between(T0 + DAY, T0 + 3 * DAY))))
query("f7_event_filter", f"with {O.EV} select cast(event_id as varchar) as id, ts from ev where ts >= {LOW} and ts <= {HIGH} and shard in (1, 2) and type in ('click', 'error')")(lambda s, d: events.filter_events(D.events(s, d), LOW, HIGH, ["shard1", "shard2"], ["click", "error"]).select("id", "ts"))
query("f8_panel_filter", f"with {O.EV} select cast(event_id as varchar) as id, ts from ev where ts >= {LOW} and shard in (1, 2) and type in ('click', 'error')")(lambda s, d: events.filter_for_panel(D.events(s, d), LOW, 0, [{"source": "shard1", "kind": "click"}, {"source": "shard2", "kind": "error"}]).select("id", "ts"))

# --- range functions --------------------------------------------------------------------

for _i, _fn in enumerate(("rate", "irate", "increase", "delta", "avg_over_time", "sum_over_time", "min_over_time", "max_over_time", "count_over_time"), 1):
    _resets = _fn in ("rate", "irate", "increase")
    query(f"w{_i}_{_fn}", f"with {O.ranged(_fn, O.counter(40) if _resets else O.GAUGE)} select sig as labels_sig, t as ts, round(v, 6) as value from r")(
        lambda s, d, fn=_fn, resets=_resets: flat(R.range_function(D.counter(s, d, 40) if resets else D.gauge(s, d), fn, WIN, START, END, STEP))
    )
query("w10_grid_end_only", f"with {O.ranged('sum_over_time', O.GAUGE, start=END, step=STEP)} select sig as labels_sig, t as ts, round(v, 6) as value from r")(lambda s, d: flat(R.range_function(D.gauge(s, d), "sum_over_time", WIN, START, END, 0)))
query("w11_lookback", f"with {O.ranged('count_over_time', O.GAUGE, step=HOUR)} select sig as labels_sig, t as ts, round(v, 6) as value from r")(lambda s, d: flat(R.range_function(D.gauge(s, d), "count_over_time", WIN, START, END, HOUR)))
query("w12_panel_step", f"with {O.ranged('max_over_time', O.GAUGE, start=T0, end=T0 + 30 * DAY, step=3 * HOUR)} select sig as labels_sig, t as ts, round(v, 6) as value from r")(lambda s, d: flat(R.range_function(D.gauge(s, d), "max_over_time", WIN, T0, T0 + 30 * DAY, R.step_for(30 * DAY))))
# 36 steps a window, by panes
query("w_wide_rate", f"with {O.ranged('rate', O.counter(40), step=HOUR // 3)} select sig as labels_sig, t as ts, round(v, 6) as value from r")(lambda s, d: flat(R.range_function(D.counter(s, d, 40), "rate", WIN, START, END, HOUR // 3)))
query("w_wide_delta", f"with {O.ranged('delta', O.GAUGE, step=HOUR // 3)} select sig as labels_sig, t as ts, round(v, 6) as value from r")(lambda s, d: flat(R.range_function(D.gauge(s, d), "delta", WIN, START, END, HOUR // 3)))
query("w_align_to_grid", f"with {O.ranged('last_over_time', O.GAUGE)} select sig as labels_sig, t as ts, round(v, 6) as value from r")(lambda s, d: flat(R.align_to_grid(D.gauge(s, d), WIN, START, END, STEP)))

# --- aggregation ------------------------------------------------------------------------

for _i, _op in enumerate(A.OPS):
    query(f"a{1 + _i}_{_op}", O.aggregated(_op, (), "''"))(lambda s, d, op=_op: fine(A.aggregate(averages(s, d), op)))
    query(f"a{6 + _i}_{_op}_by", O.aggregated(_op, ("type",), "'type=' || type || ',zone='"))(lambda s, d, op=_op: fine(A.aggregate(averages(s, d), op, by=["type", "zone"])))
    query(f"a{11 + _i}_{_op}_without", O.aggregated(_op, ("type",), "'type=' || type"))(lambda s, d, op=_op: fine(A.aggregate(averages(s, d), op, without=["shard"], named_in=D.gauge(s, d))))
query("a16_empty_lists", O.aggregated("sum", (), "''"))(lambda s, d: fine(A.aggregate(averages(s, d), "sum", by=[], without=[])))
for _q in (0.5, 0.95):
    query(f"a17_quantile_{int(100 * _q)}", O.quantile(_q))(lambda s, d, q=_q: flat(histogram.histogram_quantile(D.quantity_buckets(s, d), q)))
_STATS_SQL = {"lastNotNull": "arg_max(v, ts)", "last": "arg_max(v, ts)", "first": "arg_min(v, ts)", "max": "max(v)", "min": "min(v)", "mean": "avg(v)", "sum": "sum(v)"}
for _calc, _sql in _STATS_SQL.items():
    query(f"a18_stat_{_calc.lower()}", f"with {O.GAUGE} select sig as labels_sig, round({_sql}, 6) as value from s group by sig")(lambda s, d, calc=_calc: reduce.stat(D.gauge(s, d), reduce.choose(["p99", calc])).select("labels_sig", F.round("value", 6).alias("value")))


def _packed(s, d) -> tuple[DataFrame, DataFrame]:
    return upkeep.pack(D.gauge(s, d), T0 + 20 * DAY, least=16, most=50)


query("a19_store_stats", f"with {O.GAUGE} select count(*) as samples from s")(lambda s, d: reduce.store_stats(*reversed(_packed(s, d))))
query("a20_extent", f"with {O.GAUGE} select min(ts) as min_ts, max(ts) as max_ts from s")(lambda s, d: reduce.extent(*reversed(_packed(s, d))))

_RULE = alerts.Rule("high", "last(event_value)", ">", 40.0, 2 * HOUR)


def _ticks(s, d) -> DataFrame:
    return alerts.observe(D.gauge(s, d), "high", HOUR, START, END)


def _timeline(s, d) -> DataFrame:
    return alerts.timeline(_ticks(s, d), alerts.rules_frame(s, [_RULE]).withColumnRenamed("name", "rule"))


_LINE = O.alert_timeline(40.0, 2 * HOUR, HOUR)


@query("a21_alert_counters", f"with e as ({_LINE}), x as (select count(*) as n from e), z as (select labels_sig, arg_max(status, (coalesce(resolved_at, fired_at), status)) as st from e group by labels_sig) select (select count(*) from (with {O.alert_ticks(40.0, HOUR)} select * from k)) as evaluations, n as sends, (select count(*) from e where status = 'resolved') as send_failures, (select count(*) from z where st = 'firing') as firing from x")
def _a21(s, d):
    done = _timeline(s, d)
    # deliveries of resolved alerts are taken as failed, to have both kinds
    return reduce.alert_counters(done, done.select((F.col("status") == "firing").alias("ok")), _ticks(s, d))


@query("a22_health", f"with {O.EV}, a as (select 't' || shard as target, arg_max(row(ts, case when type = 'error' then 0 else usr end, case when type = 'error' then 500 else 200 end, usr % 100, type), (ts, event_id)) as l from ev group by shard), t as (select unnest(['t0','t1','t2','t3','t4','t5','t6','t7','t8']) as target) select t.target, l[1] as last_ts, l[2] as samples, l[3] as code, l[4] as duration_ms, case when l[5] = 'error' then 'status 500' else '' end as error, case when l is null then 'pending' when l[5] = 'error' then 'down' else 'ok' end as status from t left join a on t.target = a.target")
def _a22(s, d):
    return reduce.health(s.range(9).select(F.concat(F.lit("t"), F.col("id")).alias("target")), D.attempts(s, d))


query("a23_panel_extent", f"{AVG} select min(t) as x_min, max(t) as x_max, round(min(v), 6) as y_min, round(max(v), 6) as y_max from r")(lambda s, d: reduce.panel_extent(averages(s, d)).select("x_min", "x_max", F.round("y_min", 6).alias("y_min"), F.round("y_max", 6).alias("y_max")))

# --- joins and arithmetic ---------------------------------------------------------------

query("j1_series_join", f"with {O.DAILY} select sig as labels_sig, ts, round(price / n, 6) as value from d")(lambda s, d: flat(arith.with_vector(D.orders_daily(s, d)[0], "/", D.orders_daily(s, d)[1])))


@query("j2_single_series", f"with {O.DAILY} select sig as labels_sig, ts, round(n / sum(n) over (partition by ts), 6) as value from d")
def _j2(s, d):
    count = D.orders_daily(s, d)[1]
    return flat(arith.with_vector(count, "/", A.aggregate(count, "sum"), right_single=True))


@query("j2_single_left", f"with {O.DAILY} select sig as labels_sig, ts, round(sum(n) over (partition by ts) / n, 6) as value from d")
def _j2_left(s, d):
    count = D.orders_daily(s, d)[1]
    return flat(arith.with_vector(A.aggregate(count, "sum"), "/", count, broadcast="both"))


@query("j3_overlay", f"with {O.EV}, p as (select 'p' || i as panel, {T0} + i * {DAY} as lo, {T0} + i * {DAY} + 30 * {HOUR} as hi from range(28) t(i)), m as (select panel, event_id, ts, row_number() over (partition by panel order by ts desc, cast(event_id as varchar)) as rn from p join ev on ts between lo and hi) select panel, cast(event_id as varchar) as id, ts from m where rn <= 200")
def _j3(s, d):
    windows = s.range(28).select(F.concat(F.lit("p"), "id").alias("panel"), (F.col("id") * DAY + T0).alias("start"), (F.col("id") * DAY + T0 + 30 * HOUR).alias("end"))
    return panels.events_overlay(D.events(s, d), windows).select("panel", "id", "ts")


query("j4_nearest", f"with {O.GAUGE}, o as (select *, row_number() over (partition by sig order by abs(ts - {HIGH}), ts) as rn from s) {PICK.replace(' from s', ' from o')} where rn = 1")(lambda s, d: flat(rank.nearest_sample(D.gauge(s, d), HIGH)))
for _i, (_name, _op) in enumerate((("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")), 1):
    _l = f"v {_op} 4" if _op != "/" else "v / 4"
    _r = f"100 {_op} v" if _op != "/" else "case when v = 0 then 0 else 100 / v end"
    query(f"x{_i}_{_name}_scalar", f"{AVG} select sig as labels_sig, t as ts, round({_l}, {O.DIGITS}) as value from r")(lambda s, d, op=_op: fine(arith.with_scalar(averages(s, d), op, 4)))
    query(f"x{_i}_scalar_{_name}", f"{AVG} select sig as labels_sig, t as ts, round({_r}, {O.DIGITS}) as value from r")(lambda s, d, op=_op: fine(arith.with_scalar(averages(s, d), op, 100, scalar_left=True)))
    query(f"x{_i + 4}_{_name}_vector", f"with {O.DAILY} select sig as labels_sig, ts, round(price {_op} n, 6) as value from d")(lambda s, d, op=_op: flat(arith.with_vector(D.orders_daily(s, d)[0], op, D.orders_daily(s, d)[1])))
query("x4_zero_division", f"{AVG} select sig as labels_sig, t as ts, 0.0::double as value from r")(lambda s, d: flat(arith.with_scalar(averages(s, d), "/", 0)))
query("x9_signature", f"with {O.EV} select event_id, 'shard=' || shard || ',type=' || type || ',user=' || usr as sig from ev")(lambda s, d: D.event_rows(s, d).select("event_id", L.signature(F.create_map(F.lit("user"), F.col("user").cast("string"), F.lit("type"), F.col("type"), F.lit("shard"), F.col("shard").cast("string"))).alias("sig")))


@query("x10_parse_signature", f"with {O.EV} select event_id, case when shard = 0 then 0 else 2 end as n, case when shard = 0 then '' else type end as type, case when shard = 0 then '' else 'a=' || usr end as usr from ev")
def _x10(s, d):
    text = F.when(F.col("shard") == 0, "").otherwise(F.concat(F.lit("type="), "type", F.lit(",usr=a="), F.col("user").cast("string")))
    e = D.event_rows(s, d).select("event_id", L.parse_signature(text).alias("labels"))
    return e.select("event_id", F.size("labels").alias("n"), L.label(F.col("labels"), "type").alias("type"), L.label(F.col("labels"), "usr").alias("usr"))


query("x11_fingerprint", f"with {O.EV} select event_id, sha256('a' || chr(0) || type || chr(0) || 'b' || chr(0) || usr) as print from ev")(lambda s, d: D.event_rows(s, d).select("event_id", F.sha2(L.fingerprint(F.create_map(F.lit("b"), F.col("user").cast("string"), F.lit("a"), F.col("type"))), 256).alias("print")))
query("x12_compare", f"with {O.EV} select event_id, amount < 20 as lt, amount <= 20 as le, amount >= 20 as ge, amount > 20 as gt, amount > 20 as unknown from ev")(lambda s, d: D.event_rows(s, d).select("event_id", *(L.compare(F.col("amount"), op, 20.0).alias(n) for n, op in (("lt", "<"), ("le", "<="), ("ge", ">="), ("gt", ">"), ("unknown", "??")))))


@query("x13_legend", f"with {O.EV} select event_id, case shard % 4 when 0 then 'm' when 1 then type when 2 then 'a=' || type || ' b=' || usr else 'j' end as plain, type || '/' || case when shard % 4 = 3 then 'j' else '' end as templated from ev")
def _x13(s, d):
    k, one, two, job = F.col("shard") % 4, F.create_map(F.lit("a"), F.col("type"), F.lit("job"), F.lit("x")), F.create_map(F.lit("a"), F.col("type"), F.lit("b"), F.col("user").cast("string")), F.create_map(F.lit("job"), F.lit("j"))
    labels = F.when(k == 0, F.create_map().cast("map<string,string>")).when(k == 1, one).when(k == 2, two).otherwise(job)
    named = F.map_concat(F.map_filter(labels, lambda key, _: (key == "job") & (k == 3)), F.create_map(F.lit("t"), F.col("type")))
    return D.event_rows(s, d).select("event_id", L.legend(F.lit("m"), labels).alias("plain"), L.legend(F.lit("m"), named, "{{t}}/{{job}}{{none}}").alias("templated"))


query("x14_path", f"with {O.EV} select event_id, cast(ts as varchar) as ms, cast(null as varchar) as none from ev")(lambda s, d: events.parse_json(D.log_lines(s, d, "json")).select("event_id", L.path(F.col("record"), "$.at.ms").alias("ms"), L.path(F.col("record"), "$.at.x").alias("none")))


@query("x15_to_millis", f"with {O.EV} select event_id, case shard % 4 when 0 then ts when 1 then usr when 2 then ts else null end as ms from ev")
def _x15(s, d):
    k = F.col("shard") % 4
    text = F.when(k == 0, F.col("ts").cast("string")).when(k == 1, F.concat(F.col("user").cast("string"), F.lit(".75"))).when(k == 2, F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("2024")
    return D.event_rows(s, d).select("event_id", F.when(k == 3, L.to_millis(F.lit("x2024"))).otherwise(L.to_millis(text)).alias("ms"))


# --- ranking and unions -----------------------------------------------------------------

_TOP = "{avg}, o as (select *, row_number() over (partition by t order by v {way}, sig) as rn from r) select sig as labels_sig, t as ts, round(v, 6) as value from o where rn <= 3"
query("r1_topk", _TOP.format(avg=AVG, way="desc"))(lambda s, d: flat(rank.topk(averages(s, d), 3)))
query("r2_bottomk", _TOP.format(avg=AVG, way="asc"))(lambda s, d: flat(rank.bottomk(averages(s, d), 3)))
query("r3_series_order", f"{AVG} select sig as labels_sig, t as ts, round(v, 6) as value from r order by 1, 2")(lambda s, d: select.series_order(flat(averages(s, d))))
query("r4_newest", f"with {O.EV} select cast(event_id as varchar) as id, ts from ev order by ts desc, cast(event_id as varchar) limit 200")(lambda s, d: rank.newest(D.events(s, d)).select("id", "ts"))
query("u1_merge_targets", f"with {O.DAILY} select 0 as target_idx, '{{{{status}}}}' as legend, sig as labels_sig, ts, round(price, 6) as value from d union all select 1, 'n', sig, ts, n from d")(lambda s, d: flat(upkeep.merge_targets([(D.orders_daily(s, d)[0], "{{status}}"), (D.orders_daily(s, d)[1], "n")]), "target_idx", "legend"))


@query("u2_raw_and_packed", f"with {O.GAUGE} select sig as labels_sig, ts, round(case when ts >= {T0 + 15 * DAY} then v + 1 else v end, 6) as value from s")
def _u2(s, d):
    packed, rest = _packed(s, d)
    raw = rest.unionByName(D.gauge(s, d).where(F.col("ts").between(T0 + 15 * DAY, T0 + 20 * DAY))).dropDuplicates(["metric", "labels_sig", "ts"]).where(F.col("ts") >= T0 + 15 * DAY)
    low = rest.where(F.col("ts") < T0 + 15 * DAY)
    return flat(upkeep.merge_raw_packed(arith.with_scalar(raw, "+", 1).unionByName(low), upkeep.unpack(packed, T0, END + 30 * DAY)))


# --- alerts and upkeep ------------------------------------------------------------------


def _transitions(frame: DataFrame) -> DataFrame:
    return frame.select("labels_sig", "status", "fired_at", "resolved_at", F.round("value", 6).alias("value"))


query("t2_alert_timeline", _LINE)(lambda s, d: _transitions(_timeline(s, d)))
query("t2_alert_replay", _LINE)(lambda s, d: _transitions(alert_state.replay(_ticks(s, d), alerts.rules_frame(s, [_RULE]).withColumnRenamed("name", "rule"))))
query("t3_alert_ticks", f"with {O.alert_ticks(40.0, HOUR)} select sig as labels_sig, tick, round(v, 6) as value from k")(lambda s, d: _ticks(s, d).select("labels_sig", "tick", F.round("value", 6).alias("value")))


@query("t4_rule_change", _LINE)
def _t4(s, d):
    rules = alerts.rules_frame(s, [_RULE, alerts.Rule("gone", "x", "<", 10.0)]).withColumnRenamed("name", "rule")
    ticks = _ticks(s, d)
    done = alerts.timeline(ticks.unionByName(ticks.withColumn("rule", F.lit("gone"))), rules)
    return _transitions(alerts.keep_rules(done, rules.where(F.col("rule") == "high")))


query("s18_alert_bodies", f"with e as ({_LINE}) select labels_sig, status, cast(fired_at as varchar) as fired_at, cast(resolved_at as varchar) as resolved_at from e")(
    lambda s, d: alerts.bodies(_timeline(s, d)).select("labels_sig", "status", F.get_json_object("body", "$.fired_at").alias("fired_at"), F.get_json_object("body", "$.resolved_at").alias("resolved_at"))
)
query("m1_time_retention", f"with {O.GAUGE} {PICK} where ts >= {T0 + 10 * DAY}")(lambda s, d: flat(upkeep.retain(D.gauge(s, d), T0 + 20 * DAY, 10 * DAY)))

_RUNS = f"with {O.GAUGE}, p as (select *, count(*) filter (where ts < {T0 + 20 * DAY} - 7200000) over (partition by sig) as n_old from s), o as (select *, (row_number() over (partition by sig order by ts) - 1) // 50 as run from p where ts < {T0 + 20 * DAY} - 7200000 and n_old >= 16), k as (select sig as labels_sig, run, min(ts) as start_ts, max(ts) as end_ts, cast(count(*) as integer) as count from o group by sig, run)"
query("m1_retention_report", f"{_RUNS} select 'samples' as \"table\", (select count(*) from s where ts < {T0 + 10 * DAY}) as dropped union all select 'packed', (select count(*) from k where end_ts < {T0 + 10 * DAY}) union all select 'events', (select count(*) from ev where ts < {T0 + 10 * DAY})")(lambda s, d: upkeep.retention_report(D.gauge(s, d), _packed(s, d)[0], D.events(s, d), T0 + 20 * DAY, 10 * DAY))
query("m1_packed_retention", f"{_RUNS} select labels_sig, start_ts, end_ts, count from k where end_ts >= {T0 + 10 * DAY}")(lambda s, d: upkeep.retain_packed(_packed(s, d)[0], T0 + 20 * DAY, 10 * DAY).select("labels_sig", "start_ts", "end_ts", "count"))
query("m2_size_retention", f"with {O.GAUGE}, p as (select ts // {DAY} as part, count(*) * 30 as bytes from s group by 1), h as (select *, sum(bytes) over (order by part desc) as held from p) select part, bytes, cast(held as bigint) as held from h where held <= (select sum(bytes) // 2 from p)")(
    lambda s, d: (lambda parts: upkeep.retain_size(parts, parts.agg(F.expr("sum(bytes) div 2")).scalar()))(D.gauge(s, d).groupBy(F.expr(f"ts div {DAY}").alias("part")).agg((F.count("*") * 30).alias("bytes")))
)
query("m3_series_dictionary", f"with {O.GAUGE} select distinct 'event_value' as metric, sig as labels_sig, 1 as n_ids from s")(lambda s, d: upkeep.series_dictionary(D.gauge(s, d)).groupBy("metric", "labels_sig").agg(F.count_distinct("series_id").cast("int").alias("n_ids")))
query("m3_series_ids", f"with {O.GAUGE} select count(distinct sig) as series, count(distinct sig) as ids, cast(0 as bigint) as collisions from s")(
    lambda s, d: (lambda held: held.agg(F.count("*").alias("series"), F.count_distinct("series_id").alias("ids")).withColumn("collisions", upkeep.id_collisions(held).agg(F.count("*").alias("n")).scalar()))(upkeep.series_dictionary(D.gauge(s, d)))
)
query("m4_pack", f"{_RUNS} select labels_sig, start_ts, end_ts, count from k")(lambda s, d: _packed(s, d)[0].select("labels_sig", "start_ts", "end_ts", "count"))
query("m5_unpack", f"{_RUNS} select sig as labels_sig, ts, round(v, 6) as value from o where ts between {LOW} and {HIGH}")(lambda s, d: flat(upkeep.unpack(_packed(s, d)[0], LOW, HIGH)))

# --- prepared panels --------------------------------------------------------------------

_STEP, _WINDOW = 6 * HOUR, 12 * HOUR


def _panel(s, d) -> panels.Panels:
    return panels.Panels(D.panel_samples(s, d), START, END, _STEP, _WINDOW)


def _rates(key: str, scale: float, sig: str, where: str = "true", keys: str = "type") -> str:
    return f"with {O.ranged('rate', O.counter(), where=where)} select {sig} as labels_sig, t as ts, round(sum(v) * {scale}, 6) as value from r group by t, {keys}" if key else ""


query("p1_cpu_by_mode", _rates("mode", 0.5, "'mode=' || type"))(lambda s, d: flat(_panel(s, d).cpu_by_mode()))
query("p2_load", f"with {O.GAUGE}, l as (select unnest([0, 1, 2]) as target_idx, unnest(['1m', '5m', '15m']) as legend, unnest(['click', 'view', 'purchase']) as kind) select target_idx, legend, 'shard=' || shard as labels_sig, ts, round(v, 6) as value from s join l on s.type = l.kind where ts between {START} and {END}")(lambda s, d: flat(_panel(s, d).load_averages(), "target_idx", "legend"))
query("p3_memory_available", f"with {O.GAUGE} select sig as labels_sig, ts, round(v * 3, 6) as value from s where ts between {START} and {END}")(lambda s, d: flat(_panel(s, d).memory_available()))
query("p3_memory_used", f"with {O.GAUGE} select sig as labels_sig, ts, round(v * 8 - v * 3, 6) as value from s where ts between {START} and {END}")(lambda s, d: flat(_panel(s, d).memory_used()))
_PAIR = "with {body}, x as (select t, type, sum(v) as v from r group by t, type), m as (select * from (values {values}) y(target_idx, scale)) select target_idx, '{{{{{label}}}}}' as legend, '{label}=' || type as labels_sig, t as ts, round(v * scale, 6) as value from x, m"
_BODY = O.ranged("rate", O.counter())
query("p4_network", _PAIR.format(body=_BODY, values="(0, 100), (1, 200)", label="device"))(lambda s, d: flat(_panel(s, d).network(), "target_idx", "legend"))
query("p5_disk", _PAIR.format(body=_BODY, values="(0, 300), (1, 400)", label="device"))(lambda s, d: flat(_panel(s, d).disk(), "target_idx", "legend"))
query("p6_containers", _PAIR.format(body=_BODY, values="(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)", label="name") + f" union all select 5, '{{{{name}}}}', 'name=' || type, ts, round(sum(v) * 10, 6) from (select type, ts, arg_max(amount, event_id) as v from ev where ts between {START} and {END} group by type, shard, ts) group by type, ts")(lambda s, d: flat(_panel(s, d).containers(), "target_idx", "legend"))
query("p7_health_stats", f"with {O.ranged('increase', O.counter())} select sig as labels_sig, round(arg_max(v, t), 6) as value from r group by sig")(lambda s, d: _panel(s, d).health_stat("increase", "self_scrapes_total", WIN).select("labels_sig", F.round("value", 6).alias("value")))
query("p8_events_table", f"with {O.EV} select cast(event_id as varchar) as id, ts from ev where ts between {START} and {END} and type = 'error' order by ts desc, cast(event_id as varchar) limit 50")(lambda s, d: panels.events_table(D.events(s, d), START, END, [{"kind": "error"}]).select("id", "ts"))
query("p9_error_share", f"with {_BODY}, x as (select t, type, sum(v) as v from r group by t, type) select 'status=' || type as labels_sig, t as ts, round(case when sum(v) over (partition by t) = 0 then 0 else v / sum(v) over (partition by t) end, 6) as value from x")(lambda s, d: flat(_panel(s, d).error_share("http_requests_total", "status")))


_Y0, _Y1 = 725_846_400_000, 1_041_379_200_000  # 1993 to 2002


@query("p10_latency", O.latency(0.95, _Y0, _Y1, 30 * DAY, 90 * DAY))
def _p10(s, d):
    return flat(panels.Panels(D.quantity_buckets(s, d), _Y0, _Y1, 30 * DAY, 90 * DAY).latency("order_qty_bucket", 0.95, 90 * DAY))
