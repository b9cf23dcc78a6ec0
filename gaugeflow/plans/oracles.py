"""DuckDB counterparts of the registered queries.

They are written from the definitions (range joins over the grid, windows,
plain aggregation), not from the Spark plans.
"""

from __future__ import annotations

from .adapters import DAY, EDGES, HOUR, T0

#: The whole month of the events table, ending off the grid; LOW to HIGH is the range of the time filters.
START, END, STEP, WIN = T0, T0 + 30 * DAY + 1_234_567, 6 * HOUR, 12 * HOUR
LOW, HIGH = T0 + 2 * DAY, T0 + 12 * DAY + 1_234_567
#: Digits of what is made of averages of cents; at six, halves are frequent, and engines round those differently.
DIGITS = 8

EV = "ev as (select event_id, epoch_us(ts) // 1000 as ts, event_type as type, user_id % 8 as shard, user_id as usr, value as amount, props from events)"
GAUGE = f"{EV}, s as (select 'shard=' || shard || ',type=' || type as sig, type, cast(shard as varchar) as shard, ts, arg_max(amount, event_id) as v from ev group by type, shard, ts)"


def counter(modulo: int | None = None) -> str:
    value = "row_number() over (partition by type, shard order by ts, event_id)"
    value = value if modulo is None else f"({value}) % {modulo}"
    return f"{EV}, n as (select *, {value} as k from ev), s as (select 'shard=' || shard || ',type=' || type as sig, type, cast(shard as varchar) as shard, ts, cast(arg_max(k, event_id) as double) as v from n group by type, shard, ts)"


def grid(start: int = START, end: int = END, step: int = STEP) -> str:
    return f"grid as (select unnest(range({start}, {end} + 1, {step})) as t union select {end})"


#: Aggregates of one series' samples in one window; pv and pts are the sample before, within the window.
_INC = "sum(case when pv is null then 0 when v >= pv then v - pv else v end)"
_RATE = f"case when max(ts) > min(ts) then {_INC} / ((max(ts) - min(ts)) / 1000.0) else 0 end"
FUNCTIONS = {
    "rate": (_RATE, 2),
    "increase": (f"({_RATE}) * {WIN} / 1000.0", 2),
    "irate": ("arg_max(case when ts > pts then (case when v >= pv then v - pv else v end) / ((ts - pts) / 1000.0) else 0 end, ts)", 2),
    "delta": ("arg_max(v, ts) - arg_min(v, ts)", 2),
    "avg_over_time": ("avg(v)", 1),
    "sum_over_time": ("sum(v)", 1),
    "min_over_time": ("min(v)", 1),
    "max_over_time": ("max(v)", 1),
    "count_over_time": ("cast(count(*) as double)", 1),
    "last_over_time": ("arg_max(v, ts)", 1),
}


def ranged(fn: str, base: str, window: int = WIN, where: str = "true", start: int = START, end: int = END, step: int = STEP) -> str:
    """CTEs ending in r(sig, type, shard, t, v): ``fn`` of every series at every grid time."""
    value, least = FUNCTIONS[fn]
    return (
        f"{base}, {grid(start, end, step)}, j as (select sig, type, shard, t, ts, v, lag(v) over w as pv, lag(ts) over w as pts from s join grid on ts between t - {window} and t where {where} "
        f"window w as (partition by sig, t order by ts)), r as (select sig, type, shard, t, {value} as v from j group by all having count(*) >= {least})"
    )


def aggregated(op: str, keys: tuple[str, ...], sig: str) -> str:
    value = "cast(count(v) as double)" if op == "count" else f"{op}(v)"
    group = "".join(f", {k}" for k in keys)
    return f"with {ranged('avg_over_time', GAUGE)} select {sig} as labels_sig, t as ts, round({value}, {DIGITS}) as value from r group by t{group}"


BUCKETS = (
    "q as (select l_returnflag as flag, epoch_ms(date_trunc('month', l_shipdate)) as ts, l_quantity as qty from lineitem), "
    f"le as (select unnest([{', '.join(f'{e}' for e in EDGES)}, 'inf'::double]) as le), "
    "b as (select flag, ts, le, cast(count(*) filter (where qty <= le) as double) as c from q, le group by flag, ts, le)"
)


def quantile(q: float) -> str:
    return (
        f"with {BUCKETS}, o as (select *, max(c) over (partition by flag, ts) as total, lag(le) over w as lo, lag(c) over w as pc, max(case when le < 'inf'::double then le end) over (partition by flag, ts) as top "
        f"from b window w as (partition by flag, ts order by le)), h as (select *, row_number() over (partition by flag, ts order by le) as rn from o where total > 0 and c >= {q} * total), "
        f"z as (select * from h where rn = 1) select 'flag=' || flag as labels_sig, ts, round(case when le = 'inf'::double then top when c - coalesce(pc, 0) <= 0 then le "
        f"else coalesce(lo, least(0, le)) + ({q} * total - coalesce(pc, 0)) / (c - coalesce(pc, 0)) * (le - coalesce(lo, least(0, le))) end, 6) as value from z"
    )


DAILY = "d as (select 'status=' || o_orderstatus as sig, epoch_ms(date_trunc('day', o_orderdate)) as ts, sum(o_totalprice) as price, cast(count(*) as double) as n from orders group by all)"


def alert_ticks(threshold: float, interval: int) -> str:
    """CTE k(sig, tick, v, crossed): the last value within the interval and a minute, at every tick."""
    body = ranged("last_over_time", GAUGE, interval + 60_000, start=START, end=END, step=interval)
    return f"{body}, k as (select sig, t as tick, v, v > {threshold} as crossed from r)"


def alert_timeline(threshold: float, hold: int, interval: int) -> str:
    """Transitions by runs of equal crossing state, counted as differences of two row numbers."""
    return (
        f"with {alert_ticks(threshold, interval)}, i as (select *, row_number() over (partition by sig order by tick) - row_number() over (partition by sig, crossed order by tick) as run, lead(tick) over (partition by sig order by tick) as nxt, lead(v) over (partition by sig order by tick) as nv from k), "
        f"u as (select sig, run, min(tick) as since, max(tick) as until, (array_agg(nxt order by tick desc))[1] as after, (array_agg(nv order by tick desc))[1] as after_v from i where crossed group by sig, run), "
        f"f as (select u.sig, u.run, u.after, u.after_v, min(i.tick) as fired from u join i on i.sig = u.sig and i.run = u.run and i.crossed and i.tick - u.since >= {hold} group by all) "
        f"select f.sig as labels_sig, 'firing' as status, f.fired as fired_at, cast(null as bigint) as resolved_at, round(i.v, 6) as value from f join i on i.sig = f.sig and i.tick = f.fired "
        f"union all select sig, 'resolved', fired, after, round(after_v, 6) from f where after is not null"
    )


def latency(q: float, start: int, end: int, step: int, window: int) -> str:
    """Quantile of the rates of the quantity buckets; every bucket of a flag is met at every month."""
    rate = "case when max(ts) > min(ts) then sum(case when pc is null then 0 when c >= pc then c - pc else c end) / ((max(ts) - min(ts)) / 1000.0) else 0 end"
    return (
        f"with {BUCKETS}, {grid(start, end, step)}, j as (select flag, le, t, ts, c, lag(c) over (partition by flag, le, t order by ts) as pc from b join grid on ts between t - {window} and t), "
        f"r as (select flag, le, t, {rate} as c from j group by all having count(*) >= 2), "
        "o as (select *, max(case when le = 'inf'::double then c end) over (partition by flag, t) as total, lag(le) over w as lo, lag(c) over w as pc, max(case when le < 'inf'::double then le end) over (partition by flag, t) as top from r window w as (partition by flag, t order by le)), "
        f"h as (select *, row_number() over (partition by flag, t order by le) as rn from o where total > 0 and c >= {q} * total), z as (select * from h where rn = 1) "
        f"select 'flag=' || flag as labels_sig, t as ts, round(case when le = 'inf'::double then top when c - coalesce(pc, 0) <= 0 then le else coalesce(lo, least(0, le)) + ({q} * total - coalesce(pc, 0)) / (c - coalesce(pc, 0)) * (le - coalesce(lo, least(0, le))) end, 6) as value from z"
    )
