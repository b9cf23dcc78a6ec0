"""Range-vector functions on an evaluation grid.

A sample belongs to every grid time t with ``t - window <= ts <= t``. There is neither
a range join nor a Python function, and samples combine before the first shuffle.

Narrow windows (up to ``MOST_EXPLODED`` steps): each sample is exploded to its grid
times and hash-aggregated, window / step + 1 rows for each sample.

Wide windows: times are cut where any window starts or ends. As times are whole
milliseconds, [t - window, t] ends just before t + 1, so a sample on an edge falls on
the right side of each cut. Samples between two cuts (a pane) always count together
and become one partial state. All windows span equally many panes; panes are put in
blocks of that many, so a window is the end of one block and the start of the next.
Running states from both ends of each block give two rows for each window, whatever
its width: rows grow with samples, panes and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_STEP = 15_000
DAY = 86_400_000
MOST_EXPLODED = 8
LEAST_SAMPLES = {"rate": 2, "irate": 2, "increase": 2, "delta": 2}


def step_for(window_ms: int, points: int = 240) -> int:
    """Step that gives a panel about ``points`` points, a second at least."""
    return max(round(window_ms / points), 1000)


def grid(start: int, end: int, step: int) -> list[int]:
    """Evaluation times: every step from ``start``, and ``end`` itself; a step of 0 is ``end`` alone."""
    if step <= 0:
        return [end]
    times = list(range(start, end + 1, step))
    return times if times and times[-1] == end else [*times, end]


def grid_times(ts: Column, window: int, start: int, end: int, step: int) -> Column:
    """Array of the grid times whose window holds ``ts``."""
    last = F.when((ts >= end - window) & (ts <= end), F.array(F.lit(end).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    if step <= 0:
        return last
    low = F.greatest(F.lit(0), F.ceil((ts - start) / step)).cast("long")
    high = F.least(F.floor((ts + window - start) / step), F.lit((end - start) // step)).cast("long")
    steps = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * step + start)).otherwise(F.array().cast("array<bigint>"))
    return steps if (end - start) % step == 0 else F.concat(steps, last)


def _refuse_absurd(window: int, step: int, most_steps: int = 100_000) -> None:
    if step > 0 and window / step > most_steps:
        raise ValueError(f"window / step is over {most_steps}; take a larger step")


def explode_to_grid(samples: DataFrame, window: int, start: int, end: int, step: int, most_steps: int = 100_000) -> DataFrame:
    """Samples within the lookback, once for each grid time ``t`` they count for."""
    _refuse_absurd(window, step, most_steps)
    reach = samples.where(F.col("ts").between(max(0, start - window), end))
    return reach.withColumn("t", F.explode(grid_times(F.col("ts"), window, start, end, step)))


def _value(fn: str, window: int) -> Column:
    inside = F.col("prev_ts") >= F.col("t") - window
    span = (F.max("ts") - F.min("ts")) / 1000.0
    total = F.coalesce(F.sum(F.when(inside, F.col("inc"))), F.lit(0.0))
    rate = F.when(span > 0, total / span).otherwise(0.0)
    return {
        "rate": rate,
        "increase": rate * (window / 1000.0),
        "irate": F.max_by(F.when(inside, F.col("instant")), "ts"),
        "delta": F.max_by("value", "ts") - F.min_by("value", "ts"),
        "avg_over_time": F.avg("value"),
        "sum_over_time": F.sum("value"),
        "min_over_time": F.min("value"),
        "max_over_time": F.max("value"),
        "count_over_time": F.count("*").cast("double"),
        "last_over_time": F.max_by("value", "ts"),
    }[fn]


def with_previous(samples: DataFrame, window: int) -> DataFrame:
    """Add ``prev_ts`` and ``prev`` of the sample before in the series, if it is within ``window``.

    Series are cut into blocks of time, so that a long or dense one is no single task;
    samples at the end of a block are carried into the next one, as its first ones may
    follow them. Samples further apart never share a window, so nothing reads them.
    """
    size = max(DAY, 4 * window)
    block = F.floor(F.col("ts") / size)
    blocks = F.when(F.col("ts") >= (block + 1) * size - window, F.array(block, block + 1)).otherwise(F.array(block))
    within = Window.partitionBy("metric", "labels_sig", "block").orderBy("ts")
    out = samples.withColumn("block", F.explode(blocks)).withColumns({"prev_ts": F.lag("ts").over(within), "prev": F.lag("value").over(within)})
    return out.where(F.col("block") == block).drop("block")


def range_function(samples: DataFrame, fn: str, window: int, start: int, end: int, step: int = DEFAULT_STEP, most_exploded: int = MOST_EXPLODED) -> DataFrame:
    """One row for each series and grid time with enough samples in ``[t - window, t]``.

    ``rate``, ``increase`` and ``irate`` read a drop as a counter reset (the new value is
    the increment); rates divide by the span between first and last sample.
    """
    reach = samples.where(F.col("ts").between(max(0, start - window), end))
    if fn in ("rate", "increase", "irate"):
        reach = with_previous(reach, window)
        reach = reach.withColumn("inc", F.when(F.col("value") >= F.col("prev"), F.col("value") - F.col("prev")).when(F.col("prev").isNotNull(), F.col("value")))
        gap = (F.col("ts") - F.col("prev_ts")) / 1000.0
        reach = reach.withColumn("instant", F.when(gap > 0, F.col("inc") / gap).when(gap <= 0, 0.0))
    _refuse_absurd(window, step)
    if step > 0 and window > most_exploded * step and end >= start:
        out = _from_panes(reach, fn, window, start, end, step)
        if (end - start) % step:
            out = out.unionByName(_exploded(reach, fn, window, start, end, 0))
    else:
        out = _exploded(reach, fn, window, start, end, step)
    return out.where(F.col("n") >= LEAST_SAMPLES.get(fn, 1)).select("metric", "labels", "labels_sig", F.col("t").alias("ts"), "value")


SERIES = ("metric", "labels_sig", "labels")


def _exploded(reach: DataFrame, fn: str, window: int, start: int, end: int, step: int) -> DataFrame:
    return explode_to_grid(reach, window, start, end, step).groupBy(*SERIES, "t").agg(_value(fn, window).alias("value"), F.count("*").alias("n"))


def _pane_states(reach: DataFrame, pane: Column) -> DataFrame:
    """One state for each series and pane; columns that a function does not read are pruned.

    ``rise`` adds the increments within the pane, without that of its first sample,
    which counts (as ``first_inc``) only where an earlier pane is in the window.
    """
    first_inc = F.min_by("inc", "ts")
    inside = F.col("prev_ts") >= F.col("pane_start")
    return reach.withColumn("pane", pane).groupBy(*SERIES, "pane").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min("ts").alias("first_ts"), F.min_by("value", "ts").alias("first_value"), F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("last_value"),
        first_inc.alias("first_inc"), F.coalesce(F.sum(F.when(inside, F.col("inc"))), F.lit(0.0)).alias("rise"),
        F.max_by("prev_ts", "ts").alias("last_prev"), F.max_by("instant", "ts").alias("instant"),
    )


def pane_rows(reach: DataFrame, fn: str, window: int, start: int, end: int, step: int) -> DataFrame:
    """The states that make up each series' window at each grid time start + k * step: the end of a block and the start of the next."""
    opens, closes = (start - window) % step, (start + 1) % step
    cuts = sorted({opens, closes})

    def number(ts):
        return sum((ts - c) // step for c in cuts)

    def number_column(ts: Column) -> Column:
        out = F.lit(0).cast("long")
        for c in cuts:
            out = out + F.floor((ts - c) / step)
        return out

    # The time at which a sample's pane starts: the last cut at or before it.
    starts = F.greatest(*(F.floor((F.col("ts") - c) / step) * step + c for c in cuts)) if len(cuts) > 1 else F.floor((F.col("ts") - cuts[0]) / step) * step + cuts[0]
    low, last, hop = number(start - window), (end - start) // step, len(cuts)
    span = number(start) - low + 1  # panes in a window
    counters = fn in ("rate", "increase", "irate")
    rows = reach.withColumn("pane_start", starts)
    if not counters:
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("prev_ts", "long"), ("inc", "double"), ("instant", "double"))})
    states = _pane_states(rows, number_column(F.col("ts")) - low).withColumn("block", F.floor(F.col("pane") / span))
    part = Window.partitionBy("metric", "labels_sig", "block")
    ahead, back = part.orderBy("pane"), part.orderBy(F.desc("pane"))
    upto, onward = ahead.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, 0)
    block_end = (F.col("block") + 1) * span - 1
    sums = {"n": F.sum("n"), "total": F.sum("total"), "low": F.min("low"), "high": F.max("high")}
    states = states.withColumn("joint", F.when(F.row_number().over(ahead) > 1, F.coalesce("first_inc", F.lit(0.0))).otherwise(0.0))
    later = F.coalesce(F.sum(F.coalesce("first_inc", F.lit(0.0))).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    states = states.withColumns(
        {f"{c}_upto": agg.over(upto) for c, agg in sums.items()}
        | {f"{c}_onward": agg.over(onward) for c, agg in sums.items()}
        | {f"{c}_upto": F.first(c).over(upto) for c in ("first_ts", "first_value", "first_inc")}
        | {f"{c}_onward": F.first(c).over(onward) for c in ("last_ts", "last_value", "last_prev", "instant")}
        | {"rise_upto": F.sum(F.col("rise") + F.col("joint")).over(upto), "rise_onward": F.sum("rise").over(onward) + later}
        | {"before": F.coalesce(F.lag("pane").over(ahead) + 1, F.col("block") * span), "after": F.least(F.coalesce(F.lead("pane").over(ahead) - 1, block_end), block_end - 1)}
    )

    def hops(least: Column, most: Column) -> Column:
        """Windows k within least to most, both counted in panes."""
        first, final = F.greatest(F.ceil(least / hop), F.lit(0)).cast("long"), F.least(F.floor(most / hop), F.lit(last)).cast("long")
        return F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<bigint>"))

    # A window starts in the pane k * hop. The end of a block serves those that start at
    # the pane or, where panes are missing, before it; the start of a block those that
    # end there, but for the one that is the whole block.
    ends, begins = hops(F.col("before"), F.col("pane")), hops(F.col("pane") - span + 1, F.col("after") - span + 1)
    tagged = F.concat(F.transform(ends, lambda k: F.struct(k.alias("k"), F.lit(True).alias("end"))), F.transform(begins, lambda k: F.struct(k.alias("k"), F.lit(False).alias("end"))))
    end = F.col("w.end")
    either = {c: F.when(end, F.col(f"{c}_onward")).otherwise(F.col(f"{c}_upto")) for c in (*sums, "rise")}
    either |= {c: F.when(end, F.col(c)).otherwise(F.col(f"{c}_upto")) for c in ("first_ts", "first_value")}
    either |= {c: F.when(end, F.col(f"{c}_onward")).otherwise(F.col(c)) for c in ("last_ts", "last_value", "last_prev", "instant")}
    joint = F.when(~end, F.col("first_inc_upto"))
    return states.withColumn("w", F.explode(tagged)).select(*SERIES, (F.col("w.k") * step + start).alias("t"), end.alias("end"), joint.alias("joint"), *(c.alias(name) for name, c in either.items()))


def _from_panes(reach: DataFrame, fn: str, window: int, start: int, end: int, step: int) -> DataFrame:
    """n and value of every series and grid time start + k * step."""
    both = F.count_if("end") > 0
    rise = F.sum("rise") + F.when(both, F.coalesce(F.max("joint"), F.lit(0.0))).otherwise(0.0)
    seconds = (F.max("last_ts") - F.min("first_ts")) / 1000.0
    rate = F.when(seconds > 0, rise / seconds).otherwise(0.0)
    value = {
        "rate": rate,
        "increase": rate * (window / 1000.0),
        "irate": F.max_by(F.when(F.col("last_prev") >= F.col("t") - window, F.col("instant")), "last_ts"),
        "delta": F.max_by("last_value", "last_ts") - F.min_by("first_value", "first_ts"),
        "avg_over_time": F.sum("total") / F.sum("n"),
        "sum_over_time": F.sum("total"),
        "min_over_time": F.min("low"),
        "max_over_time": F.max("high"),
        "count_over_time": F.sum("n").cast("double"),
        "last_over_time": F.max_by("last_value", "last_ts"),
    }[fn]
    return pane_rows(reach, fn, window, start, end, step).groupBy(*SERIES, "t").agg(value.alias("value"), F.sum("n").alias("n"))


def align_to_grid(samples: DataFrame, window: int, start: int, end: int, step: int = DEFAULT_STEP) -> DataFrame:
    """Last sample in the window at each grid time; lets raw series meet range functions."""
    return range_function(samples, "last_over_time", window, start, end, step)
