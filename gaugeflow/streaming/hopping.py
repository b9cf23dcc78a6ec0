"""Range functions over a stream of samples.

Narrow windows of functions that don't heed the order (up to ``MOST_EXPLODED`` steps)
are hopping windows: one small state for each series and open window.

All others go by panes. Times are cut where any window starts or ends; the samples of a
series between two cuts become one pane once the watermark has passed it. A second
stateful step keeps the panes of the last ``window_ms`` of each series and gives out
every grid time that the watermark has passed, also after the series' last sample. A
sample is held once until its pane is done, then only its pane is, whatever the width
of the window; a series that ends leaves no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.range_fn import LEAST_SAMPLES, MOST_EXPLODED

SIMPLE = {"avg_over_time": F.avg, "sum_over_time": F.sum, "min_over_time": F.min, "max_over_time": F.max, "count_over_time": lambda c: F.count(c).cast("double")}
ORDERED = ("rate", "increase", "irate", "delta")

#: What is kept of a pane: number, sum and ends of its samples, and the increments within it.
PANE = {"first_ts": "long", "last_ts": "long", "before_ts": "long", "n": "long", "total": "double", "low": "double", "high": "double", "first": "double", "last": "double", "before": "double", "rise": "double"}
STATE = "next long, " + ", ".join(f"{name} array<{kind}>" for name, kind in PANE.items())
OUT = "metric string, labels_sig string, ts long, value double"


def _rise(before, after):
    """Increment of a counter; a drop is a reset, after which the new value counts."""
    return np.where(after >= before, after - before, after)


def _from_points(fn: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """(aggregates, columns of a pane made from them): points are collected for counters only."""
    order = F.struct("ts", "value")
    made = {"first_ts": F.min("ts"), "last_ts": F.max("ts"), "n": F.count("*"), "total": F.sum("value"), "low": F.min("value"), "high": F.max("value"), "first": F.min_by("value", order), "last": F.max_by("value", order)}
    if fn not in ("rate", "increase", "irate"):
        return made, {"before_ts": F.lit(None).cast("long"), "before": F.lit(None).cast("double"), "rise": F.lit(0.0)}
    p = F.array_sort("points")
    step = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: F.when(b["value"] >= a["value"], b["value"] - a["value"]).otherwise(b["value"]))
    last_but_one = F.get(p, F.size(p) - 2)
    return made | {"points": F.collect_list(order)}, {"before_ts": last_but_one["ts"], "before": last_but_one["value"], "rise": F.aggregate(step, F.lit(0.0), lambda a, x: a + x)}


def _windows(panes: dict[str, np.ndarray], fn: str, times: np.ndarray, window_ms: int) -> Iterator[tuple[int, float]]:
    """(t, value) of the grid times with enough samples; ``panes`` are in order of time."""
    lows = np.searchsorted(panes["first_ts"], times - window_ms, "left")
    highs = np.searchsorted(panes["last_ts"], times, "right")
    joints = np.concatenate(([0.0], _rise(panes["last"][:-1], panes["first"][1:])))
    for t, a, b in zip(times.tolist(), lows.tolist(), highs.tolist(), strict=True):
        n = int(panes["n"][a:b].sum()) if a < b else 0
        if n < LEAST_SAMPLES.get(fn, 1):
            continue
        seconds = float(panes["last_ts"][b - 1] - panes["first_ts"][a]) / 1000.0
        if fn in ("rate", "increase"):
            total = float(panes["rise"][a:b].sum() + joints[a + 1 : b].sum())
            rate = total / seconds if seconds > 0 else 0.0
            yield t, rate * (window_ms / 1000.0) if fn == "increase" else rate
        elif fn == "irate":
            alone = panes["n"][b - 1] == 1
            before_ts, before = (panes["last_ts"][b - 2], panes["last"][b - 2]) if alone else (panes["before_ts"][b - 1], panes["before"][b - 1])
            gap = float(panes["last_ts"][b - 1] - before_ts) / 1000.0
            yield t, float(_rise(before, panes["last"][b - 1])) / gap if gap > 0 else 0.0
        elif fn == "delta":
            yield t, float(panes["last"][b - 1] - panes["first"][a])
        elif fn in ("min_over_time", "max_over_time"):
            yield t, float(panes["low"][a:b].min() if fn == "min_over_time" else panes["high"][a:b].max())
        elif fn == "count_over_time":
            yield t, float(n)
        else:
            total = float(panes["total"][a:b].sum())
            yield t, total / n if fn == "avg_over_time" else total


class Panes(StatefulProcessor):
    """Keeps the panes of one series' last window and the next grid time; panes come in order of time from batch to batch."""

    KINDS = {name: np.int64 if kind == "long" else np.float64 for name, kind in PANE.items()}

    def __init__(self, fn: str, window_ms: int, step_ms: int, start: int):
        self.fn, self.window_ms, self.step_ms, self.start = fn, window_ms, step_ms, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("panes", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([frame[list(PANE)] for frame in rows]).fillna({"before_ts": 0, "before": 0.0}).sort_values("first_ts")
        due, held = self._held()
        held = {name: np.concatenate((held[name], fresh[name].to_numpy().astype(kind))) for name, kind in self.KINDS.items()}
        yield self._give(key, due, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield self._give(key, *self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _held(self) -> tuple[int | None, dict[str, np.ndarray]]:
        due, *lists = self.state.get() if self.state.exists() else (None, *([] for _ in PANE))
        return due, {name: np.array(values, kind) for (name, kind), values in zip(self.KINDS.items(), lists, strict=True)}

    def _give(self, key: tuple, due: int | None, held: dict[str, np.ndarray], watermark: int) -> pd.DataFrame:
        """The grid times before the watermark, as far as any pane reaches; what later ones need stays."""
        first = -(-(int(held["first_ts"][0]) - self.start) // self.step_ms) * self.step_ms + self.start
        due = first if due is None else max(due, first)
        end = min(watermark - 1, int(held["last_ts"][-1]) + self.window_ms)
        times = np.arange(due, end + 1, self.step_ms, dtype=np.int64)
        found = list(_windows(held, self.fn, times, self.window_ms))
        due += len(times) * self.step_ms
        kept = held["first_ts"] >= due - self.window_ms
        if kept.any():
            self.state.update((due, *(held[name][kept].tolist() for name in PANE)))
            self.handle.registerTimer(max(due, watermark) + 1)
        else:
            self.state.clear()
        at, values = [t for t, _ in found], [v for _, v in found]
        return pd.DataFrame({"metric": key[0], "labels_sig": key[1], "ts": np.array(at, np.int64), "value": np.array(values, np.float64)})


def streaming_range(samples: DataFrame, fn: str, window_ms: int, step_ms: int, start: int = 0, late_ms: int = 0, most_exploded: int = MOST_EXPLODED) -> DataFrame:
    """``fn`` at every grid time start + k * step over a stream of samples; late rows count up to ``late_ms``.

    A range [t - window, t] is closed at both ends, that is open at t + 1 millisecond.
    Steps may be wider than the window. Panes need the RocksDB state store. Each series and time is one sample; should it
    come twice, both count, the smaller value first. Samples whose value is null are left out.
    """
    if fn not in SIMPLE and fn not in ORDERED:
        raise ValueError(f"unknown range function {fn}")
    opens, closes = (start - window_ms) % step_ms, (start + 1) % step_ms
    timed = samples.where(F.col("value").isNotNull()).withColumn("at", F.timestamp_millis("ts")).withWatermark("at", f"{late_ms} milliseconds")
    if fn in SIMPLE and step_ms <= window_ms <= most_exploded * step_ms:
        hop = F.window("at", f"{window_ms + 1} milliseconds", f"{step_ms} milliseconds", f"{opens} milliseconds")
        out = timed.groupBy(hop.alias("w"), "metric", "labels_sig").agg(SIMPLE[fn]("value").alias("value"))
        return out.select("metric", "labels_sig", (F.unix_millis("w.end") - 1).alias("ts"), "value")
    # Spark's window runs from one end of ranges to the next; a start of ranges parts it.
    # It reads the event time, as other conditions are judged before the watermark, which then would miss samples.
    opened = F.pmod(F.unix_millis("at") - closes, F.lit(step_ms)) >= (opens - closes) % step_ms
    if step_ms > window_ms:  # what no range holds
        timed = timed.where(opened)
    made, more = _from_points(fn)
    between = F.window("at", f"{step_ms} milliseconds", f"{step_ms} milliseconds", f"{closes} milliseconds")
    panes = timed.groupBy(between.alias("w"), opened.alias("opened"), "metric", "labels_sig").agg(*(c.alias(name) for name, c in made.items()))
    panes = panes.withColumns(more).select("metric", "labels_sig", F.window_time("w").alias("at"), *PANE)
    return panes.groupBy("metric", "labels_sig").transformWithStateInPandas(Panes(fn, window_ms, step_ms, start), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
