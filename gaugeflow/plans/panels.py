"""Prepared panel jobs: fixed compositions of the operators over a samples frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.aggregate import aggregate
from ..operators.arith import with_vector
from ..operators.events import filter_for_panel, overlay
from ..operators.histogram import histogram_quantile
from ..operators.rank import newest
from ..operators.range_fn import align_to_grid, range_function
from ..operators.reduce import stat
from ..operators.select import match, scan
from ..operators.upkeep import merge_targets

MINUTE = 60_000


class Panels:
    """The jobs over one samples frame and one evaluation grid."""

    def __init__(self, samples: DataFrame, start: int, end: int, step: int, window: int = MINUTE):
        self.samples, self.start, self.end, self.step, self.window = samples, start, end, step, window

    def _raw(self, metric: str, window: int = 0) -> DataFrame:
        return scan(self.samples, metric, max(0, self.start - window), self.end)

    def _fn(self, fn: str, metric: str, *matchers: tuple[str, str, str], window: int | None = None) -> DataFrame:
        window = self.window if window is None else window
        return range_function(match(self._raw(metric, window), *matchers), fn, window, self.start, self.end, self.step)

    def cpu_by_mode(self) -> DataFrame:
        return aggregate(self._fn("rate", "node_cpu_seconds_total", ("mode", "!=", "idle")), "sum", by=["mode"])

    def load_averages(self) -> DataFrame:
        return merge_targets([(self._raw(f"node_load{n}"), f"{n}m") for n in (1, 5, 15)])

    def memory_available(self) -> DataFrame:
        return self._raw("node_memory_MemAvailable_bytes")

    def memory_used(self) -> DataFrame:
        return with_vector(self._raw("node_memory_MemTotal_bytes"), "-", self._raw("node_memory_MemAvailable_bytes"))

    def rate_by(self, metric: str, label: str) -> DataFrame:
        """Summed rate of a counter by one label: network and disk by device, container figures by name."""
        return aggregate(self._fn("rate", metric), "sum", by=[label])

    def gauge_by(self, metric: str, label: str) -> DataFrame:
        return aggregate(self._raw(metric), "sum", by=[label])

    def network(self) -> DataFrame:
        return merge_targets([(self.rate_by(f"node_network_{d}_bytes_total", "device"), "{{device}}") for d in ("receive", "transmit")])

    def disk(self) -> DataFrame:
        return merge_targets([(self.rate_by(f"node_disk_{d}_bytes_total", "device"), "{{device}}") for d in ("read", "written")])

    def containers(self) -> DataFrame:
        rates = ("container_cpu_usage_seconds_total", "container_network_receive_bytes_total", "container_network_transmit_bytes_total", "container_fs_reads_bytes_total", "container_fs_writes_bytes_total")
        return merge_targets([*((self.rate_by(m, "name"), "{{name}}") for m in rates), (self.gauge_by("container_memory_usage_bytes", "name"), "{{name}}")])

    def health_stat(self, fn: str, metric: str, window: int = 5 * MINUTE) -> DataFrame:
        return stat(self._fn(fn, metric, window=window), "lastNotNull")

    def error_share(self, metric: str, label: str) -> DataFrame:
        parts = aggregate(self._fn("rate", metric), "sum", by=[label])
        return with_vector(parts, "/", aggregate(parts, "sum"), right_single=True)

    def latency(self, metric: str, q: float = 0.95, window: int = 5 * MINUTE) -> DataFrame:
        return histogram_quantile(self._fn("rate", metric, window=window), q)

    def aligned(self, metric: str) -> DataFrame:
        return align_to_grid(self._raw(metric, self.window), self.window, self.start, self.end, self.step)


def events_table(events: DataFrame, start: int, end: int, targets: list[dict[str, str]], limit: int = 50) -> DataFrame:
    return newest(filter_for_panel(events, start, end, targets), limit)


def events_overlay(events: DataFrame, windows: DataFrame) -> DataFrame:
    return overlay(events, windows)
