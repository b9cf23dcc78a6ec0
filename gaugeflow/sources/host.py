"""Samples from landed snapshots of host counters (one text line a row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import signature

#: Column order and names of the kernel's text files.
CPU_MODES = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest", "guest_nice")
MEMORY = {"MemTotal": "node_memory_MemTotal_bytes", "MemFree": "node_memory_MemFree_bytes", "MemAvailable": "node_memory_MemAvailable_bytes", "Buffers": "node_memory_Buffers_bytes", "Cached": "node_memory_Cached_bytes", "SwapTotal": "node_memory_SwapTotal_bytes", "SwapFree": "node_memory_SwapFree_bytes"}
NETWORK = {"node_network_receive_bytes_total": 0, "node_network_receive_packets_total": 1, "node_network_receive_errs_total": 2, "node_network_transmit_bytes_total": 8, "node_network_transmit_packets_total": 9, "node_network_transmit_errs_total": 10}
TUNNELS = r"^(ip6gre|ip6tnl|ip6_vti|ip_vti|gretap|gre|erspan|sit|tunl)\d"
DISKS = {"node_disk_reads_completed_total": (3, 1), "node_disk_read_bytes_total": (5, 512), "node_disk_writes_completed_total": (7, 1), "node_disk_written_bytes_total": (9, 512)}
NO_DISKS = "^(loop|ram|dm-|zram|nbd|sr|fd)"


def _job(*more) -> Column:
    """Labels of a host sample: the job and further names and values."""
    return F.create_map(F.lit("job"), F.lit("host"), *(F.lit(x) if isinstance(x, str) else x for x in more))


def _fields() -> Column:
    return F.split(F.trim("line"), r"\s+")


def _rows(frame: DataFrame, entries: Column, others: tuple[str, ...]) -> DataFrame:
    """Explode (metric, labels, value) entries; unreadable values go."""
    out = frame.select(*others, F.explode(entries).alias("e")).select(*others, "e.metric", "e.labels", "e.value").where(F.col("value").isNotNull())
    return out.withColumn("labels_sig", signature(F.col("labels")))


def _entry(metric, labels: Column, value: Column) -> Column:
    return F.struct((F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), labels.alias("labels"), value.alias("value"))


def cpu(lines: DataFrame) -> DataFrame:
    """``cpuN`` lines in seconds by mode (the total line is skipped), and the boot time."""
    others = tuple(c for c in lines.columns if c != "line")
    f = lines.withColumn("f", _fields())
    name = F.col("f")[0]
    per = F.array(*(_entry("node_cpu_seconds_total", _job("cpu", F.substring(name, F.lit(4), F.length(name)), "mode", F.lit(m)), F.get("f", F.lit(i + 1)).try_cast("double") / 100) for i, m in enumerate(CPU_MODES)))
    boot = F.array(_entry("node_boot_time_seconds", _job(), F.get("f", F.lit(1)).try_cast("double")))
    return _rows(f.where(name.rlike(r"^cpu\d+$") | (name == "btime")), F.when(name == "btime", boot).otherwise(per), others)


def memory(lines: DataFrame) -> DataFrame:
    """Seven known keys in bytes; ``kB`` values count 1024."""
    others = tuple(c for c in lines.columns if c != "line")
    names = F.create_map(*(F.lit(x) for pair in MEMORY.items() for x in pair))
    key, unit = F.regexp_extract("line", r"^(\w+):", 1), F.regexp_extract("line", r"^\w+:\s+\d+\s*(\w*)", 1)
    value = F.regexp_extract("line", r"^\w+:\s+(\d+)", 1).try_cast("double") * F.when(unit == "kB", 1024).otherwise(1)
    metric = F.try_element_at(names, key)
    return _rows(lines.where(metric.isNotNull()), F.array(_entry(metric, _job(), value)), others)


def load(lines: DataFrame) -> DataFrame:
    others = tuple(c for c in lines.columns if c != "line")
    return _rows(lines.withColumn("f", _fields()).where(F.size("f") >= 3), F.array(*(_entry(f"node_load{n}", _job(), F.col("f")[i].try_cast("double")) for i, n in enumerate((1, 5, 15)))), others)


def network(lines: DataFrame) -> DataFrame:
    """Six counters a device; header lines and tunnel devices are skipped, short lines too."""
    others = tuple(c for c in lines.columns if c != "line")
    device = F.trim(F.regexp_extract("line", r"^\s*([^:|\s]+):", 1))
    f = lines.withColumns({"device": device, "f": F.split(F.trim(F.regexp_replace("line", r"^\s*[^:|]+:", "")), r"\s+")})
    f = f.where((F.col("device") != "") & ~F.col("device").rlike(TUNNELS) & (F.size("f") >= 16))
    return _rows(f, F.array(*(_entry(m, _job("device", F.col("device")), F.coalesce(F.col("f")[i].try_cast("double"), F.lit(0.0))) for m, i in NETWORK.items())), others)


def disks(lines: DataFrame) -> DataFrame:
    """Four counters a device; sectors count 512 bytes; virtual devices are skipped."""
    others = tuple(c for c in lines.columns if c != "line")
    f = lines.withColumn("f", _fields()).where(F.size("f") >= 14).where(~F.get("f", F.lit(2)).rlike(NO_DISKS))
    return _rows(f, F.array(*(_entry(m, _job("device", F.col("f")[2]), F.coalesce(F.col("f")[i].try_cast("double"), F.lit(0.0)) * k) for m, (i, k) in DISKS.items())), others)
