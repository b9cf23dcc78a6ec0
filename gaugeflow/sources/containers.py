"""Samples, snapshots and scrape targets from landed container records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import signature

#: The part of a stats record that is read.
STATS = (
    "ts bigint, container struct<name:string,image:string,state:string,labels:map<string,string>>, "
    "stats struct<cpu:struct<total:bigint>,memory:struct<usage:bigint,max_usage:bigint,limit:bigint,stats:map<string,bigint>>,"
    "networks:map<string,struct<rx_bytes:bigint,tx_bytes:bigint>>,io:array<struct<op:string,value:bigint>>>"
)
SERVICE, PROJECT = "com.docker.compose.service", "com.docker.compose.project"


def read(lines: DataFrame) -> DataFrame:
    """Records of JSON lines, running containers only."""
    return lines.select(F.from_json("line", STATS).alias("r")).select("r.*").where(F.col("container.state") == "running")


def working_set(usage: Column, stats: Column) -> Column:
    """Usage without inactive file cache; the usage itself if the cache is larger."""
    get = lambda k: F.coalesce(F.try_element_at(stats, F.lit(k)), F.lit(0))
    cache = F.when(get("inactive_file") != 0, get("inactive_file")).otherwise(get("total_inactive_file"))
    return F.when(cache > usage, usage).otherwise(usage - cache)


def anon_memory(stats: Column) -> Column:
    """The first known field of anonymous memory; null if there is none."""
    return F.coalesce(*(F.try_element_at(stats, F.lit(k)) for k in ("anon", "total_rss", "rss")))


def base_labels() -> Column:
    own = F.col("container.labels")
    optional = F.create_map(F.lit("compose_service"), F.try_element_at(own, F.lit(SERVICE)), F.lit("compose_project"), F.try_element_at(own, F.lit(PROJECT)))
    fixed = F.create_map(F.lit("job"), F.lit("docker"), F.lit("name"), F.col("container.name"), F.lit("image"), F.col("container.image"))
    return F.map_concat(fixed, F.map_filter(optional, lambda _, v: v.isNotNull() & (v != "")))


def samples(records: DataFrame) -> DataFrame:
    """Samples of every record: CPU seconds, memory, network by interface, block I/O by direction."""
    mem = F.col("stats.memory")
    io = lambda *ops: F.aggregate(F.filter(F.coalesce("stats.io", F.array().cast("array<struct<op:string,value:bigint>>")), lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda a, x: a + x["value"])
    entry = lambda metric, value, labels: F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), labels.alias("labels"))
    base = F.col("base")
    single = F.array(
        entry("container_cpu_usage_seconds_total", F.col("stats.cpu.total") / 1e9, base),
        entry("container_memory_usage_bytes", working_set(mem["usage"], mem["stats"]), base),
        entry("container_memory_max_usage_bytes", mem["max_usage"], base),
        entry("container_memory_limit_bytes", mem["limit"], base),
        entry("container_memory_anon_bytes", anon_memory(mem["stats"]), base),
        entry("container_fs_reads_bytes_total", io("Read", "read"), base),
        entry("container_fs_writes_bytes_total", io("Write", "write"), base),
    )

    def both(x: Column) -> Column:
        labels = F.map_concat(base, F.create_map(F.lit("interface"), x["key"]))
        return F.array(entry("container_network_receive_bytes_total", x["value"]["rx_bytes"], labels), entry("container_network_transmit_bytes_total", x["value"]["tx_bytes"], labels))

    network = F.flatten(F.transform(F.map_entries(F.col("stats.networks")), both))
    rows = records.withColumn("base", base_labels()).select("ts", F.explode(F.concat(single, F.coalesce(network, F.slice(single, 1, 0)))).alias("e"))
    out = rows.select("e.metric", "e.labels", "ts", "e.value").where(F.col("value").isNotNull())
    return out.select("metric", "labels", signature(F.col("labels")).alias("labels_sig"), "ts", "value")


def snapshot(records: DataFrame) -> DataFrame:
    """Latest view of every container, by name."""
    view = F.struct(F.col("container.image").alias("image"), F.col("container.state").alias("state"), working_set(F.col("stats.memory.usage"), F.col("stats.memory.stats")).alias("memory"), F.col("ts").alias("last_seen"))
    return records.groupBy(F.col("container.name").alias("name")).agg(F.max_by(view, "ts").alias("v")).select("name", "v.*").orderBy("name")


def targets(inventory: DataFrame, prefix: str = "metrics.scrape") -> DataFrame:
    """Scrape targets of the containers (name, labels) that opt in and name a port."""
    get = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))
    path = get(f"{prefix}.path")
    full = F.when(path == "", "/metrics").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    job = F.coalesce(F.nullif(get(f"{prefix}.job"), F.lit("")), F.nullif(get(SERVICE), F.lit("")), F.col("name"))
    return inventory.where((get(prefix) == "true") & (get(f"{prefix}.port") != "")).select(
        F.concat(F.lit("docker:"), "name").alias("target"), F.concat(F.lit("http://"), F.col("name"), F.lit(":"), get(f"{prefix}.port"), full).alias("url"), job.alias("job"), F.col("name").alias("instance")
    )
