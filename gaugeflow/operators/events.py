"""Structured events from log lines: parsing, filtering, mapping, rendering, storing."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import RFC3339, path, sorted_entries, to_millis


def parse_json(lines: DataFrame) -> DataFrame:
    """``record`` (VARIANT) of the lines that hold a JSON object; other lines go."""
    parsed = lines.withColumn("record", F.try_parse_json("line"))
    return parsed.where(F.schema_of_variant("record").startswith("OBJECT"))


def parse_logfmt(lines: DataFrame) -> DataFrame:
    """``fields`` map of ``k=v`` tokens; quoted values with escapes, bare keys empty, the last of equal keys wins."""
    token = r'([^\s=]+)(?:=(?:"((?:[^"\\]|\\.)*)"?|(\S*)))?'
    keys, quoted, bare = (F.regexp_extract_all("line", F.lit(token), F.lit(i)) for i in (1, 2, 3))

    def unescape(text: Column) -> Column:
        # a lone mark stands for an escaped backslash while the others are read
        held = F.replace(text, F.lit("\\\\"), F.lit("\0"))
        for mark, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"')):
            held = F.replace(held, F.lit(mark), F.lit(char))
        return F.replace(held, F.lit("\0"), F.lit("\\"))

    pairs = F.transform(F.arrays_zip(keys.alias("k"), quoted.alias("q"), bare.alias("b")), lambda x: F.struct(x["k"].alias("key"), F.when(x["b"] != "", x["b"]).otherwise(unescape(x["q"])).alias("value")))
    last_wins = F.filter("pairs", lambda x, i: ~F.exists(F.slice("pairs", i + 2, F.greatest(F.size("pairs") - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return lines.withColumn("pairs", pairs).withColumn("fields", F.map_from_entries(last_wins)).drop("pairs")


def parse_regex(lines: DataFrame, pattern: str) -> DataFrame:
    """``fields`` map of the named groups of an unanchored match; lines without a match go."""
    java = pattern.replace("(?P<", "(?<")
    names = re.findall(r"\(\?<(\w+)>", java)
    groups = {name: number for name, number in re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", java)).groupindex.items()}
    fields = F.create_map(*(x for n in names for x in (F.lit(n), F.regexp_extract("line", java, groups[n])))) if names else F.create_map().cast("map<string,string>")
    return lines.where(F.col("line").rlike(java)).withColumn("fields", fields)


def parse_plain(lines: DataFrame) -> DataFrame:
    return lines.withColumn("fields", F.create_map(F.lit("line"), F.col("line")))


def split_stamp(lines: DataFrame) -> DataFrame:
    """Container log lines: ``stamp_ms`` from a leading RFC 3339 time, the rest in ``line``."""
    head = F.regexp_extract("line", r"^(\S+) ", 1)
    valid = head.rlike(RFC3339)
    return lines.select(
        *(c for c in lines.columns if c != "line"),
        F.when(valid, F.unix_millis(head.try_cast("timestamp"))).alias("stamp_ms"),
        F.when(valid, F.expr("substring(line, instr(line, ' ') + 1)")).otherwise(F.col("line")).alias("line"),
    )


def _field(frame: DataFrame, name: str) -> Column:
    """Text of a field for matching: only strings count, others read as empty; null if missing."""
    if "record" in frame.columns:
        where = f"$.{name}"
        value = F.try_variant_get("record", where, "variant")
        return F.when(value.isNotNull(), F.when(F.schema_of_variant(value) == "STRING", path(F.col("record"), where)).otherwise(""))
    return F.try_element_at("fields", F.lit(name))


def match_records(frame: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Records that pass all rules (field, ``equals`` or ``contains``, value); a missing field fails."""
    tests = []
    for name, kind, value in rules:
        own = _field(frame, name)
        tests.append(own == value if kind == "equals" else own.contains(value))
    return frame.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def _at(frame: DataFrame, where: str) -> Column:
    if "record" in frame.columns:
        return path(F.col("record"), where)
    return F.try_element_at("fields", F.lit(where.removeprefix("$.")))


def map_events(frame: DataFrame, source: str, kind: str, payload: dict[str, str], ts_path: str = "", ingest_ms: Column | int = 0) -> DataFrame:
    """Events (ts, source, kind, payload): the record's stamp, else the mapped time, else ingest time."""
    mapped = to_millis(_at(frame, ts_path)) if ts_path else F.lit(None).cast("long")
    stamp = F.col("stamp_ms") if "stamp_ms" in frame.columns else F.lit(None).cast("long")
    ingest = F.lit(ingest_ms) if isinstance(ingest_ms, int) else ingest_ms
    values = [x for key, where in payload.items() for x in (F.lit(key), F.coalesce(_at(frame, where), F.lit("")))]
    fields = F.create_map(*values) if values else F.create_map().cast("map<string,string>")
    return frame.select(F.coalesce(stamp, mapped, ingest).cast("long").alias("ts"), F.lit(source).alias("source"), F.lit(kind).alias("kind"), fields.alias("payload"))


def render(template: str) -> Column:
    """Text of a template whose ``{{.key}}`` placeholders read the payload; missing keys are empty."""
    parts = re.split(r"\{\{\s*\.(\w+)\s*\}\}", template)
    return F.concat(F.lit(""), *(F.coalesce(F.try_element_at("payload", F.lit(p)), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def with_id(events: DataFrame) -> DataFrame:
    """Add ``id``, a digest of source, time, kind and the payload by key."""
    fields = F.array_join(F.transform(sorted_entries(F.col("payload")), lambda e: F.concat(e["key"], F.lit("\0"), e["value"])), "\0")
    return events.withColumn("id", F.sha2(F.concat_ws("\0", "source", F.col("ts").cast("string"), "kind", fields), 256))


def insert_new(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Events of ``batch`` whose id isn't stored, each id once."""
    fresh = batch if stored is None else batch.join(stored.select("id"), "id", "left_anti")
    return fresh.dropDuplicates(["id"])


def filter_events(events: DataFrame, start: int, end: int = 0, sources: Sequence[str] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """Events from ``start`` on, up to ``end`` if it is positive, of any listed source and any listed kind."""
    out = events.where(F.col("ts") >= start)
    if end > 0:
        out = out.where(F.col("ts") <= end)
    for name, wanted in (("source", sources), ("kind", kinds)):
        if wanted:
            out = out.where(F.col(name).isin(*wanted))
    return out


def filter_for_panel(events: DataFrame, start: int, end: int, targets: Sequence[dict[str, str]]) -> DataFrame:
    """Filter by the sources and the kinds of all targets together, not pair by pair."""
    return filter_events(events, start, end, [t["source"] for t in targets if t.get("source")], [t["kind"] for t in targets if t.get("kind")])


def overlay(events: DataFrame, windows: DataFrame, most: int = 200) -> DataFrame:
    """Events inside each panel window (panel, start, end), the newest ``most`` of each.

    Windows are cut into hours and joined by the hour, so the join is an equi-join
    however many windows there are.
    """
    from pyspark.sql import Window

    hour = 3_600_000
    cut = windows.withColumn("hour", F.explode(F.sequence(F.expr(f"start div {hour}"), F.expr(f"`end` div {hour}"))))
    met = events.withColumn("hour", F.expr(f"ts div {hour}")).join(cut, "hour").where(F.col("ts").between(F.col("start"), F.col("end")))
    place = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("ts"), "id"))
    return met.withColumn("place", place).where(F.col("place") <= most).drop("hour", "place", "start", "end")
