"""Column functions over label maps, payload paths and thresholds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def sorted_entries(labels: Column) -> Column:
    return F.array_sort(F.map_entries(labels))


def signature(labels: Column) -> Column:
    """Canonical text of a label map: ``k=v`` by key, joined by commas, unescaped."""
    return F.array_join(F.transform(sorted_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def fingerprint(labels: Column) -> Column:
    """As ``signature``, with NUL between keys, values and entries, so that commas don't collide."""
    return F.array_join(F.transform(sorted_entries(labels), lambda e: F.concat(e["key"], F.lit("\0"), e["value"])), "\0")


def parse_signature(text: Column) -> Column:
    """Label map of a canonical text; the empty text is the empty map."""
    return F.when(text == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit(","), F.lit("=")))


def label(labels: Column, name: str) -> Column:
    """A label's value; an absent label reads as the empty string."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def legend(metric: Column, labels: Column, template: str | None = None) -> Column:
    """Series name: a ``{{name}}`` template, else what tells the series apart."""
    if template:
        parts = re.split(r"\{\{\s*([\w.]+)\s*\}\}", template)
        return F.concat(F.lit(""), *(label(labels, p) if i % 2 else F.lit(p) for i, p in enumerate(parts)))
    short = F.map_filter(labels, lambda k, _: ~k.isin("job", "instance"))
    chosen = F.when(F.size(short) > 0, short).otherwise(labels)
    pairs = F.array_join(F.transform(sorted_entries(chosen), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return F.when(F.size(chosen) == 0, metric).when(F.size(chosen) == 1, F.map_values(chosen)[0]).otherwise(pairs)


def compare(value: Column, op: str, threshold) -> Column:
    """``value op threshold``; an unknown operator reads as ``>``."""
    limit = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    return {"<": value < limit, "<=": value <= limit, ">=": value >= limit}.get(op, value > limit)


def compare_by(value: Column, op: Column, threshold: Column) -> Column:
    """``compare`` with the operator in a column."""
    return F.when(op == "<", value < threshold).when(op == "<=", value <= threshold).when(op == ">=", value >= threshold).otherwise(value > threshold)


def path(variant: Column, where: str) -> Column:
    """Text at ``$.a.b`` of a parsed record; null where absent; no arrays or wildcards."""
    if not re.fullmatch(r"\$(\.\w+)+", where):
        return F.lit(None).cast("string")
    return F.try_variant_get(variant, where, "string")


def to_millis(text: Column) -> Column:
    """Milliseconds of a number (truncated), a numeric string or an RFC 3339 time; else null."""
    number = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.try_cast("double").try_cast("long"))
    exact = F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.try_cast("long"))
    stamp = F.when(text.rlike(RFC3339), F.unix_millis(text.try_cast("timestamp")))
    return F.coalesce(exact, number, stamp)
