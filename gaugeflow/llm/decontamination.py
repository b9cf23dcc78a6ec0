"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of the normalised items is broadcast behind a size check. A larger
benchmark is read in blocks: one automaton is built and broadcast at a time, the
documents stream through it and are written with their marks, and it is released
before the next one is built. So more items cost more scans, not more memory; a
block of 1 MB of items takes some 0.2 GB in the driver and in each worker. An item
longer than a block is cut into pieces that share all but one word of a window, so
each of its windows lies in one piece. Documents are never shuffled.

Defined results: null and empty texts have no words and no hits; an item that is
null or has no words matches nothing; repeated items and repeated document rows
each keep their own id and row (equal items share one place in the automaton); texts
of any length are streamed, items of any length cut; empty tables give no rows, or
documents without hits; ids
of any type come out as strings; an input column whose name this operator returns
is replaced by the returned one; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Texts, byte_lut, cut, gram_hashes, slices, word_hashes, word_spans

#: Bytes 0-9, a-z (A-Z are lower-cased before) and all bytes of characters beyond ASCII.
LETTERS = byte_lut(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

ADDED = ("n_words", "n_hit", "item_ids", "hit_spans", "clean_text")


def normalised_words(text: str | None) -> list[bytes]:
    """The words of one text, lower-cased over A-Z only."""
    texts = Texts(pa.array([text], pa.string()))
    data = LOWER[texts.data]
    starts, ends, _ = word_spans(texts, LETTERS, data)
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


class ItemAutomaton:
    """Generalised suffix automaton over the words of test items.

    ``items`` of a state are those with a window ending in it; ``short`` lists
    whole items of fewer than ``window`` words that are suffixes of its strings.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = [(item, words, self._insert(words)) for item, words in items if words]
        n = len(self.next)
        self.items: list[set] = [set() for _ in range(n)]
        own_short: list[list] = [[] for _ in range(n)]
        for item, words, states in ends:
            if len(words) < window:
                at = 0
                for w in words:
                    at = self.next[at][w]
                own_short[at].append((len(words), item))
            for at in states:
                while at > 0 and self.length[at] >= window and item not in self.items[at]:
                    self.items[at].add(item)
                    at = self.link[at]
        self.at_window, self.short = [0] * n, [[] for _ in range(n)]
        for at in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[at]
            self.short[at] = own_short[at] + self.short[up]
            self.at_window[at] = at if self.length[at] >= window > self.length[up] else self.at_window[up]
        self.gram = min([window, *(len(words) for _, words in items if words)])
        # Every window holds grams of this many words, so only such places need the automaton.
        grams = {b"\x00".join(words[i : i + self.gram]) for _, words in items for i in range(len(words) - self.gram + 1)}
        joined = [g.split(b"\x00") for g in sorted(grams)]
        flat = b" ".join(w for g in joined for w in g)
        texts = Texts(pa.array([flat.decode("utf-8")], pa.string()))
        starts, stops, _ = word_spans(texts, LETTERS)
        self.gram_keys = np.sort(gram_hashes(word_hashes(texts.data, starts, stops), self.gram)[:: self.gram]) if joined else np.zeros(0, np.uint64)
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.gram_keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _new(self, length: int, link: int, follow: dict) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _insert(self, words: list[bytes]) -> list[int]:
        last, states = 0, []
        for w in words:
            q = self.next[last].get(w)
            if q is not None:  # the prefix is known from another item
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
            else:
                new, p = self._new(self.length[last] + 1, 0, {}), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
                last = new
            states.append(last)
        return states

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, set | list]]:
        """Follow the longest match; yield (last word, window length, items) of each window met."""
        at, matched = 0, 0
        for i, w in enumerate(words):
            while at and w not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            follow = self.next[at].get(w)
            if follow is None:
                matched = 0
                continue
            at, matched = follow, matched + 1
            if matched >= self.window:
                yield i, self.window, self.items[self.at_window[at]]
            for n, item in self.short[at]:
                if n <= matched:
                    yield i, n, (item,)

    def candidates(self, keys: np.ndarray) -> np.ndarray:
        """Positions whose gram is, but for hash collisions, a gram of an item."""
        maybe = np.flatnonzero(self.coarse[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.gram_keys, keys[maybe]), max(0, len(self.gram_keys) - 1))
        return maybe[self.gram_keys[where] == keys[maybe]] if len(self.gram_keys) else maybe[:0]


def _mark(automaton, column: str, finish=None):
    """Append one automaton's hits to ``_spans`` (word ranges, flat) and ``_items``; ``finish`` each part if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, ids = automaton.value
        for batch in batches:
            for part in slices(batch, column):
                texts = Texts(part.column(column))
                data = LOWER[texts.data]
                starts, ends, first = word_spans(texts, LETTERS, data)
                hits: dict[int, list[int]] = {}
                found: dict[int, set] = {}
                places = auto.candidates(gram_hashes(word_hashes(data, starts, ends), auto.gram))
                i = 0
                while i < len(places):
                    begin, end = int(places[i]), int(places[i]) + auto.gram
                    while i + 1 < len(places) and places[i + 1] <= end:
                        i += 1
                        end = int(places[i]) + auto.gram
                    i += 1
                    # a run of grams may cross into later rows: stream each row's share
                    row = int(np.searchsorted(first, begin, "right")) - 1
                    while begin < end:
                        stop = min(end, int(first[row + 1]))
                        words = [data[starts[j] : ends[j]].tobytes() for j in range(begin, stop)]
                        for last, n, items in auto.stream(words):
                            at = begin + last + 1 - int(first[row])
                            hits.setdefault(row, []).extend((at - n, at))
                            found.setdefault(row, set()).update(items)
                        begin, row = stop, row + 1
                spans, items = part.column("_spans").to_pylist(), part.column("_items").to_pylist()
                for row, more in hits.items():
                    spans[row] = [*(spans[row] or ()), *more]
                    items[row] = sorted({*(items[row] or ()), *(x for i in found[row] for x in ids[i] if x is not None)})
                rest = [part.column(c) for c in part.schema.names[:-3]]
                counts = pa.array(np.diff(first), pa.int64())
                marked = pa.RecordBatch.from_arrays([*rest, counts, pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=part.schema.names)
                yield finish(marked) if finish else marked

    return run


def merged(flat: list[int] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip((flat or [])[::2], (flat or [])[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _finish(column: str, least_span: int):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column(column))
        starts, ends, first = word_spans(texts, LETTERS, LOWER[texts.data])
        given = part.column(column)
        n_hit, spans, clean = [], [], []
        for row, flat in enumerate(part.column("_spans").to_pylist()):
            ranges = merged(flat)
            n_hit.append(sum(b - a for a, b in ranges))
            spans.append([{"start": a, "stop": b} for a, b in ranges])
            gone = [(int(starts[first[row] + a]), int(ends[first[row] + b - 1])) for a, b in ranges if b - a >= least_span]
            if not gone:
                clean.append(given[row].as_py())
                continue
            edges = [int(texts.off[row]), *(x for pair in gone for x in pair), int(texts.off[row + 1])]
            clean.append(b" ".join(x for a, b in list(pairwise(edges))[::2] if (x := texts.data[a:b].tobytes().strip())).decode("utf-8", "replace"))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        items = pa.array([x or [] for x in part.column("_items").to_pylist()], pa.list_(pa.string()))
        added = [part.column("_words"), pa.array(n_hit, pa.int64()), items, pa.array(spans, kind), pa.array(clean, pa.string())]
        return pa.RecordBatch.from_arrays([*part.columns[:-3], *added], names=[*part.schema.names[:-3], *ADDED])

    return run


def pieces(words: list[bytes], window: int, most_bytes: int) -> Iterator[tuple[bytes, ...]]:
    """The words of one item in pieces of about ``most_bytes``; neighbours share ``window - 1`` words, so each window lies in just one."""
    begin = 0
    while begin < len(words):
        end, size = begin, 0
        while end < len(words) and (end - begin < window or size + len(words[end]) < most_bytes):
            size += len(words[end]) + 1
            end += 1
        yield tuple(words[begin:end])
        begin = end - window + 1 if end < len(words) else end


def automata(items: DataFrame, window: int, id_column: str, column: str, most_bytes: int) -> Iterator[tuple[ItemAutomaton, list[list[str]]]]:
    """Automata of about ``most_bytes`` of item words each, with the ids of their distinct items; a longer item is in several."""
    known: dict[tuple[bytes, ...], list[str]] = {}
    size = 0

    def made():
        return ItemAutomaton([(i, list(words)) for i, words in enumerate(known)], window), list(known.values())

    for item, text in items.select(F.col(id_column).cast("string"), column).where(F.col(column).isNotNull()).toLocalIterator():
        for piece in pieces(normalised_words(text), window, most_bytes):
            length = sum(map(len, piece)) + len(piece)
            if size and size + length > most_bytes:
                yield made()
                known, size = {}, 0
            known.setdefault(piece, []).append(item)
            size += length
    yield made()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, column: str = "text", id_column: str = "item_id", item_column: str = "text", least_span: int = 1, most_bytes: int = 1_000_000) -> DataFrame:
    """Mark and cut the words of ``docs`` that lie in a window of a test item.

    Adds ``n_words``, ``n_hit``, ``item_ids`` (items with occurring windows),
    ``hit_spans`` (word ranges) and ``clean_text`` (without spans of at least
    ``least_span`` words). An item of fewer than ``window`` words is one window.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in docs.columns if c in {*ADDED, "_words", "_spans", "_items"}))
    marked = docs.withColumns({"_words": F.lit(0).cast("long"), "_spans": F.lit(None).cast("array<int>"), "_items": F.lit(None).cast("array<string>")})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in marked.schema])
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), spans, T.StringType())
    out = T.StructType([*schema.fields[:-3], *(T.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True))])
    blocks = automata(items, window, id_column, item_column, most_bytes)
    now = spark.sparkContext.broadcast(next(blocks))
    for more in blocks:
        marked = cut(marked.mapInArrow(_mark(now, column), schema), marked)
        now.unpersist()
        now = spark.sparkContext.broadcast(more)
    return marked.mapInArrow(_mark(now, column, _finish(column, least_span)), out)


def within_limits(marked: DataFrame, coverage: float = 0.5) -> DataFrame:
    """Rows to keep: clean ones, and those whose share of hit words is at most ``coverage``."""
    return marked.where((F.col("n_hit") == 0) | (F.col("n_hit") <= coverage * F.col("n_words")))


def digest(marked: DataFrame) -> DataFrame:
    """The per-document figures of the query contract."""
    ids = F.array_join(F.array_sort("item_ids"), ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[int, str | None]], window: int = 10) -> tuple[int, int, str]:
    """Reference result of one document: words, hit words, digest of the items (for tests)."""
    words = normalised_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        own = normalised_words(item_text)
        n = min(window, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
