"""Removal of repeated word spans by suffix automata of reference shards.

A word goes if some window of ``window`` words covers it whose word sequence also
starts earlier (smaller doc_id, or earlier in the same document).

1. Every window holds at least one anchor, the least hash among its word grams, so
   equal windows share an anchor at the same place. Anchors met twice or more are
   joined to the place of their first occurrence.
2. The texts around first occurrences, in blocks of ``block`` words, are the
   reference shards; the runs of windows whose anchor points into a block are
   routed to it. A block has a bounded size, and any number of runs can meet it: a
   frequent one gets copies, among which the rows with its anchors are dealt by hash.
3. Each task builds the suffix automaton of a block and streams its runs through
   for matching statistics; words in matches of ``window`` words or more go.
4. Windows whose anchor is known but whose words the block lacks (the same gram in
   another context) are few; fingerprints route the equal ones together, and their
   words decide which of them repeat.

The reference isn't broadcast whole, as it grows with the corpus; each automaton
is of bounded size instead.

Defined results: null and empty texts have no words; rows with equal doc_id and
text get equal results, and rows with equal doc_id and other texts count as one
document compared by start, but each is handled on its own (``own`` tells them
apart); null ids are one id before all others; other columns are not used; texts
shorter than the window stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANK, Texts, cut, drop, gram_hashes, mix, slices, sliding, word_hashes, word_spans

WINDOW, GRAM, BLOCK = 20, 8, 512
#: A block gets a copy for each so many places of its anchors, up to a number of copies.
SHARE, COPIES = 1024, 1024
NULL_ID = -(1 << 63)


class Grams:
    """Words, grams and window minima of a slice of texts."""

    def __init__(self, texts: Texts, window: int, gram: int):
        self.starts, self.ends, self.first = word_spans(texts, BLANK)
        self.words = word_hashes(texts.data, self.starts, self.ends)
        n, span = len(self.words), window - gram + 1
        self.row = np.repeat(np.arange(texts.n), np.diff(self.first))
        self.gram = gram_hashes(self.words, gram)
        self.window_ok = self.row[: max(0, n - window + 1)] == self.row[window - 1 :] if n >= window else np.zeros(0, bool)
        # grams and windows that cross rows never count: such a window is masked whole
        least = sliding(np.minimum, self.gram, span)[: len(self.window_ok)]
        self.least = np.where(self.window_ok, least, np.uint64(0))

    def anchors(self, span: int) -> np.ndarray:
        """Positions whose gram is the least of some window."""
        if not len(self.least):
            return np.zeros(0, np.int64)
        pad = np.zeros(span - 1, np.uint64)
        return np.flatnonzero(sliding(np.maximum, np.concatenate([pad, self.least, pad]), span) == self.gram)


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                g = Grams(Texts(part.column("text")), window, gram)
                at = g.anchors(window - gram + 1)
                rows = g.row[at]
                ids, own = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "own"))
                yield pa.RecordBatch.from_arrays([pa.array(g.gram[at].view(np.int64)), pa.array(ids[rows]), pa.array(own[rows]), pa.array((at - g.first[rows]).astype(np.int32))], names=["anchor", "doc_id", "own", "pos"])

    return run


def _runs(window: int, gram: int):
    """Cut the judged windows of each document into runs, one owner block each."""
    span = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                g = Grams(texts, window, gram)
                probes = part.column("probes")
                held = probes.flatten()
                rows = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(probes.offsets)))
                pos, owner, owner_own, block, copy = (held.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                at = g.first[rows] + pos
                fits = at < np.minimum(g.first[rows + 1], len(g.gram))
                rows, owner, owner_own, block, copy, at = rows[fits], owner[fits], owner_own[fits], block[fits], copy[fits], at[fits]
                found = []
                for back in range(span):
                    s = at - back
                    ok = (s >= g.first[rows]) & (s < len(g.least))
                    ok[ok] = g.window_ok[s[ok]] & (g.least[s[ok]] == g.gram[at[ok]])
                    found.append(np.stack([rows[ok], owner[ok], owner_own[ok], block[ok], copy[ok], s[ok]]))
                r, o, oo, b, c, s = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
                order = np.lexsort((s, b, oo, o, r))
                r, o, oo, b, c, s = r[order], o[order], oo[order], b[order], c[order], s[order]
                same = (r[1:] == r[:-1]) & (o[1:] == o[:-1]) & (oo[1:] == oo[:-1]) & (b[1:] == b[:-1])
                begins = np.flatnonzero(np.concatenate([[len(s) > 0], ~(same & (s[1:] - s[:-1] <= 1))])) if len(s) else np.zeros(0, np.int64)
                stops = np.append(begins[1:], len(s))
                ids, keys = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "own"))
                text = [texts.data[g.starts[s[i]] : g.ends[s[j - 1] + window - 1]].tobytes() for i, j in zip(begins, stops, strict=True)]
                cols = [o[begins], oo[begins], b[begins].astype(np.int32), c[begins].astype(np.int32), ids[r[begins]], keys[r[begins]], (s[begins] - g.first[r[begins]]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(text, pa.binary())], names=["owner", "owner_own", "block", "copy", "doc_id", "own", "start", "run"])

    return run


def _blocks(window: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                starts, ends, first = word_spans(texts, BLANK)
                out = []
                for i, (doc_id, own, blocks) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "own", "blocks")), strict=True)):
                    n = int(first[i + 1] - first[i])
                    for block, copy in ((x["block"], x["copy"]) for x in blocks):
                        low, high = max(0, block * size - window), min(n, (block + 1) * size + window)
                        if high - low >= window:
                            out.append((doc_id, own, block, copy, low, texts.data[starts[first[i] + low] : ends[first[i] + high - 1]].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], k) for j, k in enumerate(kinds)], names=["owner", "owner_own", "block", "copy", "low", "reference"])

    return run


class SuffixAutomaton:
    """Suffix automaton of one word sequence; ``end`` is the first end of a state's strings."""

    def __init__(self, words: list[bytes]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for i, w in enumerate(words):
            new, p = len(self.next), last
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            self.end.append(i)
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    self.end.append(self.end[q])
                    self.link[q] = self.link[new] = copy
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
            last = new

    def matching(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Longest match ending at each word: (length, state)."""
        at, matched, follow, link, length = 0, 0, self.next, self.link, self.length
        for w in words:
            to = follow[at].get(w)
            while to is None and at:
                at = link[at]
                matched = length[at]
                to = follow[at].get(w)
            if to is None:
                matched = 0
            else:
                at, matched = to, matched + 1
            yield matched, at

    def first_end(self, state: int, length: int) -> int:
        """First end of the string of ``length`` words that ends the match at ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return self.end[state]


def _stretches(starts: list[int]) -> list[list[int]]:
    """First and last of each stretch of consecutive numbers."""
    out: list[list[int]] = []
    for s in starts:
        if out and s == out[-1][1] + 1:
            out[-1][1] = s
        else:
            out.append([s, s])
    return out


def _stream(window: int):
    """Stream runs through the automaton of their block: removed spans, and, with their words, the runs of windows left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, auto = None, None
        for batch in batches:
            out = [[] for _ in range(5)]
            names = ("owner", "owner_own", "block", "low", "reference", "doc_id", "own", "start", "run")
            for owner, owner_own, block, low, reference, doc_id, own, start, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if key != (owner, owner_own, block):
                    key, auto = (owner, owner_own, block), SuffixAutomaton(reference.split())
                words = text.split()
                gone: list[int] = []
                rest: list[int] = []
                same = owner == doc_id
                for i, (matched, state) in enumerate(auto.matching(words)):
                    if i < window - 1:
                        continue
                    s = i - window + 1
                    repeats = matched >= window and (not same or low + auto.first_end(state, window) - window + 1 < start + s)
                    (gone if repeats else rest).append(s)
                for stretches, left in ((_stretches(gone), False), (_stretches(rest), True)):
                    for a, b in stretches:
                        for col, x in zip(out, (doc_id, own, start + a, start + b + window, b" ".join(words[a : b + window]) if left else None), strict=True):
                            col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "own", "start", "stop", "words"])

    return run


def _windows(window: int):
    """The windows of the runs left over, by fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.set_column(batch.schema.get_field_index("words"), "words", batch.column("words").cast(pa.string())), "words"):
                texts = Texts(part.column("words"))
                starts, ends, first = word_spans(texts, BLANK)
                hashes = word_hashes(texts.data, starts, ends)
                one, two = gram_hashes(hashes, window), gram_hashes(mix(hashes + np.uint64(0x5BD1E995)), window)
                count = np.maximum(np.diff(first) - window + 1, 0)
                row = np.repeat(np.arange(part.num_rows), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = first[row] + nth
                cols = [pa.array(x[at].view(np.int64)) for x in (one, two)] + [part.column(c).take(pa.array(row)) for c in ("doc_id", "own", "start", "stop")] + [pa.array(nth.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["one", "two", "doc_id", "own", "start", "stop", "nth"])

    return run


def _keep():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                n_words, n_removed, kept = [], [], []
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    words = texts.bytes_of(i).split()
                    n = len(words)
                    gone = np.zeros(n + 1, np.int64)
                    for span in spans or ():
                        gone[min(n, span["start"])] += 1
                        gone[min(n, span["stop"])] -= 1
                    if spans:
                        stay = np.cumsum(gone)[:n] == 0
                        words = [w for w, ok in zip(words, stay.tolist(), strict=True) if ok]
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    kept.append(b" ".join(words))
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``own``: 0, but a hash of the text where an id has several texts."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("key"))
    twice = cut(keys.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id", F.lit(True).alias("twice")))
    if not twice.limit(1).count():
        drop(twice)
        return docs.withColumn("own", F.lit(0).cast("long"))
    return docs.join(twice, "doc_id", "left").withColumn("own", F.when(F.col("twice"), F.xxhash64("text")).otherwise(0)).drop("twice")


def _left_over(rest: DataFrame, window: int) -> DataFrame:
    """(doc_id, own, start, stop) of windows of ``rest`` (doc_id, own, start, stop, words) whose words also start earlier in it."""
    windows = rest.mapInArrow(_windows(window), "one long, two long, doc_id long, own long, start int, stop int, nth int")
    known = cut(windows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    met = cut(windows.join(known, ["one", "two"]).select("doc_id", "own", "start", "stop", "nth").distinct(), known)
    words = F.array_join(F.slice(F.split(F.decode("words", "UTF-8"), " "), F.col("nth") + 1, F.lit(window)), " ")
    runs = rest.dropDuplicates(["doc_id", "own", "start", "stop"])
    texts = cut(met.join(runs, ["doc_id", "own", "start", "stop"]).select("doc_id", "own", (F.col("start") + F.col("nth")).alias("start"), words.alias("words")), met)
    firsts = cut(texts.groupBy("words").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = texts.join(firsts, "words").where(F.struct("doc_id", "start") > F.col("first"))
    return again.select("doc_id", "own", "start", (F.col("start") + window).alias("stop"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, share: int = SHARE, copies: int = COPIES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row."""
    docs = _told_apart(docs)
    places = docs.mapInArrow(_anchors(window, gram), "anchor long, doc_id long, own long, pos int")
    # Written first, so that the join's two sides are plain shuffles, whose skewed keys Spark splits.
    firsts = places.groupBy("anchor").agg(F.min(F.struct("doc_id", "pos", "own")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # A block's anchors are at most as many as its words.
    in_block = Window.partitionBy("first.doc_id", "first.own", F.expr(f"first.pos div {block}"))
    firsts = cut(firsts.withColumn("n", F.sum("n").over(in_block)))
    later = places.join(firsts, "anchor").where((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.pos") != F.col("pos")))
    # A row's own probes: at most one per word of it.
    owner = (F.col("first.doc_id").alias("owner"), F.col("first.own").alias("owner_own"), F.expr(f"cast(first.pos div {block} as int)").alias("block"))
    copy = F.pmod(F.xxhash64("doc_id", "own"), F.least(F.lit(copies), F.ceil(F.col("n") / share))).cast("int").alias("copy")
    probes = cut(later.groupBy("doc_id", "own").agg(F.collect_set(F.struct("pos", *owner, copy)).alias("probes")), firsts)
    runs = docs.join(probes, ["doc_id", "own"]).mapInArrow(_runs(window, gram), "owner long, owner_own long, block int, copy int, doc_id long, own long, start int, run binary")
    owners = probes.select(F.explode("probes").alias("p")).groupBy(F.col("p.owner").alias("doc_id"), F.col("p.owner_own").alias("own")).agg(F.collect_set(F.struct("p.block", "p.copy")).alias("blocks"))
    shards = docs.join(owners, ["doc_id", "own"]).select("doc_id", "own", "text", "blocks").mapInArrow(_blocks(window, block), "owner long, owner_own long, block int, copy int, low int, reference binary")
    # Repeated rows give one block.
    shards = shards.groupBy("owner", "owner_own", "block", "copy").agg(F.first("low").alias("low"), F.first("reference").alias("reference"))
    judged = cut(runs.join(shards, ["owner", "owner_own", "block", "copy"]).mapInArrow(_stream(window), "doc_id long, own long, start int, stop int, words binary"), probes)
    again = _left_over(judged.where(F.col("words").isNotNull()), window)
    spans = judged.where(F.col("words").isNull()).select("doc_id", "own", "start", "stop").unionByName(again)
    spans = spans.groupBy("doc_id", "own").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    kept = docs.join(spans, ["doc_id", "own"], "left").select("doc_id", "text", "spans").mapInArrow(_keep(), "doc_id long, n_words long, n_removed long, kept_text string")
    return kept.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """Reference result for distinct ids (for tests): doc_id, words, removed words, kept text."""
    split = {d: [w.decode() for w in (t or "").encode().split()] for d, t in docs}
    first: dict[tuple, tuple] = {}
    for d in sorted(split):
        for i in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][i : i + window]), (d, i))
    out = []
    for d, words in split.items():
        gone = {j for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] != (d, i) for j in range(i, i + window)}
        out.append((d, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return out
