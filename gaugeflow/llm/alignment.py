"""Alignment of two tokenizers over a corpus, with pair counts by spilled runs.

Both tokenizers cut the same bytes, so tokens of A and B that overlap meet in one
stretch between neighbouring ends of either: every stretch is one link, and offsets
where both end close a group. Counting how many documents hold each linked pair goes
through runs instead of rows:

1. Documents are encoded; the distinct (pair, document) records of about
   ``run_records`` are sorted by A id, B id and document, cut by radix of the A id and
   written as zstd blocks, one row for each run and radix.
2. Every task merges the blocks it reads into one run of pair counts for each radix;
   these runs, a row a pair and task at most, are shuffled by radix, and a merge by
   heap adds them up. In that order all pairs of an A id follow each other, so its
   highest count is known as its last pair passes, and B's side is bounded by its vocabulary.
3. The runs meet the counts of their radix again, which gives each document its part
   of the sums; the parts of a run's documents are added by run.

A common pair is one record for each document in step 1 and one for each task in step
2, so no task gathers what holds it. ``spread`` copies of a radix's counts deal its
runs to several tasks in step 3.

Defined results: null and empty texts, and texts whose tokens do not give back their
bytes, have no tokens: zeros and an empty digest; rows that share an id count as
documents of their own; a text of any length is one document of its run; an empty
table gives no rows; other columns are not used.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Texts, cut, drop, slices
from .tokens import ENTRY_BYTES, SHORT, TABLE_BYTES, byte_symbols, joinable, load_byte_bpe, spaced_pieces

RUN_RECORDS, RADIX_BITS, RUNS_A_TASK = 1_000_000, 4, 32
#: Bits of an id of B and of a document's number in its run; ids of A take the rest.
B_BITS, DOC_BITS = 20, 22
#: Counts are merged and compared in blocks of about this many pairs.
BLOCK_PAIRS = 1 << 16

DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUN = f"run long, radix int, block binary, docs array<struct<{', '.join(x.replace(' ', ': ', 1) for x in DOC.split(', '))}>>"


class Aligner:
    """Tokens, groups and links of pieces of text under two tokenizers; short pieces are remembered.

    ``a`` is a byte-level BPE file; ``b`` a sentencepiece model that puts a space in
    front itself. Pieces are numbered in a table whose bytes are bounded.
    """

    def __init__(self, a: str, b: str, table_bytes: int = TABLE_BYTES):
        import sentencepiece

        self.a = load_byte_bpe(a, plain_specials=True)
        symbol = byte_symbols()
        self.a_bytes = {i: bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode() for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        if any(" " in n.replace("▁", " ").lstrip(" ") for n in names) or len(names) >> B_BITS or max(self.a_bytes) >> (64 - B_BITS - DOC_BITS):
            raise ValueError("these vocabularies need other bits or cross blanks")
        self.a_length = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_length[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_length = np.array([len(x) for x in self.b_bytes])
        self.digits = [str(i) for i in range(max(len(self.a_length), len(names)))]
        self.table_bytes = table_bytes
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        # Of each piece: tokens of A and B, groups, links, the place of its links in the pool, whether its bytes come back.
        self.sizes = np.zeros((1024, 6), np.int64)
        self.pool, self.used, self.held = np.zeros(1024, np.uint64), 0, 0

    def _store(self, block: list[bytes], groups: list[bytes], sizes: np.ndarray, links: np.ndarray) -> None:
        at = len(self.groups)
        while at + len(block) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.used + len(links) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        sizes[:, 4] = self.used + np.cumsum(sizes[:, 3]) - sizes[:, 3]
        self.sizes[at : at + len(block)] = sizes
        self.pool[self.used : self.used + len(links)] = links
        self.used += len(links)
        self.groups += groups
        self.number.update((p, at + i) for i, p in enumerate(block))
        self.held += sum(map(len, block)) + sum(map(len, groups)) + links.nbytes + 2 * ENTRY_BYTES * len(block)

    def _add(self, block: list[bytes]) -> None:
        """Tokens of pieces that may stand in one text, each after a space."""
        text = b" " + b" ".join(block)
        plain = text.decode("utf-8", "replace")
        a = self.a.encode_batch_fast([plain], add_special_tokens=False)[0].ids
        b = self.b.encode(plain[1:], num_threads=1)
        stops = np.cumsum([len(p) + 1 for p in block])
        if b"".join(map(self.a_bytes.__getitem__, a)) != text or b"".join(map(self.b_bytes.__getitem__, b)) != text:
            if len(block) > 1:
                for p in block:
                    self._add([p])
            else:
                self._store(block, [b""], np.zeros((1, 6), np.int64), np.zeros(0, np.uint64))
            return
        own_a, own_b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(self.a_length[own_a]), np.cumsum(self.b_length[own_b])
        cuts = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        links = own_a[at_a].astype(np.uint64) << np.uint64(B_BITS) | own_b[at_b].astype(np.uint64)
        shared = (ends_a[at_a] == cuts) & (ends_b[at_b] == cuts)
        both, from_a, from_b = cuts[shared], [0, *(at_a[shared] + 1).tolist()], [0, *(at_b[shared] + 1).tolist()]
        text_a, text_b = [self.digits[i] for i in a], [self.digits[i] for i in b]
        groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[m:n])}" for (i, j), (m, n) in zip(pairwise(from_a), pairwise(from_b), strict=True)]
        upto = np.stack([np.searchsorted(x, stops, "right") for x in (ends_a, ends_b, both, cuts)], axis=1)
        sizes = np.concatenate([np.diff(upto, axis=0, prepend=0), np.zeros((len(block), 1), np.int64), np.ones((len(block), 1), np.int64)], axis=1)
        of = [0, *upto[:, 2].tolist()]
        self._store(block, [";".join(groups[i:j]).encode() for i, j in pairwise(of)], sizes, links)

    def __call__(self, texts: list[bytes]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """For each text (n_a, n_b, n_groups, n_links, digest); then text, pair and number of all its distinct links."""
        if self.held > self.table_bytes:
            self._clear()
        parts = [spaced_pieces(t) if t else [] for t in texts]
        missing = set().union(*parts).difference(self.number)
        long = [p for p in missing if len(p) > SHORT]
        for block in joinable(list(missing.difference(long))):
            self._add(block)
        kept = len(self.groups), self.used, self.held
        for p in long:
            self._add([p])
        numbers = [np.fromiter(map(self.number.__getitem__, own), np.int64, len(own)) for own in parts]
        for i, own in enumerate(numbers):
            if not self.sizes[own, 5].all():
                # Only a whole text tells whether its joined tokens differ.
                if texts[i] not in self.number:
                    self._add([texts[i]])
                    long.append(texts[i])
                at = self.number[texts[i]]
                numbers[i] = np.full(self.sizes[at, 5], at)
        out = []
        for own in numbers:
            digest = hashlib.sha256(b";".join(map(self.groups.__getitem__, own.tolist()))).hexdigest() if len(own) else ""
            out.append((*self.sizes[own, :4].sum(axis=0).tolist(), digest))
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(texts)), [len(own) for own in numbers])
        # Distinct pieces of each text, then their links.
        key, times = np.unique(row * (len(self.groups) + 1) + flat, return_counts=True)
        row, flat = np.divmod(key, len(self.groups) + 1)
        count, begin = self.sizes[flat, 3], self.sizes[flat, 4]
        pairs = self.pool[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]
        row, times = np.repeat(row, count), np.repeat(times, count)
        order = np.lexsort((pairs, row))
        row, pairs, times = row[order], pairs[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pairs[1:] != pairs[:-1])])[: len(row)])
        times = np.add.reduceat(times, first) if len(first) else times
        for p in long:
            del self.number[p]
        del self.groups[kept[0] :]
        _, self.used, self.held = kept
        return out, row[first], pairs[first], times


_loaded: dict[tuple, Aligner] = {}


def aligner(a: str, b: str, table_bytes: int = TABLE_BYTES) -> Aligner:
    """One aligner for each worker process and pair of files; its table outlives a task."""
    key = (a, b, table_bytes)
    if key not in _loaded:
        _loaded[key] = Aligner(*key)
    return _loaded[key]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers as one zstd block: ascending first one by differences, all by byte planes."""
    first = np.diff(columns[0].astype("<u8"), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in (first, *columns[1:])]
    return np.array([len(first)], "<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(block, columns: int) -> list[np.ndarray]:
    block = memoryview(block)
    n = int(np.frombuffer(block[:8], "<u8")[0])
    flat = zstandard.ZstdDecompressor().decompress(block[8:], max_output_size=8 * n * columns + 1)
    out = [np.ascontiguousarray(np.frombuffer(flat, np.uint8, 8 * n, 8 * n * i).reshape(8, n).T).view("<u8").ravel() for i in range(columns)]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge sorted runs of (keys, counts) blocks, adding the counts of equal keys.

    A heap holds the last key of each run's block; what is not above the least of them
    is complete, and only that run must go on.
    """
    heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def load(i: int) -> None:
        for keys, counts in runs[i]:
            if len(keys):
                heads[i] = keys, counts
                heapq.heappush(heap, (int(keys[-1]), i))
                return

    for i in range(len(runs)):
        load(i)
    while heap:
        limit, i = heapq.heappop(heap)
        keys, counts = [], []
        for j, (own, n) in list(heads.items()):
            stop = int(np.searchsorted(own, np.uint64(limit), "right"))
            if stop:
                keys.append(own[:stop])
                counts.append(n[:stop])
                heads[j] = own[stop:], n[stop:]
        del heads[i]
        load(i)
        # Runs that end with the same key have nothing left in their blocks either.
        while heap and heap[0][0] == limit:
            _, j = heapq.heappop(heap)
            del heads[j]
            load(j)
        yield added(np.concatenate(keys), np.concatenate(counts))


def in_blocks(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(keys), BLOCK_PAIRS):
        yield keys[at : at + BLOCK_PAIRS], counts[at : at + BLOCK_PAIRS]


def with_best(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Add whether a pair's count is the highest of its A id; the pairs of the last one wait until they are complete."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for more, n in blocks:
        keys, counts = np.concatenate([keys, more]), np.concatenate([counts, n])
        side = keys >> np.uint64(B_BITS)
        stop = int(np.searchsorted(side, side[-1]))
        if stop:
            yield keys[:stop], counts[:stop], _highest(keys[:stop], counts[:stop])
            keys, counts = keys[stop:], counts[stop:]
    if len(keys):
        yield keys, counts, _highest(keys, counts)


def _highest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    side = keys >> np.uint64(B_BITS)
    first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    most = np.maximum.reduceat(counts, first)
    return counts == np.repeat(most, np.diff(np.append(first, len(keys))))


def radix_of(pairs: np.ndarray) -> np.ndarray:
    return (((pairs >> np.uint64(B_BITS)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - RADIX_BITS)).astype(np.int64)


def _runs(a: str, b: str, run_records: int, load: Callable):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, number = load(a, b), TaskContext.get().partitionId() << 32
        docs, records, count = [], [], 0
        kind = pa.list_(pa.struct([(f.split()[0], pa.string() if "string" in f else pa.int64()) for f in DOC.split(", ")]))

        def close() -> pa.RecordBatch:
            nonlocal docs, records, count, number
            row, pairs, times = (np.concatenate(c) for c in zip(*records, strict=True))
            key = pairs << np.uint64(DOC_BITS) | row.astype(np.uint64)
            order = np.argsort(key)
            key, times, radix = key[order], times[order], radix_of(pairs[order])
            kept = [int(r) for r in np.unique(radix)]
            blocks = [packed(key[radix == r], times[radix == r]) for r in kept]
            n = len(kept) + 1
            cols = [pa.array([number] * n, pa.int64()), pa.array([-1, *kept], pa.int32()), pa.array([None, *blocks], pa.binary()), pa.array([docs, *[None] * len(kept)], kind)]
            docs, records, count, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(cols, names=["run", "radix", "block", "docs"])

        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                found, row, pairs, times = align([texts.bytes_of(i) for i in range(texts.n)])
                records.append((row + len(docs), pairs, times))
                docs += [dict(zip([f.split()[0] for f in DOC.split(", ")], (d, *x), strict=True)) for d, x in zip(part.column("doc_id").to_pylist(), found, strict=True)]
                count += len(row)
                if count >= run_records or len(docs) >> (DOC_BITS - 2):
                    yield close()
        if docs:
            yield close()

    return write


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run of pair counts for each radix a task has read."""
    held: dict[int, list] = {}

    def fold(r: int) -> None:
        keys, counts = (np.concatenate(c) for c in zip(*held[r], strict=True))
        held[r] = [added(keys, counts)]

    for batch in batches:
        for r, block in zip(batch.column("radix").to_pylist(), batch.column("block"), strict=True):
            pairs = unpacked(block.as_buffer(), 2)[0] >> np.uint64(DOC_BITS)
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            held.setdefault(r, []).append((pairs[first], np.diff(np.append(first, len(pairs)))))
            if len(held[r]) >= 16:
                fold(r)
    for r in sorted(held):
        fold(r)
        blocks = [packed(k, c) for k, c in in_blocks(*held[r][0])]
        yield pa.RecordBatch.from_arrays([pa.array([r] * len(blocks), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int64()), pa.array(blocks, pa.binary())], names=["radix", "source", "at", "block"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All counts of each radix, in order, from rows sorted by radix; few compressed runs of it are held at a time."""

    def finish(r: int, runs: dict) -> Iterator[pa.RecordBatch]:
        read = [((b[0], b[1].astype(np.int64)) for b in (unpacked(x, 2) for x in own)) for own in runs.values()]
        for keys, counts, high in with_best(merged(read)):
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([int(keys[0])], pa.int64()), pa.array([packed(keys, counts, high)], pa.binary())], names=["radix", "first", "counts"])

    radix, runs = None, {}
    for batch in batches:
        for r, source, block in zip(batch.column("radix").to_pylist(), batch.column("source").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if r != radix:
                if runs:
                    yield from finish(radix, runs)
                radix, runs = r, {}
            runs.setdefault(source, []).append(block)
            if len(runs) > 256:
                done = [packed(k, c) for k, c in merged([((b[0], b[1].astype(np.int64)) for b in (unpacked(x, 2) for x in own)) for s, own in runs.items() if s != source])]
                runs = {-1: done, source: runs[source]}
    if runs:
        yield from finish(radix, runs)


def _contribute(key: tuple, runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What the pairs of a radix add to the documents of some runs."""
    out = []
    if runs.num_rows:
        known, count, high = (np.concatenate(c) for c in zip(*(unpacked(x.as_buffer(), 3) for x in counts.sort_by("first")["counts"]), strict=True))
        for run, block in zip(runs["run"].to_pylist(), runs["block"], strict=True):
            records, times = unpacked(block.as_buffer(), 2)
            at = np.searchsorted(known, records >> np.uint64(DOC_BITS))
            row, times = records & np.uint64((1 << DOC_BITS) - 1), times.astype(np.int64)
            order = np.argsort(row, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]]))
            sums = [np.add.reduceat((times * x[at].astype(np.int64))[order], first) for x in (high, count)]
            out.append((run, packed(row[order][first], *sums)))
    return pa.Table.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["run", "parts"])


def _total(key: tuple, rows: pa.Table) -> pa.Table:
    """The documents of a run with the sums of their parts."""
    docs = rows.filter(rows["docs"].is_valid())["docs"].combine_chunks().flatten()
    best, count = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for part in rows["parts"]:
        if part.is_valid:
            row, more, n = unpacked(part.as_buffer(), 3)
            best[row.astype(np.int64)] += more.astype(np.int64)
            count[row.astype(np.int64)] += n.astype(np.int64)
    return pa.Table.from_arrays([*docs.flatten(), pa.array(best), pa.array(count)], names=[*(f.split()[0] for f in DOC.split(", ")), "n_best", "count_sum"])


def pair_counts(runs: DataFrame) -> DataFrame:
    """radix, first, counts: blocks of all pair counts, whole A ids to a block."""
    merged_here = runs.where("radix >= 0").select("radix", "block").mapInArrow(_partial, "radix int, source long, at long, block binary")
    dealt = merged_here.repartition(1 << RADIX_BITS, "radix").sortWithinPartitions("radix", "source", "at")
    return dealt.mapInArrow(_count, "radix int, first long, counts binary")


def links_table(counts: DataFrame) -> DataFrame:
    """a_id, b_id, documents, best: one row a pair, from the blocks of ``pair_counts``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("counts"):
                keys, n, high = unpacked(block.as_buffer(), 3)
                cols = [(keys >> np.uint64(B_BITS)).astype(np.int64), (keys & np.uint64((1 << B_BITS) - 1)).astype(np.int64), n.astype(np.int64), high.astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a_id", "b_id", "documents", "best"])

    return counts.select("counts").mapInArrow(rows, "a_id long, b_id long, documents long, best boolean")


def spill(docs: DataFrame, a: str, b: str, run_records: int = RUN_RECORDS, load: Callable = aligner) -> DataFrame:
    """The written runs of ``docs`` (doc_id, text), see ``RUN``: rows of radix -1 hold the documents of a run."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(_runs(a, b, run_records, load), RUN))


def align(docs: DataFrame, a: str, b: str, run_records: int = RUN_RECORDS, load: Callable = aligner) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    ``n_best`` counts the links whose pair has its A id's highest count (ties included),
    ``count_sum`` adds the counts of all links; a count is the number of documents.
    """
    runs = spill(docs, a, b, run_records, load)
    counts = cut(pair_counts(runs))
    spread = max(1, -(-runs.where("radix < 0").count() // RUNS_A_TASK))
    met = runs.where("radix >= 0").select("run", "radix", "block", F.pmod(F.xxhash64("run"), F.lit(spread)).alias("salt"))
    known = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<long>")))
    parts = met.groupBy("radix", "salt").cogroup(known.groupBy("radix", "salt")).applyInArrow(_contribute, "run long, parts binary")
    own = runs.where("radix < 0").select("run", "docs", F.lit(None).cast("binary").alias("parts"))
    both = own.unionByName(parts.withColumn("docs", F.lit(None).cast(runs.schema["docs"].dataType)))
    out = cut(both.groupBy("run").applyInArrow(_total, f"{DOC}, n_best long, count_sum long"))
    drop(runs, counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
