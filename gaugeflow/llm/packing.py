"""Token packing by the online sum-of-squares rule.

Each partition packs its own documents as they stream by: a remainder goes to the
fill level that minimises the sum over levels of the squared number of partly
filled windows at that level, kept in one array entry per level. Whole windows
leave at once, and at the end of a partition the open windows are cut into each
other, so a partition leaves at most one window partly filled. Only the ids of
open windows are held. No row is shuffled and no state is shared.

Defined results: null and empty texts are the end token alone; repeated rows are
packed as often as they occur; other columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Texts, slices

WINDOW, END_TOKEN = 2048, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class WordTokenizer:
    """The ids of whole texts from a tokenizer file whose tokens never cross white space.

    Ids are remembered per blank-separated chunk and per letter run in two bounded
    tables, and what is missing goes to the tokenizer in one call per slice: each
    run ends in exactly one token with the end-of-word mark. A chunk outside
    Latin-1 goes to the tokenizer by itself; within Latin-1 its runs are those of
    the file's own split pattern. Chunks over ``LONG`` bytes, as in texts without
    blanks, hardly recur and are not remembered, so an entry takes at most half a KB.
    """

    LONG = 64

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, most_chunks: int, most_runs: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.most_chunks, self.most_runs = most_chunks, most_runs

    def _exact(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_runs(self, missing: list[str], block: int = 4096) -> None:
        for at in range(0, len(missing), block):
            part = missing[at : at + block]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                self.runs.update((run, self._exact(run)) for run in part)
                continue
            flat, begin = ids.tobytes(), 0
            for run, stop in zip(part, (4 * stops).tolist(), strict=True):
                self.runs[run] = flat[begin:stop]
                begin = stop

    def _learn(self, needed: set[bytes]) -> None:
        missing = needed.difference(self.chunks)
        if len(self.chunks) + len(missing) > self.most_chunks:
            self.chunks.clear()
            missing = needed
        if len(self.runs) > self.most_runs:
            self.runs.clear()
        split: dict[bytes, list[str]] = {}
        for chunk in missing:
            text = chunk.decode("utf-8", "replace")
            if max(text) > "\xff" or "<|" in text:
                self.chunks[chunk] = self._exact(text)
                continue
            low = text.lower()
            if low[:-1].isalpha():  # a word, or a word and one more character
                split[chunk] = [low] if low[-1].isalpha() else [low[:-1], low[-1]]
            else:
                split[chunk] = self.SPLIT.findall(low)
        if unknown := {run for runs in split.values() for run in runs if run not in self.runs}:
            self._learn_runs(sorted(unknown))
        runs = self.runs
        self.chunks.update((chunk, b"".join([runs[r] for r in own])) for chunk, own in split.items())

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words = [text.split() for text in texts]
        needed = set().union(*words)
        long = {chunk: self._exact(chunk.decode("utf-8", "replace")) for chunk in needed if len(chunk) > self.LONG}
        self._learn(needed.difference(long))
        ids = (lambda chunk: self.chunks.get(chunk) or long[chunk]) if long else self.chunks.__getitem__
        return [b"".join(map(ids, own)) for own in words]


_loaded: dict[tuple, WordTokenizer] = {}


def word_tokenizer(path: str, most_chunks: int = 600_000, most_runs: int = 900_000) -> Callable[[list[bytes]], list[bytes]]:
    """One tokenizer per worker process and file; its tables outlive a task.

    The table sizes trade memory (about 0.2 KB an entry, half a KB at most) for speed, never results.
    """
    key = (path, most_chunks, most_runs)
    if key not in _loaded:
        _loaded[key] = WordTokenizer(*key)
    return _loaded[key]


class SumOfSquares:
    """Online packing of pieces (doc_id, start, ids, doc_tokens) into windows."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # open windows at each fill level
        # What the sum of squares gains when a window enters a level, and when one leaves it.
        self.enter = np.ones(window + 1, np.int64)
        self.enter[window] = 0  # a full window is none of the partly filled
        self.leave = np.full(window + 1, self.NONE)
        self.leave[0] = 0  # a new window leaves no level
        self.open: list[list] = [[] for _ in range(window + 1)]
        self.done: list[list] = []

    NONE = np.int64(1 << 60)

    def _level(self, size: int) -> int:
        """The level, 0 for a new window, whose choice leaves the least sum of squares.

        The fullest of equally good levels leaves the least room behind.
        """
        gain = self.enter[size:] + self.leave[: self.window - size + 1]
        return len(gain) - 1 - int(gain[::-1].argmin())

    def _change(self, level: int, by: int) -> None:
        n = self.count[level] = self.count[level] + by
        self.enter[level] = 2 * n + 1
        self.leave[level] = 1 - 2 * n if n else self.NONE

    def add(self, doc_id, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.done.append([(doc_id, start, ids[4 * start : 4 * (start + self.window)], total)])
            start += self.window
        if size := total - start:
            level = self._level(size)
            held = self.open[level].pop() if level else []
            if level:
                self._change(level, -1)
            held.append((doc_id, start, ids[4 * start :], total))
            if level + size == self.window:
                self.done.append(held)
            else:
                self.open[level + size].append(held)
                self._change(level + size, 1)

    def take(self) -> list[list]:
        out, self.done = self.done, []
        return out

    def close(self) -> list[list]:
        """Cut the emptiest open windows into the gaps of the fullest."""
        left = [held for level in self.open for held in level]  # emptiest first
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:], self.enter[:-1], self.leave[1:] = 0, 1, self.NONE
        low = 0
        for high in range(len(left) - 1, -1, -1):
            room = self.window - sum(len(p[2]) // 4 for p in left[high])
            while room and low < high:
                doc_id, start, ids, total = left[low].pop()
                n = min(room, len(ids) // 4)
                left[high].append((doc_id, start + len(ids) // 4 - n, ids[-4 * n :], total))
                if 4 * n < len(ids):
                    left[low].append((doc_id, start, ids[: -4 * n], total))
                elif not left[low]:
                    low += 1
                room -= n
            if low > high:
                break
        self.done.extend(held for held in left if held)
        return self.take()


def _pack(path: str, window: int, end_token: int, load: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, packer = load(path), SumOfSquares(window)
        end = np.array([end_token], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33

        def emit(windows: list[list]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for held in windows:
                at = 0
                for doc_id, start, ids, total in held:
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at))
                    at += len(ids) // 4
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=FIELDS)

        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                encoded = tokenize([texts.bytes_of(i) for i in range(part.num_rows)])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    packer.add(doc_id, ids + end)
                yield emit(packer.take())
        yield emit(packer.close())

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_token: int = END_TOKEN, load: Callable = word_tokenizer) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into windows of ``window`` tokens; one row per piece.

    ``load`` makes a function from lists of UTF-8 texts to their little-endian 32-bit
    ids by the file at ``tokenizer_path``, which must exist on every executor. ``sequence_id``
    carries the partition in its high bits.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(tokenizer_path, window, end_token, load), SCHEMA)
