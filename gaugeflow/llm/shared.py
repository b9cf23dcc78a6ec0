"""Helpers the operators share: reading tables, cutting lineage, vectorised words."""

from __future__ import annotations

import hashlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text is handled in slices of about this many bytes, so a task's arrays stay small.
SLICE_BYTES = 1_000_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or on one machine a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[context.applicationId]


_lock = threading.Lock()
_writers: WeakKeyDictionary = WeakKeyDictionary()


@contextmanager
def writing(spark: SparkSession):
    """Settings of written steps, held while any step of the session is being written."""
    with _lock:
        count, held = _writers.get(spark, (0, None))
        if not count:
            held = {k: spark.conf.get(k) for k in (_CLEANUP, _BATCH)}
            rows = int(held[_BATCH])
            spark.conf.set(_CLEANUP, "true")
            spark.conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        _writers[spark] = count + 1, held
    try:
        yield
    finally:
        with _lock:
            count, held = _writers[spark]
            _writers[spark] = count - 1, held
            if count == 1:
                for k, v in held.items():
                    spark.conf.set(k, v)


_paths: WeakKeyDictionary = WeakKeyDictionary()


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; empty the written tables ``done``.

    The written files survive lost executors. The shuffle files of the write are
    released when it ends instead of when the driver happens to collect garbage,
    and rows go to Python in batches small enough for long texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    drop(*done)
    return out


def drop(*tables: DataFrame) -> None:
    """Empty tables that ``cut`` has written and nothing will read again."""
    for one in tables:
        if path := _paths.pop(one, None):
            one.sparkSession.createDataFrame([], one.schema).write.mode("overwrite").parquet(path)


def byte_lut(is_word) -> np.ndarray:
    """A 256-entry table of the bytes that belong to words, from a rule on the byte."""
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words end at space and at the ASCII control characters tab to carriage return.
BLANK = byte_lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


class Texts:
    """UTF-8 bytes of a string column; null counts as empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        base = int(offsets[0]) if len(offsets) else 0
        end = int(offsets[-1]) if len(offsets) else 0
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
        self.off = offsets - base
        self.n = len(column)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``most`` text bytes each."""
    if batch.num_rows == 0:
        return
    off = Texts(batch.column(column)).off
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(texts: Texts, lut: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1 entries)."""
    inside = lut[texts.data if data is None else data]
    size = len(inside)
    if size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(texts.n + 1, np.int64)
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = texts.off[(texts.off > 0) & (texts.off < size)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, texts.off, "left")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D
_LONG = 64  # bytes of a word beyond which it is hashed on its own
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight of them at a time."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place
    length = ends - starts
    out = mix(length.astype(np.uint64) * np.uint64(_BASE))
    short = length <= _LONG
    rows = np.flatnonzero(short)
    for at in range(0, _LONG, 8):
        rows = rows[length[rows] > at]
        if not len(rows):
            break
        value = eight[starts[rows] + at] & _FIRST_BYTES[np.minimum(length[rows] - at, 8)]
        out[rows] = mix((out[rows] ^ value) + np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(~short):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; grams may cross rows, callers mask those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(_BASE) + words[j : j + n]
        return mix(out)


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """op over every ``w`` consecutive entries (op: np.minimum or np.maximum), by doubling."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:])
        have += step
    return out
