"""Token ids in raw binary shards, with a minimal perfect hash index for access by key.

``write_tokens`` sorts documents by id over range partitions and writes each partition
as one shard of three files: the raw little-endian ids of its documents one after the
other (two bytes each where the vocabulary allows, else four), their keys in order, and
an index. The index is a minimal perfect hash in levels of bits: a key takes the first
level in which no other remaining key falls on its bit, and the rank of that bit is its
slot. A slot holds a 32-bit fingerprint of the key and the place and length of its
ids, so a document is found in constant time without reading any keys, and a key that
is not there passes for one that is with a chance of 2**-32. The shard of a key is
found by bisection of the first keys in the manifest.

Files of a task carry a name of its own and count only once the manifest names them;
a lost or repeated task leaves nothing behind that a reader sees. Places come from the
index in scans too, where they are checked against the keys.

Defined results: null and empty texts are the end id alone; null ids come first, and
repeated ids stand next to each other, told apart by copy number in the index; rows of
one id are ordered by a hash of their text; an empty table gives a manifest without
shards; a text of any length is one row of its shard; other columns are not used.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import mix, writing
from .tokens import encode

GAMMA, MOST_LEVELS = 2.0, 200
#: Ids are read back in runs of about this many bytes.
READ_BYTES = 4_000_000
MANIFEST = "manifest.json"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hash(keys: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of (key, copy) under a seed."""
    with np.errstate(over="ignore"):
        return mix(mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed) * _STEP) + copies.astype(np.uint64) * _STEP)


class PerfectHash:
    """Slots 0 to n - 1 of n distinct pairs (key, copy)."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.begins = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, copies: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(keys):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("repeated (key, copy) pairs")
            size = -(-max(64, int(GAMMA * len(keys))) // 64) * 64
            at = (_hash(keys, copies, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys, copies = keys[~alone[at]], copies[~alone[at]]
        flat = np.concatenate(words) if words else np.zeros(0, "<u8")
        counts = np.bitwise_count(flat).astype(np.int64)
        return cls(np.array(sizes, "<u8"), flat, (np.cumsum(counts) - counts).astype("<u8"))

    def slots(self, keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """The slot of each pair; of pairs not built in any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (_hash(keys[left], copies[left], level + 1) % size).astype(np.int64)
            word, bit = self.begins[level] + at // 64, (at % 64).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[word[hit]].astype(np.int64) + np.bitwise_count(below)
            left = left[~hit]
            if not len(left):
                break
        return out


class KeyIndex:
    """The perfect hash of a shard and what its slots hold."""

    MAGIC, FINGERPRINT_SEED = b"TOKMPH01", 1 << 20

    def __init__(self, hashed: PerfectHash, fingerprints: np.ndarray, offsets: np.ndarray, lengths: np.ndarray):
        self.hashed, self.fingerprints, self.offsets, self.lengths = hashed, fingerprints, offsets, lengths

    @classmethod
    def _fingerprint(cls, keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
        return (_hash(keys, copies, cls.FINGERPRINT_SEED) >> np.uint64(32)).astype("<u4")

    @classmethod
    def build(cls, keys: np.ndarray, copies: np.ndarray, lengths: np.ndarray) -> KeyIndex:
        hashed = PerfectHash.build(keys, copies)
        slots = hashed.slots(keys, copies)
        fingerprints, offsets, own = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
        fingerprints[slots], offsets[slots], own[slots] = cls._fingerprint(keys, copies), np.cumsum(lengths) - lengths, lengths
        return cls(hashed, fingerprints, offsets, own)

    def find(self, keys: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of each pair, counted in ids."""
        slots = self.hashed.slots(keys, copies)
        found = slots >= 0
        found[found] = self.fingerprints[slots[found]] == self._fingerprint(keys[found], copies[found])
        safe = np.where(found, slots, 0)
        if not len(self.offsets):
            return found, safe, safe
        return found, self.offsets[safe].astype(np.int64), self.lengths[safe].astype(np.int64)

    def to_bytes(self) -> bytes:
        h = self.hashed
        head = np.array([len(self.offsets), len(h.sizes), len(h.words)], "<u8")
        return self.MAGIC + b"".join(x.tobytes() for x in (head, h.sizes, h.words, h.ranks, self.offsets, self.lengths, self.fingerprints))

    @classmethod
    def from_bytes(cls, data: bytes) -> KeyIndex:
        if data[:8] != cls.MAGIC:
            raise ValueError("not an index of token shards")
        n, levels, words = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        at, out = 32, []
        for count, kind in ((levels, "<u8"), (words, "<u8"), (words, "<u8"), (n, "<u8"), (n, "<u8"), (n, "<u4")):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        sizes, bits, ranks, offsets, lengths, fingerprints = out
        return cls(PerfectHash(sizes, bits, ranks), fingerprints, offsets, lengths)


def copy_numbers(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand directly before each of the sorted ``keys``."""
    if not len(keys):
        return np.zeros(0, np.int64)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    begins = np.flatnonzero(first)
    return np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys))))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


def _read(path: str, name: str) -> bytes:
    system, root = _open(path)
    with system.open_input_file(f"{root}/{name}") as f:
        return f.read()


def read_manifest(path: str) -> dict:
    return json.loads(_read(path, MANIFEST))


@dataclass
class Written(WriterCommitMessage):
    shard: dict | None


class ShardWriter(DataSourceArrowWriter):
    """One shard for each partition of rows (doc_id, ids) that come in the order of their keys."""

    def __init__(self, path: str, width: int, end_id: int):
        self.path, self.width, self.end_id = path, width, end_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        part = TaskContext.get().partitionId()
        name = f"shard-{part:06d}-{uuid.uuid4().hex}"
        keys, lengths, nulls, out = [], [], 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}.ids")
            own = batch.column("doc_id")
            nulls += own.null_count
            keys.append(own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for ids in batch.column("ids"):
                values = np.frombuffer(ids.as_buffer(), "<u4")
                if self.width == 2 and len(values) and values.max() > 0xFFFF:
                    raise ValueError("an id does not fit into two bytes")
                out.write(values.astype("<u2") if self.width == 2 else values)
                lengths.append(len(values))
        if out is None:
            return Written(None)
        out.close()
        own, size = np.concatenate(keys), np.array(lengths, np.int64)
        if (own[nulls + 1 :] < own[nulls:-1]).any():
            raise ValueError("the rows of a shard must come in the order of their keys")
        # Null keys are found by scans only, under numbers that follow the copies of key 0.
        index = KeyIndex.build(own, _copies(own, nulls), size)
        for end, data in (("keys", own.tobytes()), ("mph", index.to_bytes())):
            with system.open_output_stream(f"{root}/{name}.{end}") as f:
                f.write(data)
        real = own[nulls:]
        return Written({"name": name, "part": part, "docs": len(own), "ids": int(size.sum()), "nulls": nulls, "first": int(real[0]) if len(real) else None, "last": int(real[-1]) if len(real) else None})

    def commit(self, messages: list[Written | None]) -> None:
        shards, start = [], 0
        for one in sorted((m.shard for m in messages if m and m.shard), key=lambda s: s["part"]):
            shards.append(one | {"start": start})
            start += one["ids"]
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        old = []
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            old = read_manifest(self.path)["shards"]
        with system.open_output_stream(f"{root}/{MANIFEST}.new") as f:
            f.write(json.dumps({"format": 1, "width": self.width, "end_id": self.end_id, "ids": start, "shards": shards}).encode())
        system.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
        self._remove(old)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([m.shard for m in messages if m and m.shard])

    def _remove(self, shards: list[dict]) -> None:
        system, root = _open(self.path)
        for one in shards:
            for end in ("ids", "keys", "mph"):
                system.delete_file(f"{root}/{one['name']}.{end}")


def _copies(keys: np.ndarray, nulls: int) -> np.ndarray:
    """Copy numbers of the keys of a shard; the null ones, stored as 0, count on from 2**40."""
    return np.concatenate([np.arange(nulls) + (1 << 40), copy_numbers(keys[nulls:])]).astype(np.int64)


@dataclass
class Shard(InputPartition):
    shard: dict
    width: int


class ShardReader(DataSourceReader):
    """All documents of the shards, each found through the index."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        manifest = read_manifest(self.path)
        return [Shard(s, manifest["width"]) for s in manifest["shards"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Shard):
            return
        shard, name = partition.shard, partition.shard["name"]
        keys = np.frombuffer(_read(self.path, f"{name}.keys"), "<i8")
        nulls = shard["nulls"]
        found, offsets, lengths = KeyIndex.from_bytes(_read(self.path, f"{name}.mph")).find(keys, _copies(keys, nulls))
        if not found.all() or (np.cumsum(lengths) - lengths != offsets).any() or lengths.sum() != shard["ids"]:
            raise ValueError(f"the index of {name} does not match its keys")
        system, root = _open(self.path)
        with system.open_input_file(f"{root}/{name}.ids") as f:
            low = 0
            while low < len(keys):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + READ_BYTES // 4, "left")))
                begin, end = int(offsets[low]), int(offsets[high - 1] + lengths[high - 1])
                flat = np.frombuffer(f.read_at((end - begin) * partition.width, begin * partition.width), f"<u{partition.width}").astype("<u4")
                bounds = np.append(offsets[low:high], end) - begin
                ids = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(np.ascontiguousarray(4 * bounds)), pa.py_buffer(flat)]).cast(pa.binary())
                names = pa.array(keys[low:high], mask=np.arange(low, high) < nulls)
                yield pa.RecordBatch.from_arrays([names, pa.array(shard["start"] + offsets[low:high]), pa.array(lengths[low:high]), ids], names=["doc_id", "start", "n_tokens", "ids"])
                low = high


class TokenShards(DataSource):
    """``format("token_shards")``: options path, width (2 or 4 bytes an id) and end_id."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options.get("width", 4)), int(self.options.get("end_id", 0)))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, width: int = 2) -> None:
    """Write the ids of all ``docs`` (doc_id, text) as shards in ascending order of doc_id under ``path``."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenShards)
    # A row's own number lets rows that are equal, however many, be dealt to several partitions.
    order = ["doc_id", "hash", "own"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "own": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    with writing(spark):
        encode(dealt, tokenizer_path, end_id).write.format("token_shards").option("width", width).option("end_id", end_id).mode("overwrite").save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian 32-bit) of all documents."""
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").load(path)


class TokenStore:
    """Access by key from one process; indexes of the shards met last are kept."""

    def __init__(self, path: str, most_indexes: int = 16):
        self.path, self.manifest = path, read_manifest(path)
        self.shards = [s for s in self.manifest["shards"] if s["first"] is not None]
        self.lasts = [s["last"] for s in self.shards]
        self.firsts = [s["first"] for s in self.shards]
        self.index = lru_cache(most_indexes)(lambda name: KeyIndex.from_bytes(_read(path, f"{name}.mph")))

    def places(self, key: int) -> range:
        """Numbers of the shards whose keys reach over ``key``; more than one only where copies cross their border."""
        return range(bisect_left(self.lasts, key), bisect_right(self.firsts, key))

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of all documents with this key."""
        width, out = self.manifest["width"], []
        system, root = _open(self.path)
        for shard in (self.shards[i] for i in self.places(key)):
            copy = 0
            while True:
                found, offset, length = self.index(shard["name"]).find(np.array([key]), np.array([copy]))
                if not found[0]:
                    break
                with system.open_input_file(f"{root}/{shard['name']}.ids") as f:
                    out.append(np.frombuffer(f.read_at(int(length[0]) * width, int(offset[0]) * width), f"<u{width}").astype("<u4"))
                copy += 1
        return out


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids of the documents that ``keys`` (doc_id) names, one row a document; keys not there give none.

    Distinct keys are dealt by shard, so that each shard's index is opened by few tasks.
    """
    found = "doc_id long, n_tokens long, ids binary"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = TokenStore(path)
        for batch in batches:
            pairs = [(k, p) for k in batch.column("doc_id").to_pylist() for p in store.places(k)[:1]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([p for _, p in pairs], pa.int64())], names=["doc_id", "shard"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = TokenStore(path)
        for batch in batches:
            for key in batch.column("doc_id").to_pylist():
                got = store.get(key)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.int64()), pa.array([len(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    dealt = asked.mapInArrow(route, "doc_id long, shard long").repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("shard")
    return dealt.mapInArrow(fetch, found)
