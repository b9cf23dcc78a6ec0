"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are centred, rotated by learned rotations (alternating between codes and
the orthogonal map that fits them best) and cut to sign bits. A block of vectors
is indexed once for each 8-bit substring of its codes. A query probes, in every
substring's table, all values within floor(radius / substrings) bits of its own:
by the pigeonhole principle these buckets hold every code within the radius.
Codes within the radius, or the nearest ``k`` codes of a block that has fewer,
are reranked by the cosine of the original vectors in double precision.

Rotations and radius are fitted on at most ``sample`` vectors, taken by the order
of a hash of vec_id; every vector is indexed. Queries are written as a table, in
blocks of about ``query_block`` vectors; one block at a time goes to the tasks, and
its neighbours are written before the next one is read, so driver and executors
hold one block however many queries there are. Each block costs one scan.

Defined results: vectors that are null, zero, of another length than most of the
sample, or that hold nulls or non-finite numbers take no part, nor do rows with
a null id; rows of the query's own id are not its neighbours; of several query
rows with one id the first by vector counts; ties go to the smaller vec_id; other
columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop

SAMPLE, ROTATIONS, QUERY_BLOCK, PART_BITS = 16_384, 2, 20_000, 8


class Coder:
    """Sign codes of ``rotations`` learned rotations, and the search radius."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 25, seed: int = 7, k: int = 5, quantile: float = 0.97):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centre = unit.mean(axis=0)
        x = unit - self.centre
        rng = np.random.default_rng(seed)
        self.turns = []
        for _ in range(rotations):
            turn = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.sign(x @ turn).T @ x)
                turn = (u @ v).T
            self.turns.append(turn)
        codes = self.codes(sample)
        self.parts = codes.shape[1]
        # the radius that holds nearly all true neighbours within the sample
        ask = np.arange(0, len(x), max(1, len(x) // 256))
        near = unit[ask] @ unit.T
        near[np.arange(len(ask)), ask] = -2
        top = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
        far = np.array([hamming(codes[t], codes[a]) for a, t in zip(ask, top, strict=True)])
        self.radius = int(np.quantile(far, quantile)) if far.size else 8 * self.parts

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - self.centre
        bits = np.concatenate([x @ turn > 0 for turn in self.turns], axis=1)
        pad = -bits.shape[1] % 64
        return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


_values = np.arange(256, dtype=np.uint8)
_weight = np.bitwise_count(_values)


class CodeIndex:
    """One table of buckets for each 8-bit substring of the codes of a block."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.order = [np.argsort(column, kind="stable") for column in self.codes.T]
        self.sizes = [np.bincount(column, minlength=256) for column in self.codes.T]

    def within(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """Rows whose code is within ``radius``; the nearest ``least`` rows if those are fewer."""
        ball = _weight <= radius // self.codes.shape[1]
        met = np.zeros(len(self.codes), bool)
        for j, own in enumerate(code):
            probed = ball[_values ^ own]  # buckets of this table to open
            met[self.order[j][np.repeat(probed, self.sizes[j])]] = True
        rows = np.flatnonzero(met)
        rows = rows[hamming(self.codes[rows], code) <= radius]
        if len(rows) < least:
            far = hamming(self.codes, code)
            rows = np.flatnonzero(far <= np.partition(far, min(least, len(far)) - 1)[min(least, len(far)) - 1])
        return rows


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _search(asked, coder, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, codes = asked.value
        norms = np.sqrt((queries * queries).sum(axis=1))
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("vec_id").to_numpy()
            x = matrix(batch.column("vector"))
            lengths = np.sqrt((x * x).sum(axis=1))
            index = CodeIndex(coder.value.codes(x))
            for q in range(len(ids)):
                rows = index.within(codes[q], coder.value.radius, k + 1)
                rows = rows[own[rows] != ids[q]]
                score = np.concatenate([best[q][0], (x[rows] * queries[q]).sum(axis=1) / (lengths[rows] * norms[q])])
                names = np.concatenate([best[q][1], own[rows]])
                take = np.lexsort((names, -score))[:k]
                best[q] = (score[take], names[take])
        sizes = [len(names) for _, names in best]
        cols = [pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([n for _, n in best]) if best else np.zeros(0, np.int64)), pa.array(np.concatenate([s for s, _ in best]) if best else np.zeros(0))]
        yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0)).where(finite & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 5, sample: int = SAMPLE, query_block: int = QUERY_BLOCK, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row where ``is_query`` holds (a condition on vec_id)."""
    sc = vectors.sparkSession.sparkContext
    rows = usable(vectors, column)
    learn = [r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toLocalIterator()]
    empty = "query_id long, rank int, vec_id long, score double"
    if not learn:
        return vectors.sparkSession.createDataFrame([], empty)
    sizes = [len(v) for v in learn]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    rows = rows.where(F.size("vector") == dim)
    coder = Coder(np.array([v for v in learn if len(v) == dim], np.float64), k=k)
    asking = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asking = cut(asking.withColumn("hash", F.xxhash64("vec_id")))
    blocks = -(-asking.count() // query_block)
    if not blocks:
        return vectors.sparkSession.createDataFrame([], empty)
    shared, found = sc.broadcast(coder), []
    for block in range(blocks):
        own = asking.where(F.pmod("hash", F.lit(blocks)) == block).select("vec_id", "vector").toArrow()
        x = matrix(own.column("vector"))
        asked = sc.broadcast((own.column("vec_id").to_numpy(), x, coder.codes(x) if len(x) else np.zeros((0, 0), np.uint8)))
        found.append(cut(rows.mapInArrow(_search(asked, shared, k), "query_id long, vec_id long, score double")))
        asked.unpersist()
    drop(asking)
    met = found[0]
    for more in found[1:]:
        met = met.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = 5) -> dict[int, list[int]]:
    """Exact neighbours (for tests and recall)."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(queries):
        score = unit @ unit[q]
        score[ids == ids[q]] = -2
        out[int(ids[q])] = ids[np.lexsort((ids, -score))[:k]].tolist()
    return out
