"""Hard negatives from blocks of candidates along a Hilbert curve, chosen by zone maps.

``layout`` turns components into integers floor(scale * x), orders the rows by their
place on a Hilbert curve through the dimensions that vary most, cuts the curve into
blocks of ``block_rows`` and writes each as one Parquet row: ids, labels, values, and a
zone map of least and greatest value in each dimension, with the labels it holds.
Interval arithmetic on a zone bounds the inner products of an anchor with all rows of
the block: the sum over dimensions of the lesser (greater) of anchor times least and
anchor times greatest. The columns of the zones are read first and alone:

1. Positives: an anchor reads the blocks that hold its label and may reach the
   score of its fifth best in its own block, which the layout has noted.
2. Negatives: each positive opens a window of scores; an anchor reads the blocks whose
   bounds meet one of its windows.

Chosen blocks are joined to the anchors that ask for them, as a bit set; a task keeps
the best rows of each anchor and window. Anchors come from a written table, in groups
of at most ``anchor_group``, so what goes to the tasks is bounded by that number.
Scores are exact: sums stay in doubles where all products keep below 2**53, else in
64-bit integers.

Defined results: rows without id, label or vector, with null or non-finite components,
or of another length than most (of equally many the longer) take no part; several
candidates may share an id and count one by one, but none of its own id is another row
of an anchor; of several anchors with one id the one of least label, then vector counts;
ties go to the smaller id; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop

SCALE, BLOCK_ROWS, ANCHOR_GROUP = 256, 1024, 16_384
CURVE_DIMS, CURVE_BITS = 8, 8
#: Anchors are scored against a block in parts of about this many scores.
PART_SCORES = 1 << 21
BLOCK = "block long, ids array<long>, labels array<long>, cells binary, low array<long>, high array<long>, held array<long>"
FOUND = "anchor_id long, window long, positive_id long, positive_score long, vec_id long, score long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of ``bits``-bit cells (at most 64 bits in all), as unsigned 64-bit numbers."""
    x = cells.T.astype(np.uint64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint64(1 << level), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(level)) & np.uint64(1))
    return out


def usable(rows: DataFrame, label: Column, column: str, scale: int) -> DataFrame:
    """vec_id, label, cell (integers) of the rows that take part."""
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)).where(finite)
    return own.select("vec_id", "label", F.transform("vector", lambda x: F.floor(x * scale)).alias("cell"))


def lists(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equally long integer lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def narrow(cells: np.ndarray) -> np.ndarray:
    """The cells in the fewest bytes that hold them all."""
    return cells.astype(next(kind for kind in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(kind).min <= cells.min() and cells.max() <= np.iinfo(kind).max))


def largest(cells: np.ndarray) -> int:
    return max(int(cells.max()), -int(cells.min()))


def scores(asked: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    if not asked.size or not cells.size:
        return np.zeros((len(asked), len(cells)), np.int64)
    if largest(asked) * largest(cells) * asked.shape[1] < 2**53:
        return (asked.astype(np.float64) @ cells.T.astype(np.float64)).astype(np.int64)
    return asked @ cells.T.astype(np.int64)


def bounds(asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor with a row between ``low`` and ``high``, in doubles rounded outwards."""
    up, down = np.maximum(asked, 0).astype(np.float64), np.minimum(asked, 0).astype(np.float64)
    slack = 1e-12 * (np.abs(asked).astype(np.float64) @ np.maximum(np.abs(low), np.abs(high)).astype(np.float64)) + 1
    return up @ low + down @ high - slack, up @ high + down @ low + slack


NOTHING = np.iinfo(np.int64).min


def best(found: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest allowed scores of each row, ties to the smaller id; ``ids`` ascend."""
    masked = np.where(allowed, found, NOTHING)
    n = masked.shape[1]
    if n > k:
        least = np.partition(masked, n - k, axis=1)[:, n - k, None]
        above = masked > least
        level = (masked == least) & (least != NOTHING)
        room = k - above.sum(axis=1, keepdims=True)
        if (level.sum(axis=1, keepdims=True) > room).any():
            level &= np.cumsum(level, axis=1) <= room
        return np.nonzero(above | level)
    return np.nonzero(masked != NOTHING)


def layout(rows: DataFrame, is_anchor: Column, positives: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The blocks of ``rows`` (vec_id, label, cell), with what their anchors know from their own block; see ``BLOCK``."""
    spark = rows.sparkSession
    sizes = rows.groupBy(F.size("cell").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], BLOCK + ", anchors array<struct<vec_id: long, label: long, cell: array<long>, seed: long>>")
    dim = sizes["dim"]
    rows = rows.where(F.size("cell") == dim)
    # One short row for each dimension.
    spread = rows.select(F.posexplode("cell").alias("d", "x")).groupBy("d").agg(F.stddev_pop("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high"))
    chosen = spread.orderBy(F.desc("s"), "d").limit(CURVE_DIMS).collect()
    # Cells of the curve span two standard deviations to each side of the middle; beyond lie the border cells.
    axes = np.array([c["d"] for c in chosen])
    middle = np.array([(c["low"] + c["high"]) / 2 for c in chosen])
    step = np.array([max(min(4 * c["s"], c["high"] - c["low"]), 1e-9) for c in chosen]) / (1 << CURVE_BITS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = lists(batch.column("cell"), dim)
            grid = np.floor((cells[:, axes] - middle) / step) + (1 << CURVE_BITS - 1)
            at = hilbert(np.clip(grid, 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            yield batch.append_column("place", pa.array((at ^ np.uint64(1 << 63)).view(np.int64)))

    placed = cut(rows.withColumn("asks", F.coalesce(is_anchor, F.lit(False))).mapInArrow(place, "vec_id long, label long, cell array<long>, asks boolean, place long"))
    dealt = placed.withColumn("own", F.monotonically_increasing_id()).repartitionByRange("place", "vec_id", "own").sortWithinPartitions("place", "vec_id", "own")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def block(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            ids, labels, asks = (part.column(c).to_numpy() for c in ("vec_id", "label", "asks"))
            cells = lists(part.column("cell").combine_chunks(), dim)
            order = np.argsort(ids, kind="stable")
            ids, labels, asks, cells = ids[order], labels[order], asks[order], np.ascontiguousarray(cells[order], "<i8")
            own = np.flatnonzero(asks)
            found = scores(cells[own], cells)
            row, col = best(found, (labels[own][:, None] == labels) & (ids[own][:, None] != ids), ids, positives)
            seeds = np.full(len(own), NOTHING)
            for i in range(len(own)):
                mine = found[i, col[row == i]]
                if len(mine) == positives:
                    seeds[i] = mine.min()
            anchors = [{"vec_id": int(ids[a]), "label": int(labels[a]), "cell": cells[a].tolist(), "seed": int(s)} for a, s in zip(own, seeds, strict=True)]
            values = [number, ids.tolist(), labels.tolist(), narrow(cells).tobytes(), cells.min(axis=0).tolist(), cells.max(axis=0).tolist(), sorted(set(labels.tolist())), anchors]
            number += 1
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 2, pa.binary(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.struct([("vec_id", pa.int64()), ("label", pa.int64()), ("cell", pa.list_(pa.int64())), ("seed", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["block", "ids", "labels", "cells", "low", "high", "held", "anchors"])

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= block_rows:
                whole, at = pa.Table.from_batches(held), 0
                while count - at >= block_rows:
                    yield block(whole.slice(at, block_rows))
                    at += block_rows
                rest = whole.slice(at)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield block(pa.Table.from_batches(held))

    made = cut(dealt.mapInArrow(pack, BLOCK + ", anchors array<struct<vec_id: long, label: long, cell: array<long>, seed: long>>"))
    drop(placed)
    return made


class Group:
    """A bounded group of anchors: ids, labels, cells, scores from which a block matters, and their windows."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("vec_id").combine_chunks()
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        self.cells = np.array(rows.column("cell").to_pylist(), np.int64).reshape(len(self.ids), -1)
        self.seeds = rows.column("seed").to_numpy()
        windows = rows.column("windows").to_pylist()
        self.positives = max((len(w) for w in windows), default=0)
        table = np.zeros((len(self.ids), self.positives, 4), np.int64)
        table[:, :, 2], table[:, :, 3] = 1, 0  # an empty window
        for i, own in enumerate(windows):
            for j, w in enumerate(own):
                table[i, j] = w["positive_id"], w["positive_score"], w["low"], w["high"]
        self.positive_ids, self.positive_scores, self.low, self.high = np.moveaxis(table, 2, 0)

    def asking(self, low: np.ndarray, high: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Which anchors must read a block with these zones."""
        least, most = bounds(self.cells, low, high)
        if not self.positives:
            return np.isin(self.labels, held) & (most >= self.seeds)
        met = ((most[:, None] >= self.low) & (least[:, None] <= self.high) & (self.low <= self.high)).any(axis=1)
        return met & ((len(held) > 1) | (self.labels != held[0]))


def _choose(group):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = group.value
        for batch in batches:
            out = []
            for block, low, high, held in zip(*(batch.column(c).to_pylist() for c in ("block", "low", "high", "held")), strict=True):
                bits = asked.asking(np.array(low), np.array(high), np.array(held))
                if bits.any():
                    out.append((block, np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([a for _, a in out], pa.binary())], names=["block", "asked"])

    return run


def _read(group, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Group = group.value
        windows = max(asked.positives, 1)
        # of each anchor and window the best rows so far
        top_score = np.full((len(asked.ids), windows, k), NOTHING)
        top_id = np.zeros((len(asked.ids), windows, k), np.int64)

        def take(row: np.ndarray, w: int, score: np.ndarray, ids: np.ndarray) -> None:
            touched, at = np.unique(row, return_inverse=True)
            begin = np.searchsorted(at, np.arange(len(touched)))
            nth = np.arange(len(row)) - begin[at]
            new_score, new_id = np.full((len(touched), k), NOTHING), np.zeros((len(touched), k), np.int64)
            new_score[at, nth], new_id[at, nth] = score, ids
            both, names = np.concatenate([top_score[touched, w], new_score], axis=1), np.concatenate([top_id[touched, w], new_id], axis=1)
            order = np.lexsort((names, -np.maximum(both, NOTHING + 1)), axis=1)[:, :k]
            top_score[touched, w], top_id[touched, w] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

        for batch in batches:
            for ids, labels, cells, bits in zip(*(batch.column(c) for c in ("ids", "labels", "cells", "asked")), strict=True):
                ids, labels = (x.values.to_numpy(zero_copy_only=False) for x in (ids, labels))
                cells = np.frombuffer(cells.as_buffer(), f"<i{len(cells.as_buffer()) // (len(ids) * asked.cells.shape[1])}").reshape(len(ids), -1)
                all_rows = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=len(asked.ids)))
                part = max(1, PART_SCORES // len(ids))
                for at in range(0, len(all_rows), part):
                    rows = all_rows[at : at + part]
                    found, same = scores(asked.cells[rows], cells), asked.labels[rows][:, None] == labels
                    if not asked.positives:
                        row, col = best(found, same & (asked.ids[rows][:, None] != ids), ids, k)
                        take(rows[row], 0, found[row, col], ids[col])
                        continue
                    for w in range(windows):
                        within = ~same & (found >= asked.low[rows, w, None]) & (found <= asked.high[rows, w, None])
                        some = np.flatnonzero(within.any(axis=1))
                        if len(some):
                            row, col = best(found[some], within[some], ids, k)
                            take(rows[some[row]], w, found[some[row], col], ids[col])
        row, w, nth = np.nonzero(top_score != NOTHING)
        none = np.zeros(len(row), np.int64)
        pos = (asked.positive_ids[row, w], asked.positive_scores[row, w]) if asked.positives else (none, none)
        cols = (asked.ids[row], w, *pos, top_id[row, w, nth], top_score[row, w, nth])
        for low in range(0, len(row), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 50_000]) for c in cols], names=["anchor_id", "window", "positive_id", "positive_score", "vec_id", "score"])

    return run


def _search(blocks: DataFrame, anchors: DataFrame, groups: int, k: int) -> DataFrame:
    """The best rows of all anchors, one group of anchors after the other."""
    sc, out = blocks.sparkSession.sparkContext, None
    ranked = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    for g in range(groups):
        rows = anchors.where(F.pmod("hash", F.lit(groups)) == g).select("vec_id", "label", "cell", "seed", "windows").toArrow()
        if not rows.num_rows:
            continue
        group = sc.broadcast(Group(rows))
        chosen = blocks.select("block", "low", "high", "held").mapInArrow(_choose(group), "block long, asked binary")
        read = blocks.select("block", "ids", "labels", "cells").join(chosen, "block").mapInArrow(_read(group, k), FOUND)
        one = cut(read.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
        out = one if out is None else out.unionByName(one)
        group.unpersist()
    return out


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, column: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, block_rows: int = BLOCK_ROWS, anchor_group: int = ANCHOR_GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives are the best rows of other labels whose score is between ``low`` and
    ``high`` hundredths of the positive's. ``is_anchor`` is a condition on vec_id.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = layout(usable(rows, F.col("label") if label is None else label, column, scale), is_anchor, positives, block_rows)
    window = "array<struct<positive_id: long, positive_score: long, low: long, high: long>>"
    anchors = blocks.select(F.explode("anchors").alias("a")).select("a.*").groupBy("vec_id").agg(F.min_by(F.struct("label", "cell", "seed"), F.struct("label", "cell")).alias("a"))
    anchors = cut(anchors.select("vec_id", "a.label", "a.cell", "a.seed", F.array().cast(window).alias("windows"), F.xxhash64("vec_id").alias("hash")))
    groups = -(-anchors.count() // anchor_group)
    if not groups:
        return empty
    near = _search(blocks, anchors, groups, positives)
    if near is None:
        return empty
    # Hundredths rounded inwards, without leaving integers.
    window_of = F.struct(F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(f"-(({-low} * score - pmod({-low} * score, 100)) div 100)").alias("low"), F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("high"))
    bounded = near.select("anchor_id", window_of.alias("w"))
    wide = bounded.groupBy("anchor_id").agg(F.collect_list("w").alias("windows"))  # at most ``positives`` of them
    opened = cut(anchors.drop("windows").join(wide.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), anchors)
    found = _search(blocks, opened, groups, negatives)
    if found is None:
        return empty
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
