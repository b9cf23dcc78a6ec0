"""Near-duplicate classes by order min-hash and banded alignment.

1. Texts are collapsed to distinct ones; each is sketched ``sketches`` times: the
   ``kept`` least hashes among its k-mers of ``k`` words, every k-mer labelled with
   its occurrence number, taken in text order. Equal sketches mean equal k-mers in
   equal order, so the sketches follow edit similarity, not just overlap. Pairs
   whose longer text has fewer than ``SHORT`` words meet by single words instead, as
   one edit may touch all of their k-mers.
2. Texts with an equal sketch form a bucket. In each of ``TURNS`` turns a member of the
   bucket's largest class leads it, and every text outside that class is compared with
   the likely leader (4) that it meets in most buckets.
3. Buckets whose members then lie in different classes are still open. Up to ``FEW``
   members, all pairs of a bucket are judged, each in the first bucket it shares, so
   that it is returned once whatever else it shares. For the texts of larger buckets there is
   an exact similarity join: a pair within the edit limit has all but ``limit`` of the
   longer text's words in common, so both texts hold a common word among the
   ``limit + 1`` words of each that come first in one global order, rarest first
   (prefix filter). It finds every link between these texts, and texts that merely
   have passages in common hardly meet, so that no large bucket is spread into pairs.
4. Candidates of both steps must pass a bound on the symmetric difference of their
   words, from the parities of hashed words, before their texts are fetched.
5. A pair is a link if the word edit distance is at most (1 - ``similarity``) times
   the longer text: bounds by common word grams first, then an alignment limited to
   that band of diagonals.
6. Classes are the connected components, named by their least doc_id.

Every pair of texts that shares a sketch is thus compared, or in one class already.
Scattered edits of a share e leave J = (1-e)^5 / (2 - (1-e)^5) of the k-mers, so a pair
shares none of 96 sketches with probability (1 - J^2)^96: 0.023 at similarity 0.8,
0.0003 at 0.85, nothing to speak of above; edits in few places cost less.

Defined results: texts without words (null, empty, blank) and rows with a null
doc_id are each alone; equal texts are one class; rows that share a doc_id are one
document; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import BLANK, Texts, cut, drop, gram_hashes, mix, slices, word_hashes, word_spans

K, KEPT, SKETCHES, SIMILARITY = 5, 2, 96, 0.8
#: Below this many words an edit takes too large a share of the k-mers.
SHORT = 48
#: Least and most parity bits of a text's words; in between four for each word.
PARITY_BITS = 1 << 9, 1 << 14
#: Elections of leaders before all pairs that are still apart are judged.
TURNS, LEADERS = 1, 8
#: Members of a bucket up to which their pairs are judged one by one.
FEW = 2_048
#: Frequent words whose order is learned, from so many texts; all others count as rare.
RANKED, SAMPLE = 100_000, 2_000
#: Texts of up to this many words are aligned with the band's columns as bits.
BITWISE = 4_096
#: Words are compared with the next ones in chunks of this many when an alignment runs along a diagonal.
_CHUNK = 32


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes with the occurrence number of each mixed in, so that no two are equal."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    runs = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    occurrence = np.empty(len(hashes), np.uint64)
    occurrence[order] = np.arange(len(hashes)) - np.repeat(runs, np.diff(np.append(runs, len(hashes))))
    with np.errstate(over="ignore"):
        return mix(hashes + occurrence * np.uint64(0x632BE59BD9B4E019))


def sketch_text(words: np.ndarray, k: int = K, kept: int = KEPT, sketches: int = SKETCHES) -> np.ndarray:
    """Order min-hash sketches of one text from its word hashes."""
    grams = labelled(gram_hashes(words, min(k, len(words))))
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1 + (k << 32), 1 + (k << 32) + sketches, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        hashes = grams[None, :] ^ seeds[:, None]
        hashes *= mix(seeds)[:, None] | np.uint64(1)
        least = np.empty((sketches, min(kept, len(grams))), np.int64)
        rows = np.arange(sketches)
        for j in range(least.shape[1]):
            least[:, j] = hashes.argmin(axis=1)
            hashes[rows, least[:, j]] = np.iinfo(np.uint64).max
        least.sort(axis=1)  # text order
        out = seeds.copy()
        for j in range(least.shape[1]):
            out = mix(out * np.uint64(0x5851F42D4C957F2D) + grams[least[:, j]])
    return out.view(np.int64)


def sketches_of(words: np.ndarray, k: int = K, kept: int = KEPT, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> np.ndarray:
    """All sketches of one text: of single words if a longer one of a link may be short, of k-mers if it may not."""
    n = len(words)
    parts = [sketch_text(words, 1, kept, sketches)] if n < SHORT else []
    if n >= SHORT * similarity - 1e-9:
        parts.append(sketch_text(words, k, kept, sketches))
    return np.concatenate(parts)


def parity_of(words: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of the text's labelled words falls on each of a power of two of bits.

    Two texts differ in at most as many bits as their bags of words differ in words.
    """
    bits = min(PARITY_BITS[1], max(PARITY_BITS[0], 1 << (4 * len(words) - 1).bit_length()))
    count = np.bincount((labelled(words) >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits(count & 1).view(np.int64)


def folded(parity: np.ndarray, longs: int) -> np.ndarray:
    """The parity of the same text over fewer bits."""
    while parity.shape[-1] > longs:
        parity = parity[..., : parity.shape[-1] // 2] ^ parity[..., parity.shape[-1] // 2 :]
    return parity


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if r is None else len(r) for r in rows]
    held = [r for r in rows if r is not None]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64)))


def _sketch(k: int, kept: int, sketches: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                starts, ends, first = word_spans(texts, BLANK)
                words = word_hashes(texts.data, starts, ends)
                own = [words[a:b] if b > a else None for a, b in pairwise(first)]
                sketched = _lists([None if w is None else sketches_of(w, k, kept, sketches, similarity) for w in own])
                keys = [part.column(c) for c in ("doc_id", "key_a", "key_b")]
                yield pa.RecordBatch.from_arrays([*keys, sketched, pa.array(np.diff(first).astype(np.int32))], names=["doc_id", "key_a", "key_b", "sketch", "n_words"])

    return run


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and parities of each text."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = Texts(part.column("text"))
            starts, ends, first = word_spans(texts, BLANK)
            words = word_hashes(texts.data, starts, ends)
            parity = [parity_of(words[a:b]) for a, b in pairwise(first)]
            short = [folded(p, PARITY_BITS[0] // 64) for p in parity]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(np.diff(first).astype(np.int32)), _lists(parity), _lists(short)], names=["doc_id", "text", "n_words", "parity", "short"])


def limit_of(longer: int, similarity: float) -> int:
    """Edits that a link may have."""
    return int((1 - similarity) * longer + 1e-9)


def numbered(*texts: list[bytes]) -> list[np.ndarray]:
    """Each text's words as numbers, equal for equal words."""
    known: dict[bytes, int] = {}
    return [np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in texts]


def _slide(a: np.ndarray, b: np.ndarray, i: np.ndarray, diagonal: np.ndarray) -> None:
    """Move each ``i`` along its diagonal while the words are equal; both texts end in words of their own."""
    live = np.flatnonzero(i >= 0)
    live = live[a[i[live]] == b[i[live] + diagonal[live]]]
    i[live] += 1
    ahead = np.arange(_CHUNK)
    while len(live):
        x, y = i[live, None] + ahead, (i[live] + diagonal[live])[:, None] + ahead
        same = a[np.minimum(x, len(a) - 1)] == b[np.minimum(y, len(b) - 1)]
        whole = same.all(axis=1)
        i[live] += np.where(whole, _CHUNK, same.argmin(axis=1))
        live = live[whole]


def _apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both texts without their common beginning and end."""
    top = min(len(a), len(b))
    unlike = np.flatnonzero(a[:top] != b[:top])
    low = int(unlike[0]) if len(unlike) else top
    unlike = np.flatnonzero(a[low:][::-1][: top - low] != b[low:][::-1][: top - low])
    tail = int(unlike[0]) if len(unlike) else top - low
    return a[low : len(a) - tail], b[low : len(b) - tail]


def edit_distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance of numbered texts if at most ``most``, in the band of 2 * most + 1 diagonals."""
    if abs(len(a) - len(b)) > most:
        return None
    a, b = _apart(a, b)
    if not len(a) or not len(b):
        return max(len(a), len(b)) if max(len(a), len(b)) <= most else None
    return _by_columns(a.tolist(), b.tolist(), most) if max(len(a), len(b)) <= BITWISE else _by_reach(a, b, most)


def _by_columns(a: list[int], b: list[int], most: int) -> int | None:
    """The band's columns one by one, each the bits of its vertical steps up and down; bit r is row j - most + r."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    mask = (1 << 2 * most + 1) - 1
    up, down = mask >> most << most, 0  # above the text there are no steps
    goal = len(a) - len(b)
    watched, distance = 1 << most + goal, max(goal, 0)  # the goal's diagonal, on which the distance never falls
    for j, w in enumerate(b):
        same = where.get(w, 0)
        same = (same >> j - most if j > most else same << most - j) & mask
        flat = ((same & up) + up ^ up | same | down) & mask  # no step along the diagonal
        if not flat & watched:
            distance += 1
            if distance > most:
                return None
        right = (down | ~(flat | up)) & mask
        left = flat & up
        up, down = (left | ~(flat >> 1 | right)) & mask, flat >> 1 & right
    return distance


def _by_reach(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The furthest row reached on each diagonal of the band, for one edit more at a time."""
    n, m = len(a), len(b)
    a, b, goal, none = np.append(a, -1), np.append(b, -2), m - n, -2
    first, reach = 0, np.array([-1])  # least diagonal, and the furthest row of ``a`` on it and the next ones
    for d in range(most + 1):
        low, high = max(-d, -n, goal - most + d), min(d, m, goal + most - d)  # others can't come back to the goal within the band
        if low > high:
            return None
        diagonal = np.arange(low, high + 1)
        if d == 0:
            now = np.zeros(len(diagonal), np.int64)
        else:
            pad = np.full(max(2, 2 + first - low), none), np.full(max(2, 2 + high - first - len(reach) + 1), none)
            wide, at = np.concatenate([pad[0], reach, pad[1]]), low - first + len(pad[0])
            size = len(diagonal)
            now = np.maximum(np.maximum(wide[at - 1 : at - 1 + size], wide[at : at + size] + 1), wide[at + 1 : at + 1 + size] + 1)
            now = np.where(now < 0, none, np.minimum(np.minimum(now, n), m - diagonal))
        _slide(a, b, now, diagonal)
        if low <= goal <= high and now[goal - low] >= n:
            return d
        first, reach = low, now
    return None


def _lacking(a: np.ndarray, b: np.ndarray) -> int:
    """The larger of the two bag differences of numbered items."""
    size = 1 + max(a.max(initial=-1), b.max(initial=-1))
    more = np.bincount(a, minlength=size) - np.bincount(b, minlength=size)
    return max(int(more[more > 0].sum()), -int(more[more < 0].sum()))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length of two numbered texts reaches ``similarity``."""
    most = limit_of(max(len(a), len(b)), similarity)
    if abs(len(a) - len(b)) > most:
        return False
    # One edit touches at most g of the grams of g words on either side.
    one, two = a, b
    for g in range(1, 5 if min(len(a), len(b)) > BITWISE else 2):
        if g > 1:
            size = 1 + max(one.max(), two.max(), a.max(), b.max())
            pairs = np.concatenate([one[:-1] * size + a[g - 1 :], two[:-1] * size + b[g - 1 :]])
            names = np.unique(pairs, return_inverse=True)[1]
            one, two = names[: len(a) - g + 1], names[len(a) - g + 1 :]
        if _lacking(one, two) > g * most:
            return False
    return edit_distance_within(a, b, most) is not None


def _align(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for leader, member, one, two in zip(*(batch.column(c) for c in ("leader", "member", "leader_text", "member_text")), strict=True):
                if similar(*numbered(one.as_py().encode().split(), two.as_py().encode().split()), similarity):
                    a.append(leader.as_py())
                    b.append(member.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class _Bounds:
    """Lengths and parities of some texts, compared by row numbers."""

    def __init__(self, n_words: np.ndarray, parity: pa.ListArray, similarity: float):
        self.n, self.similarity = n_words.astype(np.int64), similarity
        flat, off = parity.flatten().to_numpy().view(np.uint64), np.asarray(parity.offsets) - parity.offsets[0].as_py()
        self.size = np.diff(off)
        self.rows = [flat[a:b] for a, b in pairwise(off)]
        self.tables: dict[int, np.ndarray] = {}

    def table(self, longs: int) -> np.ndarray:
        if longs not in self.tables:
            self.tables[longs] = np.stack([folded(p, longs) if len(p) >= longs else np.zeros(longs, np.uint64) for p in self.rows])
        return self.tables[longs]

    def slack(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far each of the pairs of rows ``i`` and ``j`` keeps from its bound; negative if it can't be a link."""
        gap = np.abs(self.n[i] - self.n[j])
        most = ((1 - self.similarity) * np.maximum(self.n[i], self.n[j]) + 1e-9).astype(np.int64)
        out = np.where(gap <= most, 2 * most - gap, -1)
        size = np.where(out >= 0, np.minimum(self.size[i], self.size[j]), 0)
        for longs in np.unique(size[out >= 0]):
            at = np.flatnonzero(size == longs)
            # A replaced word is one lost and one gained; an edit of length one is lost or gained.
            out[at] -= np.bitwise_count(self.table(longs)[i[at]] ^ self.table(longs)[j[at]]).sum(axis=1, dtype=np.int64)
        return out


def _likely(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                both = lambda name: pa.concat_arrays([batch.column(f"{x}_{name}") for x in ("leader", "member")])
                bounds = _Bounds(both("n_words").to_numpy(), both("parity"), similarity)
                batch = batch.filter(pa.array(bounds.slack(np.arange(n), np.arange(n) + n) >= 0))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("leader", "member", "shared")], names=["leader", "member", "shared"])

    return run


def _described(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(leader, member, shared) whose word bounds allow a link."""
    side = lambda name: texts.select(F.col("doc_id").alias(name), F.col("n_words").alias(f"{name}_n_words"), F.col("parity").alias(f"{name}_parity"))
    return pairs.join(side("member"), "member").join(side("leader"), "leader").mapInArrow(_likely(similarity), "leader long, member long, shared long")


class _Meetings:
    """Sketches of some texts by their numbers, those of words before those of k-mers; 0 where a text has none."""

    def __init__(self, n_words: np.ndarray, sketch: pa.ListArray, similarity: float):
        flat, off = sketch.flatten().to_numpy(), np.asarray(sketch.offsets) - sketch.offsets[0].as_py()
        parts = (n_words < SHORT).astype(np.int64) + (n_words >= SHORT * similarity - 1e-9)  # as in sketches_of
        width = 2 * int((np.diff(off) // parts).max())
        self.table = np.zeros((len(n_words), width), np.int64)
        for i, (a, b) in enumerate(pairwise(off)):
            at = 0 if n_words[i] < SHORT else width - (b - a)
            self.table[i, at : at + b - a] = flat[a:b]

    def first(self, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Whether ``value`` is the first sketch that the rows ``i`` and ``j`` share."""
        same = (self.table[i] == self.table[j]) & (self.table[i] != 0)
        return ~same.any(axis=1) | (self.table[i, same.argmax(axis=1)] == value)


#: Pairs that are returned together.
_PAIRS = 10_000


def _judge(similarity: float):
    """Pairs of texts with an equal value, next to each other in the input, that may be links between classes; ``shared`` is their slack.

    A pair is returned for the first sketch it shares only, so by one task and once.
    """

    def pairs(held: pa.Table) -> Iterator[pa.RecordBatch]:
        value, ids, label, n_words = (held.column(c).to_numpy() for c in ("value", "doc_id", "label", "n_words"))
        bounds = _Bounds(n_words, held.column("parity").combine_chunks(), similarity)
        live, step, found, count, meetings = np.arange(len(value)), 1, [], 0, None
        while len(live):
            live = live[live + step < len(value)]
            live = live[value[live] == value[live + step]]
            i = live[label[live] != label[live + step]]
            slack = bounds.slack(i, i + step)
            i, slack = i[slack >= 0], slack[slack >= 0]
            if len(i):
                meetings = meetings or _Meetings(n_words, held.column("sketch").combine_chunks(), similarity)
                here = meetings.first(i, i + step, value[i])
                i, slack = i[here], slack[here]
                found.append((np.minimum(ids[i], ids[i + step]), np.maximum(ids[i], ids[i + step]), slack))
                count += len(i)
            if count >= _PAIRS or not len(live) and count:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["leader", "member", "shared"])
                found, count = [], 0
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held else ()), batch])
            value = held.column("value").to_numpy()
            # the last value may go on in the next batch
            last = np.flatnonzero(value[1:] != value[:-1])
            if len(last):
                yield from pairs(held.slice(0, int(last[-1]) + 1))
                held = held.slice(int(last[-1]) + 1)
        if held:
            yield from pairs(held)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    mine = texts.select(F.col("doc_id").alias("member"), F.col("text").alias("member_text"))
    other = texts.select(F.col("doc_id").alias("leader"), F.col("text").alias("leader_text"))
    return pairs.select("leader", "member").join(mine, "member").join(other, "leader").mapInArrow(_align(similarity), "a long, b long")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` with the classes of both, where these differ."""
    side = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    named = pairs.join(side("leader"), "leader", "left").join(side("member"), "member", "left")
    named = named.withColumns({f"{x}_label": F.coalesce(f"{x}_label", x) for x in ("leader", "member")})
    return named.where("leader_label <> member_label")


def _words(ranks=None, similarity: float = SIMILARITY):
    """The labelled words of each text, or with ``ranks`` only those of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rank = ranks.value if ranks else (None, None)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                starts, ends, first = word_spans(texts, BLANK)
                hashes, out = word_hashes(texts.data, starts, ends), []
                for a, b in pairwise(first):
                    words = labelled(hashes[a:b])
                    if ranks and len(words):
                        place = np.minimum(np.searchsorted(names, words), max(0, len(names) - 1))
                        score = np.where(names[place] == words, rank[place], -1) if len(names) else np.full(len(words), -1)
                        words = words[np.lexsort((words, score))][: limit_of(len(words), similarity) + 1]
                    out.append(words.view(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), _lists(out)], names=[*(c for c in part.schema.names if c != "text"), "words"])

    return run


def prefix_pairs(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(leader, member, shared) of all pairs of ``texts`` (doc_id, text, n_words, parity, label) that may be links between classes.

    Prefix filter: one global order of labelled words, by how many texts hold them;
    a link's texts meet in the first words of both. Any order is exact; the learned
    ranks of frequent words, at most ``RANKED`` from ``SAMPLE`` texts, only make the
    meetings few.
    """
    spark = texts.sparkSession
    some = texts.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    flat = some.mapInArrow(_words(), "doc_id long, words array<long>").select(F.explode("words").alias("word"))
    common = flat.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(RANKED).toPandas()
    names = common["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    ranks = spark.sparkContext.broadcast((names[order], common["n"].to_numpy(np.int64)[order]))
    held = texts.select("doc_id", "label", "text").mapInArrow(_words(ranks, similarity), "doc_id long, label long, words array<long>")
    held = cut(held.select("doc_id", "label", F.explode("words").alias("word")))
    mixed = held.groupBy("word").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("word")
    # Written first, so that the join's two sides are plain shuffles, whose skewed keys Spark splits.
    met = cut(held.join(mixed, "word").join(texts.select("doc_id", "n_words", "short"), "doc_id"), held)
    side = lambda tag: met.select("word", *(F.col(c).alias(f"{tag}_{c}") for c in ("doc_id", "n_words", "short", "label")))
    longer, shorter = F.greatest("a_n_words", "b_n_words"), F.least("a_n_words", "b_n_words")
    most = F.floor(F.lit(1 - similarity) * longer + 1e-9)
    apart = sum((F.bit_count(F.col("a_short")[i].bitwiseXOR(F.col("b_short")[i])) for i in range(PARITY_BITS[0] // 64)), F.lit(0))
    pairs = side("a").join(side("b"), "word").where("a_doc_id < b_doc_id and a_label <> b_label").where((longer - shorter <= most) & (apart <= 2 * most - (longer - shorter)))
    pairs = cut(pairs.groupBy(F.col("a_doc_id").alias("leader"), F.col("b_doc_id").alias("member")).agg(F.count("*").alias("shared")), met)
    return cut(_described(pairs, texts, similarity), pairs)


def open_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """(leader, member, shared) of all pairs in a bucket of ``members`` (value, rep) that may be links between classes."""
    named = members.select("value", F.col("rep").alias("doc_id")).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = named.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high").select("value", "n")
    still = cut(named.join(mixed, "value").select("value", "n", "doc_id", "label"))
    # A pair belongs to the first bucket it shares: if that is a larger one, to the join below.
    few = still.where(F.col("n") <= FEW).select("value", "doc_id", "label")
    few = few.join(texts.select("doc_id", "n_words", "parity"), "doc_id").join(sketched.select(F.col("rep").alias("doc_id"), "sketch"), "doc_id")
    met = few.repartition("value").sortWithinPartitions("value").mapInArrow(_judge(similarity), "leader long, member long, shared long")
    pairs = cut(met.groupBy("leader", "member").agg(F.max("shared").alias("shared")))
    many = cut(still.where(F.col("n") > FEW).select("doc_id", "label").distinct(), still)
    if many.limit(1).count():
        pairs = cut(pairs.unionByName(prefix_pairs(texts.join(many, "doc_id"), similarity)).groupBy("leader", "member").agg(F.max("shared").alias("shared")), pairs)
    drop(many)
    return pairs


def _strongest(pairs: DataFrame) -> DataFrame:
    """One pair of each two classes, the one that shares most."""
    low, high = F.least("leader_label", "member_label"), F.greatest("leader_label", "member_label")
    return pairs.groupBy(low.alias("low"), high.alias("high")).agg(F.max_by(F.struct("leader", "member"), F.struct("shared", (-F.col("leader")).alias("l"), (-F.col("member")).alias("m"))).alias("p")).select("p.*")


def _elected(members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(member, leader, shared): each member of ``members`` (value, rep, fame) in another class than its bucket's leader, with the ``LEADERS`` it meets most.

    A member of the bucket's largest class leads, first the one with most company,
    later another one each turn.
    """
    named = members.withColumns({"label": F.col("rep"), "size": F.lit(1).cast("long")})
    if labels is not None:
        sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
        known = labels.join(sizes, "label").select(F.col("node").alias("rep"), "label", "size")
        named = members.join(known, "rep", "left").withColumns({"label": F.coalesce("label", "rep"), "size": F.coalesce("size", F.lit(1))})
    among = F.col("fame") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    leaders = named.groupBy("value").agg(F.max_by(F.struct("rep", "label"), F.struct("size", among.alias("among"), (-F.col("rep")).alias("small"))).alias("top"), F.min("label").alias("low"), F.max("label").alias("high"))
    leaders = leaders.where("low <> high").select("value", F.col("top.rep").alias("leader"), F.col("top.label").alias("leader_label"))
    met = named.join(leaders, "value").where("label <> leader_label").groupBy("leader", F.col("rep").alias("member")).agg(F.count("*").alias("shared"))
    ranked = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("shared"), "leader"))
    return met.withColumn("rank", ranked).where(F.col("rank") <= LEADERS).drop("rank")


def links_of(sketched: DataFrame, texts_of, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(a, b) of links, and (node, label) of their components, among distinct texts (rep, sketch).

    ``texts_of`` gives doc_id, text, n_words, parity of the given ids.
    """
    spread = sketched.select("rep", F.explode("sketch").alias("value"))  # each is seeded by its number
    # Written first, so that the join's two sides are plain shuffles, whose skewed keys Spark splits.
    sizes = cut(spread.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"))
    sized = cut(spread.join(sizes, "value"), sizes)
    fame = cut(sized.groupBy("rep").agg(F.sum("n").alias("fame")))
    texts = cut(texts_of(fame.select(F.col("rep").alias("doc_id"))))
    members = cut(sized.join(fame, "rep").select("value", "rep", "fame"), sized, fame)
    links, labels = None, None
    for turn in range(TURNS):
        pairs = cut(_elected(members, labels, turn))
        best = _described(pairs, texts, similarity).groupBy("member").agg(F.max_by("leader", F.struct("shared", (-F.col("leader")).alias("small"))).alias("leader"))
        more = cut(_verified(best, texts, similarity), pairs)
        if links is None:
            links, labels = more, components(more)
        elif not more.limit(1).count():
            break
        else:
            links, labels = _joined(links, labels, more)
    pairs = open_pairs(members, labels, texts, sketched, similarity)
    first = cut(_strongest(_labelled(pairs, labels)), members)
    links, labels = _joined(links, labels, cut(_verified(first, texts, similarity)))
    rest = _labelled(pairs, labels).join(first, ["leader", "member"], "left_anti")
    links, labels = _joined(links, labels, cut(_verified(rest, texts, similarity), pairs, first))
    drop(texts)
    return links, labels


def _joined(links: DataFrame, labels: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    if not more.limit(1).count():
        return links, labels
    links = cut(links.unionByName(more), links, more)
    return links, components(links, labels)


def classes(docs: DataFrame, k: int = K, kept: int = KEPT, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key_a, key_b, class_id) of every row of ``docs`` (doc_id, text); the keys hash the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(7), F.col("text")).alias("key_b"))
    made = cut(rows.mapInArrow(_sketch(k, kept, sketches, similarity), "doc_id long, key_a long, key_b long, sketch array<long>, n_words int"))
    # Equal texts have equal sketches, so any of them stands for all.
    wordy = made.where((F.col("n_words") > 0) & F.col("doc_id").isNotNull())
    distinct = cut(wordy.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    sketched = cut(made.select("doc_id", "key_a", "key_b", "n_words"), made)
    wordy = sketched.where((F.col("n_words") > 0) & F.col("doc_id").isNotNull())

    def texts_of(ids: DataFrame) -> DataFrame:
        known = distinct.select(F.col("rep").alias("doc_id"), "key_a", "key_b").join(ids, "doc_id")
        met = rows.join(known, ["doc_id", "key_a", "key_b"]).dropDuplicates(["doc_id", "key_a"])
        return met.select("doc_id", "text").mapInArrow(_describe, "doc_id long, text string, n_words int, parity array<long>, short array<long>")

    links, labels = links_of(distinct, texts_of, similarity)
    # Rows of one text and rows of one doc_id hang together too.
    distinct = cut(distinct.select("key_a", "key_b", "rep"), distinct)
    copies = wordy.join(distinct, ["key_a", "key_b"])
    twice = wordy.groupBy("doc_id").agg(F.count_distinct("key_a").alias("n")).where("n > 1")
    if twice.limit(1).count():
        labels = components(links.unionByName(copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    named = copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "key_a", "key_b", F.coalesce("label", "rep").alias("class_id"))
    alone = sketched.where((F.col("n_words") == 0) | F.col("doc_id").isNull()).select("doc_id", "key_a", "key_b", F.col("doc_id").alias("class_id"))
    return named.unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, the one of least doc_id; all columns."""
    found = classes(docs, **options)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).where(F.col("doc_id").isNotNull()).select("doc_id", "key_a", "key_b").distinct()
    own = docs.withColumns({"key_a": F.xxhash64("text"), "key_b": F.xxhash64(F.lit(7), F.col("text"))})
    kept = own.join(first, ["doc_id", "key_a", "key_b"], "left_semi").dropDuplicates(["doc_id", "key_a", "key_b"])
    return kept.unionByName(own.where(F.col("doc_id").isNull())).select(*docs.columns)
