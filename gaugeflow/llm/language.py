"""Language of words and documents by a linear-chain conditional random field.

Every word emits weights of its hashed character n-grams (those at its ends are
its affixes), of the word itself and of the language lists that hold it; learned
transitions tie neighbouring words. Forward-backward gives each word its marginal
over the languages, and a document's prediction is the language with the largest
mean marginal, so code-switched text is labelled word by word.

Fitting uses at most ``sample`` labelled rows of each language, by the order of a hash
of doc_id, so that rare languages are learned too, and learns transitions from pieces of different rows strung together. Long texts are
cut into segments whose transfer matrices are chained, which gives the exact
marginals of the whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0;
repeated rows are labelled alike; without labelled rows all rows are ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices

SAMPLE, BUCKETS, SEGMENT, PIECE = 500, 1 << 16, 128, 60
WORDS = re.compile(r"[^\W\d_]+")
ADDED = ("lang_pred", "score", "word_langs")


def hashed_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the 2- to 4-grams of ``^word$`` and of the whole words."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(m) for m in marked])
    out_word, out_bucket = [], []
    with np.errstate(over="ignore"):
        scrambled = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value = scrambled
        for n in (2, 3, 4):
            if len(codes) < n:
                break
            value = (value[:-1] ^ (value[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + scrambled[n - 1 :]
            ok = owner[: len(value)] == owner[n - 1 :]
            out_word.append(owner[: len(value)][ok])
            out_bucket.append((value[ok] * np.uint64(0x94D049BB133111EB) + np.uint64(n)) >> np.uint64(48))
        place = np.arange(len(codes)) - np.repeat(np.cumsum([0, *(len(m) for m in marked[:-1])]), [len(m) for m in marked]) if words else np.zeros(0, np.int64)
        whole = np.zeros(len(words), np.uint64)
        np.add.at(whole, owner, scrambled * (place.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(1)))
        out_word.append(np.arange(len(words)))
        out_bucket.append((whole * np.uint64(0x94D049BB133111EB)) >> np.uint64(48))
    return np.concatenate(out_word), np.concatenate(out_bucket).astype(np.int64) % BUCKETS


@dataclass
class Crf:
    langs: list[str]
    grams: np.ndarray  # bucket x language
    lists: np.ndarray  # language list (last: none) x language
    step: np.ndarray  # from x to
    first: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        n = len(self.langs)
        owner, bucket = hashed_grams(words)
        out = np.stack([np.bincount(owner, self.grams[bucket, j], len(words)) for j in range(n)], axis=1)
        return out + self.lists[[self.lexicon.get(w, n) for w in words]]


def chain_marginals(scores: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (batch, time, label) and expected steps (label, label) of equally long chains."""
    b, t, n = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move, start = np.exp(step - step.max()), np.exp(first - first.max())
    ahead, back = np.empty((b, t, n)), np.empty((b, t, n))
    ahead[:, 0] = start * emit[:, 0]
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (ahead[:, i - 1] @ move) * emit[:, i]
        ahead[:, i] = x / x.sum(axis=1, keepdims=True)
    back[:, -1] = 1
    for i in range(t - 2, -1, -1):
        x = (emit[:, i + 1] * back[:, i + 1]) @ move.T
        back[:, i] = x / x.sum(axis=1, keepdims=True)
    both = ahead * back
    both /= both.sum(axis=2, keepdims=True)
    right = emit[:, 1:] * back[:, 1:]
    pair = ahead[:, :-1, :, None] * move * right[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return both, pair.sum(axis=(0, 1))


def mean_marginals(scores: np.ndarray, bounds: np.ndarray, first: np.ndarray, step: np.ndarray, segment: int = SEGMENT, best: np.ndarray | None = None) -> np.ndarray:
    """Summed marginals of each chain; chain i holds the words bounds[i] to bounds[i + 1] of ``scores``. ``best`` gets the likeliest label of each word."""
    n = scores.shape[1]
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), n))
    parts = -(-sizes // segment)
    if not parts.sum():
        return out
    chain = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = bounds[:-1][chain] + nth * segment
    length = np.minimum(segment, bounds[1:][chain] - begin)
    at = np.minimum(begin[:, None] + np.arange(segment), len(scores) - 1)
    used = np.arange(segment) < length[:, None]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))[at]
    move, start = np.exp(step - step.max()), np.exp(first - first.max())
    # A chain starts from ``start`` in place of a step: fold that into its first emission.
    heads = nth == 0
    even = np.full(n, 1.0 / n)
    emit[heads, 0] *= start / (even @ move)
    through = np.tile(np.eye(n), (len(chain), 1, 1))
    for i in range(segment):
        live = used[:, i]
        x = (through[live] @ move) * emit[live, i][:, None, :]
        through[live] = x / x.sum(axis=(1, 2), keepdims=True)
    entry, leave = np.empty((len(chain), n)), np.empty((len(chain), n))
    entry[heads] = even
    for k in range(1, int(parts.max())):
        now = np.flatnonzero(nth == k)
        x = np.einsum("bi,bij->bj", entry[now - 1], through[now - 1])
        entry[now] = x / x.sum(axis=1, keepdims=True)
    last = nth == parts[chain] - 1
    leave[last] = 1.0
    for k in range(int(parts.max()) - 2, -1, -1):
        now = np.flatnonzero((nth == k) & ~last)
        x = np.einsum("bij,bj->bi", through[now + 1], leave[now + 1])
        leave[now] = x / x.sum(axis=1, keepdims=True)
    ahead = np.empty((segment, len(chain), n))
    state = entry
    for i in range(segment):
        x = (state @ move) * emit[:, i]
        state = np.where(used[:, i, None], x / x.sum(axis=1, keepdims=True), state)
        ahead[i] = state
    total, state = np.zeros((len(chain), n)), leave
    for i in range(segment - 1, -1, -1):
        both = ahead[i] * state
        if best is not None:
            best[begin[used[:, i]] + i] = both[used[:, i]].argmax(axis=1)
        total += np.where(used[:, i, None], both / both.sum(axis=1, keepdims=True), 0)
        x = (emit[:, i] * state) @ move.T
        state = np.where(used[:, i, None], x / x.sum(axis=1, keepdims=True), state)
    np.add.at(out, chain, total)
    return out


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def train(rows: list[tuple[str | None, str]], epochs: int = 3, batch: int = 64, seed: int = 5) -> Crf | None:
    """Fit by stochastic gradients (Adagrad) on strings of three pieces of ``PIECE`` words."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    n, code = len(langs), {lang: i for i, lang in enumerate(langs)}
    counts: dict[str, Counter] = {}
    pieces: list[tuple[list[str], int]] = []
    for text, lang in rows:
        own = words_of(text)
        for w in own:
            counts.setdefault(w, Counter())[code[lang]] += 1
        pieces += [(own[i : i + PIECE], code[lang]) for i in range(0, len(own) - PIECE + 1, PIECE)]
        if own and len(own) < PIECE:
            pieces.append(((own * PIECE)[:PIECE], code[lang]))
    lexicon = {w: c.most_common(1)[0][0] for w, c in counts.items() if c.total() >= 5 and c.most_common(1)[0][1] >= 0.8 * c.total()}
    model = Crf(langs, np.zeros((BUCKETS, n)), np.zeros((n + 1, n)), np.zeros((n, n)), np.zeros(n), lexicon)
    number = {w: i for i, w in enumerate(counts)}
    words = list(counts)
    owner, bucket = hashed_grams(words)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    edge = np.searchsorted(owner, np.arange(len(words) + 1))
    listed = np.array([lexicon.get(w, n) for w in words])
    coded = [np.array([number[w] for w in own]) for own, _ in pieces]
    sums = [np.full(x.shape, 1e-6) for x in (model.grams, model.lists, model.step, model.first)]
    rng = np.random.default_rng(seed)

    def update(param: np.ndarray, total: np.ndarray, grad: np.ndarray, rate: float = 0.2) -> None:
        total += grad * grad
        param += rate * grad / np.sqrt(total)

    for _ in range(epochs if len(pieces) >= 3 else 0):
        mixed = rng.permutation(len(pieces))[: len(pieces) // 3 * 3].reshape(-1, 3)
        for at in range(0, len(mixed), batch):
            group = mixed[at : at + batch]
            seq = np.stack([np.concatenate([coded[p] for p in row]) for row in group])
            gold = np.stack([np.repeat([pieces[p][1] for p in row], PIECE) for row in group])
            used, inverse = np.unique(seq, return_inverse=True)
            inverse = inverse.reshape(seq.shape)
            take = np.concatenate([np.arange(edge[u], edge[u + 1]) for u in used])
            local = np.repeat(np.arange(len(used)), edge[used + 1] - edge[used])
            emit = np.stack([np.bincount(local, model.grams[bucket[take], j], len(used)) for j in range(n)], axis=1) + model.lists[listed[used]]
            both, pair = chain_marginals(emit[inverse], model.first, model.step)
            gap = np.eye(n)[gold] - both
            on_word = np.stack([np.bincount(inverse.ravel(), gap[:, :, j].ravel(), len(used)) for j in range(n)], axis=1) / len(group)
            touched, back = np.unique(bucket[take], return_inverse=True)
            grad = np.stack([np.bincount(back, on_word[local, j], len(touched)) for j in range(n)], axis=1)
            sums[0][touched] += grad * grad
            model.grams[touched] += 0.2 * grad / np.sqrt(sums[0][touched])
            on_list = np.zeros_like(model.lists)
            np.add.at(on_list, listed[used], on_word)
            update(model.lists, sums[1], on_list)
            real = np.zeros((n, n))
            np.add.at(real, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            update(model.step, sums[2], (real - pair) / len(group))
            update(model.first, sums[3], (np.eye(n)[gold[:, 0]] - both[:, 0]).mean(axis=0))
    return model


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def fit(docs: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """Train on a bounded sample of the labelled rows outside the held-out third."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    keys = rows.select("doc_id", "lang", F.xxhash64("text").alias("key")).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "key"))
    picked = keys.withColumn("nth", nth).where(F.col("nth") <= sample).drop("nth")
    met = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "lang", "key"]).dropDuplicates(["doc_id", "lang", "key"])
    return train([(r["text"], r["lang"]) for r in met.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "key").toLocalIterator()])


def _label(shared, words: bool = False, most_words: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Crf | None = shared.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.langs) if model else 1))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [words_of(t) for t in part.column("text").to_pylist()]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                by_word: list[list[str]] = [[] for _ in texts]
                if model:
                    fresh = [w for w in set().union(*texts).difference(known) if any(c.isalpha() for c in w)]
                    if len(known) + len(fresh) > most_words:
                        known, table = {}, table[:0]
                        fresh = [w for w in set().union(*texts) if any(c.isalpha() for c in w)]
                    if fresh:
                        known.update(zip(fresh, range(len(table), len(table) + len(fresh)), strict=True))
                        table = np.concatenate([table, model.emissions(fresh)])
                    rows = [[i for w in own if (i := known.get(w, -1)) >= 0] for own in texts]
                    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                    flat = np.array([i for r in rows for i in r], np.int64)
                    if len(flat):
                        best_of = np.zeros(len(flat), np.int64) if words else None
                        share = mean_marginals(table[flat], bounds, model.first, model.step, best=best_of)
                        for i in np.flatnonzero(np.diff(bounds)):
                            best = int(share[i].argmax())
                            langs[i] = model.langs[best]
                            scores[i] = float(min(1.0, share[i, best] / (bounds[i + 1] - bounds[i])))
                            if words:
                                by_word[i] = [model.langs[x] for x in best_of[bounds[i] : bounds[i + 1]]]
                added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *([pa.array(by_word, pa.list_(pa.string()))] if words else ())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *ADDED[: len(added)]])

    return run


def label(docs: DataFrame, model: Crf | None, words: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replacing columns so named), and with ``words`` the language of each word of ``words_of`` as ``word_langs``."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("word_langs", T.ArrayType(T.StringType()))][: 3 if words else 2]
    docs = docs.drop(*(c for c in docs.columns if c in [f.name for f in added]))
    return docs.mapInArrow(_label(docs.sparkSession.sparkContext.broadcast(model), words), T.StructType([*docs.schema.fields, *added]))
