"""Toxicity by a weighted lexicon that is learned from labelled rows.

Texts are folded (case, accents, homoglyphs, digits and signs standing for
letters), then one Aho-Corasick pass finds the lexicon entries: whole words and
word beginnings with log-odds weights. Hits inside exception phrases don't count.
The weights are normalised by length and a logistic curve turns them into a score.

Fitting uses at most ``sample`` labelled rows, taken by the order of a hash of
doc_id over all labelled rows; scoring covers every row and whole texts.

Defined results: null and empty texts have no hits and get the score of a text
without hits; repeated rows score alike; without labelled rows of both kinds the
lexicon is empty and the score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, slices

SAMPLE, LEAST_DOCS, LEAST_G2, THRESHOLD = 12_000, 5, 40.0, 0.3
BEGINNINGS = range(4, 9)
ADDED = ("weight", "n_hits", "n_words", "score")

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("авсеԁһіјкӏмнорԛѕтухузбг" + "αβεηικμνορτυχγ", "abcedhijklmhopqstyxyzbr" + "abenikmvoptuxy", strict=False)) | {"х": "x", "у": "y", "п": "n", "и": "u", "ѵ": "v", "ѡ": "w", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o"}
#: Digits and signs that stand for letters inside words.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"})
# Tried at the start of each run without white space only, so a text costs its length.
_MIXED = re.compile(r"(?<!\S)\S*?(?:[^\W\d_][0-9]|[0-9@$!][^\W\d_])\S*")
_GAPS = re.compile(r"[\W_]+")


class _Fold(dict):
    """Character table filled on demand: lower case, no marks, Latin shape."""

    def __missing__(self, code: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c)).lower()
        self[code] = out = "".join(LOOKALIKES.get(c, c) for c in plain)
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words, each with one space before and after."""
    plain = (text or "").translate(_FOLD)
    plain = _MIXED.sub(lambda m: m.group().translate(STAND_INS), plain)
    return " " + _GAPS.sub(" ", plain).strip() + " "


def entries_of(folded: str) -> set[str]:
    """Candidate lexicon entries of a text: `` word `` for whole words, `` begin`` for beginnings."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for phrase in self.exceptions:
            auto.add_word(f" {phrase} ", (f" {phrase} ", None))
        for entry, weight in self.weights.items():
            auto.add_word(entry, (entry, weight))
        if len(auto):
            auto.make_automaton()
        return auto


def weigh(auto, folded: str) -> tuple[float, int, int]:
    """Summed weight of the longest entry at each word, hits, and words."""
    words = folded.count(" ") - 1 if len(folded) > 2 else 0
    if not len(auto) or not words:
        return 0.0, 0, words
    best: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    for end, (entry, weight) in auto.iter(folded):
        start = end - len(entry) + 1
        if weight is None:
            free.append((start, end))
        elif len(entry) > best.get(start, (0, 0.0))[0]:
            best[start] = (len(entry), weight)
    # A hit counts unless an exception that begins at or before it ends after it.
    hits, reach, nth = [], -1, 0
    free.sort()
    for at, (_, weight) in sorted(best.items()):
        while nth < len(free) and free[nth][0] <= at:
            reach = max(reach, free[nth][1])
            nth += 1
        if at >= reach:
            hits.append(weight)
    return sum(hits), len(hits), words


def features(total: float, hits: int, words: int) -> tuple[float, float, float]:
    return math.log1p(total), math.log1p(1000 * total / (words + 50)), float(hits > 0)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps; intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id="doc_id", parts: int = 4, part: int = 2):
    return F.crc32(F.col(doc_id).cast("string")) % parts == part


def _count_entries(known=None):
    """The distinct entries of each text, or those that are ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 200_000):
                found: list[str] = []
                for text in part.column("text").to_pylist():
                    entries = entries_of(fold(text))
                    found.extend(entries if known is None else entries & known.value)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["entry"])

    return run


def _hit_phrases(lexicon):
    """Each hit with the word before or after it, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.value.automaton()
        for batch in batches:
            phrases, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded, seen = fold(text), set()
                for end, (entry, _) in auto.iter(folded) if len(auto) else ():
                    start = end - len(entry) + 2
                    word_end = folded.index(" ", start)
                    before = folded.rfind(" ", 0, start - 1) + 1
                    after = folded.find(" ", word_end + 1)
                    seen.update(p for p in (folded[before:word_end] if start > 1 else "", folded[start:after] if after > 0 else "") if " " in p)
                phrases += sorted(seen)
                toxic += [label] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int32())], names=["phrase", "toxic"])

    return run


def _weigh_rows(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, curve = lexicon.value.automaton(), np.array(lexicon.value.curve)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [weigh(auto, fold(text)) for text in part.column("text").to_pylist()]
                x = np.array([(1.0, *features(*f)) for f in found]).reshape(-1, 4)
                score = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
                figures = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *figures, pa.array(score)], names=[*part.schema.names, *ADDED])

    return run


def g_squared(a: int, b: int, pos: int, neg: int) -> float:
    """Likelihood ratio of an entry in ``a`` of ``pos`` toxic and ``b`` of ``neg`` clean rows."""
    p = (a + b) / (pos + neg)
    return 2 * sum(k * math.log(k / m) for k, m in ((a, pos * p), (b, neg * p), (pos - a, pos * (1 - p)), (neg - b, neg * (1 - p))) if k > 0 and m > 0)


def select_entries(counts: dict[str, tuple[int, int]], pos: int, neg: int, least_g2: float = LEAST_G2) -> dict[str, float]:
    """Entries by falling significance, none the beginning of another; weight by log-odds."""
    ranked = sorted(((g_squared(a, b, pos, neg), len(e), e) for e, (a, b) in counts.items() if a * neg > b * pos), reverse=True)
    taken: dict[str, float] = {}
    blocked: set[str] = set()
    for g2, _, entry in ranked:
        if g2 < least_g2:
            break
        stem = entry.strip()
        starts = {stem[:n] for n in range(3, len(stem) + 1)}
        if stem in blocked or any(f" {s}" in taken for s in starts):
            continue
        a, b = counts[entry]
        taken[entry] = max(0.1, math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1)))
        blocked |= starts
    return taken


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_docs: int = LEAST_DOCS) -> Lexicon:
    """Learn the lexicon from labelled rows outside the held-out quarter."""
    spark = docs.sparkSession
    marked = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # One text of each id, so that no repetition of ids exceeds the sample.
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = cut(met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        share = pos / max(1, pos + neg)
        return Lexicon(curve=(math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0, 0.0))
    # At most as many entries as the bounded sample has words, fewer by ``least_docs``.
    toxic = rows.where("toxic = 1").mapInArrow(_count_entries(), "entry string").groupBy("entry").count().where(F.col("count") >= least_docs)
    in_toxic = {r["entry"]: r["count"] for r in toxic.collect()}
    known = spark.sparkContext.broadcast(frozenset(in_toxic))
    clean = rows.where("toxic = 0").mapInArrow(_count_entries(known), "entry string").groupBy("entry").count()
    in_clean = {r["entry"]: r["count"] for r in clean.collect()}
    lexicon = Lexicon(weights=select_entries({e: (n, in_clean.get(e, 0)) for e, n in in_toxic.items()}, pos, neg))
    phrases = rows.mapInArrow(_hit_phrases(spark.sparkContext.broadcast(lexicon)), "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where("n - a >= 3")
    # An exception is a phrase met in clean rows at least as often as chance would have it.
    lexicon.exceptions = tuple(sorted(r["phrase"] for r in phrases.collect() if r["a"] * neg < (r["n"] - r["a"]) * pos))
    weighed = rows.mapInArrow(_weigh_rows(spark.sparkContext.broadcast(lexicon)), T.StructType([*rows.schema.fields, T.StructField("weight", T.DoubleType()), T.StructField("n_hits", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())]))
    got = weighed.select("weight", "n_hits", "n_words", "toxic").toPandas()
    x = np.array([features(*r) for r in got[["weight", "n_hits", "n_words"]].itertuples(index=False, name=None)])
    lexicon.curve = fit_curve(x, got["toxic"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, column: str = "text") -> DataFrame:
    """``docs`` with ``weight``, ``n_hits``, ``n_words`` and ``score`` (replacing columns so named)."""
    docs = docs.drop(*(c for c in docs.columns if c in ADDED))
    if column != "text":
        docs = docs.withColumnRenamed("text", "_text").withColumnRenamed(column, "text") if "text" in docs.columns else docs.withColumnRenamed(column, "text")
    schema = T.StructType([*docs.schema.fields, T.StructField("weight", T.DoubleType()), T.StructField("n_hits", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])
    out = docs.mapInArrow(_weigh_rows(docs.sparkSession.sparkContext.broadcast(lexicon)), schema)
    if column != "text":
        out = out.withColumnRenamed("text", column).withColumnRenamed("_text", "text")
    return out
