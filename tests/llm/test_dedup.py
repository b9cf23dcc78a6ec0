"""Near-duplicate classes and repeated spans against brute force."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from gaugeflow.llm import near_dedup, substrings
from gaugeflow.llm.graph import components
from gaugeflow.llm.shared import BLANK, Texts, word_hashes, word_spans

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, base, share):
    words = base.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = rng.choice(WORDS)
    return " ".join(words)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment_equals_plain_distance():
    rng = random.Random(1)
    for i in range(800):
        letters, size = ("abc", 14) if i % 2 else ("abcdefghij", 60)
        a = [rng.choice(letters).encode() for _ in range(rng.randrange(0, size))]
        b = [rng.choice(letters).encode() for _ in range(rng.randrange(0, size))]
        if i % 3:
            b = [w for w in a if rng.random() < 0.9]
        d, most = plain_distance(a, b), rng.randrange(0, size)
        want = d if d <= most else None
        assert near_dedup.edit_distance_within(*near_dedup.numbered(a, b), most) == want
        if a and b and abs(len(a) - len(b)) <= most:
            assert near_dedup._by_reach(*near_dedup.numbered(a, b), most) == want
        if a and b:
            assert near_dedup.similar(*near_dedup.numbered(a, b)) == (d <= near_dedup.limit_of(max(len(a), len(b)), 0.8))


@pytest.mark.parametrize("vocabulary", [50, 400, 100_000])
def test_unlike_long_texts_are_told_apart_soon(vocabulary):
    rng = np.random.default_rng(3)
    passage = rng.integers(0, vocabulary, 2_000)
    a, b = (np.concatenate([passage, rng.integers(0, vocabulary, 98_000)]) for _ in range(2))
    began = time.perf_counter()
    assert not near_dedup.similar(a, b)
    assert near_dedup.similar(a, np.delete(a, np.arange(0, 100_000, 150)))
    assert time.perf_counter() - began < 20


def test_parity_bounds_the_differences():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 60, rng.integers(1, 300)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), len(a) // 5)) if len(a) > 1 and rng.random() < 0.5 else rng.integers(0, 60, rng.integers(1, 300)).astype(np.uint64)
        apart = np.abs(np.bincount(a.astype(int), minlength=60) - np.bincount(b.astype(int), minlength=60)).sum()
        one, two = near_dedup.parity_of(a), near_dedup.parity_of(b)
        longs = min(len(one), len(two))
        assert np.bitwise_count((near_dedup.folded(one, longs) ^ near_dedup.folded(two, longs)).view(np.uint64)).sum() <= apart


def test_sketch_follows_order():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2**63, 300).astype(np.uint64)
    same = near_dedup.sketch_text(words)
    assert (same == near_dedup.sketch_text(words.copy())).all() and len(same) == near_dedup.SKETCHES
    moved = near_dedup.sketch_text(np.concatenate([words[150:], words[:150]]))
    assert (moved == same).mean() < 0.8  # same k-mers, other order
    assert len(near_dedup.sketch_text(words[:2])) == near_dedup.SKETCHES


def sketched(t, **options):
    texts = Texts(pa.array([t]))
    starts, ends, _ = word_spans(texts, BLANK)
    return near_dedup.sketches_of(word_hashes(texts.data, starts, ends), **options).tolist()


def class_map(frame):
    return sorted((r["doc_id"], r["class_id"]) for r in frame.select("doc_id", "class_id").collect())


def test_classes(spark, docs):
    rng = random.Random(2)
    base, other = text(rng, 200), text(rng, 150)
    rows = [(10, base), (11, base), (12, edited(rng, base, 0.03)), (13, edited(rng, base, 0.05)), (20, other), (21, edited(rng, other, 0.04)), (30, text(rng, 180)), (40, "x"), (41, "x"), (42, "y"), (50, None), (51, ""), (52, " \n"), (60, text(rng, 3000))]
    got = dict(class_map(near_dedup.classes(docs(rows, class_id=5))))
    assert got == {10: 10, 11: 10, 12: 10, 13: 10, 20: 20, 21: 20, 30: 30, 40: 40, 41: 40, 42: 42, 50: 50, 51: 51, 52: 52, 60: 60}
    kept = near_dedup.keep_one(docs(rows, key_a="mine"))
    assert kept.columns == [*docs([]).columns, "key_a"] and sorted(r["doc_id"] for r in kept.collect()) == [10, 20, 30, 40, 42, 50, 51, 52, 60]


def test_classes_of_repeated_rows_and_null_ids(spark, docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u v")]
    got = near_dedup.classes(docs(rows)).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in got) == [(-1, -1), (1, 1), (1, 1), (2, 2)]
    assert sorted((r["doc_id"] or -1) for r in near_dedup.keep_one(docs(rows)).collect()) == [-1, 1, 2]
    assert near_dedup.classes(docs([])).count() == 0


def test_planted_pairs_are_found(spark, docs):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        base = text(rng, rng.randrange(40, 300))
        rows += [(2 * i, base), (2 * i + 1, edited(rng, base, 0.02))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    assert dict(class_map(near_dedup.classes(docs(rows)))) == want


def test_pairs_that_share_a_sketch_are_found(spark, docs):
    """All of them, and they are nearly all pairs up to the stated similarity."""
    rng = random.Random(8)
    rows, want, met = [], {}, {}
    for share, least in ((0.02, 60), (0.05, 60), (0.1, 60), (0.15, 58), (0.2, 54)):
        for i in range(60):
            base = text(rng, rng.randrange(5, 45) if i % 2 else rng.randrange(45, 300))
            pair = base, edited(rng, base, share)
            meets = bool({*sketched(pair[0])} & {*sketched(pair[1])})
            met[share, least] = met.get((share, least), 0) + meets
            at = len(rows)
            rows += [(at, pair[0]), (at + 1, pair[1])]
            want |= {at: at, at + 1: at + 1 - meets}
    assert dict(class_map(near_dedup.classes(docs(rows)))) == want
    assert all(n >= least for (_, least), n in met.items())


def test_short_and_bordering_texts_meet(spark, docs):
    rng = random.Random(9)
    rows = [(1, "a b c d e f g"), (2, "a b c d e f x"), (3, "k l m n o"), (4, "k l z n o"), (5, "p q r s"), (6, "p q r t")]
    long = text(rng, near_dedup.SHORT).split()
    rows += [(7, " ".join(long)), (8, " ".join(w for i, w in enumerate(long) if i % 5 != 2 or i > 28))]
    got = dict(class_map(near_dedup.classes(docs(rows))))
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 7}


def test_members_meet_behind_an_unlike_leader(spark, docs):
    """Two similar texts whose only bucket is led by a text that has just a passage in common with them."""
    rng = random.Random(10)
    one = {"kept": 1, "sketches": 1}
    rows, want = [], {}
    while len(rows) < 30:
        passage, base = text(rng, 60), text(rng, 60)
        three = (passage + " " + text(rng, 60), passage + " " + base, passage + " " + edited(rng, base, 0.2))
        if sketched(three[0], **one) == sketched(three[1], **one) == sketched(three[2], **one):
            i = len(rows)
            rows += [(i + j, t) for j, t in enumerate(three)]
            want |= {i: i, i + 1: i + 1, i + 2: i + 1}
    assert dict(class_map(near_dedup.classes(docs(rows), **one))) == want


def all_pairs(rows):
    """Classes over all pairs of texts, by the plain distance."""
    label = {d: d for d, _ in rows}
    split = [(d, t.encode().split()) for d, t in rows]
    for i, (d, a) in enumerate(split):
        for e, b in split[:i]:
            longer = max(len(a), len(b))
            if longer and abs(len(a) - len(b)) <= 0.2 * longer and label[d] != label[e] and plain_distance(a, b) <= near_dedup.limit_of(longer, 0.8):
                low, high = sorted((label[d], label[e]))
                label = {x: low if y == high else y for x, y in label.items()}
    return label


def forms(rng, n, words, fresh, first):
    """Form letters: a template with ``fresh`` words of their own in one place."""
    template = text(rng, words - fresh).split()
    at = rng.randrange(len(template))
    return template, at, [(first + i, " ".join([*template[:at], *(f"f{first + i}x{j}" for j in range(fresh)), *template[at:]])) for i in range(n)]


@pytest.mark.parametrize("few", [256, 1])
def test_classes_equal_all_pairs(spark, docs, monkeypatch, few):
    """Random, templated and short texts, with edits around the limit of a link."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    rng = random.Random(11)
    rows = []
    for i in range(25):
        base = text(rng, rng.randrange(4, 90))
        rows += [(len(rows) + j, edited(rng, base, rng.choice([0, 0.05, 0.1, 0.15, 0.2, 0.25]))) for j in range(rng.randrange(1, 4))]
    for _ in range(3):
        rows += forms(rng, 15, 60, rng.choice([10, 13, 18]), len(rows))[2]
    rng.shuffle(rows)
    assert dict(class_map(near_dedup.classes(docs(rows)))) == all_pairs(rows)


def test_pairs_beside_form_letters(spark, docs):
    """Families of unlike form letters hide no pair that differs from their template by just the limit."""
    rng = random.Random(12)
    rows, want = [], {}
    for family in range(20):
        template, at, letters = forms(rng, 60, 250, 50, 60 * family)
        rows += letters
        want |= {d: d for d, _ in letters}
        one, two = template.copy(), template.copy()
        for words in (one, two):
            for start in (30, 130):
                words[start : start + 20] = text(rng, 20).split() if words is two else words[start : start + 20]
        rows += [(10_000 + 2 * family, " ".join(one)), (10_001 + 2 * family, " ".join(two))]
        want |= {10_000 + 2 * family: 10_000 + 2 * family, 10_001 + 2 * family: 10_000 + 2 * family}
    got = dict(class_map(near_dedup.classes(docs(rows))))
    assert [got[10_001 + 2 * i] == got[10_000 + 2 * i] for i in range(20)] == [True] * 20


def test_pairs_of_many_buckets_are_returned_once():
    """Whichever tasks judge the buckets, a pair comes from the first bucket it shares alone."""
    rng = random.Random(13)
    base = {n: text(rng, n) for n in (30, 46, 200)}
    texts = [edited(rng, base[n], 0.03) for n in base for _ in range(8)]
    found = (Texts(pa.array([t])) for t in texts)
    words = [word_hashes(t.data, *word_spans(t, BLANK)[:2]) for t in found]
    sketches = [near_dedup.sketches_of(w).tolist() for w in words]
    parity = [near_dedup.parity_of(w).tolist() for w in words]
    buckets = {}
    for i, own in enumerate(sketches):
        for value in own:
            buckets.setdefault(value, []).append(i)
    want = {(a, b) for met in buckets.values() for a in met for b in met if a < b}
    got = []
    for value, met in buckets.items():
        n_words = pa.array([len(words[i]) for i in met], pa.int32())
        rows = {"value": pa.array([value] * len(met)), "doc_id": pa.array(met), "label": pa.array(met), "n_words": n_words}
        rows |= {"parity": pa.array([parity[i] for i in met]), "sketch": pa.array([sketches[i] for i in met])}
        for out in near_dedup._judge(0.8)(iter([pa.RecordBatch.from_pydict(rows)])):
            got += zip(out.column("leader").to_pylist(), out.column("member").to_pylist(), strict=True)
    assert len(want) >= 80 and max(map(len, buckets.values())) > 2
    assert sorted(got) == sorted(want)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (100, 101, 102)} == {100}


def span_rows(seed):
    rng = random.Random(seed)
    shared = [text(rng, n) for n in (19, 20, 25, 60)]
    rows = [(i, "\t".join([text(rng, rng.randrange(0, 30)), rng.choice(shared), text(rng, rng.randrange(0, 30)), rng.choice(shared)])) for i in range(25)]
    rows += [(100, rows[3][1]), (101, "z " * 70), (102, "z " * 45), (103, None), (104, ""), (105, " \x0b "), (106, text(rng, 2000) + " " + shared[2]), (107, "é ü x " * 15)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block, share", [(4, 512, 256), (5, 16, 256), (6, 512, 3), (7, 16, 1)])
def test_repeated_spans(spark, docs, seed, block, share):
    """With a small ``share`` the frequent blocks have several copies."""
    rows = span_rows(seed)
    got = substrings.remove_repeats(docs(rows, n_words=3), block=block, share=share, copies=5)
    assert sorted(map(tuple, got.collect())) == sorted(substrings.brute_force(rows))


def test_repeated_spans_of_odd_rows(spark, docs):
    rng = random.Random(6)
    long = text(rng, 40)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_removed"]) for r in substrings.remove_repeats(docs([(None, long), (1, long), (1, long), (2, "a b")])).collect())
    assert got == [(-1, 0), (1, 40), (1, 40), (2, 0)]
    assert substrings.remove_repeats(docs([])).count() == 0


def test_words_decide_and_not_their_hashes(spark, docs):
    """Three words of long complementary Thue-Morse bytes at two places: no window repeats."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    base = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join([*base[:4], x, *base[5:9], y, *base[10:]])) for i, (x, y) in enumerate([(one, one), (one, two), (two, one)])]
    assert sorted(map(tuple, substrings.remove_repeats(docs(rows)).collect())) == sorted(substrings.brute_force(rows))


def test_windows_in_many_contexts(spark, docs):
    """Equal anchors in unlike contexts: what the blocks lack is decided among the windows left over."""
    rng = random.Random(13)
    line = " ".join(f"l{i}" for i in range(9))
    tails = [text(rng, 30) for _ in range(6)]
    rows = [(i, f"{text(rng, 25)} {line} {tails[i % 6]}") for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in (3, 4)]
    for gram in (8, 3):
        assert sorted(map(tuple, substrings.remove_repeats(docs(rows), gram=gram, block=16).collect())) == sorted(substrings.brute_force(rows))


def test_rows_without_or_with_one_id_cost_no_more(spark, docs):
    rng = random.Random(14)
    passage = text(rng, 25)
    texts = [f"{text(rng, i % 40)} {passage} {text(rng, 10)}" for i in range(250)]
    for doc_id in (None, 7):
        got = substrings.remove_repeats(docs([(doc_id, t) for t in texts])).collect()
        first = min(i % 40 for i in range(250))
        assert sum(r["n_removed"] > 0 for r in got) >= sum(i % 40 > first for i in range(250))


def test_suffix_automaton_matching():
    rng = random.Random(7)
    for _ in range(100):
        ref = [rng.choice("ab").encode() for _ in range(rng.randrange(1, 20))]
        ask = [rng.choice("abc").encode() for _ in range(rng.randrange(1, 20))]
        auto = substrings.SuffixAutomaton(ref)
        inside = lambda s: any(ref[i : i + len(s)] == s for i in range(len(ref) - len(s) + 1))
        for i, (n, state) in enumerate(auto.matching(ask)):
            want = max((k for k in range(i + 2) if inside(ask[i + 1 - k : i + 1])), default=0)
            assert n == want
            if n:
                assert auto.first_end(state, n) == next(e for e in range(n - 1, len(ref)) if ref[e - n + 1 : e + 1] == ask[i + 1 - n : i + 1])
