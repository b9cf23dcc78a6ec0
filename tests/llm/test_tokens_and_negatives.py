"""Token files, alignment of tokenizers, hard negatives."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import alignment, hard_negatives, token_files, tokens

NAN, INF = float("nan"), float("inf")

TEXTS = [
    None, "", " ", "  two  spaces ", "plain words and more plain words", "tab\tand\nline \n  break", "a b 　c", "don't 123 $$$ it's", "<|endoftext|> and <|endoftext|>x", "naïve façade Ünï", "日本語のテキスト",
    "▁ own mark ▁", "ab<s>c</s> <unk> <0x41>", "nul\x00 bell\x07", "x " * 400, "é" * 300, "q" * 5000, " lead", "trail ", "words and words and words", "🙂🙂 emoji ​ zero", "\x85next \x1cfs",
]


@pytest.fixture(scope="module")
def files():
    pytest.importorskip("public_tokenizers")
    from gaugeflow.llm.queries import tokenizer_path

    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = ["tree", "Stone", " ", "  ", "\n", "\t", "é", "ß", "12", "$", "'s", ".", "日", " ", "▁", "🙂", "<|endoftext|>", " a", " b"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_encoder_is_exact(files, seed):
    encoder = tokens.ByteBpe(files[0], table_bytes=20_000)
    texts = [t or "" for t in TEXTS] + random_texts(seed, 400)
    for _ in range(2):
        for text, ids in zip(texts, encoder([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    encoder([b"one two"])
    assert encoder.held < 500  # the table went as it was over its bound


def test_encoder_keeps_no_long_pieces(files):
    encoder = tokens.ByteBpe(files[0])
    began = time.perf_counter()
    encoder([b"ab" * 500_000, "日本".encode() * 100_000, b"x " + b"y" * 1000])
    assert encoder.held < 1000 and time.perf_counter() - began < 20


@pytest.mark.parametrize("seed", range(3))
def test_encoder_is_exact_around_cuts(files, seed):
    """Runs of the kinds of characters between which a text is cut, and of those that look alike."""
    encoder = tokens.ByteBpe(files[0], table_bytes=200_000)
    rng = random.Random(seed)
    parts = [
        "a", "Zo", "the", "é", "ÿ", "×", "÷", "ß", "ł", "日", "の", "7", "42", "²", "٣", ".", "!?", "#", "'", "'s", "'LL", "’", "—", "e\u0301", "🙂", "…",
        " ", " ", "  ", "\n", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u180e", "\u2003", "\u200b", "\u3000", "\0", "<|", "<|endoftext|>", "endoftext|>",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(8_000)]
    for at in range(0, len(texts), 2_000):
        part = texts[at : at + 2_000]
        for text, ids in zip(part, encoder([t.encode() for t in part]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_encoder_reuses_words_beside_marks_and_lines(files):
    """A word beside another mark, number or line end is no new word for the library."""
    encoder = tokens.ByteBpe(files[0])
    words = [a + b for a in ("tree", "Stone", "naïve", "été") for b in ("", "ing", "less", "ward", "é")]
    texts = [f"x {a}{mark}{b}, {a}{number}" for a in words for b in words for mark in (".\n", "\n", ",", '")') for number in (7, 20)]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.tokenizer = Counting(encoder.tokenizer)
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder([t.encode() for t in texts])] == want
    assert encoder.tokenizer.chars < 0.05 * sum(map(len, texts))


def test_encoder_forgets_rare_pieces_first(files):
    encoder = tokens.ByteBpe(files[0], table_bytes=100_000)
    often = " ".join(f"frequent{a}{b}" for a in "abcdefghij" for b in "klmnopqrst")
    encoder([often.encode()])
    encoder.tokenizer, rolled = Counting(encoder.tokenizer), 0
    for i in range(40):
        rare = " ".join(f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}{a}{b}" for a in "abcdefghij" for b in "klmnop")
        before, held = encoder.tokenizer.chars, encoder.held
        encoder([f"x {often} {rare}".encode()])
        rolled += encoder.held < held
        assert encoder.tokenizer.chars - before < 2 * len(rare)
    assert rolled > 3 and encoder.held < 150_000 and len(encoder.table) + len(encoder.older) < 1_000


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.sort(rng.choice(10 * n + 1, n, replace=False)).astype(np.int64) - 5 * n
    lengths = rng.integers(1, 9, n)
    index = token_files.KeyIndex.from_bytes(token_files.KeyIndex.build(keys, np.zeros(n, np.int64), lengths).to_bytes())
    assert sorted(index.hashed.slots(keys, np.zeros(n, np.int64)).tolist()) == list(range(n))
    found, offsets, own = index.find(keys, np.zeros(n, np.int64))
    assert found.all() and (offsets == np.cumsum(lengths) - lengths).all() and (own == lengths).all()
    other = np.arange(20 * n + 1, 30 * n + 5, dtype=np.int64)
    assert not index.find(other, np.zeros(len(other), np.int64))[0].any()
    assert not index.find(keys, np.ones(n, np.int64))[0].any()


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError, match="repeated"):
        token_files.PerfectHash.build(np.array([3, 3]), np.array([0, 0]))


def check_files(spark, rows, path, tokenizer, width):
    whole = tokens.load_byte_bpe(tokenizer)
    got = [tuple(r) for r in token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()]
    encoded = [(d, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t in rows]
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, len(i), zlib.crc32(i.tobytes())) for d, i in encoded)
    at = 0
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [d for d, *_ in sorted(got, key=lambda r: r[1])] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    manifest = token_files.read_manifest(path)
    assert manifest["ids"] == at and manifest["width"] == width and sum(s["docs"] for s in manifest["shards"]) == len(rows)
    return encoded


def test_token_files(spark, docs, files, tmp_path):
    rows = [(i * 7 - 30, t) for i, t in enumerate(TEXTS * 4)] + [(5, "same"), (5, "same"), (5, "other"), (None, "no id"), (None, None), (0, "zero")]
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(docs(rows, start="mine", ids=1, n_tokens=None).repartition(5), path, files[0])
    encoded = check_files(spark, rows, path, files[0], 2)
    want = defaultdict(list)
    for d, ids in encoded:
        want[d].append(ids.tolist())
    store = token_files.TokenStore(path)
    for d in {d for d, _ in rows} - {None}:
        assert sorted(x.tolist() for x in store.get(d)) == sorted(want[d])
    assert store.get(10**9) == [] and store.get(6) == []
    asked = spark.createDataFrame([(d,) for d in [5, 0, -30, 6, None, 5]], "doc_id long")
    found = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_files.lookup(asked, path).collect()]
    assert sorted(found) == sorted((d, ids) for d in (5, 0, -30) for ids in want[d])
    # writing again replaces the shards, also with other widths
    token_files.write_tokens(docs(rows[:9]), path, files[0], width=4)
    check_files(spark, rows[:9], path, files[0], 4)
    assert len(list((tmp_path / "t").glob("*.ids"))) == len(token_files.read_manifest(path)["shards"])


def test_token_files_of_many_copies_and_none(spark, docs, files, tmp_path):
    path = f"file://{tmp_path}/many"
    rows = [(None, "hot")] * 300 + [(4, "hot")] * 300 + [(i, "cold") for i in range(300)]
    token_files.write_tokens(docs(rows).repartition(4), path, files[0])
    check_files(spark, rows, path, files[0], 2)
    assert len(token_files.TokenStore(path).get(4)) == 301
    token_files.write_tokens(docs([]), f"{path}-none", files[0])
    assert token_files.read_tokens(spark, f"{path}-none").count() == 0 and token_files.TokenStore(f"{path}-none").get(1) == []


def test_lost_writes_leave_nothing(spark, docs, files, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(docs([(1, "kept")]), path, files[0])
    before = token_files.read_manifest(path)
    with pytest.raises(Exception, match="two bytes"):
        spark.createDataFrame([(2, np.array([1 << 20], "<u4").tobytes())], "doc_id long, ids binary").write.format("token_shards").option("width", 2).mode("overwrite").save(path)
    assert token_files.read_manifest(path) == before and token_files.read_tokens(spark, path).count() == 1


def plain_alignment(al, text):
    """Tokens, groups and links by two pointers over whole texts."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    of_a, of_b = [al.a_bytes[i] for i in a], [al.b_bytes[i] for i in b]
    if b"".join(of_a) != whole or b"".join(of_b) != whole:
        return None
    links, groups, i, j, end_a, end_b, own_a, own_b = [], [], 0, 0, len(of_a[0]), len(of_b[0]), [a[0]], [b[0]]
    while True:
        links.append((a[i], b[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a and step_b:
            groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
            own_a, own_b = [], []
        i, j = i + step_a, j + step_b
        if i == len(a):
            return a, b, groups, links
        if step_a:
            end_a += len(of_a[i])
            own_a.append(a[i])
        if step_b:
            end_b += len(of_b[j])
            own_b.append(b[j])


@pytest.mark.parametrize("seed, run_records", [(0, 50), (1, 700), (2, 10**6)])
def test_alignment(spark, docs, files, seed, run_records):
    rows = list(enumerate([*TEXTS, *random_texts(seed, 150)])) + [(0, "words and words"), (None, "words")]
    got = alignment.align(docs(rows, n_a="mine", run=1, docs=2).repartition(3), *files, run_records=run_records).collect()
    al = alignment.Aligner(*files)
    own = [(d, plain_alignment(al, t)) for d, t in rows]
    assert sum(v is None for _, v in own) > 3
    count = Counter(p for _, v in own if v for p in set(v[3]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = Counter()
    for d, v in own:
        want[(d, 0, 0, 0, 0, 0, 0, "") if v is None else (d, len(v[0]), len(v[1]), len(v[2]), len(v[3]), sum(count[p] == most[p[0]] for p in v[3]), sum(count[p] for p in v[3]), hashlib.sha256(";".join(v[2]).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    table = alignment.links_table(alignment.pair_counts(alignment.spill(docs(rows), *files, run_records=run_records))).collect()
    assert {(r["a_id"], r["b_id"]): (r["documents"], r["best"]) for r in table} == {p: (n, n == most[p[0]]) for p, n in count.items()} and len(table) == len(count)


def test_alignment_of_nothing_and_long_texts(spark, docs, files):
    assert alignment.align(docs([]), *files).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(docs([(1, None), (2, "")]), *files).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    al = alignment.Aligner(*files)
    began = time.perf_counter()
    (sizes, *_), *_ = al([b"ab1" * 300_000])
    assert sizes[0] > 0 and al.held == 0 and time.perf_counter() - began < 30


def test_merge_of_runs():
    rng = random.Random(3)
    want, runs = Counter(), []
    for _ in range(9):
        keys = sorted(rng.sample(range(200), rng.randrange(0, 120)))
        want.update({k: k % 5 + 1 for k in keys})
        cut = rng.randrange(1, 9)
        runs.append(iter([(np.array(keys[i : i + cut], np.uint64), np.array([k % 5 + 1 for k in keys[i : i + cut]])) for i in range(0, len(keys), cut)]))
    got = [(int(k), int(n)) for keys, counts in alignment.merged(runs) for k, n in zip(keys, counts, strict=True)]
    assert got == sorted(want.items())


def brute_negatives(rows, positives=5, negatives=3):
    """rows: (vec_id, label, cells); exact by Python integers."""
    out, anchors = Counter(), {}
    for v, l, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if v % 50 == 0:
            anchors.setdefault(v, (l, x))
    for a, (own, y) in anchors.items():
        scored = sorted((-sum(i * j for i, j in zip(x, y, strict=True)), v, l) for v, l, x in rows if v != a)
        for p, pid, _ in [s for s in scored if s[2] == own][:positives]:
            fit = [s for s in scored if s[2] != own and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            for rank, (n, v, _) in enumerate(fit, 1):
                out[(a, pid, rank, v, -p, -n)] += 1
    return out


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank string, block int")


@pytest.mark.parametrize("seed, block_rows, group", [(0, 16, 3), (1, 64, 100), (2, 7, 1)])
def test_hard_negatives(spark, seed, block_rows, group):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    x = np.concatenate([centres[i % 6] + 0.3 * rng.normal(size=12) for i in range(420)]).reshape(420, 12)
    x[200:260] = x[100]  # a large group of equal vectors
    rows = [(int(i), v.tolist(), int(i) % 4, "mine", 1) for i, v in enumerate(x)]
    rows += [(7, x[3].tolist(), 2, "", 0), (50, x[9].tolist(), 3, "", 0), (None, x[3].tolist(), 1, "", 0), (901, None, 1, "", 0), (902, [1.0, None] * 6, 1, "", 0), (903, [NAN] * 12, 1, "", 0), (904, [INF] * 12, 1, "", 0), (905, x[3].tolist(), None, "", 0), (906, [1.0], 1, "", 0), (907, [], 1, "", 0), (950, [0.0] * 12, 1, "", 0), (1000, (-x[3]).tolist(), 1, "", 0)]
    got = Counter(tuple(r) for r in hard_negatives.mine(embeddings(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, block_rows=block_rows, anchor_group=group).collect())
    usable = [(v, l, np.floor(256 * np.array(e)).astype(int).tolist()) for v, e, l, *_ in rows if v is not None and e and l is not None and len(e) == 12 and None not in e and np.isfinite(e).all()]
    assert got == brute_negatives(usable) and len(got) > 50


def test_hard_negatives_of_few_rows(spark):
    nothing = embeddings(spark, [])
    assert hard_negatives.mine(nothing, F.col("vec_id") % 50 == 0).count() == 0
    few = embeddings(spark, [(50, [1.0, 0.0], 1, "", 0), (1, [1.0, 0.0], 1, "", 0), (2, [0.8, 0.1], 2, "", 0), (3, [0.8, 0.1], 2, "", 0), (4, [0.2, 9.0], 2, "", 0)])
    got = [tuple(r) for r in hard_negatives.mine(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(50, 1, 1, 2, 65536, 52224), (50, 1, 2, 3, 65536, 52224)]
    assert hard_negatives.mine(few.where("vec_id <> 50"), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(few.where("vec_id <> 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_zone_bounds_and_blocks(spark):
    """Bounds hold for every row of a block; a clustered table leaves blocks unread."""
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.02 * rng.normal(size=(200, 8)) for c in 3 * rng.normal(size=(8, 8))])
    frame = embeddings(spark, [(i, v.tolist(), i % 3, "", 0) for i, v in enumerate(x)])
    rows = hard_negatives.usable(frame, F.col("label"), "embedding", 256)
    blocks = hard_negatives.layout(rows, F.col("vec_id") % 50 == 0, block_rows=32)
    got = blocks.collect()
    assert sum(len(r["ids"]) for r in got) == 1600
    cells = {i: np.floor(256 * v).astype(np.int64) for i, v in enumerate(x)}
    asked = np.array([cells[i] for i in range(0, 1600, 50)])
    unread = 0
    for r in got:
        low, high = hard_negatives.bounds(asked, np.array(r["low"]), np.array(r["high"]))
        own = asked @ np.array([cells[i] for i in r["ids"]]).T
        assert (own >= low[:, None]).all() and (own <= high[:, None]).all()
        unread += int((high < own.max() / 2).sum())
    assert unread > len(got)


def test_hilbert_neighbours():
    """Consecutive places on the curve are cells that touch, and every cell is met once."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        at = hard_negatives.hilbert(grid, bits)
        assert sorted(at.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()
