"""Sharding, packing, neighbours, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import ann, packing, sharding

ROWS = [(i * 3, "word " * (i % 50)) for i in range(500)] + [(5, None), (7, ""), (None, "x"), (8, "é" * 4000), (9, "same"), (9, "same")]


def test_sharding(spark, docs):
    got = sharding.shard(docs(ROWS, shard="mine"), 24).toPandas()
    assert len(got) == len(ROWS) and set(got.columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    sizes = got.groupby("shard")["size"].sum()
    target, largest = got["size"].sum() / 24, got["size"].max()
    assert len(sizes) == 24 and (sizes - target).abs().max() <= largest
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    ids = got[got.doc_id.notna()].groupby("shard")["doc_id"].agg(["min", "max"]).sort_index()
    assert (ids["max"].to_numpy()[:-1] <= ids["min"].to_numpy()[1:]).all()
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in ROWS)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"], strict=True)) == want
    assert sharding.shard(docs([]), 24).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from gaugeflow.llm.queries import tokenizer_path

    return tokenizer_path()


ODD = ["ﬁ ＡＢＣ x́y İstanbul ΣΑΣ it's 'sx a\x85b c　d", "<|endoftext|> 12ab³½", "̈ x", "don't $$$''' 've", "", "Ünï​code 日本語 x", "a\x1cb \x0b tab\tnl\n"]


def test_tokenizer_is_exact(tokenizer):
    words = packing.WordTokenizer(tokenizer, most_chunks=5, most_runs=3)
    for _ in range(2):
        for text, ids in zip(ODD, words([t.encode() for t in ODD]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_tokenizer_remembers_no_long_chunks(tokenizer):
    """Texts without blanks leave the tables as they are, with the same ids."""
    words = packing.WordTokenizer(tokenizer, most_chunks=1000, most_runs=1000)
    texts = ["日本語" * 400, "QUJD" * 300 + " tail", "x1" * 50_000, "short words"]
    for text, ids in zip(texts, words([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(map(len, words.chunks)) < 100 and len(words.runs) < 10


def check_packing(got, texts, encode, window):
    ids = {d: np.array([*encode(t or ""), 1], "<u4") for d, t in texts}
    assert (got.groupby("sequence_id")["length"].sum() <= window).all()
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    for doc_id, pieces in got.sort_values("start").groupby("doc_id"):
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[doc_id][at : at + p.length].tobytes()) and p.doc_tokens == len(ids[doc_id])
            at += p.length
        assert at == len(ids[doc_id])
    assert set(got["doc_id"]) == set(ids)


def test_packing(spark, docs, tokenizer):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["tree", "stone's", "x1", "Wort"]) for _ in range(rng.randrange(0, 90)))) for i in range(150)] + [(900, None), (901, ""), (902, "tree " * 3000), *((1000 + i, t) for i, t in enumerate(ODD))]
    whole = packing.WordTokenizer(tokenizer, 10, 10).tokenizer
    encode = lambda t: whole.encode(t, add_special_tokens=False).ids
    got = packing.pack(docs(texts, start="mine").coalesce(1), tokenizer, window=64).toPandas()
    check_packing(got, texts, encode, 64)
    fill = got.groupby("sequence_id")["length"].sum()
    assert (fill < 64).sum() <= 1
    assert packing.pack(docs([]), tokenizer).count() == 0
    twice = packing.pack(docs([(1, "a"), (1, "a")]), tokenizer).toPandas()
    assert len(twice) == 2 and twice["length"].tolist() == [2, 2]


def test_sum_of_squares_choice():
    """The level array's choice is the one that a plain search over all levels finds."""
    rng = random.Random(2)
    packer = packing.SumOfSquares(16)
    for i in range(300):
        size = rng.randrange(1, 16)
        n = packer.count.copy()
        best = None
        for level in range(0, 16 - size + 1):
            if level and not n[level]:
                continue
            after = n.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 16
            cost = int((after[1:16] ** 2).sum())
            if best is None or cost <= best[0]:
                best = (cost, level)
        assert packer._level(size) == best[1]
        packer.add(i, b"\0\0\0\0" * size)


def vectors(rng, n, dim=32):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 2] = x[n // 3]
    return x


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    x = vectors(rng, 1500)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(5)
    got = ann.nearest(frame, F.col("vec_id") % 10 == 0).toPandas().sort_values(["query_id", "rank"])
    want = ann.brute_force(np.arange(1500), x.astype(float), np.arange(1500) % 10 == 0)
    mine = got.groupby("query_id")["vec_id"].apply(list)
    assert np.mean([len(set(mine[q]) & set(v)) / 5 for q, v in want.items()]) >= 0.9
    assert (got.groupby("query_id")["rank"].apply(list).apply(lambda r: r == [1, 2, 3, 4, 5])).all()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert np.allclose(got["score"], [unit[q] @ unit[v] for q, v in zip(got["query_id"], got["vec_id"], strict=True)])
    blocks = ann.nearest(frame, F.col("vec_id") % 10 == 0, query_block=37).toPandas().sort_values(["query_id", "rank"])
    assert blocks["vec_id"].tolist() == got["vec_id"].tolist()


def test_neighbours_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [3.0, 0.0], 1), (50, [0.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (9, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert ann.nearest(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(frame.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    rng = random.Random(4)
    word = lambda: rng.choice(["tree", "house", "river", "stone", "cloud", "grass", "moss", "leaf"]) + rng.choice(["", "s", "y", "ing"])
    clean = {i: " ".join(word() for _ in range(60)) for i in range(80)}
    toxic = {100 + i: " ".join([*(word() for _ in range(20)), "moron", "scumbag"]) for i in range(40)}
    near = {200 + i: clean[i] + " tail" for i in range(10)}
    item = " ".join(f"item{i}" for i in range(12))
    leaked = {300: clean[11].replace(" ", "  ", 1)[::-1] + " " + item, 301: item}
    private = {400: " ".join(word() for _ in range(50)) + " write to ann7@mail.example.com"}
    rows = [(d, t, "en", "s", len(t)) for part in (clean, toxic, near, leaked, private) for d, t in part.items()] + [(500, None, None, None, None), (501, "", None, None, 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in [*clean, *toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame = spark.read.parquet(f"{d}/documents.parquet")
    seen = [set(r["doc_id"] for r in frame.collect())]
    for name, stage in pipeline.STAGES[:-1]:
        frame = pipeline.cut(stage(spark, frame, d))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r["doc_id"] for r in frame.collect()})
    assert seen[0] - seen[1] == set(toxic) and seen[1] - seen[2] == set(near) and seen[2] - seen[3] == {301} and seen[3] == seen[4]
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert "item3" not in texts[300] and "ann7@mail" not in texts[400] and all(texts[i] == clean[i] for i in clean)
    packed = pipeline.run(spark, d).toPandas()
    assert set(packed["doc_id"]) == seen[4]
