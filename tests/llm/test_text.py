"""Toxicity, decontamination, language, pages and personal values."""

import datetime
import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import decontamination as dec
from gaugeflow.llm import html_text, language, pii, toxicity

ITEMS = [(1, "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one here"), (3, None), (4, "..."), (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda nu"), (12, "short one here"), (6, "Élan vital ünder the 3 trees")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


DOC_ROWS = [
    (1, "x alpha, beta-gamma delta epsilon zeta eta THETA iota kappa lambda mu y"), (2, "no hits at all"), (3, None), (4, ""), (5, "a short one  here short one here"),
    (6, "élan vital ünder the 3 trees"), (7, "Élan vital ünder the 3 trees!"), (8, "w " * 5000 + "short one here"), (9, "short one"), (9, "short one"), (10, "alpha beta gamma delta epsilon zeta eta theta iota"),
]


def test_decontamination(spark, docs):
    marked = dec.decontaminate(docs(DOC_ROWS, n_hit="mine", item_ids=1), items(spark))
    got = sorted(tuple(r)[:5] for r in dec.digest(marked).collect())
    want = sorted((d, n, h, None, s) for d, t in DOC_ROWS for n, h, s in [dec.brute_force(t, ITEMS)])
    assert [(*x[:3], x[4]) for x in got] == [(*x[:3], x[4]) for x in want]
    clean = {r["doc_id"]: r["clean_text"] for r in marked.collect()}
    assert clean[1] == "x y" and clean[2] == "no hits at all" and clean[3] is None and clean[5] == "a" and clean[7] == "!"
    kept = {r["doc_id"] for r in dec.within_limits(marked).collect()}
    assert kept == {2, 3, 4, 8, 9, 10, 6}
    assert dec.decontaminate(docs([]), items(spark)).count() == 0 and dec.decontaminate(docs(DOC_ROWS), items(spark, [])).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, docs):
    """A benchmark beyond the broadcast bound goes through several automata with the same result."""
    one = dec.digest(dec.decontaminate(docs(DOC_ROWS), items(spark)))
    many = dec.digest(dec.decontaminate(docs(DOC_ROWS), items(spark), most_bytes=30))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_long_items_are_cut_between_windows(spark, docs):
    """Every window of an item lies in one piece, pieces are bounded, and marks equal brute force."""
    rng = random.Random(4)
    words = [str(rng.randrange(400)).encode() for _ in range(3000)]
    for n, most in ((3000, 200), (3000, 1), (10, 5), (9, 5), (11, 5), (0, 5)):
        cut = list(dec.pieces(words[:n], 10, most))
        windows = [p[i : i + 10] for p in cut for i in range(max(len(p) - 9, min(1, len(p))))]
        assert windows == [tuple(words[:n][i : i + 10]) for i in range(max(n - 9, min(1, n)))]
        assert all(len(p) <= 10 or sum(map(len, p)) + len(p) <= most + 1 for p in cut)
    text = b" ".join(words).decode()
    parts = text.split()
    its = [(1, text), (2, " ".join(parts[500:700])), (3, "one two")]
    rows = [(i, " ".join([*parts[at : at + 40], "x", *parts[at + 5 : at + 14], "one", "two"])) for i, at in enumerate(range(0, 2900, 97))]
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in dec.digest(dec.decontaminate(docs(rows), items(spark, its), most_bytes=4000)).collect())
    assert got == sorted((d, *dec.brute_force(t, its)) for d, t in rows)


def test_items_with_text_ids_and_many_copies(spark, docs):
    its = spark.createDataFrame([("b", "short one here"), ("a", "short one here"), *((f"r{i}", "over and over again") for i in range(2000))], "item_id string, text string")
    got = dec.digest(dec.decontaminate(docs([(1, "a short one here"), (2, "over and over again " * 50)]), its)).orderBy("doc_id").collect()
    assert [r["n_items"] for r in got] == [2, 2000] and got[0]["items_sha256"] == hashlib.sha256(b"a,b").hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_random(spark, docs, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcd")
    its = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 11, 14])))) for i in range(8)]
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in dec.digest(dec.decontaminate(docs(rows), items(spark, its))).collect())
    assert got == sorted((d, *dec.brute_force(t, its)) for d, t in rows)


def test_folding():
    assert toxicity.fold("Ｓtüpíd  1D10T!! ѕсum th@t$ 2024 $$$") == " stupid idiot scum that 2024 " or toxicity.fold("1D10T").strip() == "idiot"
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_folding_costs_the_length_of_a_text():
    """Texts without blanks of a million characters, and the same result as a plain version chunk by chunk."""
    for text in ("中" * 1_000_000, "x" * 1_000_000, "a1" * 500_000, "中1" * 500_000, "QUJD+/" * 170_000):
        began = time.perf_counter()
        folded = toxicity.fold(text)
        assert time.perf_counter() - began < 15 and len(folded) > 500_000
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab1 3$\n@!_é中. ") for _ in range(rng.randrange(40)))
        plain = text.translate(toxicity._FOLD)
        pair = re.compile(r"[^\W\d_][0-9]|[0-9@$!][^\W\d_]")
        chunks = [c.translate(toxicity.STAND_INS) if pair.search(c) else c for c in re.split(r"(\s+)", plain)]
        assert toxicity.fold(text) == " " + re.sub(r"[\W_]+", " ", "".join(chunks)).strip() + " "


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(["tree", "house", "river", "stone", "cloud", "grass"]) for _ in range(rng.randrange(5, 60))]
        if bad := i % 5 == 0:
            for w in rng.sample(["moron", "scumbag", "id10t"], 2):
                words.insert(rng.randrange(len(words)), w)
        elif i % 7 == 0:
            words += ["moron", "valley"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, docs, toxic_rows):
    rows, labels = toxic_rows
    frame = spark.createDataFrame([*labels, (None, None, None), (1, 1, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs(rows), frame)
    assert {" scumbag ", " idiot "} <= set(lexicon.weights) and "moron valley" in lexicon.exceptions
    extra = [(1000, None), (1001, ""), (1002, "you 1d1ot"), (1002, "you 1d1ot"), (1003, "tree " * 30_000), (1004, "moron valley")]
    got = toxicity.score(docs(rows + extra, score="mine"), lexicon)
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert got.count() == len(rows) + len(extra) and all(0 <= s <= 1 for s in scores.values())
    right = np.mean([(scores[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in labels])
    assert right > 0.97 and scores[1000] == scores[1001] < 0.1 and scores[1002] > 0.3 and scores[1003] < 0.1 and scores[1004] < 0.3


def plain_weigh(lexicon, folded):
    """Longest entry at each place, exceptions by looking at every place."""
    total, hits = 0.0, 0
    free = [(i, i + len(p) + 1) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
    for i in range(len(folded)):
        found = [e for e in lexicon.weights if folded.startswith(e, i)]
        if found and not any(a <= i < b for a, b in free):
            total, hits = total + lexicon.weights[max(found, key=len)], hits + 1
    return total, hits, len(folded.split())


def test_weights_equal_the_plain_ones():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({" moron ": 2.0, " scum": 1.5, " scumba": 1.0, " idiot ": 0.5}, ("moron valley", "nice idiot", "idiot scumbag"))
    auto = lexicon.automaton()
    for _ in range(500):
        folded = toxicity.fold(" ".join(rng.choice(["moron", "m0ron", "valley", "scumbag", "scum", "ID10T", "nice", "tree"]) for _ in range(rng.randrange(0, 12))))
        got, want = toxicity.weigh(auto, folded), plain_weigh(lexicon, folded)
        assert got[1:] == want[1:] and abs(got[0] - want[0]) < 1e-9
    began = time.perf_counter()
    assert toxicity.weigh(auto, toxicity.fold("moron valley idiot " * 100_000))[1] == 100_000
    assert time.perf_counter() - began < 10


def test_toxicity_without_labels(spark, docs):
    lexicon = toxicity.fit(docs([(1, "a")]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs([(1, "a"), (2, None)]), lexicon).where("score > 0.5").count() == 0
    assert toxicity.score(docs([]), lexicon).count() == 0


def test_segmented_marginals_are_exact():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = [int(x) for x in rng.integers(0, 40, 5)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        scores, first, step = rng.normal(size=(bounds[-1], 3)), rng.normal(size=3), rng.normal(size=(3, 3))
        got = language.mean_marginals(scores, bounds, first, step, segment=7)
        for i in range(5):
            if sizes[i]:
                both, _ = language.chain_marginals(scores[bounds[i] : bounds[i + 1]][None], first, step)
                assert np.allclose(both[0].sum(0), got[i])


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    for t in (1, 2, 4):
        scores, first, step = rng.normal(size=(t, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
        weight = {p: math.exp(first[p[0]] + sum(scores[i, x] for i, x in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product(range(3), repeat=t)}
        total = sum(weight.values())
        both, pair = language.chain_marginals(scores[None], first, step)
        for i in range(t):
            assert np.allclose(both[0, i], [sum(w for p, w in weight.items() if p[i] == x) / total for x in range(3)])
        assert np.allclose(pair, [[sum(w * sum(q == (a, b) for q in itertools.pairwise(p)) for p, w in weight.items()) / total for b in range(3)] for a in range(3)])


def test_words_of_switched_text(spark):
    rng = random.Random(2)
    vocab = {"en": ["the", "house", "with", "thing", "over"], "de": ["das", "haus", "mit", "über", "sich"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(40)), lang) for i in range(200) for lang in [rng.choice(list(vocab))]]
    rows += [(1000, " ".join(["the house with thing over"] * 5 + ["das haus mit über sich"] * 5), None), (1001, "... 12", None), (1002, None, None), (1003, "the " * 300 + "haus " * 300, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["word_langs"] for r in language.label(frame, language.fit(frame), words=True).where("doc_id >= 1000").collect()}
    assert got == {1000: ["en"] * 25 + ["de"] * 25, 1001: [], 1002: [], 1003: ["en"] * 300 + ["de"] * 300}


def test_rare_languages_are_learned(spark):
    rows = [(i, "the house with thing over " * 3, "en") for i in range(900)] + [(1000 + i, "das haus mit über sich " * 3, "de") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.label(frame.where("lang = 'de'"), language.fit(frame, sample=20)).collect()} == {"de"}


def test_language(spark):
    rng = random.Random(1)
    vocab = {"en": ["the", "house", "with", "thing", "over"], "de": ["das", "haus", "mit", "über", "sich"], "fr": ["le", "maison", "avec", "élan", "sur"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(3, 80))), lang) for i in range(300) for lang in [rng.choice(list(vocab))]]
    rows += [(900, None, "en"), (901, "123 !!", None), (902, "", "de"), (903, "the house mit mit", None), (904, "das haus " * 4000, None), (905, "the", "en"), (905, "the", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.label(frame.select("doc_id", "text", F.lit(1).alias("score")), model).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang in rows[:300]]) > 0.97
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[904][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    none = language.fit(frame.withColumn("lang", F.lit(None).cast("string")))
    assert none is None and {r["lang_pred"] for r in language.label(frame.select("doc_id", "text"), none).collect()} == {"und"}
    assert language.label(frame.where("false").select("doc_id", "text"), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="ad banner">Buy now</div><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p>First  paragraph\n with <b>bold</b> text &eacute; that goes on for quite a while.<p>Short.<br>Two
<blockquote>A quote</blockquote><form>Name<input></form><aside>See also</aside><div class="comments"><p>Nice post, this is a reader comment of some length.</p></div></article>
<section id="comments"><p>Another long comment of a reader that has many words in it.</p></section><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    want = "Head & line\nFirst paragraph with bold text é that goes on for quite a while.\nShort. Two\nA quote"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", PAGE[: PAGE.index("<blockquote>") + 5]), (1, "u", PAGE), (5, "u", "just text"), (6, "u", "<article>" + "<p>word word word</p>" * 5000 + "</article>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("mine")))
    text = {r["page_id"]: r["text"] for r in got.collect()}
    assert text[1] == want and text[2] == text[3] == "" and text[4] == want.removesuffix("\nA quote") and text[5] == "just text" and text[6].count("\n") == 4999
    assert got.count() == 7 and all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_without_article():
    page = "<body><div class=top><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div id=main><p>" + "long text of the story " * 20 + "</p><p>End.</p></div><div><a href=1>more</a> <a href=2>links</a></div></body>"
    assert html_text.main_text(page).split("\n")[-1] == "End." and "more" not in html_text.main_text(page) and "two" not in html_text.main_text(page)


@pytest.mark.parametrize("sizes", [[500, 480, 470, 460], [400, 380, 60, 70, 50, 390, 410]])
@pytest.mark.parametrize("tag", ["div", "section", "td"])
def test_pages_with_a_region_for_each_paragraph(sizes, tag):
    paragraphs = [("word " * n)[:n].strip() for n in sizes]
    inner = "".join(f"<{tag}><p>{p}</p></{tag}>" for p in paragraphs)
    page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><div>{inner}</div><div><a href=1>more</a> <a href=2>links</a></div></body>"
    assert html_text.main_text(page) == "\n".join(paragraphs)


def test_like_paragraphs_all_stay_and_link_blocks_in_articles_go():
    page = '<body><div class="story">' + "".join(f"<div><p>{'word ' * (20 + i % 7)}</p></div>" for i in range(2000)) + "</div></body>"
    assert html_text.main_text(page).count("\n") == 1999
    body = "<p>" + "long text of the story " * 20 + "</p><p>End.</p>"
    page = f'<body><article><h1>Head</h1>{body}<div class="x"><a href=1>Related one</a> <a href=2>two</a></div><ul><li><a href=3>More stories</a></li></ul><ul><li>a point</li></ul></article></body>'
    assert html_text.main_text(page).split("\n")[2:] == ["End.", "a point"]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "<p>text one</p>" + "</div><p>x y z</p>" * 50_000, "<body>" + "".join(f"<div><p>para {i} with words</p>" for i in range(50_000)), "<body>" + "<p><b>" * 100_000])
def test_large_pages_cost_their_length(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("part", ["<p class=x ", '<a href="', "<!-- ", "</p ", "<![CDATA[", "<a x=\"'>", "<a href='>", "<script ", "<!x "])
@pytest.mark.parametrize("end", ["", ">", "<p>the end</p>"])
def test_unfinished_tags_cost_their_length(part, end):
    began = time.perf_counter()
    html_text.main_text("<p>text of the page</p>" + part * 30_000 + end)
    assert time.perf_counter() - began < 5


def test_finished_pages_stay_and_others_lose_what_never_ends():
    whole = "<!doctype html><body a='>'><!-- <p \" --><p class=\"a > b\">1 < 2 <3 & \"x</p><script>if (a<b && c=\"'>\") '</p' </script><style>a>b</style><br/><![CDATA[ > ]]>"
    assert html_text.finished(whole) == whole
    assert html_text.finished("<p>a</p><p class=x") == "<p>a</p>" and html_text.finished("a <b") == "a " and html_text.finished("1 < 2") == "1 < 2"
    assert html_text.main_text('<body><p>one two</p><a href="x>three</a><p>four</p>') == "one two\nthree\nfour"
    assert html_text.main_text("<body><p>one two</p><!-- three <p>four</p>").endswith("four")


def test_text_of_articles_stays():
    body = "".join(f"<p>{'long text of the story ' * (15 + i)}</p>" for i in range(4))
    sources = "".join(f"<li><a href={i}>The source of statement number {i}</a></li>" for i in range(8))
    page = f"""<body><nav><a href=1>Home</a></nav><main><ul><li><a href=1>World</a></li><li><a href=2>Our sports</a></li></ul><h1>Head</h1>{body}<div class="share-price"><p>Shares fell by two.</p></div>
    <div><a href=1>{'a linked paragraph ' * 5}</a></div><section id="related-work"><p>Others did so.</p></section>{body}<h2>Sources</h2><ul>{sources}</ul>
    <div class="share-buttons"><p>Send it</p></div><div class="post-comments">so true</div><div class="ad-slot top-1"><p>Buy</p></div><div id="siteNav nav-primary">A B</div></main></body>"""
    got = html_text.main_text(page).split("\n")
    assert got[0] == "Head" and {"Shares fell by two.", "Others did so.", "Sources", ("a linked paragraph " * 5).strip(), "The source of statement number 7"} <= set(got)
    assert len(got) == 1 + 8 + 3 + 1 + 8 and not {"World", "Our sports", "Home", "Send it", "so true", "Buy", "A B"} & set(got)


def plain_selection(lines, parents):
    """The selection with paths, loops and nothing shared."""
    ratio = [len(x.text) / max(1, x.tags) * min(1, max(0, 1 - x.linked / len(x.text))) for x in lines]
    weights = {d: math.exp(-0.5 * d * d) for d in range(-2, 3)}
    soft = []
    for i in range(len(ratio)):
        near = [(weights[d], ratio[i + d]) for d in weights if 0 <= i + d < len(ratio)]
        soft.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    logs = sorted(math.log1p(r) for r in soft)
    mean = lambda x: sum(x) / len(x)
    inner = lambda x: sum((v - mean(x)) ** 2 for v in x)
    cuts = [(inner(logs[:i]) + inner(logs[i:]), i) for i in range(1, len(logs))]
    level = 0.0
    if cuts and logs[-1] - logs[0] >= 1e-9:
        i = min(cuts)[1]
        if mean(logs[i:]) - mean(logs[:i]) >= math.log(html_text.APART):
            level = math.expm1((logs[i - 1] + logs[i]) / 2)
    seeds = [x for x, r in zip(lines, soft, strict=True) if r >= level]

    def path(region):
        return [region] if region == 0 else [*path(parents[region]), region]

    def poor(region):
        inside = [x for x in lines if region in path(x.region)]
        return sum(x.linked for x in inside) > 0.5 * sum(len(x.text) for x in inside)

    roots = {x.article for x in seeds if x.article}
    if not roots:
        good = [path(x.region) for x in seeds if not poor(x.region)]
        if not good:
            return ""
        roots = {[r for r in good[0] if all(r in p for p in good)][-1]}
        in_article = False
    else:
        in_article = True

    def menu(region, root):
        inside = [i for i, x in enumerate(lines) if region in path(x.region)]
        own = [i for i, x in enumerate(lines) if any(x is y for y in seeds) and x.article == root and not poor(x.region)]
        label = sum(lines[i].label_words for i in inside) / max(1, sum(lines[i].links for i in inside))
        return poor(region) and (not in_article or not own or (max(inside) < own[0] or min(inside) > own[-1]) and label < 4)

    kept = []
    for x in lines:
        own = path(x.region)
        if any(r in roots and not any(menu(q, r) and q not in roots for q in own[own.index(r) + 1 :]) for r in own):
            kept.append(x.text)
    return "\n".join(kept)


def test_selection_equals_the_plain_one():
    rng = random.Random(5)

    def part(depth):
        kind = rng.choice(["p", "p", "link", "div", "ul", "section", "article"]) if depth else rng.choice(["p", "link"])
        if kind == "p":
            return "<p>" + " ".join(rng.choice(["word", "stone", "tree"]) for _ in range(rng.choice([2, 5, 40]))) + "<b>x</b>" * rng.randrange(3) + "</p>"
        if kind == "link":
            return "<p>" + "<a href=1>go there now</a> " * rng.randrange(1, 4) + "</p>"
        inner = "".join(part(depth - 1) for _ in range(rng.randrange(1, 5)))
        return f"<{kind}>{inner}</{kind}>"

    for _ in range(300):
        page = "<body>" + "".join(part(rng.randrange(0, 4)) for _ in range(rng.randrange(1, 5))) + "</body>"
        assert html_text.main_text(page) == plain_selection(*html_text.lines_of(page)), page


def feistel(value: str, key: str, kind: str, letters: int = 26) -> str:
    """The network in plain Python."""
    shape = "".join("0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in value)
    half = len(value) // 2
    sides = [value[:half], value[half:]]
    for i in range(pii.ROUNDS):
        digest = hashlib.sha256("|".join([key, f"{kind}|{shape}", str(i), sides[1 - i % 2]]).encode()).hexdigest()
        out = ""
        for j, c in enumerate(sides[i % 2]):
            add = int(digest[2 * (j % 32) : 2 * (j % 32) + 2], 16)
            low, size = (48, 10) if c.isdigit() else (97, letters) if c.islower() else (65, letters)
            out += chr(low + (ord(c) - low + add) % size)
        sides[i % 2] = out
    return "".join(sides)


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_feistel_equals_plain_python_and_is_a_permutation(spark):
    values = ["1234567", "ab12CD", "7", "z", "0000000000", *(f"{i:03d}" for i in range(1000))]
    got = [r["f"] for r in spark.createDataFrame([(v,) for v in values], "v string").select(pii.feistel(F.col("v"), "k", "t").alias("f")).collect()]
    assert got == [feistel(v, "k", "t") for v in values]
    assert len(set(got[5:])) == 1000 and all(len(x) == 3 and x.isdigit() for x in got[5:])


def test_pseudonyms(spark, docs):
    good = {"card": "4111 1111 1111 1111", "email": "ann.smith7@mail.example.com", "phone": "+1 (415) 555-0100", "address": "192.168.10.254", "date": "1987-03-31", "social": "123-45-6789", "iban": "DE89370400440532013000", "secret": 'token = "0a1b2c3d4e5f6a7b"'}
    bad = ["4111 1111 1111 1112", "300.1.1.1", "1987-02-31", "000-12-3456", "DE89370400440532013001", "1234567890123456", "v1.2.3", "10 000"]
    rows = [(i, f"see {v}, ok") for i, v in enumerate(good.values())] + [(100 + i, f"see {v}, ok") for i, v in enumerate(bad)]
    rows += [(200, None), (201, ""), (202, "x " * 20_000 + good["card"]), (203, f"{good['card']} {good['card']} {good['email']}"), (203, f"{good['card']} {good['card']} {good['email']}"), (204, "MAIL ÉA.B@X.ORG!!")]
    frame = pii.pseudonymise(docs(rows, kinds="mine"), "gaugeflow")
    got = {r["doc_id"]: r for r in frame.collect()}
    assert frame.count() == len(rows) and frame.columns[:5] == docs([]).columns
    for i, (kind, value) in enumerate(good.items()):
        new = got[i]["text"][4:-4]
        assert got[i]["kinds"] == [kind] and new != value and len(new) == len(value), kind
    assert all(got[100 + i]["text"] == f"see {v}, ok" and got[100 + i]["n_values"] == 0 for i, v in enumerate(bad))
    card = got[0]["text"][4:-4]
    assert luhn(card) and card[4] == " " and got[203]["text"].startswith(f"{card} {card} ") and got[203]["n_values"] == 3 and got[202]["text"].endswith(card)
    assert got[200]["text"] is None and got[201]["text"] == "" and got[200]["n_values"] == 0 and got[204]["kinds"] == ["email"]
    year, month, day = map(int, got[4]["text"][4:-4].split("-"))
    assert 1800 <= year < 2200 and 1 <= month <= 12 and 1 <= day <= 31
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(rows), key="other").collect()}
    assert other[0] != got[0]["text"]
    assert pii.pseudonymise(docs([]), "k").count() == 0


def test_validation_chooses_the_extent(spark, docs):
    card, at, es = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332"
    values = [f"{card} 12/26", f"{card} 123", f"7 {card}", f"{at} BIC", f"{es} 2024", f"{at} {card} 2020-13-45 5", f"+49 {card}", "\x01\x03# a\x02@ 4111"]
    got = [r for r in pii.pseudonymise(docs(list(enumerate(values))), "k").orderBy("doc_id").collect()]
    assert [r["kinds"] for r in got] == [["card"]] * 3 + [["iban"]] * 2 + [["card", "iban"], ["card"], []]
    assert all(len(r["text"]) == len(v) and card not in r["text"] and at not in r["text"] and es not in r["text"] for r, v in zip(got, values, strict=True))
    assert got[0]["text"].endswith(" 12/26") and got[1]["text"].endswith(" 123") and got[3]["text"].endswith(" BIC") and got[7]["text"] == values[7]


def test_dates_are_permuted(spark):
    days = spark.sql("select date_format(date_add(date'1800-01-01', cast(id as int)), 'yyyy-MM-dd') as v from range(0, 146097, 7)")
    got = days.select("v", pii._date(F.col("v"), "k").alias("n")).agg(F.count("*").alias("a"), F.count_distinct("n").alias("b"), F.count_if(F.col("n") == F.col("v")).alias("same")).first()
    assert got["a"] == got["b"] and got["same"] < 20


def test_valid_numbers_stay_valid_and_apart(spark):
    rng = random.Random(3)
    values = sorted({f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(2000)})
    got = [r["n"] for r in spark.createDataFrame([(v,) for v in values], "v string").select(pii._social(F.col("v"), "k").alias("n")).collect()]
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", n) for n in got) and len({*got}) == len(values)


def test_forms_of_dates_and_cases_of_mail_are_linked(spark, docs):
    rows = [(0, "on 1999-12-31."), (1, "on 31.12.1999."), (2, "on 12/31/1999."), (3, "on 31/12/1999 or 32.12.1999 or 1.31.12.1999.5"), (4, "at anna@example.com"), (5, "at Anna@Example.com")]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(rows), "k").collect()}
    year, month, day = got[0][3:-1].split("-")
    assert got[1] == f"on {day}.{month}.{year}." and got[2] == f"on {month}/{day}/{year}." and got[3] == rows[3][1] and year != "1999"
    assert got[4] != rows[4][1] and got[5] != got[4] and got[5].lower() == got[4] and [c.isupper() for c in got[5]] == [c.isupper() for c in rows[5][1]]


def plain_stretch(text, key):
    """Cards of one stretch of groups: all runs, longest first, each compared with all taken ones."""
    groups, taken = re.split(r"(?=[ \-])", text), []
    runs = []
    for i in range(len(groups)):
        for j in range(i + 1, len(groups) + 1):
            digits = re.sub(r"\D", "", "".join(groups[i:j]))
            if len(digits) > 19:
                break
            if len(digits) > 12 and luhn(digits) and groups[i].strip(" -"):
                runs.append((-len(digits), i, j))
    for _, i, j in sorted(runs):
        if all(j <= a or b <= i for a, b in taken):
            taken.append((i, j))
    for i, j in taken:
        run = "".join(groups[i:j])
        new = feistel(re.sub(r"\D", "", run)[:-1], key, "card")
        left = iter(next(new + str(d) for d in range(10) if luhn(new + str(d))))
        groups[i:j] = ["".join(next(left) if c.isdigit() else c for c in run), *[""] * (j - i - 1)]
    return "".join(groups), len(taken)


def test_number_tables(spark, docs):
    rng = random.Random(8)
    number = lambda: str(rng.randrange(10 ** rng.randrange(0, 4), 10 ** rng.randrange(4, 6)))
    rows = [(i, rng.choice([" ", "-"]).join(number() for _ in range(60))) for i in range(40)] + [(40, "0000 " * 30 + "0000")]
    rows = [(i, re.sub(r"\d{3}-\d{2}-\d{4}", "1", t)) for i, t in rows]
    got = {r["doc_id"]: (r["text"], r["n_values"]) for r in pii.pseudonymise(docs(rows), "k").collect() if {*r["kinds"]} <= {"card"}}
    assert len(got) > 30 and got == {i: plain_stretch(t, "k") for i, t in rows if i in got}


def test_addresses_beyond_ascii(spark, docs):
    values = ["jürgen.müller@web.de", "ann@xn--o3vkkbx.example.com", "олег@mail.example.org", "李雷@mail.example.cn", "jörgen.müller@web.de", "ÀØ@b.xn--p1ai.com"]
    rows = [(i, f"to {v} now") for i, v in enumerate(values)]
    got = {r["doc_id"]: r["text"][3:-4] for r in pii.pseudonymise(docs(rows), "k").collect()}
    assert all(len(got[i]) == len(v) and not {*v.split("@")[0]} - {*"."} <= {*got[i].split("@")[0]} for i, v in enumerate(values)) and len({*got.values()}) == len(values)
    assert not any(a == b and a not in ".@" for a, b in zip(got[0].split("@")[0][1:2] + got[2][:4], "ü" + "олег", strict=True) if a == "ü")
    assert ".xn--" not in got[0] and "@xn--o3vkkbx." in got[1] and ".xn--p1ai." in got[5] and got[2].endswith(".org")


def plain_values(key):
    """Pseudonyms by plain Python: kind -> new value of a value, None if it doesn't validate."""

    def refill(value, symbols):
        left = iter(symbols)
        return "".join(next(left) if c.isascii() and c.isalnum() else c for c in value)

    def bare(value):
        return "".join(c for c in value if c.isascii() and c.isalnum())

    def halves(kind, a, b, m, n):
        for i in range(pii.ROUNDS):
            add = int(hashlib.sha256("|".join([key, kind, str(i), str(a if i % 2 else b)]).encode()).hexdigest()[:6], 16)
            a, b = (a, (b + add) % n) if i % 2 else ((a + add) % m, b)
        return a, b

    def card(v):
        new = feistel(bare(v)[:-1], key, "card")
        return refill(v, next(new + str(d) for d in range(10) if luhn(new + str(d)))) if luhn(v) else None

    def number(s):
        return int("".join(str(int(c, 36)) for c in s))

    def iban(v):
        s = bare(v)
        new = feistel(s[4:], key, "iban")
        return refill(v, s[:2] + f"{98 - number(new + s[:2] + '00') % 97:02d}" + new) if number(s[4:] + s[:4]) % 97 == 1 else None

    def address(v):
        o = [int(x) for x in v.split(".")]
        a, b = halves("address", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return ".".join(map(str, (*divmod(a, 256), *divmod(b, 256)))) if max(o) < 256 else None

    def date(v):
        try:
            day = (datetime.date.fromisoformat(v) - datetime.date(1800, 1, 1)).days
        except ValueError:
            return None
        a, b = halves("date", *divmod(day, 773), 189, 773)
        return (datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)).isoformat()

    def email(v):
        head, top = v.rsplit(".", 1)
        return refill(head, feistel(bare(head), key, "email")) + "." + top

    def social(v):
        ok = v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"
        a, b = halves("social", (int(v[:3]) - 1 - (int(v[:3]) > 666)) * 99 + int(v[4:6]) - 1, int(v[7:]) - 1, 898 * 99, 9999)
        area = a // 99 + 1
        return f"{area + (area > 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}" if ok else None

    return {"card": card, "iban": iban, "address": address, "date": date, "email": email, "social": social}


def test_pseudonyms_equal_the_plain_ones(spark, docs):
    """Detection and replacement of random values, right and wrong ones, against plain Python."""
    rng, rules = random.Random(9), plain_values("k")
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))

    def iban():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}" if rng.random() < 0.7 else f"DE{digits(20)}"

    def card():
        body = digits(15)
        s = next(body + str(d) for d in range(10) if luhn(body + str(d))) if rng.random() < 0.7 else digits(16)
        return rng.choice([s, " ".join(s[i : i + 4] for i in range(0, 16, 4)), "-".join(s[i : i + 4] for i in range(0, 16, 4))])

    make = {
        "card": card, "iban": iban, "address": lambda: ".".join(str(rng.randrange(0, 280)) for _ in range(4)), "date": lambda: f"{rng.randrange(1801, 2199)}-{rng.randrange(1, 14):02d}-{rng.randrange(1, 32):02d}",
        "email": lambda: f"{word()}.{word()}{digits(2)}@{word()}.example.com", "social": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    rows, want = [], {}
    for i in range(60):
        text, new, kinds = [], [], []
        for _ in range(rng.randrange(0, 6)):
            kind = rng.choice(list(make))
            value = make[kind]()
            changed = rules[kind](value)
            filler = " ".join(word() for _ in range(rng.randrange(1, 4)))
            text += [filler, value]
            new += [filler, value if changed is None else changed]
            kinds += [kind] * (changed is not None)
        rows.append((i, "; ".join(text)))
        want[i] = ("; ".join(new), len(kinds), sorted(set(kinds)))
    got = {r["doc_id"]: (r["text"], r["n_values"], r["kinds"]) for r in pii.pseudonymise(docs(rows), "k").collect()}
    assert got == want
