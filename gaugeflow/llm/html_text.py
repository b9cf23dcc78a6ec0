"""Main text of web pages from streaming parser events.

The standard library's parser feeds blocks (the lines of the page). Elements that
are never part of an article (navigation, footers, forms, scripts, adverts,
notices, comments, hidden parts) are skipped by name, role or class while parsing.
The others get a text-to-tag ratio, smoothed by a Gaussian along the page. The
smoothed ratios fall into two clusters, or one where the two would lie close; lines
of the upper cluster are the seeds. They select the regions: the articles that hold
seeds, or on pages whose seeds lie in none, the lowest region common to all seeds.
A selected region keeps all of its lines, short ones too, but for menus: in an article
the regions and lists of short link labels that lie before its first or behind its last
seed, elsewhere all regions and lists that are mostly links. Lists of linked sources,
linked paragraphs and links between the seeds stay in an article.

All passes are linear in the page; nesting of any depth costs no more, nor do
unfinished tags: one that doesn't end before the page does is cut off with what follows
it, and from a quote or comment that is never closed on, tags end at their first ``>``.

Defined results: null and empty pages give an empty text, an empty table an empty one;
pages of any length are parsed whole; repeated rows and extra columns pass through (a
column named like a returned one is replaced); an unfinished tag at the end of a cut
page is not text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("script style noscript template nav footer aside form button select textarea iframe object svg canvas head dialog menu audio video".split())
REGIONS = frozenset("article main section div td body".split())
LISTS = frozenset("ul ol".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
SKIPPED_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall comment comments disqus respond replies sidebar rail related recommended recommendations share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager footer masthead topbar toolbar widget widgets skip".split())
HEADER_WORDS = frozenset(("header", "head"))
OWN_WORDS = frozenset(("article", "post", "entry", "content", "story"))
COMMENT_WORDS = frozenset(("comment", "comments"))
#: Words that say nothing of the content when they stand beside one of the above in a class name.
NEUTRAL_WORDS = frozenset("area bar block body bottom box btn button buttons card col column container content div fixed form global group head header icon icons inner item items js label layout left link links list local main mobile module outer page pane panel posts primary right row secondary section site slot stories sub tag text title top unit wrap wrapper zone".split())
#: Factor between the mean ratios of two clusters.
APART = 1.5
#: Words a link from which on it is no label of a menu.
LABEL_WORDS = 4
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_OPENING = re.compile(r"<[a-zA-Z/!?]")
_TAG = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'\s])))*+>"
#: Texts, comments, declarations, scripts, styles and tags that are finished.
_FINISHED = re.compile(
    r"(?:[^<]++|<(?![a-zA-Z/!?])|<!--(?:-?>|(?:[^-]++|-(?!-!?>))*+--!?>)|<!\[(?:[^\]]++|\](?!\]>))*+\]\]>|<(?!!--|!\[)[/!?][^>]*+>"
    rf"|<(?i:script)(?=[\s/>]){_TAG}(?:[^<]++|<(?!/(?i:script)))*+|<(?i:style)(?=[\s/>]){_TAG}(?:[^<]++|<(?!/(?i:style)))*+|<(?!(?i:script|style)[\s/>])[a-zA-Z]{_TAG})*+"
)
_LOOSE = re.compile(r"<[a-zA-Z!?][^>]*+>")


def _loosened(found: re.Match) -> str:
    """A tag without quotes where they aren't paired; no declarations."""
    tag = found[0]
    if tag[1] in "!?":
        return ""
    return tag if tag.count('"') % 2 == tag.count("'") % 2 == 0 else tag.replace('"', "").replace("'", "")


def finished(html: str) -> str:
    """The page with every tag in it finished, so that the parser meets each character once."""
    if cut := _OPENING.search(html, html.rfind(">") + 1):
        html = html[: cut.start()]
    end = _FINISHED.match(html).end()
    return html if end == len(html) else html[:end] + _LOOSE.sub(_loosened, html[end:])


def _named(value: str) -> tuple[bool, bool]:
    """Whether a class or id names a skipped part: anywhere, and outside of articles.

    A name decides only with all of its words: share-buttons does, share-price doesn't.
    """
    anywhere = outside = False
    for name in value.lower().split():
        words = {w for w in _SPLIT.split(name) if len(w) > 1 and not any(c.isdigit() for c in w)}
        plain = words - NEUTRAL_WORDS
        anywhere |= bool(words & COMMENT_WORDS) and plain - OWN_WORDS <= SKIPPED_WORDS or bool(plain) and plain <= SKIPPED_WORDS and not words & OWN_WORDS
        outside |= bool(words & HEADER_WORDS) and plain <= SKIPPED_WORDS
    return anywhere, outside


_short_named = lru_cache(4096)(_named)


@dataclass
class Line:
    text: str
    tags: int
    linked: int  # characters of links
    links: int
    label_words: int  # words of links
    region: int  # the innermost one
    article: int  # the outermost one, or 0


class _Lines(HTMLParser):
    """Collects the lines of the blocks outside skipped elements, and the parent of each region (0 is the page)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []  # name, starts a skipped part
        self.open: Counter[str] = Counter()
        self.paragraphs: list[int] = []  # places in the stack
        self.bounds: list[int] = []  # places of regions in the stack
        self.skips = 0
        self.links = 0
        self.parents = [0]
        self.regions = [0]
        self.articles: list[int] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.anchors = 0
        self.label_words = 0
        self.lines: list[Line] = []

    def flush(self) -> None:
        if text := _SPACE.sub(" ", "".join(self.parts)).strip():
            self.lines.append(Line(text, self.tags, self.linked, self.anchors, self.label_words, self.regions[-1], self.articles[0] if self.articles else 0))
            self.tags, self.linked, self.anchors, self.label_words = 0, 0, 0, 0
        self.parts = []

    def unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in SKIPPED or tag == "header" and not self.articles:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "role" and (value or "").lower() in SKIPPED_ROLES:
                return True
            if name == "style" and "display:none" in (value or "").replace(" ", "").lower():
                return True
            if name in ("class", "id") and value:
                anywhere, outside = _short_named(value) if len(value) <= 200 else _named(value)
                if anywhere or outside and not self.articles:
                    return True
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            if not self.skips:
                self.flush()
            # a paragraph ends where the next block begins
            if self.paragraphs and (not self.bounds or self.bounds[-1] < self.paragraphs[-1]):
                self.pop("p")
        elif tag == "br" and not self.skips:
            self.parts.append(" ")
        if tag in VOID:
            return
        skip = self.unwanted(tag, attrs)
        if tag == "p":
            self.paragraphs.append(len(self.stack))
        self.stack.append((tag, skip))
        self.open[tag] += 1
        self.skips += skip
        self.links += tag == "a"
        self.anchors += tag == "a" and not self.skips
        if tag in REGIONS or tag in LISTS:
            self.parents.append(self.regions[-1])
            self.regions.append(len(self.parents) - 1)
            if tag in REGIONS:
                self.bounds.append(len(self.stack) - 1)
            if tag in ("article", "main"):
                self.articles.append(self.regions[-1])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self, tag: str) -> None:
        while self.stack:
            name, skip = self.stack.pop()
            self.open[name] -= 1
            self.skips -= skip
            self.links -= name == "a"
            if name == "p":
                self.paragraphs.pop()
            if name in REGIONS or name in LISTS:
                self.regions.pop()
                if name in REGIONS:
                    self.bounds.pop()
                if name in ("article", "main"):
                    self.articles.pop()
            if name == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS and not self.skips:
            self.flush()
        if self.open[tag]:
            self.pop(tag)

    def handle_data(self, data: str) -> None:
        if not self.skips:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)
                self.label_words += len(data.split())


def lines_of(html: str) -> tuple[list[Line], list[int]]:
    """The lines of a page, and the parent of each region."""
    parser = _Lines()
    parser.feed(finished(html))
    parser.close()
    if not parser.skips:
        parser.flush()
    return parser.lines, parser.parents


def smooth(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing with the line itself weighted most; edges use what is there."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / (radius / 2)) ** 2)
    total = np.convolve(ratios, weights)[radius : radius + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weights)[radius : radius + len(ratios)]


def threshold(values: np.ndarray, apart: float = APART) -> float:
    """The split into two clusters with the least inner variance, on a log scale; 0 if their means lie closer than by the factor ``apart``."""
    ranked = np.sort(np.log1p(values))
    if len(ranked) < 2 or ranked[-1] - ranked[0] < 1e-9:
        return 0.0
    n = np.arange(1, len(ranked))
    total = np.cumsum(ranked)
    low, high = total[:-1] / n, (total[-1] - total[:-1]) / (len(ranked) - n)
    cut = int(np.argmax(n * (len(ranked) - n) * (high - low) ** 2))
    if high[cut] - low[cut] < math.log(apart):
        return 0.0
    return math.expm1((ranked[cut] + ranked[cut + 1]) / 2)


def seeds_of(lines: list[Line]) -> np.ndarray:
    """Which lines lie in the upper cluster of smoothed text-to-tag ratios."""
    chars, tags, linked = (np.array(x, float) for x in zip(*((len(x.text), max(1, x.tags), x.linked) for x in lines), strict=True))
    ratio = smooth(chars / tags * np.clip(1 - linked / chars, 0, 1))
    return ratio >= threshold(ratio)


def main_text(html: str | None) -> str:
    lines, parents = lines_of(html or "")
    if not lines:
        return ""
    seeds = seeds_of(lines)
    # Text, links, their words, first and last line of every region, its inner ones included; inner ones have larger numbers.
    chars, linked, links, words = ([0] * len(parents) for _ in range(4))
    first, last = [len(lines)] * len(parents), [-1] * len(parents)
    for i, line in enumerate(lines):
        chars[line.region] += len(line.text)
        linked[line.region] += line.linked
        links[line.region] += line.links
        words[line.region] += line.label_words
        first[line.region], last[line.region] = min(first[line.region], i), i
    for region in range(len(parents) - 1, 0, -1):
        parent = parents[region]
        for sums in (chars, linked, links, words):
            sums[parent] += sums[region]
        first[parent], last[parent] = min(first[parent], first[region]), max(last[parent], last[region])
    poor = [n > 0.5 * c for c, n in zip(chars, linked, strict=True)]
    none = (len(lines), -1)
    spans: dict[int, tuple[int, int]] = {}  # of each article, the first and last seed that isn't in a region of links
    for i, (line, seed) in enumerate(zip(lines, seeds.tolist(), strict=True)):
        if seed and line.article:
            span = spans.setdefault(line.article, none)
            if not poor[line.region]:
                spans[line.article] = (min(span[0], i), i)
    if not spans:
        held = [0] * len(parents)
        for line, seed in zip(lines, seeds.tolist(), strict=True):  # seeds in a region that is mostly links select nothing
            held[line.region] += seed and not poor[line.region]
        for region in range(len(parents) - 1, 0, -1):
            held[parents[region]] += held[region]
        if not held[0]:
            return ""
        spans = {max(region for region, n in enumerate(held) if n == held[0]): none}
    root: list[int | None] = [None] * len(parents)  # the selected region that keeps it
    for region, parent in enumerate(parents):
        if region in spans:
            root[region] = region
        elif region and (own := root[parent]) is not None:
            begin, end = spans[own]
            menu = poor[region] and (end < 0 or (last[region] < begin or first[region] > end) and words[region] < LABEL_WORDS * max(1, links[region]))
            root[region] = None if menu else own
    return "\n".join(line.text for line in lines if root[line.region] is not None)


def _extract(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                texts = [main_text(html) for html in part.column(column).to_pylist()]
                rest = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != column]
                yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(n for n, _ in rest), "text", "n_chars"])

    return run


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of ``column``."""
    pages = pages.drop(*(c for c in pages.columns if c in ("text", "n_chars") and c != column))
    fields = [f for f in pages.schema.fields if f.name != column]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.withColumn(column, F.col(column).cast("string")).mapInArrow(_extract(column), schema)
