"""Main text of HTML pages from flat text blocks.

A page is read once, tag by tag, into a flat list of text blocks (block-level
tags and line breaks end a block). A block is described by its words and link
density, those of its neighbours, and what encloses it; a decision tree, grown
from a small labelled table of blocks, says which blocks are main text.

Most of the table tells text from other parts by words and link density, of the
block and of its neighbours; marks of elements and classes are features beside
them, and may be absent or wrong.

Defined results: a null or empty page, and one without main text, gives an
empty text; malformed markup ends elements at the next matching end tag; an
unclosed script or style runs to the end of the page; a quoted attribute value
may hold any character, and a quote that never ends is no quote; rows are read
one by one, so repeated rows give the same; long and deeply nested pages take
time in proportion to their length; columns besides id, url and page are not
read, so their names cannot clash.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import small_batches

#: Elements whose content is never text of the page.
_RAW = "script|style|noscript|template|svg|iframe|textarea|select|title|object|canvas|audio|video|button"
_BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table thead tbody tfoot tr caption section article header footer nav aside main blockquote pre form fieldset legend dl dt dd hr br figure figcaption address details summary body html head dialog menu center".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_CHROME = frozenset("nav footer aside form dialog menu fieldset head".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark other parts of a page.
_OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo complementary cookie cookies copyright dialog disqus footer gdpr links login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup popular promo promoted promotion recommended recommendations related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe tags toolbar topbar tracking trending warning widget widgets alert".split()
)
_MAIN = frozenset("article content entry main post story text body maincontent articlebody postbody".split())

#: Of those, words that mark another part only alone or with words like these:
#: "related-posts" does, "related-work" is a heading of many articles.
_WEAK = frozenset("related links search tags popular trending warning replies notice".split())
_PLAIN = frozenset("posts articles stories items list box block section content news topics reading bar wrap wrapper container area form results cloud pages".split())

_SKIP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: A tag, whose attribute values may hold > within quotes; a quote that does not
#: end is an ordinary character.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>|<[!?][^>]*>""")
#: A slash that ends an element at once, and not an unquoted value.
_CLOSED = re.compile(r"""(?:\A|[\s"'])/\Z""")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    link_words: int
    chrome: int
    article: int
    heading: int
    listed: int


def _marks(attrs: str) -> tuple[int, int]:
    """(is another part, is main part) by attributes."""
    other = main = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            other = 1
        elif name == "style":
            other |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            for word in value.split():
                tokens = {t.lower() for t in _TOKEN.findall(word)}
                marks = tokens & _OTHER
                other |= bool(marks - _WEAK or marks and tokens <= _OTHER | _PLAIN)
                main |= bool(tokens & _MAIN)
    return int(other), int(main and not other)


def blocks(page: str) -> list[Block]:
    page = _SKIP.sub(" ", page)
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, chrome, main
    opened: dict[str, int] = {}
    chrome = article = link = heading = listed = 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            if t:
                out.append(Block(t, t.count(" ") + 1, linked, int(chrome > 0), int(article > 0), int(heading > 0), int(listed > 0)))
            text.clear()
        linked = 0

    def change(tag: str, c: int, m: int, by: int) -> None:
        nonlocal chrome, article, link, heading, listed
        opened[tag] = opened.get(tag, 0) + by
        chrome += by * c
        article += by * m
        link += by * (tag == "a")
        heading += by * (tag in _HEADING)
        listed += by * (tag == "li")

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        run = page[at : m.start() if m else n]
        if run:
            text.append(run)
            if link:
                linked += len(run.split())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3]
        if tag in _BLOCK:
            flush()
        elif tag in ("td", "th"):
            text.append(" ")
        if m[1]:
            if opened.get(tag):
                while True:
                    s = stack.pop()
                    change(*s, -1)
                    if s[0] == tag:
                        break
        elif tag not in _VOID and not _CLOSED.search(attrs):
            if stack and (stack[-1][0] == "p" and tag in _BLOCK or stack[-1][0] == tag == "li"):
                change(*stack.pop(), -1)
            c, mk = _marks(attrs) if attrs else (0, 0)
            c = int(c or tag in _CHROME or tag == "header" and not article)
            mk = int(tag in ("article", "main") or mk and not chrome)
            stack.append((tag, c, mk))
            change(tag, c, mk, 1)
    flush()
    return out


FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "chrome", "article", "outside", "heading", "listed")


def describe(found: list[Block]) -> np.ndarray:
    """The features of every block of a page, in the order of ``FEATURES``.
    ``outside``: the page has an article, and the block is not in it."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    w = np.array([b.words for b in found], float)
    d = np.minimum(1.0, np.array([b.link_words for b in found]) / w)
    article = np.array([b.article for b in found], float)
    outside = (1 - article) * (article.max() > 0)
    side = lambda x, k: np.append(x[1:], 0) if k > 0 else np.append(0, x[:-1])
    cols = [w, d, side(w, -1), side(d, -1), side(w, 1), side(d, 1), [b.chrome for b in found], article, outside, [b.heading for b in found], [b.listed for b in found]]
    return np.stack([np.asarray(c, float) for c in cols], 1)


#: A labelled table of blocks: the features in order, then 1 for main text.
TABLE = (
    # articles: paragraphs, headings, short lines, lists, links within text
    (80, 0.00, 60, 0.00, 70, 0.00, 0, 1, 0, 0, 0, 1),
    (45, 0.05, 80, 0.00, 30, 0.00, 0, 1, 0, 0, 0, 1),
    (8, 0.00, 2, 1.00, 60, 0.00, 0, 1, 0, 1, 0, 1),
    (5, 0.00, 70, 0.00, 90, 0.10, 0, 1, 0, 1, 0, 1),
    (1, 0.00, 40, 0.00, 25, 0.00, 0, 1, 0, 0, 0, 1),
    (3, 0.00, 1, 0.00, 1, 0.00, 0, 1, 0, 0, 0, 1),
    (12, 0.00, 30, 0.00, 11, 0.00, 0, 1, 0, 0, 1, 1),
    (2, 0.00, 12, 0.00, 2, 0.00, 0, 1, 0, 0, 1, 1),
    (30, 0.30, 50, 0.00, 20, 0.20, 0, 1, 0, 0, 0, 1),
    (6, 0.50, 40, 0.00, 40, 0.00, 0, 1, 0, 0, 0, 1),
    (200, 0.01, 0, 0.00, 4, 1.00, 0, 1, 0, 0, 0, 1),
    (1, 0.00, 1, 0.00, 9, 0.00, 0, 1, 0, 0, 0, 1),
    (25, 0.00, 9, 0.00, 12, 0.00, 0, 1, 0, 0, 0, 1),
    (5, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 0, 0, 1),
    (24, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 0, 0, 1),
    (5, 0.40, 0, 0.00, 0, 0.00, 0, 1, 0, 0, 0, 1),
    (7, 0.60, 0, 0.00, 4, 0.00, 0, 1, 0, 0, 0, 1),
    (10, 0.70, 30, 0.00, 30, 0.00, 0, 1, 0, 0, 0, 1),
    (4, 0.00, 2, 1.00, 0, 0.00, 0, 1, 0, 0, 0, 1),
    (3, 0.00, 4, 1.00, 3, 1.00, 0, 1, 0, 1, 0, 1),
    (6, 0.00, 60, 0.00, 3, 1.00, 0, 1, 0, 0, 0, 1),
    (9, 0.00, 0, 0.00, 2, 1.00, 0, 1, 0, 1, 0, 1),
    (1, 0.00, 0, 0.00, 1, 0.00, 0, 1, 0, 0, 0, 1),
    # inside articles, but of other kinds: share bars, link lists, adverts
    (4, 1.00, 90, 0.00, 3, 1.00, 0, 1, 0, 0, 1, 0),
    (3, 1.00, 4, 1.00, 5, 1.00, 0, 1, 0, 0, 1, 0),
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 1, 0, 0, 0, 0),
    (7, 1.00, 60, 0.00, 6, 1.00, 0, 1, 0, 0, 1, 0),
    (9, 0.00, 60, 0.00, 70, 0.00, 1, 1, 0, 0, 0, 0),
    (40, 0.00, 20, 0.00, 30, 0.00, 1, 1, 0, 0, 0, 0),
    (5, 0.20, 20, 0.00, 30, 0.00, 1, 1, 0, 1, 0, 0),
    # menus, headers, footers, sidebars, notices, forms, comments
    (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 1, 0, 1, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 1, 0, 1, 0),
    (2, 1.00, 1, 1.00, 8, 0.00, 1, 0, 1, 0, 1, 0),
    (8, 0.00, 1, 1.00, 10, 0.00, 1, 0, 1, 0, 0, 0),
    (12, 0.00, 40, 0.00, 5, 0.00, 1, 0, 1, 0, 0, 0),
    (60, 0.02, 30, 0.00, 30, 0.00, 1, 0, 1, 0, 0, 0),
    (30, 0.00, 3, 0.00, 50, 0.00, 1, 0, 1, 0, 0, 0),
    (4, 0.00, 60, 0.00, 20, 0.00, 1, 0, 1, 1, 0, 0),
    (90, 0.00, 40, 0.00, 40, 0.00, 1, 0, 0, 0, 0, 0),
    (15, 0.10, 40, 0.00, 6, 1.00, 1, 0, 0, 0, 0, 0),
    (3, 0.00, 5, 0.00, 1, 1.00, 1, 0, 0, 1, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 0, 0, 1, 0),
    # outside the article of a page, unmarked
    (6, 0.00, 1, 1.00, 12, 0.00, 0, 0, 1, 0, 0, 0),
    (20, 0.00, 30, 0.00, 8, 0.00, 0, 0, 1, 0, 0, 0),
    (70, 0.00, 50, 0.00, 3, 1.00, 0, 0, 1, 0, 0, 0),
    (4, 1.00, 60, 0.00, 4, 1.00, 0, 0, 1, 0, 0, 0),
    (5, 0.00, 20, 0.00, 30, 0.00, 0, 0, 1, 1, 0, 0),
    # pages without an article: text, headings before text, short text between
    (60, 0.00, 50, 0.00, 55, 0.00, 0, 0, 0, 0, 0, 1),
    (35, 0.05, 6, 0.00, 60, 0.00, 0, 0, 0, 0, 0, 1),
    (120, 0.02, 5, 1.00, 4, 1.00, 0, 0, 0, 0, 0, 1),
    (20, 0.00, 60, 0.00, 40, 0.00, 0, 0, 0, 0, 0, 1),
    (14, 0.00, 20, 0.00, 15, 0.00, 0, 0, 0, 0, 1, 1),
    (7, 0.00, 3, 1.00, 60, 0.00, 0, 0, 0, 1, 0, 1),
    (5, 0.00, 50, 0.00, 45, 0.00, 0, 0, 0, 1, 0, 1),
    (4, 0.00, 40, 0.00, 50, 0.00, 0, 0, 0, 0, 0, 1),
    (6, 0.00, 30, 0.00, 25, 0.00, 0, 0, 0, 0, 0, 1),
    (25, 0.20, 40, 0.00, 30, 0.10, 0, 0, 0, 0, 0, 1),
    # pages without an article: link lists, captions of lists, lone short lines
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0, 1, 0),
    (4, 1.00, 3, 1.00, 50, 0.00, 0, 0, 0, 0, 0, 0),
    (6, 1.00, 60, 0.00, 5, 1.00, 0, 0, 0, 0, 1, 0),
    (12, 0.90, 4, 1.00, 9, 1.00, 0, 0, 0, 0, 0, 0),
    (8, 0.60, 3, 1.00, 4, 1.00, 0, 0, 0, 0, 0, 0),
    (3, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0, 0, 0),
    (4, 0.00, 3, 1.00, 3, 1.00, 0, 0, 0, 1, 0, 0),
    (2, 0.00, 0, 0.00, 3, 1.00, 0, 0, 0, 0, 0, 0),
    (5, 0.00, 4, 1.00, 0, 0.00, 0, 0, 0, 0, 0, 0),
    (30, 0.80, 10, 1.00, 12, 1.00, 0, 0, 0, 0, 0, 0),
    # no marks at all: a site's name, captions of link lists, a title after a
    # menu, text after a menu, a footer between links, the last words of a text
    (3, 0.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0, 0, 0),
    (6, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0, 1, 0, 0),
    (4, 0.00, 60, 0.00, 3, 1.00, 0, 0, 0, 0, 0, 0),
    (3, 0.00, 90, 0.00, 5, 1.00, 0, 0, 0, 1, 0, 0),
    (6, 0.00, 2, 1.00, 70, 0.00, 0, 0, 0, 0, 0, 1),
    (4, 0.00, 1, 1.00, 45, 0.00, 0, 0, 0, 1, 0, 1),
    (40, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0, 0, 1),
    (28, 0.05, 1, 1.00, 33, 0.00, 0, 0, 0, 0, 0, 1),
    (9, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0, 0, 0),
    (11, 0.10, 2, 1.00, 1, 1.00, 0, 0, 0, 0, 0, 0),
    (18, 0.00, 55, 0.00, 3, 1.00, 0, 0, 0, 0, 0, 1),
    (7, 0.70, 40, 0.00, 2, 1.00, 0, 0, 0, 0, 0, 0),
    (12, 0.00, 70, 0.00, 0, 0.00, 0, 0, 0, 0, 0, 1),
    (4, 0.00, 2, 1.00, 0, 0.00, 0, 0, 0, 0, 0, 0),
    (22, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 0, 1),
)


@dataclass
class Tree:
    """A binary tree in arrays: feature (-1: leaf), threshold, children, value."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Classification tree by Gini impurity; thresholds lie halfway between
    neighbouring values, ties go to the feature first in order."""
    tree = Tree([], [], [], [], [])

    def node(rows: np.ndarray, left: int) -> int:
        me, p = len(tree.value), y[rows].mean()
        for column, v in zip((tree.feature, tree.threshold, tree.left, tree.right, tree.value), (-1, 0.0, -1, -1, p), strict=True):
            column.append(v)
        if left == 0 or p in (0, 1):
            return me
        best = (len(rows) * p * (1 - p) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[rows, f] <= cut
                a, b = y[rows[low]].mean(), y[rows[~low]].mean()
                cost = low.sum() * a * (1 - a) + (~low).sum() * b * (1 - b)
                if cost < best[0] - 1e-12:
                    best = (cost, f, float(cut))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            tree.feature[me], tree.threshold[me] = best[1], best[2]
            tree.left[me] = node(rows[low], left - 1)
            tree.right[me] = node(rows[~low], left - 1)
        return me

    node(np.arange(len(x)), depth)
    return tree


def train(table: tuple = TABLE) -> Tree:
    t = np.array(table, float)
    return grow(t[:, :-1], t[:, -1])


def extract(page: str | None, tree: Tree) -> list[str]:
    """The main blocks of a page, in page order."""
    if not page:
        return []
    found = blocks(page)
    keep = tree.predict(describe(found)) >= 0.5
    return [b.text for b, k in zip(found, keep.tolist(), strict=True) if k]


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """(page_id, url, blocks, text) of every page; ``text`` joins the blocks."""
    small_batches(df.sparkSession)
    tree = tree or train()
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(p, tree) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.list_(pa.string())), pa.array(["\n".join(x) for x in found], pa.string())], ["page_id", "url", "blocks", "text"])

    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return rows.mapInArrow(run, f"page_id {id_type}, url string, blocks array<string>, text string")
