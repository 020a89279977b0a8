"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. The features of a block are its words, the density of its words in links, both of the blocks before and
behind it, and one of structure, its place: inside an article (1), neither (0), in something that its names only call other matter (-1), or in an
element that is other matter (-2). A decision tree, grown by Gini impurity on a small table of labelled pages, says which blocks are the main text.
Without names or elements that tell, words and links of a block and its neighbours decide alone; within an article runs of links go; what is only named
as other matter stays if it is long text among long text.

Names are whole words of class, id and role. One that also has other words than general ones (`social-security`, `notice-period`) tells nothing, and
neither does the head of an article (`entry-header`, a header element in an article).

Defined cases: a null, empty or blank html gives an empty text; a page without block tags is one block; tags that are never closed reach to the
end of what encloses them; scripts, styles and comments never are text; rows of equal page_id are separate; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, tidy

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|(?:^|\s)aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Element names of HTML by kind.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
OTHER_TAGS = frozenset("head nav header footer aside form menu dialog button fieldset search label".split())
ARTICLE_TAGS = frozenset("article main".split())
# Words in class, id and role by which pages mark what isn't the article, and what is.
PARTS_OF_PAGES = frozenset("breadcrumb breadcrumbs contentinfo footer header login masthead menu menubar modal nav navbar navigation pager pagination rail sidebar toc toolbar topbar".split())
ASIDES = frozenset("ad ads adsbygoogle adv advert adverts advertisement advertising adsense banner banners byline complementary consent cookie cookies copyright disclaimer gdpr newsletter notice notices notification paywall popup promo promoted promotion related rss search share sharing signup skip social sponsor sponsored subscribe subscription tags teaser widget widgets".split())
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
ARTICLE_NAMES = frozenset("article articlebody entry post story".split())
#: Words that say nothing beside such a name.
GENERAL = frozenset("area author bar block body bottom box btn button buttons card col column container content desktop form global google icon icons inline inner item items left link links list main meta mobile module outer page panel posts primary right row secondary section site slot sticky text thread title top unit wide wrap wrapper".split())
FEATURES = ("place", "words", "links", "words_before", "links_before", "words_behind", "links_behind")
#: Labelled pages, a line each, as read by hand: place, words, link density, and 1 for main text, of each block in order.
LABELLED = """
-2 2 1 0|-2 1 1 0|-2 1 1 0|-1 8 0 0|1 9 0 1|1 55 0 1|1 80 .05 1|1 12 0 1|1 2 0 1|1 40 .1 1|-2 11 0 0
-2 1 1 0|-2 3 1 0|-1 14 0 0|1 6 0 1|1 30 .2 1|1 1 0 1|1 4 0 1|-1 25 .1 0|1 70 0 1|1 3 0 1|-2 9 .4 0|-2 60 0 0|-2 35 0 0
-2 12 0 0|1 1 0 1|1 120 0 1|1 8 .5 1|1 200 .01 1|-2 45 0 0|-2 120 0 0|-2 8 0 0
1 7 0 1|1 50 0 1|1 3 1 0|1 4 1 0|1 5 1 0|1 60 0 1|1 6 1 1|1 44 0 1|1 2 1 0|1 2 1 0|1 3 1 0
-1 5 0 0|1 2 0 1|1 90 0 1|1 25 1 1|1 15 0 1|1 4 1 0|1 7 1 0|-1 3 1 0|-2 4 0 0
0 1 1 0|0 2 1 0|0 1 1 0|0 7 0 1|0 60 0 1|0 35 .1 1|0 5 0 1|0 90 0 1|0 14 0 1|0 3 1 0|0 2 1 0|0 4 .8 0
0 2 1 0|0 3 1 0|0 4 0 0|0 2 1 0|0 3 1 0|0 5 0 0|0 2 1 0|0 1 1 0|0 6 .7 0|0 3 1 0
0 11 0 1
0 4 0 1|0 30 0 1|0 3 0 1
0 3 1 0|0 9 0 1|0 22 .1 1|0 18 0 1|0 6 0 1|0 2 1 0|0 4 1 0|0 25 .9 0|0 12 .8 0
0 5 1 0|0 3 0 0|0 5 1 0|0 8 0 1|0 150 .02 1|0 2 0 1|0 40 0 1|0 1 1 0|0 3 0 0|0 2 1 0
0 60 0 1|0 10 .3 1|0 200 0 1|0 40 .8 0|0 30 .9 0|0 60 .9 0
0 2 0 1|0 1 0 1
-1 140 0 1|-1 120 .02 1|-1 110 0 1|-1 6 0 0|-2 5 1 0
-1 10 0 0|0 130 0 1|-1 30 0 0|0 100 0 1|-1 60 .1 0|1 90 0 1|-1 45 0 0|1 130 0 1|-1 100 1 0|0 50 0 1
1 5 0 1|1 20 0 1|1 4 1 1|1 30 0 1|1 2 1 1|1 18 0 1|-2 3 1 0
0 5 0 1|0 40 0 1|0 3 1 1|0 50 0 1|0 30 0 1|0 8 1 1|0 16 0 1
1 60 0 1|1 3 1 0|1 2 1 0|1 4 1 0|-2 5 1 0
-2 2 1 0|1 1 0 1|1 40 0 1
-2 1 1 0|-2 1 1 0|1 3 0 1|1 4 0 1|1 50 0 1
0 1 1 0|0 1 1 0|0 4 0 1|0 50 0 1|0 3 1 0
0 2 1 0|0 3 0 1|0 25 0 1|0 6 0 1
0 70 0 1|0 2 1 0|0 3 1 0|0 2 1 0
-2 1 1 0|1 60 0 1|-2 2 1 0
-2 2 1 0|0 45 0 1|-1 1 1 0|0 30 0 1|-2 1 1 0|1 20 0 1
-1 3 1 0|1 50 0 1|1 40 0 1|-1 4 1 0|1 35 0 1|-2 5 1 0|1 25 0 1
0 50 0 1|0 4 0 1|0 2 1 0|0 3 1 0
0 30 0 1|0 5 0 1|0 1 1 0|0 2 1 0
1 30 0 1|1 2 0 1|1 1 1 1|1 27 0 1|1 3 0 1|1 2 1 1|1 40 0 1
-2 90 0 0|1 8 0 1|1 33 .3 1|-2 25 .1 0|-2 200 0 0|1 12 0 1|-2 1 1 0|-2 2 0 0
"""


@dataclass
class Tree:
    feature: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    share: float = 0.0

    def says(self, x: tuple[float, ...]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.at else node.high
        return node.share >= 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2) -> Tree:
    """Splits by the largest drop in Gini impurity; ties go to the earlier feature and the lower bound."""
    node = Tree(share=float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = (len(y) * node.share * (1 - node.share) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        cuts = np.unique(x[:, f])
        for at in (cuts[:-1] + cuts[1:]) / 2:
            low = x[:, f] <= at
            if least <= low.sum() <= len(y) - least:
                cost = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
                if cost < best[0]:
                    best = (cost, f, float(at))
    if best[1] >= 0:
        low = x[:, best[1]] <= best[2]
        node.feature, node.at, node.low, node.high = best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def with_neighbours(blocks: list[tuple[float, float, float]]) -> list[tuple[float, ...]]:
    """The features of each block of a page from (place, words, links) of all; nothing lies before the first and behind the last."""
    sizes = [(0.0, 0.0), *((words, links) for _, words, links in blocks), (0.0, 0.0)]
    return [(place, *sizes[k + 1], *sizes[k], *sizes[k + 2]) for k, (place, _, _) in enumerate(blocks)]


def learned() -> Tree:
    x, y = [], []
    for line in LABELLED.strip().split("\n"):
        blocks = [tuple(map(float, b.split())) for b in line.split("|")]
        x += with_neighbours([b[:3] for b in blocks])
        y += [b[3] for b in blocks]
    return grow(np.array(x), np.array(y))


TREE = learned()
OTHER, NAMED, NEITHER, ARTICLE, COMMENTS = -2, -1, 0, 1, -3


def place_of(tag: str, attributes: str, outer: int) -> int | None:
    """What the element says of its own matter, or None: ARTICLE, NAMED, OTHER, or COMMENTS, which are OTHER whatever they hold."""
    if tag in ("html", "body"):
        return None
    found = OTHER if tag in OTHER_TAGS and not (tag in ("header", "label") and outer == ARTICLE) else ARTICLE if tag in ARTICLE_TAGS else None
    if not attributes:
        return found
    if HIDDEN.search(attributes):
        return COMMENTS
    for m in NAME.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w for p in PART.findall(name) if len(w := p.lower()) > 1}
            told = words - GENERAL
            if told & COMMENT_NAMES and told <= COMMENT_NAMES | ARTICLE_NAMES:
                return COMMENTS
            if not told or not told <= PARTS_OF_PAGES | ASIDES | ARTICLE_NAMES:
                continue
            if told & PARTS_OF_PAGES and not (told & ARTICLE_NAMES and "header" in told):
                found = OTHER
            elif told & ASIDES and found != OTHER:
                found = NAMED
            elif found is None and told <= ARTICLE_NAMES and tag in BLOCK:
                found = ARTICLE
    return found


def inside(outer: int, own: int | None) -> int:
    """Comments hold comments only; an article within other matter is an article, and other matter within an article is other matter. A name doesn't weaken what an element around it says."""
    return outer if own is None or outer == COMMENTS or outer == OTHER and own == NAMED else own


class Blocks:
    """The text blocks of a page: (place, text, share of words in links)."""

    def __init__(self, page: str) -> None:
        self.found: list[tuple[int, str, float]] = []
        self.text: list[str] = []
        self.linked = self.links = 0
        self.open: list[tuple[str, int]] = [("", 0)]
        at = 0
        while True:
            m = TAG.search(page, at)
            self.add(page[at : m.start() if m else len(page)])
            if m is None:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.close(tag)
            elif tag in RAW and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                self.begin(tag, m[3])
        self.flush()

    def add(self, text: str) -> None:
        if text:
            self.text.append(text)
            if self.links:
                self.linked += len(text.split())

    def flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.text)).split())
        if text:
            self.found.append((max(OTHER, self.open[-1][1]), text, min(1.0, self.linked / len(text.split()))))
        self.text, self.linked = [], 0

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text.append("\n")
        if tag == "a":
            self.links = 1
        place = place_of(tag, attributes, self.open[-1][1])
        if tag in BLOCK or place is not None:
            self.flush()
        if tag in CLOSES_P and any(t == "p" for t, _ in self.open):
            self.pop("p")
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and self.open[-1][0] in (("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,)):
            self.open.pop()
        if tag not in VOID and not attributes.rstrip().endswith("/") and (tag in BLOCK or place is not None):
            self.open.append((tag, inside(self.open[-1][1], place)))

    def pop(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if tag == "p" and self.open[k][0] in BLOCK:
                return

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag in BLOCK or any(t == tag for t, _ in self.open):
            self.flush()
            self.pop(tag)


def main_text(page: str, tree: Tree = TREE) -> str:
    blocks = Blocks(page).found
    features = with_neighbours([(float(place), float(len(text.split())), links) for place, text, links in blocks])
    return "\n".join(text for (_, text, _), x in zip(blocks, features, strict=True) if tree.says(x))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(tidy(of), "page_id long, url string, text string, n_chars long")
