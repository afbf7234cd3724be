"""Main text of web pages: flat text blocks, features of neighbours, a decision tree.

A page is read once from start to end. Text between two block-level tags (or line breaks) is a
block. A block has its number of words and its link density, those of the blocks before and
behind it, and what stands around it: whether it is inside an ``article`` or ``main``, whether
the page has one, whether an element around it is a menu, header, footer, sidebar, form, notice,
advert or comment section by its tag, role, class, id or being hidden, and whether it is a heading.
A decision tree (Gini, grown until pure) over these, trained on the small labelled table below,
says which blocks are the main text: outside articles by words and links of the block and its
neighbours, inside them runs of links are menus too.

A marked inline element, such as a span of class ``advert``, is a block of its own and does not cut
the block around it; custom elements are read by the words of their names. Code is not read for marks.

Defined results: null and empty pages give the empty text; comments, scripts, styles and other
raw elements that are never closed last to the end of the page; a ``<`` that opens no tag is
text; a link that is never closed ends with the block around it; rows that repeat a page_id are
pages of their own; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import map_batches

# fixed values: element names of HTML by what they do to text
RAW = "script style noscript template iframe object svg math canvas audio video select textarea title xmp noembed noframes".split()
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("br hr img input meta link area base col embed param source track wbr".split())
ASIDE = set("nav header footer aside form menu dialog button fieldset search head".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# fixed values: words of class and id names that mark what is not the article
MARKS = set(
    "ad ads adv adsbygoogle advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar header footer masthead comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager skip search form hidden copyright legal disclaimer tags".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

COLUMNS = ("has_article", "in_article", "aside", "heading", "words_before", "links_before", "words", "links", "words_behind", "links_behind")

#: The labelled table: features as in COLUMNS, then 1 for main text.
LABELLED = """
1 1 0 1  5 0.0  8 0.0 60 0.0 1
1 1 0 0  8 0.0 60 0.0 55 0.0 1
1 1 0 0 60 0.0  1 0.0  2 0.0 1
1 1 0 0  1 0.0  2 0.0 40 0.0 1
1 1 0 0 40 0.0 12 1.0 30 0.0 1
1 1 0 0  4 1.0  3 1.0 25 0.1 0
1 1 0 0 25 0.2 80 0.3  0 0.0 1
1 1 0 1 30 0.0  3 0.0 30 0.0 1
1 1 0 0  9 0.0 14 0.0  7 0.0 1
1 1 0 0  0 0.0  1 0.0  1 1.0 1
1 1 0 0 12 0.5  4 0.0  6 0.8 1
1 1 0 0  3 0.0  2 1.0  2 1.0 0
1 1 0 0  6 1.0  1 1.0  0 0.0 0
1 1 0 1  2 1.0  2 0.0  3 0.5 1
1 1 0 0 44 0.0 20 0.4  9 0.6 1
1 1 0 0 20 0.0  5 0.9 14 0.9 1
1 1 0 0 50 0.0  6 1.0  5 1.0 0
1 1 0 0  5 0.0  4 1.0 40 0.0 1
1 1 0 0  0 0.0  4 1.0 30 0.0 1
1 1 0 0 12 0.2  2 1.0  3 0.3 1
1 1 0 0  3 0.0  6 1.0  0 0.0 1
1 1 0 0 60 0.0 10 1.0  9 1.0 0
1 1 0 0  2 1.0  2 1.0 60 0.0 0
1 1 0 0  9 1.0  8 1.0  0 0.0 0
1 1 0 0  2 0.0  1 1.0  1 1.0 0
1 1 0 0  6 1.0  9 1.0  8 1.0 0
1 1 0 0 50 0.0  7 1.0 40 0.0 1
1 1 0 0 30 0.0  2 1.0  0 0.0 1
1 1 0 0  5 1.0 30 0.1 45 0.0 1
1 1 0 0  2 1.0  3 0.0 20 0.0 1
1 1 0 0  9 1.0 45 0.0  3 1.0 1
1 1 0 0  1 0.0  1 0.0  1 0.0 1
1 1 0 0 90 0.3  3 0.3  4 0.4 1
1 1 0 0  2 0.9 70 0.2  5 1.0 1
1 1 1 0 60 0.0  9 0.0 50 0.0 0
1 1 1 0 60 0.0 30 0.0  4 0.5 0
1 1 1 1 50 0.0  2 0.0 20 0.0 0
1 1 1 0 80 0.0 70 0.0 60 0.0 0
1 1 1 0 10 0.0  2 1.0  3 1.0 0
1 0 0 0  2 1.0  1 1.0  1 1.0 0
1 0 0 0  6 0.0 20 0.0 50 0.0 0
1 0 0 0 50 0.0 12 0.1  0 0.0 0
1 0 0 1 50 0.0  3 0.0 12 0.5 0
1 0 0 0  3 0.0 60 0.0 12 0.2 0
1 0 0 0 55 0.0 50 0.0 48 0.0 0
1 0 0 0  0 0.0 25 0.0  0 0.0 0
1 0 0 1 45 0.0  5 0.0 50 0.0 0
1 0 0 0  8 0.0 30 0.0 24 0.0 0
1 0 0 0 20 0.0 22 0.0 19 0.0 0
1 0 1 0  1 1.0  1 1.0  1 1.0 0
1 0 1 0  1 1.0 14 0.0  8 0.0 0
1 0 1 0 70 0.0 10 0.1  0 0.0 0
1 0 1 1  0 0.0  4 0.0 10 0.2 0
0 0 1 0  1 1.0  1 1.0  1 1.0 0
0 0 1 0 60 0.0 25 0.0  0 0.0 0
0 0 1 0 40 0.0 60 0.0 40 0.0 0
0 0 1 1 40 0.0  2 0.0 40 0.0 0
0 0 1 0  0 0.0 80 0.2 30 0.0 0
0 0 0 0  1 1.0  2 1.0  1 1.0 0
0 0 0 0 40 0.0  9 0.9  3 1.0 0
0 0 0 0 30 0.1 15 0.6 20 0.5 0
0 0 0 0  3 0.0  2 0.0  3 0.0 0
0 0 0 0  0 0.0  4 0.0  2 1.0 0
0 0 0 0  6 0.0  5 0.2  0 0.0 0
0 0 0 0 45 0.0  6 0.0  0 0.0 0
0 0 0 0  2 1.0  5 0.0  3 1.0 0
0 0 0 0  2 1.0 45 0.0 50 0.0 1
0 0 0 0 50 0.0 40 0.1 45 0.0 1
0 0 0 0 50 0.0 35 0.0  3 0.5 1
0 0 0 0 45 0.0  5 0.0 50 0.0 1
0 0 0 0 30 0.0  9 0.0 28 0.1 1
0 0 0 0 20 0.0 22 0.0 19 0.0 1
0 0 0 0  8 0.0 30 0.0 24 0.0 1
0 0 0 1  4 1.0  7 0.0 45 0.0 1
0 0 0 1 40 0.0  3 0.0 40 0.0 1
0 0 0 1 30 0.0  2 0.0  3 1.0 0
0 0 0 1  0 0.0  2 0.0  4 1.0 0
0 0 0 0  0 0.0 25 0.0  0 0.0 1
"""


def training_table() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([[float(x) for x in line.split()] for line in LABELLED.split("\n") if line.strip()])
    return rows[:, :-1], rows[:, -1].astype(int)


def grow(x: np.ndarray, y: np.ndarray):
    """A decision tree: (feature, threshold, below, above) or a label."""
    if y.min() == y.max():
        return int(y[0])
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            gini = sum(len(p) * (1 - p.mean() ** 2 - (1 - p.mean()) ** 2) for p in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(t), low)
    if best is None:
        return int(round(y.mean()))
    _, f, t, low = best
    return f, t, grow(x[low], y[low]), grow(x[~low], y[~low])


def decide(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _aside(tag: str, attrs: str, inside: bool) -> bool:
    """``inside`` an article a header holds the article's own heading."""
    if tag in ASIDE and not (inside and tag == "header"):
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            marks = MARKS.intersection(_PART.findall(_CAMEL.sub(" ", value).lower()))
            if marks - {"header"} or marks and not inside:
                return True
        if name == "role" and ROLES.intersection(value.lower().split()):
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Page:
    def __init__(self):
        self.blocks: list[list] = []  # text, words, linked words, in_article, aside, heading
        self.stack: list[tuple[str, bool, bool, bool, tuple | None]] = []  # tag; article, aside, heading of what is inside it; what an inline element interrupts
        self.parts: list[str] = []
        self.link = -1  # depth at which a link was opened
        self.linked = 0
        self.has_article = False

    def inside(self) -> tuple[bool, bool, bool]:
        return self.stack[-1][1:4] if self.stack else (False, False, False)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            self.parts = []
            if text:
                self.blocks.append([text, text.count(" ") + 1, self.linked, *self.inside()])
        self.linked = 0

    def text(self, s: str) -> None:
        if s:
            self.parts.append(s)
            if self.link >= 0:
                self.linked += len(s.split())

    def anchor(self, end: bool) -> None:
        self.link = -1 if end else len(self.stack)

    def inline(self, tag: str, attrs: str) -> None:
        """An inline or custom element: only what is marked has a place on the stack."""
        article, aside, heading = self.inside()
        words = MARKS.intersection(tag.split("-")) if "-" in tag else ()
        if (words or attrs and _aside(tag, attrs, article)) and not any(x[0] == "pre" for x in self.stack):
            self.stack.append((tag, article, True, heading, (self.parts, self.linked)))
            self.parts, self.linked = [], 0

    def open(self, tag: str, attrs: str) -> None:
        self.flush()
        article, _, _ = self.inside()
        article_here = tag in ("article", "main") or "role" in attrs and bool(re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I))
        self.has_article |= article_here
        own = _aside(tag, attrs, article)
        if tag in VOID:
            return
        if tag in ("p", *HEADING):  # paragraphs end where the next begins
            self.end({"p", *HEADING}, 1)
        elif tag == "li":
            self.end({"p", "li"}, 2)
        article, aside, heading = self.inside()
        self.stack.append((tag, article or article_here, aside or own, heading or tag in HEADING, None))

    def end(self, tags: set, depth: int) -> None:
        while depth and self.stack and self.stack[-1][0] in tags:
            self.unwind(len(self.stack) - 1)
            depth -= 1

    def unwind(self, depth: int) -> None:
        """Close all elements beyond ``depth``."""
        while len(self.stack) > depth:
            self.flush()
            before = self.stack.pop()[4]
            if before is not None:
                self.parts, self.linked = before
        if self.link > depth:
            self.link = -1

    def close(self, tag: str) -> None:
        block = tag in BLOCK
        if block:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.unwind(i)
                return
            if self.stack[i][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html") or not block and self.stack[i][4] is None:
                return  # a stray end tag does not leave the article, and that of an inline element no block


def read_blocks(page: str) -> _Page:
    p, at = _Page(), 0
    for m in _TOKEN.finditer(page):
        p.text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            p.anchor(bool(m["end"]))
        if m["end"]:
            p.close(tag)
        elif tag in BLOCK:
            p.open(tag, m["attrs"] or "")
        else:
            p.inline(tag, m["attrs"] or "")
    p.text(page[at:])
    p.unwind(0)
    p.flush()
    return p


def main_text(page: str | None, tree) -> str:
    if not page:
        return ""
    p = read_blocks(page)
    shape = [(w, min(1.0, k / w)) for _, w, k, *_ in p.blocks]
    out = []
    for i, (text, w, _, article, aside, heading) in enumerate(p.blocks):
        before = shape[i - 1] if i else (0, 0.0)
        behind = shape[i + 1] if i + 1 < len(shape) else (0, 0.0)
        if decide(tree, (p.has_article, article, aside, heading, *before, *shape[i], *behind)):
            out.append(text)
    return "\n".join(out)


def _extract(batches, tree):
    for batch in batches:
        texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = grow(*training_table())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_batches(rows, lambda b: _extract(b, tree), "page_id long, url string, text string, n_chars long")
