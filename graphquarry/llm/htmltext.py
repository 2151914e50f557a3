"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Scripts, styles and the like have no text; blocks in menus,
headers, footers, sidebars, forms, and elements with a whole class, id or role that says advert, notice or comments
are boilerplate outright. Where the word is only part of a class, id or role, the name weighs: only what is long, with
many stop words and few links, is content there. Wrappers are exempt: the first article element, an element with a part
of a name that holds main, a first-level heading or most of the text, and one with a whole name that holds both one
of these two and most of the text. The first pass decides on the rest by length, link density and the share of stop
words: much linked text is boilerplate, long text with many stop words is content, and what is short or
middling stays open. The second pass gives each open block the label of its nearest decided neighbours: both
sides agreeing, or content if they differ and the block leans to it, or the nearer side. An article or main
element is one more evidence: inside it shorter text with fewer stop words is content and the rest leans to it,
outside it only what is content on its own is. If it holds text that the rules call content, its edge counts as
boilerplate for open blocks outside; if the rules call no block content, its open blocks are taken.

Defined cases: null or empty HTML gives an empty text; without any decided block, open blocks are content if
they hold more text than links; white space, also no-break space, becomes one space; a line break
counts as white space; blocks without text vanish.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from graphquarry.llm.common import table

SHORT_CHARS = 70
LONG_CHARS = 200
MAX_LINK_DENSITY = 0.33
MAX_LINK_DENSITY_INSIDE = 0.6
FEW_STOP_WORDS = 0.18
LEAST_STOP_WORDS = 0.09
MANY_STOP_WORDS = 0.28

# Tag, attribute and stop-word lists: fixed values.
BLOCK_TAGS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
))
VOID_TAGS = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
))
SKIPPED_TAGS = frozenset((
    "applet", "aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "frameset", "head", "header",
    "iframe", "map", "menu", "nav", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title", "video",
))
SKIPPED_NAMES = frozenset((
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus",
    "footer", "gdpr", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notification", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply",
    "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription",
    "toolbar", "widget", "widgets",
))
NEVER_SKIPPED = frozenset(("html", "body", "main"))
STOP_WORDS = frozenset((
    "a", "about", "after", "all", "also", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "for", "from", "had",
    "has", "have", "he", "her", "his", "i", "if", "in", "is", "it", "its", "more", "no", "not", "of", "on", "only", "or", "other",
    "out", "she", "so", "some", "than", "that", "the", "their", "them", "then", "there", "they", "this", "to", "was", "we",
    "were", "what", "when", "which", "who", "will", "with", "would", "you",
    "aber", "als", "am", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "durch", "ein", "eine", "einer",
    "er", "es", "für", "hat", "ich", "im", "ist", "mit", "nach", "nicht", "noch", "oder", "sich", "sie", "sind", "über", "um",
    "und", "von", "vor", "war", "wie", "wird", "zu", "zum", "zur",
    "au", "aux", "avec", "ce", "cette", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "mais", "ne",
    "nous", "ou", "par", "pas", "plus", "pour", "que", "qui", "sa", "se", "ses", "son", "sur", "un", "une", "vous",
    "al", "como", "con", "del", "el", "entre", "esta", "este", "ha", "las", "lo", "los", "más", "muy", "para", "pero", "por",
    "sin", "sobre", "su", "sus", "también", "una", "y", "ya",
))

_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    inside: bool
    skipped: bool
    label: str = ""
    names: tuple[int, ...] = ()  # elements around it with a name on the list
    weighs: bool = False


class Cutter(HTMLParser):
    """Cuts a page into blocks; tags that are never closed end with whatever closes around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []
        self.counts: Counter[str] = Counter()
        self.skips = self.articles = self.links = 0
        self.names: tuple[int, ...] = ()
        self.whole: list[bool] = []
        self.holders: set[int] = set()
        self.seen_article = False
        self.parts: list[str] = []
        self.linked = 0
        self.heading = False
        self.blocks: list[Block] = []

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(
                text, min(self.linked, len(text)), self.heading, self.articles > 0, self.skips > 0,
                names=self.names,
            ))
        self.parts.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.shut()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        whole = part = False
        for name, value in attrs:
            if name in ("class", "id", "role") and value and tag not in NEVER_SKIPPED:
                whole |= not SKIPPED_NAMES.isdisjoint(value.lower().split())
                part |= not SKIPPED_NAMES.isdisjoint(map(str.lower, _NAME.findall(value)))
        first = tag == "article" and not self.skips and not self.seen_article
        self.seen_article |= first
        if tag in ("main", "h1") and not self.skips:
            self.holders.update(self.names)
        skipped = tag in SKIPPED_TAGS
        named = part and not first
        if named:
            self.names += (len(self.whole),)
            self.whole.append(whole)
        self.open.append((tag, skipped, named))
        self.counts[tag] += 1
        self.skips += skipped
        self.articles += tag in ("article", "main")
        self.links += tag == "a"
        self.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") or (self.heading and tag not in BLOCK_TAGS)

    def shut(self) -> None:
        tag, skipped, named = self.open.pop()
        self.counts[tag] -= 1
        if tag in BLOCK_TAGS:
            self.flush()
            self.heading = False
        self.skips -= skipped
        if named:
            self.names = self.names[:-1]
        self.articles -= tag in ("article", "main")
        self.links -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if self.counts[tag]:
            while self.open[-1][0] != tag:
                self.shut()
            self.shut()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, a slash does not close an element

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def first_pass(b: Block, marked: bool = False) -> str:
    """content, boilerplate, or open with a leaning: near, short; ``marked`` pages have an article element."""
    inside = b.inside and not b.weighs
    density = b.linked / len(b.text)
    if b.skipped or density > (MAX_LINK_DENSITY_INSIDE if inside else MAX_LINK_DENSITY):
        return "boilerplate"
    if b.text.startswith(("©", "Copyright ")):
        return "boilerplate"
    n = len(b.text)
    if n < SHORT_CHARS:
        if b.weighs:
            return "boilerplate"
        if inside:
            return "near"
        return "near" if b.heading and not marked else "boilerplate" if b.linked else "short"
    words = _LETTERS.findall(b.text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)
    if inside:
        return "content" if stops >= (LEAST_STOP_WORDS if n >= LONG_CHARS else FEW_STOP_WORDS) else "near"
    if stops >= MANY_STOP_WORDS and n >= LONG_CHARS:
        return "content"
    if b.weighs:
        return "boilerplate"
    if marked:
        return "short"
    return "near" if stops >= FEW_STOP_WORDS or n >= LONG_CHARS else "short"


def second_pass(labels: list[str]) -> list[str]:
    """Open labels replaced by those of the nearest decided blocks before and after."""
    decided = ("content", "boilerplate")
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(n):
        before[i] = i if labels[i] in decided else before[i - 1] if i else -1
    for i in reversed(range(n)):
        after[i] = i if labels[i] in decided else after[i + 1] if i + 1 < n else n
    out = []
    for i, label in enumerate(labels):
        a, b = before[i], after[i]
        sides = {labels[k] for k in (a, b) if 0 <= k < n}
        if label in decided:
            out.append(label)
        elif not sides:
            out.append("content")
        elif len(sides) == 1:
            out.append(sides.pop())
        elif label == "near":
            out.append("content")
        else:
            out.append(labels[a] if i - a <= b - i else labels[b])
    return out


def blocks(html: str | None) -> list[Block]:
    """All blocks of a page with their labels."""
    if not html:
        return []
    cutter = Cutter()
    cutter.feed(html)
    if cutter.rawdata.startswith("<!--"):  # a comment that never ends
        cutter.rawdata = ""
    cutter.close()
    cutter.flush()
    found = cutter.blocks
    settle_names(found, cutter.whole, cutter.holders)
    marked = any(b.inside and not b.skipped for b in found)
    for b in found:
        b.label = first_pass(b, marked)
    within = [b for b in found if b.inside and not b.skipped]
    if any(b.label == "content" for b in within):
        decide(within)
        # the article's edge is boilerplate to what stands open outside
        edge = Block("", 0, False, True, False, "boilerplate")
        decide([edge, *(edge if b.inside else b for b in found), edge])
    elif marked and all(b.label != "content" for b in found):
        for b in found:
            if b.label != "boilerplate":
                b.label = "content" if b.inside else "boilerplate"
    else:
        decide(found)
    return found


def settle_names(found: list[Block], whole: list[bool], holders: set[int]) -> None:
    """Skip blocks in elements with a whole name and weigh those with part of one, but not in the page's wrappers."""
    held: Counter[int] = Counter()
    total = 0
    for b in found:
        if not b.skipped and b.linked <= MAX_LINK_DENSITY * len(b.text):
            total += len(b.text)
            for number in b.names:
                held[number] += len(b.text)
    most = {number for number, n in held.items() if n * 2 > total}
    for b in found:
        for number in b.names:
            if whole[number]:
                b.skipped |= number not in most or number not in holders
            else:
                b.weighs |= number not in most and number not in holders


def decide(row: list[Block]) -> None:
    for b, label in zip(row, second_pass([b.label for b in row]), strict=True):
        b.label = label


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in blocks(html) if b.label == "content")


@arrow_udf(from_arrow_type(pa.string()))
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of every page; a column already named ``text`` is replaced."""
    return pages.withColumn(text, _main_text(F.col(html)))


def query(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
