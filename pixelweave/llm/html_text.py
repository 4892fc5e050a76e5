"""Operator 9: main text of web pages by a maximum-scoring subsequence.

A page is a sequence of text runs and tags. Words score +1, tags below 0; one linear scan finds the contiguous region with the
largest sum, and its words are the main text. A tag's weight is the log of how much rarer it is inside the content than
outside, learnt from labelled pages: those whose markup names the content itself (one ``article`` or ``main`` element that is in
no other). On a page that names its content so, other words score 0. The weights are learnt on at most ``MAX_FIT`` different pages,
the first by a hash of the id and the markup.

Elements that the HTML standard has for anything but content (menus, footers, side notes, forms, scripts ...) score 0 and are left
out of the region. So are elements whose role, or one of whose class and id names, read as words, says so (``cookie-notice``,
``readerComments``, not ``has-sidebar``), unless nothing would be left: then the names don't count.

Markup is read as the standard has it, in time linear in the page: attributes may be quoted or not, names have any case, an end tag
closes what is open inside its element, ``p`` ends where a block begins, an end tag without a start is nothing. An
element that the page never closes excludes nothing. Character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by one space. Null or empty html, and pages without words, give an empty text. Repeated
rows are treated alike; of equal sums the first region counts.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, working

MAX_FIT = 5_000
#: Weight of tags that the labelled pages don't have, and the range of learnt weights.
UNSEEN, LEAST, MOST = -0.5, -8.0, -0.02
# Fixed values of the HTML standard and of common usage.
RAW = frozenset({"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "select", "canvas", "audio", "video", "xmp", "noembed", "noframes"})
NEVER = frozenset({"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset", "datalist"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
INLINE = frozenset({"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"})
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"})
NAMES = frozenset({"ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets"})
#: What may follow such a name; what before it turns its sense; what a header may belong to that is content.
BESIDE = frozenset({"area", "author", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "inner", "item", "items", "left", "link", "links", "list", "page", "posts", "right", "section", "site", "text", "title", "top", "wrap", "wrapper"})
TURNED = frozenset({"has", "hide", "is", "no", "not", "show", "with", "without"})
CONTENT = frozenset({"article", "body", "content", "entry", "main", "post", "story", "text"})
CORE = frozenset({"article", "main"})
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+>|</>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+)*+)>",
    re.S,
)
OVER = re.compile(r"^<!---?>|--!?>$")
NAMED = re.compile(r"(?<![^\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLOSER = re.compile(r"</([a-zA-Z][^\s/>]*+)")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _named(attributes: str) -> bool:
    """Whether a role, a class or an id says that an element isn't content."""
    for m in NAMED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in ROLES:
                return True
        elif any(_says_so([x.lower() for x in PARTS.findall(name)]) for name in value.split()):
            return True
    return False


def _says_so(parts: list[str]) -> bool:
    """Whether a name of these words is that of something else than content: its last word says what it is (reader-comments), or its
    first one whose part (comment-list)."""
    if not parts or parts[0] in TURNED:
        return False
    if parts[-1] in NAMES:
        return not (parts[-1] == "header" and parts[0] in CONTENT)
    return parts[0] in NAMES and all(x in NAMES or x in BESIDE for x in parts)


class Page:
    """Items of a page: texts (None for a tag), keys (the tag's name, "" for texts and what has no weight), blocks (whether the tag ends
    one); how many excluded elements, by their kind and by their names, and how many core elements are open at each."""

    def __init__(self, page: str) -> None:
        self.texts: list[str | None] = []
        self.keys: list[str] = []
        self.blocks: list[bool] = []
        self.cores = 0  # core elements in no other
        self._page = page
        self._spans: tuple[list, list, list] = ([], [], [])  # excluded by kind, by name; core
        self._stack: list[tuple[str, bool, int, int]] = []  # name, block, first item, which list of spans or -1
        self._at: dict[str, list[int]] = {}  # where a name is in the stack
        self._block: list[int] = []  # where blocks are
        self._inside = 0
        self._read()
        n = len(self.texts)
        self.kind, self.name, self.core = (_depths(x, n) for x in self._spans)

    def _add(self, text: str | None, key: str = "", block: bool = False) -> None:
        self.texts.append(text)
        self.keys.append(key)
        self.blocks.append(block)

    def _read(self) -> None:
        page, pos, at = self._page, 0, 0
        closers: dict[str, list[int]] | None = None
        for_end = page.rfind(">")
        while True:
            m = TOKEN.search(page, pos, for_end + 1) if pos <= for_end or page.find("<!--", pos) < 0 else TOKEN.search(page, pos)
            if m is None:
                if at < len(page):
                    # a comment may begin after the last ">"
                    end = page.find("<!", max(at, for_end + 1))
                    self._add(page[at : end if end >= 0 else len(page)])
                break
            if m.start() > at:
                self._add(page[at : m.start()])
            pos = at = m.end()
            if m[2] is None:  # comment, declaration
                if pos == for_end + 1 and m[0].startswith("<!--") and not OVER.search(m[0]):  # the search ended, not the comment
                    pos = at = len(page)
                continue
            close, name = bool(m[1]), m[2].lower()
            if close:
                self._close(name)
            elif name in RAW and not (m[3].endswith("/") and name in ("svg", "math")):
                self._add(None, "", name not in INLINE)
                if closers is None:
                    closers = {}
                    for c in CLOSER.finditer(page):
                        closers.setdefault(c[1].lower(), []).append(c.start())
                ends = closers.get(name, [])
                i = bisect_left(ends, pos)
                if i < len(ends):
                    stop = page.find(">", ends[i])
                    pos = at = len(page) if stop < 0 else stop + 1
                elif name in ("script", "style"):
                    pos = at = len(page)
            else:
                self._open(name, m[3])
        while self._stack:  # what is never closed excludes nothing, but is content
            name, _, first, span = self._stack[-1]
            if span == 2:
                self._spans[2].append((first, len(self.texts)))
            self._pop()

    def _open(self, name: str, attributes: str) -> None:
        block = name not in INLINE and name != "p"
        if (block or name == "p") and self._at.get("p") and self._at["p"][-1] > (self._block[-1] if self._block else -1):
            self._end(self._at["p"][-1])
        if name not in VOID:
            span = -1
            if name in NEVER or (name == "header" and not self._inside):
                span = 0
            elif name in CORE and not self._inside:
                span, self.cores = 2, self.cores + 1
            elif name not in ("body", "html") and attributes and _named(attributes):
                span = 1
            self._at.setdefault(name, []).append(len(self._stack))
            if block:
                self._block.append(len(self._stack))
            self._stack.append((name, block, len(self.texts), span))
            self._inside += span == 2
        self._add(None, "" if name in CORE else name, name not in INLINE)

    def _close(self, name: str) -> None:
        self._add(None, "" if name in CORE else name, name not in INLINE)
        own = self._at.get(name)
        if own and (self._stack[own[-1]][1] or own[-1] > (self._block[-1] if self._block else -1)):
            self._end(own[-1])

    def _end(self, at: int) -> None:
        """Closes the element there and all that is open in it."""
        while len(self._stack) > at:
            _, _, first, span = self._stack[-1]
            if span >= 0:
                self._spans[span].append((first, len(self.texts)))
            self._pop()

    def _pop(self) -> None:
        name, block, _, span = self._stack.pop()
        self._at[name].pop()
        if block:
            self._block.pop()
        self._inside -= span == 2


def _depths(spans: list[tuple[int, int]], n: int) -> list[int]:
    """How many of the spans hold each of n items."""
    if not spans:
        return [0] * n
    steps = [0] * (n + 1)
    for a, b in spans:
        steps[a] += 1
        steps[b] -= 1
    out, now = [], 0
    for x in steps[:n]:
        now += x
        out.append(now)
    return out


def tag_counts(page: str) -> Counter | None:
    """(key, inside) counts of a labelled page, None if the page doesn't name its content. Tags of excluded elements don't count."""
    read = Page(page)
    if read.cores != 1:
        return None
    return Counter((key, bool(core)) for key, core, a, b in zip(read.keys, read.core, read.kind, read.name, strict=True) if key and not a and not b)


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights by key from (inside, outside) counts."""
    inside, outside = sum(a for a, _ in counts.values()), sum(b for _, b in counts.values())
    return {key: max(LEAST, min(MOST, math.log((a + 1) / (inside + 1)) - math.log((b + 1) / (outside + 1)))) for key, (a, b) in counts.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous items with the largest sum, the first of equals; (0, 0) if no sum is above 0."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str, weight: dict[str, float]) -> str:
    """The best region's text."""
    read = Page(page)
    for skip in ([a + b for a, b in zip(read.kind, read.name, strict=True)], read.kind):
        if read.cores == 1:  # outside the content that the page names
            skip = [x or not core for x, core in zip(skip, read.core, strict=True)]
        scores = [(0.0 if skip[i] else float(len(text.split()))) if text is not None else MOST if skip[i] or not key else weight.get(key, UNSEEN) for i, (text, key) in enumerate(zip(read.texts, read.keys, strict=True))]
        first, end = best_region(scores)
        parts = []
        for i in range(first, end):
            text = read.texts[i]
            if text is not None:
                if not skip[i]:
                    parts.append(html.unescape(text) if "&" in text else text)
            elif read.blocks[i]:
                parts.append(" ")
        if found := " ".join("".join(parts).split()):
            return found
    return ""


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for piece in pieces(batch, 0):
            for page in piece.column(0).to_pylist():
                total.update(tag_counts(page or "") or {})
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([total[k] if k[1] else 0 for k in keys], pa.int64()), pa.array([0 if k[1] else total[k] for k in keys], pa.int64())], names=["key", "inside", "outside"])


def fit(pages: DataFrame, max_fit: int = MAX_FIT) -> dict[str, float]:
    """Weights from those of at most max_fit pages that name their content; a name and two numbers for each tag of theirs reach the driver."""
    order = [F.xxhash64("page_id").alias("h"), F.xxhash64("html").alias("h2")]
    # the bound of the sample comes from hashes alone; only its pages' markup is read and counted
    last = pages.select(*order).distinct().orderBy("h", "h2").limit(max_fit).agg(F.max(F.struct("h", "h2")).alias("x")).first().x
    if last is None:
        return {}
    sample = pages.select(*order, "html").where((F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("h2") <= last.h2))).dropDuplicates(["h", "h2"])
    got = sample.select("html").mapInArrow(_counted, "key string, inside bigint, outside bigint").groupBy("key").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    return weights({r.key: (r.a, r.b) for r in got.collect()})


def extract(pages: DataFrame, weight: dict[str, float]) -> DataFrame:
    """page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("html")
        for batch in batches:
            for piece in pieces(batch, 2):
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([main_text(x or "", weight) for x in piece.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string")
