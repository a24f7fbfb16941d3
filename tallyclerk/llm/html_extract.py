"""Main text of web pages by tree scoring.

A page becomes a tree of elements (with the implied ends of HTML: a paragraph ends where the next
block begins, and so on). Elements that by tag, role or name are no article text - menus, footers,
forms, adverts, comments and the like - are out with all they hold. A form, or an element that only its
name speaks against, is a wrapper and not out if it holds the only article or main element with text, or, in
a page without one, more than half of the text when next to none is left outside. Each remaining block of text
gives points for its length and its commas, less the share of its text in links, to its parent in
full and to LEVELS further containers less. A name speaks against running text only if it says nothing else,
and a fieldset is out only if it holds a control. Parsing and scoring are linear in the page. The container with the most points, less its own link
share, is kept - widened to the article or main element around it - and with it those siblings of its kind that also score or have its class.

Pages are independent rows: one pass in Arrow batches, no shuffle.

Odd input: null and empty html give an empty text; broken markup is read as a browser would, roughly;
a tag that never ends ends the page; repeated rows are extracted each; an empty table gives an empty result.
Columns other than page_id, url, html are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

# Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDED_BY = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDED_BY = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDED_BY.items()}
SCOPES = frozenset("td th caption button html body object template".split())
OUT_TAGS = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea iframe svg canvas object audio video map dialog menu label datalist search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination header masthead topbar toolbar footer foot"
    " sidebar sidebars aside rail widget widgets related recommended recommendations popular trending"
    " comment comments commentlist disqus respond replies reply discussion"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall disclaimer"
    " share sharing social subscribe subscription newsletter signup login form search hidden".split())
KEEP_TAGS = frozenset("html body article main".split())
#: Elements of running text: a name speaks against them only if nothing in it says otherwise.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figure figcaption caption".split())
#: What makes a fieldset part of a form.
CONTROLS = frozenset("input select textarea button".split())
#: Containers above a block of text that get points from it.
LEVELS = 8
#: What can hold an article; lists, tables and quotes only pass points on.
CONTAINERS = frozenset("div section article main body #page".split())
GOOD_NAMES = frozenset("article content entry post story text main body page".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z|[^<]++|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|\d+")
CLASS_OR_ID = re.compile(r"(?:class|id)\s*=\s*[\"']?([^\"'>]*)", re.I)
CLASS = re.compile(r"class\s*=\s*[\"']?([^\"'>]*)", re.I)


#: What speaks against an element: nothing, its name or being a form, or anything else.
FINE, DOUBTFUL, OUT = range(3)
#: Share of the text that is next to none.
LEFT = 0.1


def is_out(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is no part of an article, judged by itself: FINE, DOUBTFUL or OUT."""
    if tag in OUT_TAGS and tag != "form" or tag == "header" and not in_article:
        return OUT
    if not attributes or tag in KEEP_TAGS:
        return DOUBTFUL if tag == "form" else FINE
    named = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return OUT
        if key == "role" and value.lower() in OUT_ROLES and value.lower() != "form":
            return OUT
        if key == "role" and value.lower() == "form":
            named.append("form")
        if key in ("class", "id"):
            named += value.split()
    for name in named:
        parts = [p.lower() for p in NAME.findall(name)]
        if tag in PROSE and not all(p in OUT_NAMES or p.isdigit() for p in parts):
            continue
        for i, part in enumerate(parts):
            if part in OUT_NAMES and not (i and parts[i - 1] in ("no", "has", "with", "without")):
                return DOUBTFUL
    return DOUBTFUL if tag == "form" else FINE


class Page:
    """Elements in page order (parents first) and the texts and breaks between them."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.judged, self.article, self.good, self.names = ["#page"], [-1], [FINE], [False], [False], [""]
        # Places in the stack of what is open, by tag and of all blocks: no search walks the stack.
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.boxes: set[int] = set()  # fieldsets without a control so far
        self.pieces: list[tuple[int, str | None]] = []
        stack = [0]
        for m in TOKEN.finditer(html):
            name = m[3] or m[6]
            if name is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    self.pieces.append((stack[-1], unescape(text) if "&" in text else text))
                continue
            name = name.lower()
            if m[2] or m[5]:
                self._end(stack, name)
            else:
                self._start(stack, name, m[4] if m[3] else m[7])
        for i in self.boxes:
            self.judged[i] = FINE
        self._leave_out()

    def _last(self, tags: frozenset[str]) -> int:
        """The highest place in the stack of any of the tags; 0 if none is open."""
        return max((at[-1] for tag in tags if (at := self.where.get(tag))), default=0)

    def _cut(self, stack: list[int], to: int) -> None:
        """Close the elements of the stack from place `to` on."""
        if any(self.tag[i] not in INLINE for i in stack[to:]):
            self.pieces.append((stack[to - 1], None))
        for i in stack[to:]:
            self.where[self.tag[i]].pop()
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()
        del stack[to:]

    def _start(self, stack: list[int], name: str, attributes: str) -> None:
        if name in ENDS_PARAGRAPH and (at := self.where.get("p")) and at[-1] > self._last(SCOPES):
            self._cut(stack, at[-1])
        if name in ENDED_BY:
            ended, scope = ENDED_BY[name]
            k = self._last(scope)
            first = min((at[n] for tag in ended if (at := self.where.get(tag)) and (n := bisect_right(at, k)) < len(at)), default=0)
            if first:
                self._cut(stack, first)
        top = stack[-1]
        if name not in INLINE:
            self.pieces.append((top, None))
        if name in CONTROLS and (at := self.where.get("fieldset")):
            self.boxes.discard(stack[at[-1]])
        if name in VOID:
            return
        self.parent.append(top)
        self.tag.append(name)
        self.judged.append(DOUBTFUL if name == "fieldset" else is_out(name, attributes, self.article[top]))
        self.article.append(self.article[top] or name in ("article", "main"))
        named = [m[1] for m in CLASS_OR_ID.finditer(attributes)] if attributes else []
        self.good.append(any(p.lower() in GOOD_NAMES for n in named for p in NAME.findall(n)))
        self.names.append(m[1].strip() if attributes and (m := CLASS.search(attributes)) else "")
        new = len(self.tag) - 1
        if name == "fieldset":
            self.boxes.add(new)
        if not attributes.rstrip().endswith("/") or name in INLINE or name in ENDS_PARAGRAPH:
            self.where.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                self.blocks.append(len(stack))
            stack.append(new)

    def _end(self, stack: list[int], name: str) -> None:
        at = self.where.get(name)
        if not at or name in INLINE and self.blocks and self.blocks[-1] > at[-1] or name == "p" and self._last(SCOPES) > at[-1]:
            return
        self._cut(stack, at[-1])

    def _leave_out(self) -> None:
        """What is out, with all it holds; wrappers of the article are not."""
        n = len(self.tag)

        def inherited(least: int) -> list[bool]:
            out = [False] * n
            for i in range(1, n):
                out[i] = out[self.parent[i]] or self.judged[i] >= least
            return out

        self.out = inherited(DOUBTFUL)
        if DOUBTFUL not in self.judged:
            return
        surely, size = inherited(OUT), [0] * n
        for i, piece in self.pieces:
            if piece and not surely[i]:
                size[i] += len(piece.strip())
        left, all_ = sum(s for s, o in zip(size, self.out, strict=True) if not o), sum(size)
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        main = [i for i in range(n) if self.tag[i] in ("article", "main") and size[i] and not surely[i]]
        wrappers: set[int] = set()
        if main and all(self.out[i] for i in main):
            for i in main:
                while i > 0 and i not in wrappers:
                    wrappers.add(i)
                    i = self.parent[i]
        elif not main and left < LEFT * all_:
            wrappers = {i for i in range(n) if 2 * size[i] > all_}
        if wrappers:
            for i in wrappers:
                self.judged[i] = FINE
            self.out = inherited(DOUBTFUL)

    def text(self) -> str:
        n = len(self.tag)
        length, links, commas = [0] * n, [0] * n, [0] * n  # of the texts right in a block
        block, linked = list(range(n)), [False] * n
        for i in range(1, n):
            inline = self.tag[i] in INLINE
            block[i] = block[self.parent[i]] if inline else i
            linked[i] = inline and linked[self.parent[i]] or self.tag[i] == "a"
        for i, piece in self.pieces:
            if piece and not self.out[i] and (size := len(piece.strip())):
                length[block[i]] += size
                links[block[i]] += size * linked[i]
                commas[block[i]] += piece.count(",")
        score, total, total_links = [0.0] * n, length[:], links[:]
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += total[i]
            total_links[self.parent[i]] += total_links[i]
        near = [-1] * n  # the container that an element is or is in
        for i in range(n):
            near[i] = i if self.tag[i] in CONTAINERS or self.tag[i] == "td" else near[self.parent[i]] if i else -1
        for i in range(n):
            if length[i]:
                points = (1 + commas[i] + min(3, length[i] / 100)) * (1 - links[i] / length[i])
                at, far = near[i if self.tag[i] in CONTAINERS else self.parent[i]] if i or self.tag[i] in CONTAINERS else -1, 0
                while at >= 0 and points and far < LEVELS:
                    score[at] += points / (1 if not far else 2 if far == 1 else 3 * far)
                    far += 1
                    at = near[self.parent[at]] if at else -1
        for i in range(n):
            score[i] *= (1 - total_links[i] / total[i] if total[i] else 0) * (1.5 if self.tag[i] in ("article", "main") else 1.25 if self.good[i] else 1)
        usable = [i for i in range(n) if not self.out[i] and self.tag[i] not in INLINE and total[i]]
        if not usable:
            return ""
        best = max(usable, key=lambda i: (score[i], -i))
        if not score[best]:  # nothing but links and the like: the article if there is one, else all
            best = next((i for i in usable if self.tag[i] in ("article", "main")), 0)
        at = best
        while at > 0 and self.tag[at] not in ("article", "main"):
            at = self.parent[at]
        best = at if at > 0 else best
        kept = [False] * n
        for i in usable:
            beside = self.parent[i] == self.parent[best] and best > 0
            alike = self.tag[i] == self.tag[best]
            same = alike and self.names[i] and self.names[i] == self.names[best] and total_links[i] < 0.25 * total[i]
            if i == best or beside and (same or alike and score[i] >= 0.2 * score[best] or self.tag[i] == "p" and length[i] > 80 and links[i] < 0.25 * length[i]):
                kept[i] = True
        for i in range(1, n):
            kept[i] = kept[i] or kept[self.parent[i]]
        return " ".join("".join(" " if p is None else p for i, p in self.pieces if kept[i] and not self.out[i]).split())


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return by_bytes(pages).select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string")
