"""HTML main-text extraction by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import small_batches

#: A quote opens a value only after "="; one that never closes is a plain character.
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)(" + _ATTRIBUTES + r")(?:>|\Z)|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/][^\s=/]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?")
_HEADING = re.compile(r"h[1-6]\Z")
_PUNCTUATION = re.compile(r"[.,;:!?。，！？…]")
#: Elements whose content is not text, up to their own end tag.
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "object", "canvas", "xmp"}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not start a block of their own.
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img",
}
#: Elements that end an open paragraph.
_ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements, and words in class, id or role, that say what is not main text: the first words as all that a name says, the others also as its first or last word.
_NOT_MAIN = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "head"}
_NOT_MAIN_WORDS = {
    "banner", "nav", "navbar", "navigation", "menu", "aside", "footer", "header", "masthead", "notice", "notices", "modal", "subscription", "signup",
    "login", "widget", "toolbar", "pagination", "pager", "legal", "copyright", "contentinfo", "complementary", "search", "alert",
}
_FOREIGN_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "breadcrumb", "breadcrumbs", "sidebar",
    "cookie", "cookies", "consent", "gdpr", "popup", "newsletter", "subscribe", "share", "sharing", "social", "related", "recommended", "comment",
    "comments", "reply", "replies", "disqus",
}
#: First words that turn such a name around: "has-sidebar", "no-comments".
_ABOUT_OTHERS = {"has", "no", "not", "with", "without", "hide", "show"}
#: Words that leave a class such as "site-footer" what its other words say.
_NEUTRAL_WORDS = {
    "site", "top", "bottom", "left", "right", "main", "primary", "secondary", "container", "wrapper", "wrap", "box", "block", "bar", "area", "section",
    "list", "links", "item", "items", "inner", "outer", "global", "posts", "module", "form", "button", "buttons", "icons", "slot",
}
#: Of the elements in _NOT_MAIN and those with such words, these may also wrap main text.
_MAY_WRAP = {"form", "fieldset"}
_MAIN = {"article", "main"}
#: Share of the best path's score that a path needs.
THRESHOLD = 0.1
#: Weight of a path outside the article and main elements of a page that has such.
OUTSIDE = 0.02
#: Text and marks per node beyond which a path's ratios grow no more: one endless paragraph leaves short items beside it their share.
MOST_TEXT, MOST_MARKS = 500, 15


@dataclass(slots=True)
class _Mark:
    """A boilerplate mark of an open element, linked to the next one around it."""

    around: _Mark | None
    within: bool  # whether it lies in an article or main element, or is that of one
    holds: bool  # whether it holds for whatever is in its element
    prose: int = 0
    void: bool = False


@dataclass(slots=True)
class _Open:
    """An open element and what it hands on to those in it, so that no step walks up the page."""

    tag: str
    path: int  # number of its tag path; inline elements have that of their block
    mark: _Mark | None
    region: int  # number of the outermost article or main element, or 0
    apart: bool  # whether it is marked inline text


@dataclass
class Block:
    """Text of one node: its path from the root, words, and how much of it is link text."""

    path: int  # equal for equal paths of a page
    container: tuple  # its article or main element (the outermost), else the parent's path
    main: bool
    heading: bool
    item: bool
    mark: _Mark | None
    boilerplate: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    pointed: int = 0  # text of links to places of the same page

    @cached_property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())

    @property
    def prose(self) -> int:
        """Code points of text, links counting against it."""
        return max(0, len(self.text) - 2 * self.linked)


def _tokens(page: str) -> Iterator[re.Match]:
    """Tokens of a page without what stands in raw elements: after such a start tag comes its own end tag, or nothing."""
    at: int | None = 0
    while at is not None:
        start, at = at, None
        for m in _TOKEN.finditer(page, start):
            yield m
            tag = (m[1] or "").lower()
            if tag in _RAW and m[0][1] != "/" and not m[0].endswith("/>"):
                end = _RAW_END[tag].search(page, m.end())
                at = end and end.start()
                break


class _Stack:
    """Open elements; where the last one of a tag stands is looked up, never searched."""

    def __init__(self) -> None:
        self.open: list[_Open] = [_Open("", 0, None, 0, False)]
        self.at: dict[str, list[int]] = defaultdict(list)

    def push(self, element: _Open) -> None:
        self.at[element.tag].append(len(self.open))
        self.open.append(element)

    def last(self, tags: set[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def end(self, tags: set[str], unless: set[str] = frozenset()) -> None:
        """Ends the innermost element of ``tags`` and what is open within it, unless one of ``unless`` stands between."""
        k = self.last(tags)
        if k and k >= self.last(unless):
            for element in reversed(self.open[k:]):
                self.at[element.tag].pop()
            del self.open[k:]


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in page order, broken markup included (unclosed, stray and cut-off tags).

    Time and memory go with the length of the page, however deep its elements lie.
    """
    found: list[Block] = []
    stack = _Stack()
    paths: dict[tuple[int, str], int] = {}
    above, headed, items = [0], [False], [False]  # by path: its parent's, whether it is in a heading, whether it ends in a list item
    marks: list[_Mark] = []
    around: list[_Mark | None] = [None]  # by article or main element: the innermost mark around it
    pointing: list[bool] = []  # by open link: whether it points into the page
    now: Block | None = None
    for m in _tokens(page or ""):
        token, tag = m[0], (m[1] or "").lower()
        if not tag:
            if token[0] == "<" and len(token) > 1:
                continue
            if now is None:
                if token.isspace():
                    continue
                top = stack.open[-1]
                if top.apart:
                    continue  # marked inline text, apart from its block
                container = ("main", top.region) if top.region else ("path", above[top.path])
                now = Block(top.path, container, top.region > 0, headed[top.path], items[top.path], top.mark)
                found.append(now)
            now.parts.append(token)
            links = stack.at["a"]
            if links:
                now.linked += len(token.strip())
                now.pointed += len(token.strip()) * pointing[len(links) - 1]
            continue
        if token[:2] == "</":
            if tag not in _INLINE:
                now = None
            stack.end({tag})
            continue
        if tag in _RAW:
            now = None
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag not in _INLINE:
            now = None
            if tag in _ENDS_P:
                stack.end({"p"}, {"table", "td", "th", "button"})
            if tag in _SIBLINGS:
                stack.end(_SIBLINGS[tag], {"ul", "ol", "dl", "table", "select"} if tag != "td" and tag != "th" else {"tr", "table"})
        if tag in _VOID or token.endswith("/>"):
            continue
        boiler, label, points = _marks(tag, m[2] or "")
        top = stack.open[-1]
        region, mark = top.region, top.mark
        if not region and (tag in _MAIN or "[role=main" in label):
            region = len(around)
            around.append(mark)
        elif tag == "header" and region:
            boiler = False  # an article's own head, its title
        if boiler:
            mark = _Mark(mark, region > 0, tag in _NOT_MAIN - _MAY_WRAP)
            marks.append(mark)
        path = top.path
        if tag not in _INLINE:
            path = paths.setdefault((path, label), len(above))
            if path == len(above):
                above.append(top.path)
                headed.append(headed[top.path] or _HEADING.match(tag) is not None)
                items.append(tag == "li")
        elif tag == "a":
            del pointing[len(stack.at["a"]) :]
            pointing.append(points)
        stack.push(_Open(tag, path, mark, region, tag in _INLINE and (boiler or top.apart)))
    found = [b for b in found if b.text]
    _settle(found, marks, around)
    return found


def _settle(found: list[Block], marks: list[_Mark], around: list[_Mark | None]) -> None:
    """Sets ``boilerplate``: a mark says nothing about an element that holds the main text.

    Such are the elements around the article or main element with the most text (comments and
    teasers, in article elements of their own, are shorter), and, within article and main elements or
    on a page without them, those that hold most of the text: over half of it and the first
    heading, or nine tenths where there is no heading. Navigation, footers and the like never do.

    ``marks`` come in page order, so those around one come before it, and sums are handed up from the last to the first.
    """
    main = any(b.main for b in found)
    base = [b for b in found if b.main or not main]
    size = sum(b.prose for b in base)
    for b in base:
        if b.mark is not None:
            b.mark.prose += b.prose
    for mark in reversed(marks):
        if mark.around is not None and mark.around.within == mark.within:
            mark.around.prose += mark.prose
    holds: dict[int, bool] = {}  # by mark: whether one of its side, itself or around it, holds for whatever is in it
    for mark in marks:
        holds[id(mark)] = mark.holds or mark.around is not None and mark.around.within == mark.within and holds[id(mark.around)]
    heading = next((b for b in base if b.heading and not (b.mark is not None and b.mark.within == main and holds[id(b.mark)])), None)
    heads, at = set(), heading.mark if heading else None
    while at is not None:
        heads.add(id(at))
        at = at.around
    for mark in marks:
        if mark.within == main and not mark.holds:
            mark.void = mark.prose * 2 > size and id(mark) in heads if heading else mark.prose * 10 >= size * 9 > 0
    clear: dict[int, bool] = {}  # by mark: whether it and those around it within the same article are void
    for mark in marks:
        clear[id(mark)] = mark.void and (mark.around is None or mark.around.within != mark.within or clear[id(mark.around)])
    regions: dict[tuple, int] = defaultdict(int)
    for b in base:
        if b.main and (b.mark is None or not b.mark.within or clear[id(b.mark)]):
            regions[b.container] += b.prose
    if regions:
        at = around[max(regions, key=regions.get)[1]]
        while at is not None:
            at.void, at = True, at.around
    for mark in marks:
        clear[id(mark)] = mark.void and (mark.around is None or clear[id(mark.around)])
    for b in found:
        b.boilerplate = b.mark is not None and not clear[id(b.mark)]


def _marks(tag: str, attributes: str) -> tuple[bool, str, bool]:
    """Whether an element says it is boilerplate, its tag with class, id and role, and whether it links into its own page."""
    boiler, label, points = tag in _NOT_MAIN or tag == "header", tag, False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            boiler |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()))
        elif name == "hidden" or name == "aria-hidden":
            boiler |= value.lower() != "false"
        elif name == "href":
            points = value.lstrip().startswith("#")
        elif name in ("class", "id", "role"):
            boiler |= tag not in ("html", "body") and any(map(_names_boilerplate, value.split()))
            label += {"class": ".", "id": "#", "role": "[role="}[name] + value.lower()
    return boiler, label, points


@lru_cache(10_000)
def _names_boilerplate(token: str) -> bool:
    """Whether a class token says so: "site-footer", "cookie-law-info" and "userComments" do, "has-sidebar" and "post-header" don't."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w]
    while len(words) > 1 and len(words[0]) <= 2 and words[0] not in _FOREIGN_WORDS | _ABOUT_OTHERS:
        del words[0]  # "c-comment", "js-ad"
    if not words or words[0] in _ABOUT_OTHERS:
        return False
    says = _NOT_MAIN_WORDS | _FOREIGN_WORDS
    return bool({words[0], words[-1]} & _FOREIGN_WORDS) or bool(says.intersection(words)) and says.union(_NEUTRAL_WORDS).issuperset(words)


def path_scores(found: list[Block]) -> dict[tuple, float]:
    """Score of each tag path in its container, by ``(path, container)``.

    A path's ratios are its text length and its punctuation per node, text in links counting
    against both; each grows no more from ``MOST_TEXT`` and ``MOST_MARKS``. They are fused by the root of their
    product (marks count from 1, so that text without punctuation has a score) and smoothed by the mean with
    the container's: the article or main element, else the parent's path. On a page with article or main elements, paths outside of them weigh ``OUTSIDE``.
    """
    own: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    near: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
    for b in found:
        seen = (1, b.prose, len(_PUNCTUATION.findall(b.text)) if b.prose else 0)
        for row in (own[b.path], near[b.container]):
            for k in range(3):
                row[k] += seen[k]

    def fused(row: list[int]) -> float:
        return (min(row[1] / row[0], MOST_TEXT) * (min(row[2] / row[0], MOST_MARKS) + 1)) ** 0.5

    main = any(b.main for b in found)
    return {
        (b.path, b.container): (fused(own[b.path]) + fused(near[b.container])) / 2 * (OUTSIDE if main and not b.main else 1) for b in found
    }


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """Main text of a page: its blocks joined by two line ends; empty if there is none.

    Paths in elements that name themselves navigation, advert, comment, form and the like are no candidates.
    Of the others, with or without an article, those stay whose score (:func:`path_scores`) is at least ``threshold`` of the best.
    Text of a lower score stays between blocks that stay or, as a lead, right before the first of them, on the same
    side of article and main elements. A heading stays with the text that it heads. Lists of links are
    menus and go: in an article those that point into the page (a table of contents), elsewhere all.
    """
    found = [b for b in blocks(page) if not b.boilerplate]
    items: dict[int, bool] = {}
    many: dict[int, int] = defaultdict(int)
    for b in found:
        many[b.path] += 1
        only = not b.prose and (not b.main or b.pointed == b.linked)
        items[b.path] = items.get(b.path, b.item) and only
    score = path_scores(found)
    limit = threshold * max(score.values(), default=0)
    stays = [score[b.path, b.container] >= limit for b in found]
    main = any(b.main and stay for b, stay in zip(found, stays))
    side = [k for k, b in enumerate(found) if b.main == main]
    inner = [stays[k] for k in side]
    _with_neighbours([found[k] for k in side], inner)
    for k, stay in zip(side, inner):
        stays[k] = stay
    return "\n\n".join(b.text for b, stay in zip(found, stays) if stay and not (items[b.path] and many[b.path] > 1))


def _with_neighbours(found: list[Block], stays: list[bool]) -> None:
    """Adds headings of text that stays, text between blocks that stay, and text right before the first of them."""
    below = False  # whether something stays in the section that the next heading up the page heads
    for k in range(len(found) - 1, -1, -1):
        if found[k].heading and found[k].prose:
            stays[k] |= below
            below = stays[k] and k > 0 and found[k - 1].heading
        else:
            below |= stays[k]
    kept = [k for k, stay in enumerate(stays) if stay]
    for k in range(max(0, kept[0] - 1), kept[-1]) if kept else ():
        stays[k] |= found[k].prose > 0


def extract(spark: SparkSession, pages: DataFrame, *, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in column ``out`` (null or empty page: empty text).

    Repeated rows get equal texts; an input column named ``out`` is replaced,
    all others stay; an empty table gives no rows. Work and memory go with the page.
    """
    small_batches(spark)

    @F.pandas_udf("string")
    def of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield pd.Series([main_text(x) for x in s], dtype=object)

    return pages.withColumn(out, of(F.col(page).cast("string")))
