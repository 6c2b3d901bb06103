"""Main text of web pages by the distribution of text over line blocks.

1. Markup is stripped in one pass: scripts, styles, titles and comments go; an
   unclosed one runs to the page's end. What is left is a list of lines, one for
   each block of the page, with its characters and those of them in links.
2. Page furniture weighs nothing. An element is furniture by its tag (menus,
   forms, footers ...) or by a name in its class, id or role (adverts, notices,
   reader comments ...). A name counts by all its words or by its last one, so
   ``site-footer`` and ``reader-comments`` count, ``has-sidebar``,
   ``entry-header`` and ``search-engines`` do not. An element that is never
   closed is not trusted and only loses its tag. Nor does an element count that
   holds the page's article, or beside which hardly any text is left
   (``REST``): only one that is named for reader comments always counts.
3. A line weighs its text without link text; a line that is mostly links weighs
   nothing, but a paragraph or heading of that kind stays between two lines that
   are kept. Where articles hold most of the page's text, lines in them weigh all
   their text, links included, and at least ``ENOUGH``, and lines elsewhere
   nothing: references, linked headings and runs of short lines stay whole.
4. Weights are summed over sliding windows of ``WINDOW`` lines. The text surges
   where a window first reaches ``ENOUGH`` (or the page's densest window, if
   that has less) and dives where no window does any more. The lines between a
   surge and its dive are kept, but for those that weigh nothing; a stretch
   neither begins nor ends with a short line that is no paragraph, heading or
   list item. Between two stretches such lines are kept if nothing that weighs
   nothing comes between.

Defined results: a null or empty page and a page without text give the empty
text; repeated rows and null ids are rows like others; extra columns are
ignored; an empty table gives an empty result. Nothing is capped.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import modest_batches, table

WINDOW = 3
ENOUGH = 40
#: of a line's characters, so many in a hundred may be link text
LINK_SHARE = 60
#: furniture counts only if the rest of the page has so many characters for a hundred in it
REST = 10

RAW = set("script style title textarea iframe noembed noframes xmp".split())
FURNITURE = set("nav footer aside form button select option menu dialog head input label fieldset datalist audio video map noscript template svg math canvas object".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption tr".split())
#: of these, what a page has in its text and not in its menus
PARAGRAPHS = PROSE - {"li", "tr", "dt"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: words of names that mark furniture
MARKED = set(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard sponsor sponsored sponsors promo promotion "
    "promoted cookie cookies consent gdpr notice notices notification alert alerts disclaimer popup modal overlay paywall rail skip toolbar subscription cta "
    "sidebar sidenav aside widget widgets related recommended recommendations teaser trending popular "
    "menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toc topbar "
    "footer copyright colophon masthead header search searchbox share sharing social follow subscribe newsletter signup login tags tagcloud hidden".split()
)
COMMENTS = set("comment comments commentlist disqus reply replies respond".split())
#: words that say where or in what box, not what; they count for nothing in a name
BOXES = set("left right top bottom area list container wrapper wrap inner outer box block section slot links link item items bar unit panel primary secondary site page global main thread form posts articles stories buttons".split())
#: marks that a name may also have for what it belongs to: they count by all words only
WEAK_LAST = set("header footer search social hidden tags related popular follow".split())
#: first words that make a name a statement about the page
ABOUT = set("has no with without not non is hide show enable js".split())
#: names of elements that hold text
CONTENT = set("content article entry post story hentry body text main".split())
ROLES = set("banner navigation complementary contentinfo search menu menubar dialog alertdialog".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*+>",
    re.DOTALL,
)
#: a tag or comment that the page's end cuts off
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_MARK = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
PLAIN, MARK, COMMENT = 0, 1, 2


def _name_mark(name: str) -> int:
    """What one name in a class, id or role says about its element."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in ABOUT:
        return PLAIN
    telling = [w for w in words if w not in BOXES]
    if not telling:
        return PLAIN
    if telling[-1] in COMMENTS or all(w in COMMENTS for w in telling):
        return COMMENT
    if all(w in MARKED for w in telling) or telling[-1] in MARKED - WEAK_LAST:
        return MARK
    return PLAIN


def element_mark(name: str, attributes: str, in_content: bool) -> tuple[int, bool]:
    """Whether an element is furniture, and whether it says that it holds text."""
    mark, content = PLAIN, False
    if name in FURNITURE or name == "header" and not in_content:
        mark = MARK
    if attributes:
        for m in _MARK.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "style":
                mark = mark or (MARK if _UNSEEN.search(value) else PLAIN)
            elif key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
                mark = mark or MARK
            elif key in ("class", "id"):
                names = value.split()
                content = content or any(n.lower() in CONTENT for n in names)
                named = max((_name_mark(n) for n in names), default=PLAIN)
                if named == COMMENT or named == MARK and not content and name not in ("article", "main"):
                    mark = max(mark, named)
    if name in ("html", "body"):
        mark = PLAIN
    return mark, content


@dataclass(slots=True)
class _Line:
    text: str
    links: int
    article: bool
    prose: bool
    paragraph: bool
    mark: int  # number of the innermost marked element around it, -1 outside


@dataclass(slots=True)
class _Marked:
    """A marked element: its kind, the marked element around it, what it holds."""

    kind: int
    around: int
    chars: int = 0
    closed: bool = False
    counts: bool = False


class _Page:
    """Lines and marked elements of a page, in one pass over its tags."""

    def __init__(self, page: str) -> None:
        self.lines: list[_Line] = []
        self.marked: list[_Marked] = []
        #: (marked element around it, characters) of every article
        self.articles: list[tuple[int, int]] = []
        self._parts: list[str] = []
        self._link_chars = self._links = self._inside = self._content = self._chars = 0
        self._mark = -1
        self._prose = self._paragraph = False
        self.linked = np.zeros(0, dtype=bool)
        #: open elements: name, number of the marked element or -1, mark before it, characters before it, whether it holds text
        self._stack: list[tuple[str, int, int, int, bool]] = []
        self._open: dict[str, int] = {}
        at = 0
        for start, end, name, is_end, attributes in self._tags(page):
            self._add(page[at:start])
            at = end
            if name:
                self._close(name) if is_end else self._begin(name, attributes)
        rest = page[at:]
        cut = _UNFINISHED.search(rest)
        self._add(rest[: cut.start()] if cut else rest)
        self._end_line()

    @staticmethod
    def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
        at, last = 0, page.rfind(">") + 1  # no tag is complete beyond
        while m := _TOKEN.search(page, at, last):
            name, end = (m["name"] or m["name2"] or "").lower(), bool(m["end"] or m["end2"])
            at = m.end()
            if name in RAW and not end:
                closing = re.compile(rf"</{name}(?![\w-])[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
                at, name = closing.end() if closing else len(page), "br"
            yield m.start(), at, name, end, m["attributes"] or ""

    def _add(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self._parts.append(text)
            if self._links:
                self._link_chars += len("".join(text.split()))

    def _end_line(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.lines.append(_Line(text, self._link_chars, self._inside > 0, self._prose, self._paragraph, self._mark))
            self._chars += len(text)
        self._parts.clear()
        self._link_chars = 0

    def _begin(self, name: str, attributes: str) -> None:
        mark, content = element_mark(name, attributes, self._content > 0)
        if name in BLOCKS or mark:
            self._end_line()
            if name in BLOCKS:
                self._prose, self._paragraph = name in PROSE, name in PARAGRAPHS
        elif name in ("br", "td", "th", "img"):
            self._parts.append(" ")
        if name in VOID or name in ("p", "tr", "td", "th", "dt", "dd") and not mark:
            return  # nothing depends on where these end
        content = content or name in ("article", "main")
        number = -1
        if mark:
            number = len(self.marked)
            self.marked.append(_Marked(mark, self._mark))
        self._stack.append((name, number, self._mark, self._chars, content))
        self._open[name] = self._open.get(name, 0) + 1
        self._content += content
        self._inside += name in ("article", "main")
        self._links += name == "a"
        if mark:
            self._mark = number

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._end_line()
            self._prose = self._paragraph = False
        elif name in ("br", "td", "th"):
            self._parts.append(" ")
        if not self._open.get(name):
            return
        while True:
            own, number, before, chars, content = self._stack.pop()
            self._open[own] -= 1
            if number >= 0 or own in ("article", "main"):
                self._end_line()
            if number >= 0:
                self.marked[number].chars = self._chars - chars
                self.marked[number].closed = own == name
            self._mark = before
            self._content -= content
            self._inside -= own in ("article", "main")
            self._links -= own == "a"
            if own in ("article", "main"):
                self.articles.append((before if number < 0 else number, self._chars - chars))
            if own == name:
                return

    def settle(self) -> None:
        """Decide which marked elements count."""
        own = [0] * len(self.marked)
        free = 0
        for line in self.lines:
            around = line.mark
            if around >= 0:
                own[around] += len(line.text)
            else:
                free += len(line.text)
        below: list[list[int]] = [[] for _ in self.marked]
        for k, m in enumerate(self.marked):
            m.counts = m.closed
            if m.around >= 0:
                below[m.around].append(k)
        # what holds the only article does not count
        held = [(chars, mark) for mark, chars in self.articles if chars]
        outside = any(not self._counted(mark) for _, mark in held)
        if held and not outside:
            for _, mark in sorted(held, reverse=True):
                chain = list(self._chain(mark))
                if all(self.marked[k].kind != COMMENT for k in chain):
                    for k in chain:
                        self.marked[k].counts = False
                    break
        # nor what leaves hardly anything, from the largest down
        heap: list[tuple[int, int]] = []
        left = [k for k, m in enumerate(self.marked) if m.around < 0]
        while left or heap:
            for k in left:
                heapq.heappush(heap, (-self.marked[k].chars if self.marked[k].counts else -(1 << 60), k))
            left = []
            size, k = heapq.heappop(heap)
            m = self.marked[k]
            if m.counts and (m.kind == COMMENT or 100 * free >= REST * -size):
                continue
            m.counts = False
            free += own[k]
            left = below[k]

    def _chain(self, mark: int) -> Iterator[int]:
        while mark >= 0:
            yield mark
            mark = self.marked[mark].around

    def _counted(self, mark: int) -> bool:
        return any(self.marked[k].counts for k in self._chain(mark))

    def weights(self) -> np.ndarray:
        """How much each line weighs."""
        self.settle()
        dead: list[bool] = []  # the element or one around it counts; elements come after those around them
        for m in self.marked:
            dead.append(m.counts or (m.around >= 0 and dead[m.around]))
        live = np.array([line.mark < 0 or not dead[line.mark] for line in self.lines])
        size = np.array([len(line.text) for line in self.lines])
        links = np.array([line.links for line in self.lines])
        inside = np.array([line.article for line in self.lines])
        plain = np.maximum(size - links, 0) * live
        self.linked = np.zeros(len(self.lines), dtype=bool)
        if 2 * plain[inside].sum() >= plain.sum() and (inside & live).any():
            return np.where(inside & live, np.maximum(size, ENOUGH), 0)
        mostly = 100 * links > LINK_SHARE * size
        self.linked = live & mostly & np.array([line.paragraph for line in self.lines])
        return np.where(live & ~mostly, plain, 0)


def stretches(weights: np.ndarray, prose: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """True for the lines between a surge and its dive, from weights and which lines are prose."""
    span = min(window, len(weights))
    sums = np.convolve(weights, np.ones(span, dtype=weights.dtype), mode="valid")
    most = min(ENOUGH, int(sums.max()))
    if not most:
        return np.zeros(len(weights), dtype=bool)
    keep = np.convolve(sums >= most, np.ones(span, dtype=int), mode="full") > 0
    firm = (weights > 0) & (prose | (weights >= min(ENOUGH, int(weights.max()))))
    edge = np.diff(np.concatenate([[False], keep, [False]]).astype(int))
    last = -1
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        own = np.flatnonzero(firm[a:b])
        if not len(own):
            keep[a:b] = False
            continue
        keep[a : a + own[0]] = False
        keep[a + own[-1] + 1 : b] = False
        if last >= 0 and firm[last : a + own[0]].all():
            keep[last : a + own[0]] = True
        last = a + own[-1] + 1
    return keep & (weights > 0)


def between(keep: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """``keep`` with the runs of linked lines that have a kept line on either side."""
    keep = keep.copy()
    edge = np.diff(np.concatenate([[False], linked, [False]]).astype(int))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if 0 < a and b < len(keep) and keep[a - 1] and keep[b]:
            keep[a:b] = True
    return keep


def main_text(page: str) -> str:
    parsed = _Page(page)
    if not parsed.lines:
        return ""
    weights = parsed.weights()
    keep = between(np.asarray(stretches(weights, np.array([line.prose for line in parsed.lines]))), parsed.linked)
    return "\n".join(line.text for line, kept in zip(parsed.lines, keep.tolist(), strict=True) if kept)


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *others, page = range(batch.num_columns)
        texts = pa.array([main_text(p.as_py() or "") for p in batch.column(page)], pa.string())
        yield pa.record_batch([*(batch.column(k) for k in others), texts], names=[*(batch.schema.names[k] for k in others), "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html)."""
    modest_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_text_batches, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(table(spark, sf_dir, "pages"))
