"""Links of HTML pages with the areas, heading and context they stand in.

A page's tags are folded once with a stack of open elements, so that every element becomes an interval of elements and of text; areas,
containers and headings are then looked up among the intervals around a link. DataFrame operators score and filter what comes out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from curatorium.functions import lexicon

LINKS = "page long, pos long, url string, text string, heading string, context string, navigation boolean, footer boolean, breadcrumb boolean"
MAX_HOPS, MAX_CONTEXT, LEAST_CONTENT = 7, 220, 300
_TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(id|class|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BLOCKS = _HEADINGS | frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
#: An element of the key is closed where one of these begins; an open element of the second set hides it.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th", "tr"}, {"table"}), "th": ({"td", "th", "tr"}, {"table"}), "p": (_BLOCKS, {"table", "button"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
_UNWANTED = re.compile(r"(?i)(?:#|mailto:|tel:|javascript:)")


class Page:
    """The elements of one page in the order they open, each with its parent, the element after its last descendant, and its stretch of text."""

    def __init__(self, html: str, decode: Callable[[str], str] = unescape):
        self.tag, self.ids, self.classes, self.href, self.parent, self.after, self.span = [], [], [], [], [], [], []
        self.headings: dict[int, list[int]] = {}  # of each parent
        pieces, long, open_, at = [], 0, [], 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                pieces.append(decode(html[at : m.start()]))
                long += len(pieces[-1])
            at = m.end()
            if not (tag := (m[3] or "").lower()):
                continue
            if m[2]:
                if tag in (self.tag[e] for e in open_):
                    while self._close(open_, long) != tag:
                        pass
                continue
            for kind, (starts, hidden_by) in _ENDS.items():
                if tag in starts:
                    for e in reversed(open_):
                        if self.tag[e] == kind:
                            while self._close(open_, long) != kind:
                                pass
                            break
                        if self.tag[e] in hidden_by:
                            break
            found = {k.lower(): decode(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[4])}
            e, parent = len(self.tag), open_[-1] if open_ else -1
            for values, value in ((self.tag, tag), (self.ids, found.get("id", "")), (self.classes, found.get("class", "")), (self.href, found.get("href")), (self.parent, parent), (self.after, e + 1), (self.span, (long, long))):
                values.append(value)
            if tag in _HEADINGS:
                self.headings.setdefault(parent, []).append(e)
            if tag not in _VOID and not m[4].endswith("/"):
                open_.append(e)
        pieces.append(decode(html[at:]) if at < len(html) else "")
        long += len(pieces[-1])
        while open_:
            self._close(open_, long)
        self.text = "".join(pieces)

    def _close(self, open_: list[int], long: int) -> str:
        e = open_.pop()
        self.after[e], self.span[e] = len(self.tag), (self.span[e][0], long)
        return self.tag[e]

    def words(self, e: int) -> str:
        return " ".join(self.text[slice(*self.span[e])].split())

    def fits(self, e: int, selectors: tuple[str, ...]) -> bool:
        return self.tag[e] in selectors or f"#{self.ids[e]}" in selectors or any(f".{c}" in selectors for c in self.classes[e].split())

    def around(self, e: int) -> Iterator[int]:
        while e >= 0:
            yield e
            e = self.parent[e]

    def content(self) -> tuple[int, int]:
        """The elements to look for links in: those of the first content area that holds a link or a longer text, or all."""
        for selector in lexicon.CONTENT_AREAS:
            for e in range(len(self.tag)):
                if self.fits(e, (selector,)) and (any(self.tag[k] == "a" and self.href[k] is not None for k in range(e, self.after[e])) or len(self.text[slice(*self.span[e])].strip()) > LEAST_CONTENT):
                    return e, self.after[e]
        return 0, len(self.tag)

    def heading(self, e: int) -> str:
        """The nearest heading before the element among its siblings, else its parent's first heading, and so on outwards; at last the page's first h1."""
        for hop, node in enumerate(self.around(e)):
            if hop == MAX_HOPS:
                break
            among = self.headings.get(self.parent[node], ())
            before = bisect_left(among, node)
            if before or (among and self.parent[node] >= 0):
                return self.words(among[before - 1] if before else among[0])
        return next((self.words(k) for k, tag in enumerate(self.tag) if tag == "h1"), "")

    def links(self, base: str) -> Iterator[tuple]:
        first, last = self.content()
        for e in range(first, last):
            href = (self.href[e] or "").strip()
            if self.tag[e] != "a" or not href or _UNWANTED.match(href):
                continue
            try:
                url = urljoin(base, href)
            except ValueError:
                continue
            path = list(self.around(e))
            named = " ".join(f"{self.ids[k]} {self.classes[k]}" for k in path)
            flags = [any(self.fits(k, selectors) for k in path) or re.search(pattern, named) is not None for selectors, pattern in lexicon.AREAS.values()]
            container = next((k for k in path if self.fits(k, lexicon.CONTEXT_AREAS)), self.parent[e])
            context = self.words(container) if container >= 0 else " ".join(self.text.split())
            yield url, self.words(e), self.heading(e), context[:MAX_CONTEXT], *flags


def links(pages: DataFrame, whole: bool = False, decode: Callable[[str], str] = unescape) -> DataFrame:
    """(page, pos, url, text, heading, context, navigation, footer, breadcrumb) of the links in each page's content area, or in the whole page; pages has page_id, url, html.

    Addresses are made absolute. A page that is null or has no link gives no rows; links within the page and to mail, telephones and scripts are left out.
    decode reads the entities of texts and attributes; by default all that HTML names, also those that no semicolon ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, base, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                page = Page(html or "", decode)
                if whole:
                    page.content = lambda page=page: (0, len(page.tag))
                rows += [(page_id, pos, *link) for pos, link in enumerate(page.links(base or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["page", "pos", "url", "text", "heading", "context", "navigation", "footer", "breadcrumb"])

    return pages.select("page_id", "url", "html").mapInArrow(run, LINKS)
