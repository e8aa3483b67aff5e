"""A page's main content as lines, from its document tree (Arrow batches).

Navigation and lists of jump links are removed, headings are skipped, and block
elements break lines.  The main content is the ``main`` element, else the
``article``, else an element with that role, else the body: a declared region in
place of a scored one.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from lexfold.functions import vocabulary as v

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "noscript", "template", "head", "title", "svg", "iframe"))
_ENDS_P = frozenset((*v.DOM_BLOCK_TAGS, *v.DOM_HEADING_TAGS, "nav", "form")) - {"td", "th", "tr", "tbody", "thead", "tfoot", "br"}
_DEEPEST = 400


class Element:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                todo.extend(reversed(e.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {}, None)
        self.open = [self.root]

    def _close(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("table", "ul", "ol") and tag in ("p", "li", "td", "th", "tr"):
                return

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _ENDS_P:
            self._close("p")
        if tag in ("li", "tr", "td", "th", "dt", "dd"):
            self._close(tag)
        e = Element(tag, {k: x or "" for k, x in attrs}, self.open[-1])
        self.open[-1].children.append(e)
        if tag not in _VOID and len(self.open) < _DEEPEST:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag) -> None:
        self._close(tag)

    def handle_data(self, data) -> None:
        self.open[-1].children.append(data)

    def parse_marked_section(self, i, report=1) -> int:
        """A marked section that the parser does not know is a comment up to the next >, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)


def parse(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def in_page(a: Element, base: str) -> bool:
    """A link to a place on the same page: a fragment, or the same origin and path."""
    href = a.attributes.get("href", "")
    if not href:
        return False
    if href.startswith("#"):
        return True
    try:
        to, here = urlsplit(urljoin(base, href.strip())), urlsplit(base)
        port = lambda u: u.port or {"http": 80, "https": 443}.get(u.scheme)
        return (to.scheme, to.hostname, port(to), to.path or "/") == (here.scheme, here.hostname, port(here), here.path or "/")
    except ValueError:
        return False


def jump_list(e: Element, base: str) -> bool:
    """A list of mostly in-page links whose text is most of its text."""
    links = [a for a in e.walk() if a.tag == "a" and a is not e]
    if len(links) < v.JUMP_LINKS or sum(in_page(a, base) for a in links) / len(links) < v.JUMP_SHARE:
        return False
    total = len(e.text().strip())
    return not total or sum(len(a.text().strip()) for a in links) / total >= v.JUMP_TEXT_SHARE


def strip_navigation(root: Element, base: str) -> None:
    for e in [e for e in root.walk() if e.tag == "nav" or e.attributes.get("role") == "navigation"]:
        e.remove()
    for e in [e for e in root.walk() if e.tag in ("ul", "ol")]:
        if jump_list(e, base):
            e.remove()


def main_region(root: Element) -> Element:
    for wanted in (lambda e: e.tag == "main", lambda e: e.tag == "article", lambda e: e.attributes.get("role") == "main", lambda e: e.tag == "body"):
        for e in root.walk():
            if wanted(e):
                return e
    return root


def collect(e: Element) -> str:
    """Text with a line feed before and after each block; headings and silent elements are skipped."""
    out: list[str] = []
    todo: list[Element | str] = list(reversed(e.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag not in v.DOM_HEADING_TAGS and c.attributes.get("role") != "heading" and c.tag not in _SILENT:
            block = c.tag in v.DOM_BLOCK_TAGS
            todo.extend((["\n"] if block else []) + list(reversed(c.children)) + (["\n"] if block else []))
    return "".join(out)


def extract(html: str | None, url: str | None) -> tuple[str, str]:
    """(title, text) of a page."""
    root = parse(html or "")
    title = next((e.text().strip() for e in root.walk() if e.tag == "title"), "")
    strip_navigation(root, url or "http://localhost/")
    return title, collect(main_region(root))


def extracted(html: str | None, url: str | None) -> tuple[str, str, bool]:
    """(title, text, failed): a page that no parser takes must not end the job."""
    try:
        return *extract(html, url), False
    except Exception:  # whatever the parser raises
        return "", "", True


def flatten(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, title, text, failed): text in lines, as the blocks of the main content break it; empty, and failed, where the page cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extracted(h, u) for h, u in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, "title", "text", "failed"])

    picked = pages.select(key, url, html)
    return picked.mapInArrow(run, f"`{key}` {picked.schema[0].dataType.simpleString()}, title string, text string, failed boolean")
