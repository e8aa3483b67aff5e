"""HTML extraction by layout-aware rendering.

A tree builder reads tags as browsers do: void elements have no content, a
paragraph ends where a block begins, list items, table rows and cells end where
the next begins, scripts and styles are raw text.  A renderer then walks the tree and
writes all text that a reader would see: blocks on lines of their own with
blank lines where browsers have margins, list items with bullets or numbers,
table cells in aligned columns, preformatted text as it stands, of a closed
choice the chosen option, of an open one all.  What is invisible (head, scripts,
``hidden``, ``display:none``, closed dialogs ...) is left out.  A table whose
aligned form would be many times its text has its cells set apart by bars alone.

Edge cases: a null or empty page has a null title and the empty text; a page cut off in a tag
loses that tag only; unknown tags are inline; elements nested deeper than a
browser's limit become siblings; repeated rows repeat; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from lexfold.llm.common import over_batches, small_batches

#: Depth beyond which an element becomes a sibling of its parent, as in browsers.
DEEPEST = 512
#: Times its cells' characters that a table's aligned form may have, and characters that it may have in any case.
PAD_TIMES, PAD_LEAST = 8, 1 << 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: Elements whose text no reader sees.
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title area base link meta param source track".split())
#: What is not seen inside svg and math, beside that.
FOREIGN_UNSEEN = {
    "svg": frozenset("desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
#: The attribute of a label inside svg, which stands apart from others; no page can write it.
_LABEL = " label"
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp caption".split())
#: Blocks with a blank line around them.
SPACED = frozenset("blockquote dl dir fieldset figure h1 h2 h3 h4 h5 h6 hr listing menu ol p pre table ul xmp".split())
#: Blocks that end an open paragraph.
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option optgroup legend".split())
#: What the start of each of these ends, unless a scope element stands between.
IMPLIES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "caption": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "colgroup": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "frameset": ({"head"}, {"html"}),
}
#: What opens by itself where the first starts right in the second.
_IMPLIED = {(cell, "table"): ("tbody", "tr") for cell in ("td", "th")} | {(cell, part): ("tr",) for cell in ("td", "th") for part in ("tbody", "thead", "tfoot")} | {("tr", "table"): ("tbody",)}
_P_SCOPE = frozenset("table td th caption html button object".split())
_HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</?+(?:[a-zA-Z][^\s/>]*+)|</[^>]*+>?", re.S)
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)("?)|'([^']*+)('?)|([^\s>]*+)))?)""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)\b", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def build(html: str) -> Node:
    """The tree of a page: a node named html."""
    root = Node("html")
    open_ = [root]
    at, n = 0, len(html)

    def text(s: str) -> None:
        if s:
            if len(open_) > 1 and open_[-1].tag in ("head", "colgroup") and not s.isspace():
                open_.pop()
            open_[-1].children.append(unescape(s))

    def close_to(tags, scope) -> None:
        """Close the innermost of ``tags`` and what is open in it, again and again."""
        while True:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in tags:
                    del open_[k:]
                    break
                if open_[k].tag in scope:
                    return
            else:
                return

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        begin, token = m.start(), m[0]
        text(html[at:begin])
        at = m.end()
        if token[1] in "!?" or token.startswith("</") and not token[2:3].isalpha():
            continue
        closing = token[1] == "/"
        tag = token[1 + closing :].lower()
        attributes: dict[str, str] = {}
        ended = empty = False
        while True:
            a = _ATTRIBUTE.match(html, at)
            if not a or a.end() == at:
                break
            at = a.end()
            if a[1]:
                ended, empty = True, a[0].endswith("/>")
                break
            if a[3] is not None and not a[4] or a[5] is not None and not a[6]:  # a quote that never closes
                at = n
                break
            value = next((v for v in (a[3], a[5], a[7]) if v is not None), "")
            attributes.setdefault(a[2].lower(), unescape(value))
        if not ended:
            break  # the page ends in this tag
        if closing:
            if tag == "p" and not any(x.tag == "p" for x in open_):
                open_[-1].children.append(Node("p"))
                continue
            if tag == "br":
                open_[-1].children.append(Node("br"))
                continue
            stop = {"table"} if tag not in ("table", "body", "html") else ()
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
                if open_[k].tag in stop or open_[k].tag in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag == "html":
            root.attributes = attributes | root.attributes
            continue
        if tag == "body" and any(x.tag == "body" for x in open_):
            continue
        if open_[-1].tag == "head" and tag not in _HEAD_ONLY:
            open_.pop()
        if open_[-1].tag == "colgroup" and tag not in ("col", "template"):
            open_.pop()
        if tag in ENDS_P:
            close_to({"p"}, _P_SCOPE)
        if tag in IMPLIES:
            close_to(*IMPLIES[tag])
        if tag == "a" and any(x.tag == "a" for x in open_):
            close_to({"a"}, _P_SCOPE)
        for implied in _IMPLIED.get((tag, open_[-1].tag), ()):
            if len(open_) < DEEPEST - 2:
                open_[-1].children.append(Node(implied))
                open_.append(open_[-1].children[-1])
        kind = next((x.tag for x in reversed(open_) if x.tag in ("svg", "math", "foreignobject")), "")
        if tag in FOREIGN_UNSEEN.get(kind, ()):
            attributes["hidden"] = ""
        elif kind == "svg" and tag == "text":
            attributes[_LABEL] = ""
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        if empty and (kind in FOREIGN_UNSEEN or tag in FOREIGN_UNSEEN):  # only there a slash ends an element
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            node.children.append(html[at : end.start()] if end else html[at:])
            if not end:
                break
            at = html.find(">", end.end())
            at = n if at < 0 else at + 1
            continue
        if len(open_) < DEEPEST:
            open_.append(node)
    return root


def hidden(node: Node) -> bool:
    if node.tag in UNSEEN:
        return True
    a = node.attributes
    if not a:
        return node.tag == "dialog"
    return ("hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a
            or node.tag == "input" and a.get("type", "").lower() == "hidden" or "style" in a and bool(_HIDING.search(a["style"])))


class _Writer:
    """Lines of a block; ``blank`` says that a blank line is due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False

    def words(self, s: str) -> None:
        """Inline text, white space collapsed."""
        body = _SPACES.sub(" ", s)
        if not body:
            return
        lead, tail = body[0] == " ", body[-1] == " "
        body = body.strip(" ")
        if not body:
            self.space = True
            return
        if self.now:
            if self.space or lead:
                self.now.append(" ")
        else:
            self._begin()
        self.now.append(body)
        self.space = tail

    def _begin(self) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False

    def end_line(self, blank: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now))
            self.now = []
        self.space = False
        self.blank = self.blank or blank

    def line_break(self) -> None:
        if self.now:
            self.end_line()
        elif self.lines and not self.blank:
            self.blank = True

    def put(self, lines: list[str]) -> None:
        """Whole lines."""
        if not lines:
            return
        self.end_line()
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines += lines


def _ordinal(node: Node, start: int) -> int:
    try:
        return int(node.attributes.get("value", ""))
    except ValueError:
        return start


def _block(node: Node, pre: bool) -> list[str]:
    """The lines of a node's content."""
    w = _Writer()
    _flow(node, w, pre)
    w.end_line()
    return w.lines


def _flow(node: Node, w: _Writer, pre: bool) -> None:
    for c in node.children:
        if isinstance(c, str):
            if pre:
                parts = c.replace("\r\n", "\n").split("\n")
                for k, part in enumerate(parts):
                    if k:
                        if not w.now:
                            w._begin()
                        w.lines.append("".join(w.now).rstrip())
                        w.now = []
                    if part:
                        if not w.now:
                            w._begin()
                        w.now.append(part)
            else:
                w.words(c)
            continue
        if hidden(c):
            continue
        tag = c.tag
        if tag == "br":
            w.line_break()
        elif tag == "wbr":
            pass
        elif tag == "hr":
            w.end_line(True)
            w.put(["---"])
            w.end_line(True)
        elif tag == "img":
            w.words(" " + c.attributes.get("alt", "") + " " if c.attributes.get("alt") else "")
        elif tag == "input":
            if c.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                w.words(" " + c.attributes.get("value", "") + " ")
        elif tag == "textarea":
            w.words(" " + unescape("".join(x for x in c.children if isinstance(x, str))) + " ")
        elif tag == "select":
            _choice(c, w)
        elif tag == "table":
            w.end_line(True)
            for lines in _table(c):
                w.put(lines)
            w.end_line(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            _list(c, w)
        elif tag == "li":  # outside any list
            _item(c, "- ", w)
        elif tag == "details" and "open" not in c.attributes:
            w.end_line()
            for s in [x for x in c.children if isinstance(x, Node) and x.tag == "summary"][:1]:
                w.put(_block(s, pre))
            w.end_line()
        elif tag in BLOCK:
            spaced = tag in SPACED
            w.end_line(spaced)
            inner = pre or tag in ("pre", "listing", "xmp", "plaintext")
            if tag in ("dd", "blockquote"):
                w.put(["    " + x if x else "" for x in _block(c, inner)])
            elif inner and not pre:
                lines = _block(c, True)
                if lines and not lines[0]:
                    lines = lines[1:]
                w.put(lines)
            else:
                _flow(c, w, inner)
            w.end_line(spaced)
        elif _LABEL in c.attributes:
            w.words(" ")
            _flow(c, w, pre)
            w.words(" ")
        elif tag == "q":
            w.words("“")
            w.space = False
            _flow(c, w, pre)
            w.space = False
            w.now.append("”")
        else:
            _flow(c, w, pre)


def _options(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node) and not hidden(c):
            if c.tag == "option":
                yield c
            else:
                yield from _options(c)


def _choice(node: Node, w: _Writer) -> None:
    """A list box shows all its options, one below the other; a closed choice the last that is selected, else the first that can be chosen."""
    try:
        rows = int(node.attributes.get("size", "0") or 0)
    except ValueError:
        rows = 0
    options = list(_options(node))
    if "multiple" in node.attributes or rows > 1:
        w.end_line()
        for o in options:
            w.put(_block(o, False))
        w.end_line()
        return
    chosen = [o for o in options if "selected" in o.attributes][-1:] or [o for o in options if "disabled" not in o.attributes][:1]
    for o in chosen:
        w.words(" " + " ".join(_block(o, False)) + " ")


def _item(node: Node, mark: str, w: _Writer) -> None:
    lines = _block(node, False)
    if lines:
        pad = " " * len(mark)
        w.put([mark + lines[0], *(pad + x if x else "" for x in lines[1:])])
        w.blank = False


def _list(node: Node, w: _Writer) -> None:
    w.end_line(True)
    number = 1
    if node.tag == "ol":
        try:
            number = int(node.attributes.get("start", "1"))
        except ValueError:
            pass
    for c in node.children:
        if isinstance(c, str):
            w.words(c)
        elif hidden(c):
            continue
        elif c.tag == "li":
            w.end_line()
            if node.tag == "ol":
                number = _ordinal(c, number)
                mark = f"{number}. "
                number += 1
            else:
                mark = "- "
            _item(c, mark, w)
        else:
            holder = Node("div")
            holder.children = [c]
            w.put(_block(holder, False))
    w.end_line(True)


def _span(node: Node, name: str, most: int) -> int:
    try:
        return min(max(1, int(node.attributes.get(name, "1"))), most)
    except ValueError:
        return 1


def _rows(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node) and not hidden(c):
            if c.tag == "tr":
                yield c
            elif c.tag in ("tbody", "thead", "tfoot"):
                yield from _rows(c)


def _stray(node: Node) -> Iterator[object]:
    """What stands in a table outside its cells and is shown before it."""
    for c in node.children:
        if isinstance(c, str):
            if not c.isspace():
                yield c
        elif c.tag in ("tbody", "thead", "tfoot", "tr"):
            if not hidden(c):
                yield from _stray(c)
        elif c.tag not in ("td", "th", "caption", "colgroup", "col"):
            yield c


def _table(node: Node) -> Iterator[list[str]]:
    """Stray content, the caption, and the rows with their cells in aligned columns."""
    stray = Node("div")
    stray.children = list(_stray(node))
    if stray.children:
        yield _block(stray, False)
    for c in node.children:
        if isinstance(c, Node) and c.tag == "caption" and not hidden(c):
            yield _block(c, False)
    grid: list[list[tuple[int, int, list[str]]]] = []
    held: dict[int, int] = {}  # column: rows that a cell above still takes
    for r in _rows(node):
        row, column = [], 0
        for c in r.children:
            if not isinstance(c, Node) or c.tag not in ("td", "th") or hidden(c):
                continue
            while held.get(column, 0):
                column += 1
            wide = _span(c, "colspan", 1000)
            tall = _span(c, "rowspan", 65534)
            row.append((column, wide, [x for x in _block(c, False)]))
            for k in range(column, column + wide):
                held[k] = tall
            column += wide
        held = {k: v - 1 for k, v in held.items() if v > 1}
        grid.append(row)
    width: dict[int, int] = {}
    for row in grid:
        for column, wide, lines in row:
            if wide == 1:
                width[column] = max(width.get(column, 0), max(map(len, lines), default=0))
    starts, room, left = {}, 0, iter(sorted(width))
    nxt = next(left, None)
    for column in sorted({c for row in grid for c, _, _ in row}):
        while nxt is not None and nxt < column:
            room, nxt = room + width[nxt], next(left, None)
        starts[column] = room + 3 * column
    rows = sum(max((len(lines) for _, _, lines in row), default=0) for row in grid)
    written = sum(len(x) for row in grid for _, _, lines in row for x in lines)
    aligned = rows * max(starts.values(), default=0) <= max(PAD_LEAST, PAD_TIMES * written)
    out = []
    for row in grid:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line, begin = "", 0
            for column, _, lines in row:
                start = starts[column] if aligned else begin
                piece = lines[k] if k < len(lines) else ""
                if piece:
                    gap = start - len(line)
                    line += " " * max(gap, 0) if gap > 0 else (" " if line and not line.endswith(" ") else "")
                    if column and not line.endswith("| "):
                        line = line[:-2] + "| " if line.endswith("  ") else line.rstrip() + " | "
                    line += piece
                begin = len(line) + 3
            out.append(line.rstrip())
    yield out


def render(html: str | None) -> tuple[str | None, str]:
    """Title and visible text."""
    if not html:
        return None, ""
    if sys.getrecursionlimit() < 20 * DEEPEST:
        sys.setrecursionlimit(20 * DEEPEST)
    root = build(html.replace("\x00", "�"))
    lines = _block(root, False)
    return _title(root), "\n".join(x.rstrip() for x in lines).strip("\n")


def _title(root: Node) -> str | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACES.sub(" ", unescape("".join(x for x in node.children if isinstance(x, str)))).strip(" ")
        if node.tag not in ("svg", "math"):
            todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return None


def extract(df: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, title, text) of every page."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [render(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], names=[id, "title", "text"])

    picked = df.select(id, html)
    return over_batches(picked, run, f"`{id}` {picked.schema[0].dataType.simpleString()}, title string, text string")
