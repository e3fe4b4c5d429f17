"""HTML to text as a reader sees it: a tree builder, visibility rules, then layout.

The scanner splits a page into tags, text and raw text.  The builder keeps the open
elements, closes what a new tag implies (a list item ends the item before it, a block
ends a paragraph, cells and rows end cells and rows), moves what may not stand between
the rows and cells of a table before it, and ignores end tags that match nothing.  Rendering walks the tree once: hidden elements go, inline text has its white
space collapsed, blocks start on a line of their own with a blank line around
paragraphs and headings, list items get a bullet or number and an indent by depth,
preformatted text is kept, and table cells are padded to the width of their column.
Hidden is what the element's name, its `hidden` attribute or its style's `display` and
`visibility` say, a closed dialog too; `aria-hidden` hides nothing on screen.  Text of
buttons, all options, text areas, SVG and MathML is shown.

Work is linear in the page: no recursion, no backtracking over the whole page, and end
tags look for their element only as deep as the tree is (at most MAX_DEPTH, deeper
elements become siblings).

Defined results: a null page gives null, an empty or fully hidden page an empty text;
unclosed tags, comments and quotes end with the page; repeated rows are rendered one
by one; a null id keeps its row; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 200

_words = lambda s: frozenset(s.split())
#: Element classes; fixed values.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title xmp noembed noframes iframe")
HIDDEN = _words("head script style template noscript noembed noframes iframe object embed canvas audio video datalist title meta link")
#: Elements that are drawn nowhere inside SVG or MathML.
_UNDRAWN = _words("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml")
_BOXES = _words("button select text mtd mtr")
BLOCK = _words("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td textarea tfoot th thead tr ul caption")
SPACED = _words("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr article section")
LISTS = _words("ul ol menu dir")
TABLE_PARTS = _words("table tbody thead tfoot tr td th caption")

#: A start tag closes these open elements, up to the nearest of the barriers.
_IMPLIED = {
    "li": (_words("li"), _words("ul ol menu dir table td th")),
    "dt": (_words("dt dd"), _words("dl table td th")),
    "dd": (_words("dt dd"), _words("dl table td th")),
    "option": (_words("option"), _words("select datalist optgroup")),
    "optgroup": (_words("option optgroup"), _words("select datalist")),
    "tr": (_words("tr td th caption"), _words("table")),
    "td": (_words("td th"), _words("tr table")),
    "th": (_words("td th"), _words("tr table")),
    "tbody": (_words("tbody thead tfoot tr td th caption"), _words("table")),
    "thead": (_words("tbody thead tfoot tr td th caption"), _words("table")),
    "tfoot": (_words("tbody thead tfoot tr td th caption"), _words("table")),
    "body": (_words("head"), _words("html")),
}
#: A start tag of a table's structure goes into the nearest of these, whatever was opened since.
_PLACE = {name: _words("table template") for name in ("caption", "col", "colgroup", "tbody", "thead", "tfoot")}
_PLACE["tr"] = _PLACE["tbody"] | _words("tbody thead tfoot")
_PLACE["td"] = _PLACE["th"] = _PLACE["tr"] | {"tr"}
#: What may stand in a head; anything else closes it.
_HEAD = _words("base basefont bgsound link meta title noframes style script noscript template")
_FOREIGN = _words("svg math")
_ROWS = _words("table tbody thead tfoot tr")
_CELLS = _words("td th caption template")
_ENDS_P = BLOCK - _words("td th tr tbody thead tfoot caption body html option optgroup textarea") | {"p"}
_P_BARRIER = _words("td th table button caption")

_TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*)|([!?])[^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?)", re.S)
_MAY_HIDE = re.compile("hidden|style|display|visibility", re.I)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
#: Comments, strings and brackets of a style, in which a semicolon ends nothing; then its declarations of interest.
_STYLE_QUOTED = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*\"?|'[^']*'?|\([^)]*\)?", re.S)
_DISPLAY = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z][a-z -]*?)\s*(!\s*important\s*)?(?=;|$)", re.I)
_BLANK = " \t\n\r\f"
_SPACES = re.compile(r"[ \t\n\r\f\v]+")
_START = re.compile(r"start\s*=\s*[\"']?(-?[0-9]{1,9})")


class Node:
    __slots__ = ("children", "hidden", "name", "number", "shown")

    def __init__(self, name: str, hidden: bool, number: int = 1, shown: bool = True):
        self.name, self.hidden, self.number, self.shown = name, hidden, number, shown
        self.children: list[Node | str] = []


def attributes(attrs: str) -> dict[str, str]:
    """Names (lower-case) and values of a start tag's attributes; of equal names the first counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _visibility(name: str, attrs: str, shown: bool, stack: list[Node]) -> tuple[bool, bool]:
    """(not displayed with all inside, own text visible) of an element whose parent's text is `shown` or not."""
    hidden = name in HIDDEN
    if hidden or name != "dialog" and not _MAY_HIDE.search(attrs):
        return hidden, shown
    values = attributes(attrs)
    declared: dict[str, tuple[bool, str]] = {}
    if ("display" in values or "visibility" in values) and any(x.name in _FOREIGN for x in stack):
        declared = {what: (False, values.get(what, "").strip().lower()) for what in ("display", "visibility")}
    for what, value, important in _DISPLAY.findall(_STYLE_QUOTED.sub(" ", values.get("style", ""))):
        if important or not declared.get(what.lower(), (False,))[0]:
            declared[what.lower()] = (bool(important), value.lower())
    display, visible = declared.get("display", (False, ""))[1], declared.get("visibility", (False, ""))[1]
    if display == "none" or not display and ("hidden" in values or name == "dialog" and "open" not in values):
        return True, shown
    if visible in ("hidden", "collapse"):
        return False, False
    return False, shown or visible in ("visible", "initial")


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root", False)
    stack = [root]

    def close(names: frozenset, barrier: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in barrier:
                return
            if stack[i].name in names:
                del stack[i:]
                return

    def open_table() -> int:
        """Where the table is between whose rows and cells the builder stands, or 0."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in _CELLS:
                return 0
            if stack[i].name == "table":
                return i
        return 0

    def add(item: Node | str) -> None:
        """Adds to the open element, or before the table where that takes only rows or cells; an open table is the last child."""
        t = open_table() if stack[-1].name in _ROWS else 0
        if t:
            stack[t - 1].children.insert(-1, item)
        else:
            stack[-1].children.append(item)

    def end_head() -> None:
        if stack[-1].name == "head":
            stack.pop()

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        found = _TAG.match(page, lt) if lt < size else None
        if lt > at:
            text = html.unescape(page[at:lt]) if "&" in page[at:lt] else page[at:lt]
            if text.strip(_BLANK):
                end_head()
                add(text)
            elif stack[-1].name not in _ROWS:
                add(text)
        if lt >= size:
            break
        if not found:
            end_head()
            add("<")
            at = lt + 1
            continue
        at = found.end()
        if not found[3]:
            continue
        name = found[3].lower()
        if found[2]:
            if name == "br":
                end_head()
                add(Node("br", False))
            else:
                close(frozenset((name,)), TABLE_PARTS - {name} if name not in TABLE_PARTS else frozenset(("table",)) - {name})
            continue
        if name not in _HEAD:
            end_head()
        if name in _ENDS_P:
            close(frozenset("p"), _P_BARRIER)
        placed = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in _PLACE[name]), 0) if name in _PLACE else 0
        if placed:
            del stack[placed + 1 :]
        elif name == "table" and (t := open_table()):
            del stack[t:]
        elif name == "form" and open_table():
            continue  # a form between rows or cells holds nothing
        elif name in _IMPLIED:
            names, barrier = _IMPLIED[name]
            while len(stack) > 1:
                depth = len(stack)
                close(names, barrier)
                if len(stack) == depth:
                    break
        attrs = found[4]
        number = int(m[1]) if name == "ol" and (m := _START.search(attrs)) else 1
        t = open_table() if not placed and stack[-1].name in _ROWS else 0
        hidden, shown = _visibility(name, attrs, stack[t - 1 if t else -1].shown, stack)
        if name in _UNDRAWN and any(x.name in _FOREIGN for x in stack):
            hidden = True
        node = Node(name, hidden, number, shown)
        if placed:
            stack[-1].children.append(node)
        else:
            add(node)
        if name in VOID or name == "colgroup":
            continue
        if name in RAW:
            if attrs.endswith("/") and any(x.name in _FOREIGN for x in stack):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else size
            node.children.append(html.unescape(page[at:stop].removeprefix("\n")) if name == "textarea" else page[at:stop])
            at = page.find(">", stop) + 1 if end else size
            at = at or size
            continue
        if attrs.endswith("/") and name not in BLOCK and name not in HIDDEN or len(stack) >= MAX_DEPTH:
            continue
        stack.append(node)
    return root


class _Out:
    """Lines under construction: collapsed inline text, pending breaks, prefixes of list items."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False
        self.indent = ""
        self.mark = ""

    def text(self, s: str) -> None:
        parts = _SPACES.sub(" ", s)
        if parts == " " or not parts:
            self.space = self.space or bool(parts)
            return
        lead, body = parts[0] == " ", parts.strip(" ")
        if self.now and (self.space or lead):
            self.now.append(" ")
        self.now.append(body)
        self.space = parts[-1] == " "

    def line(self, force: bool = False) -> None:
        if self.now or force:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark + "".join(self.now)).rstrip())
            self.mark = ""
        self.now, self.space = [], False

    def gap(self) -> None:
        self.line()
        self.blank = True


def _cells(table: Node) -> list[list[Node]]:
    """Rows of a table; its own only, not those of tables inside."""
    rows: list[list[Node]] = []
    todo: list[Node | str] = list(reversed(table.children))
    while todo:
        n = todo.pop()
        if isinstance(n, str) or n.hidden:
            continue
        if n.name == "tr":
            rows.append([c for c in n.children if isinstance(c, Node) and c.name in ("td", "th") and not c.hidden])
        elif n.name in ("tbody", "thead", "tfoot"):
            todo.extend(reversed(n.children))
        elif n.name in ("td", "th"):
            rows.append([n])
    return rows


def render(node: Node, depth: int = 0) -> list[str]:
    """The visible lines of a tree."""
    out = _Out()
    todo: list[tuple] = [("open", node, False)]
    lists: list[list] = []
    while todo:
        step, n, pre = todo.pop()
        if step == "close":
            if n.name in SPACED and not (n.name in LISTS and len(lists) > 1):
                out.gap()
            elif n.name in BLOCK:
                out.line()
            if n.name in _BOXES:
                out.space = True
            if n.name in LISTS:
                lists.pop()
            if n.name == "li":
                if out.mark:
                    out.line(True)
                out.indent = pre
            if n.name == "blockquote":
                out.indent = out.indent[:-2]
            continue
        if isinstance(n, str):
            if pre:
                first, *more = n.replace("\r\n", "\n").split("\n")
                out.now.append(first)
                for x in more:
                    out.line(True)
                    out.now.append(x)
            else:
                out.text(n)
            continue
        if n.hidden:
            continue
        if n.name in _BOXES:
            out.space = True
        if n.name == "br":
            out.line(not out.now)
            continue
        if n.name == "hr":
            out.gap()
            continue
        if n.name == "table" and depth < 8:
            out.gap()
            for x in _table(n, depth):
                out.now = [x]
                out.line(True)
            out.gap()
            continue
        if n.name in SPACED and not (n.name in LISTS and lists):
            out.gap()
        elif n.name in BLOCK:
            out.line()
        if n.name in LISTS:
            lists.append([n.name == "ol", n.number])
        state = pre
        if n.name == "li":
            state = out.indent
            ordered, number = lists[-1] if lists else (False, 1)
            mark = f"{number}. " if ordered else "- "
            if lists:
                lists[-1][1] += 1
            out.indent, out.mark = out.indent + " " * len(mark), mark if n.shown else ""
        if n.name == "blockquote":
            out.indent += "  "
        todo.append(("close", n, state))
        inner = pre if n.name not in ("pre", "textarea") else True
        todo.extend(("open", c, inner) for c in reversed(n.children) if n.shown or isinstance(c, Node))
    out.line()
    return out.lines


def _table(table: Node, depth: int) -> list[str]:
    """A table as lines: cells padded to their column, two spaces apart; cells of several lines keep them."""
    head = [c for c in table.children if isinstance(c, Node) and c.name == "caption" and not c.hidden]
    lines = [x for c in head for x in render(_inner(c), depth + 1)]
    rows = [[render(_inner(c), depth + 1) or [""] for c in row] for row in _cells(table)]
    width: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            w = max(map(len, cell))
            if i == len(width):
                width.append(w)
            elif w > width[i]:
                width[i] = w
    for row in rows:
        for k in range(max(map(len, row), default=0)):
            lines.append("  ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, width, strict=False)).rstrip())
    return lines


def _inner(cell: Node) -> Node:
    node = Node("#cell", False, 1, cell.shown)
    node.children = cell.children
    return node


def text_of(page: str | None) -> str | None:
    """All visible text of a page, laid out."""
    if page is None:
        return None
    return "\n".join(render(parse(page))).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) for each row of pages; no shuffle."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([text_of(x) for x in part.column(1).to_pylist()], pa.string())], ["id", "text"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
