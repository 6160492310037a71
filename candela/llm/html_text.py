"""HTML extraction by layout-aware rendering.

A small tree builder (void elements, implied end tags, raw-text elements) makes a tree of each page; elements without display
are dropped while it is built, and so is text of hidden visibility, which a descendant may set back. Of an svg the text elements are set, of a select the shown
option or, for a list box, all. The renderer then sets all visible text: paragraphs and headings with a blank line around, other blocks on their own lines, list items with markers and indents, table cells in aligned columns (column and row spans included), preformatted text as it is.
One pass over the pages in Arrow batches, no shuffle.

Tokenizer, builder and renderer have no recursion and no limit of depth, and look at each part of a page, and at each place that a table's cells span, a fixed number of times. What is limited is white space
alone: indents stop growing at ``INDENT`` columns, a line isn't padded beyond ``PADDED`` columns, and below ``ALIGNED`` tables around it a table's rows are lines whose cells have two spaces between; without these, nested lists and tables would have output that grows with the square of the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"=[ \t\n\r\f]*([\"'])|>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_DISPLAY_NONE = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|initial|hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object datalist audio video canvas".split())
#: What is never drawn in an svg or a formula; within an svg only text and foreign objects have text.
_UNDRAWN = {"svg": frozenset("title desc metadata style script defs symbol clippath mask pattern marker".split()), "math": frozenset(["annotation", "annotation-xml"])}
#: Below these elements of svg and math the content is html again, and these tags of html end an svg or formula elsewhere.
_INTEGRATION = {"svg": frozenset(["foreignobject", "desc", "title"]), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
_BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr".split())
BLOCKS = SPACED | frozenset("html body div article section nav main header footer aside address form li dt dd tr td th thead tbody tfoot caption figcaption details summary legend center hgroup search dialog".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre search section table ul dd dt".split())
#: Opening the key closes an open element of the first set, up to one of the second.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
}
_SCOPES = frozenset("td th table caption button template html body".split())
INDENT, PADDED, ALIGNED = 64, 2_000, 12


class Node:
    """hidden: without display, so dropped. visible, muted: whether own text is drawn. foreign: svg or math around it."""

    __slots__ = ("attributes", "children", "foreign", "hidden", "muted", "tag", "visible")

    def __init__(self, tag: str, attributes: str = "", hidden: bool = False, visible: bool = True, foreign: str = "", muted: bool = False):
        self.tag, self.attributes, self.hidden, self.visible, self.foreign, self.muted = tag, attributes, hidden, visible, foreign, muted
        self.children: list[Node | str] = []

    def get(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


def _style(attributes: str) -> tuple[bool, bool | None]:
    """Whether an element has no display, and its own visibility (None: inherited)."""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low and "visib" not in low:
        return False, None
    gone, visible = False, None
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden":
            gone = True
        elif name == "style":
            value = unescape(m[2] or m[3] or m[4] or "")
            gone = gone or bool(_DISPLAY_NONE.search(value))
            for v in _VISIBILITY.findall(value):
                visible = v.lower() in ("visible", "initial")
    return gone, visible


class _Open:
    """The open elements, from the root down, with the places of each tag among them, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 where there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, place: int) -> None:
        while len(self.nodes) > place:
            self.pop()


_CELLS = frozenset(["td", "th", "table"])
_PASS_CELLS = frozenset("table tr tbody thead tfoot body html td th".split())
_HEAD = frozenset("meta link base title style script noscript template".split())


def tokens(html: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, stop, tag, attributes) of each tag, comment or declaration; the tag is "/x" for an end, "!" for what isn't drawn, "cdata" for character data.

    Quotes count after an equals sign, and only if they are closed. A '<' that starts no tag is text; so is all from a tag on that never ends. The consumer may move on by send(position).
    """
    at, size = 0, len(html)
    last = {q: html.rfind(q) for q in "\"'"}
    end = html.rfind(">")
    while (at := html.find("<", at)) >= 0:
        ch = html[at + 1 : at + 2]
        if ch == "!" or ch == "?":
            if html.startswith("<!--", at):
                stop = html.find("-->", at + 4)
                stop = stop + 3 if stop >= 0 else size
                yield_ = (at, stop, "!", "")
            elif html.startswith("<![CDATA[", at):
                stop = html.find("]]>", at + 9)
                stop = stop + 3 if stop >= 0 else size
                yield_ = (at, stop, "cdata", "")
            else:
                stop = html.find(">", at)
                stop = stop + 1 if stop >= 0 else size
                yield_ = (at, stop, "!", "")
        else:
            m = _NAME.match(html, at + 1)
            if m is None:
                at += 1
                continue
            stop = m.end()
            while True:
                if stop > end:
                    return  # no tag ends from here on
                m2 = _STOP.search(html, stop)
                if m2 is None:
                    return
                stop = m2.end()
                if (q := m2[1]) is None:
                    break
                if stop <= last[q]:
                    stop = html.find(q, stop) + 1
            yield_ = (at, stop, ("/" if html[at + 1] == "/" else "") + m[1].lower(), html[m.end() : stop - 1])
        moved = yield yield_
        at = yield_[1] if moved is None else moved


def parse(html: str) -> Node:
    """The tree of a page, without comments and hidden text. Any input gives a tree; a '<' that starts no tag is text."""
    root = Node("html")
    open_ = _Open(root)
    nodes = open_.nodes
    at, size = 0, len(html)
    places = open_.places

    def drawn(n: Node) -> bool:
        return n.visible and not n.hidden and not n.muted

    def text(a: int, b: int) -> None:
        if b > a and drawn(nodes[-1]):
            s = html[a:b]
            nodes[-1].children.append(unescape(s) if "&" in s else s)

    found = tokens(html)
    item = next(found, None)
    while item is not None:
        start, stop, tag, attributes = item
        text(at, start)
        at = stop
        moved = None
        if tag == "cdata":
            if drawn(nodes[-1]):
                nodes[-1].children.append(html[start + 9 : stop].removesuffix("]]>"))
        elif tag == "!":
            pass
        elif tag[0] == "/":
            tag = tag[1:]
            if tag == "br":
                nodes[-1].children.append(Node("br"))
            elif places.get(tag):
                i = places[tag][-1]
                if tag in _PASS_CELLS or i > open_.last(_CELLS):
                    open_.close(i)
        elif tag in ("html", "body"):
            if tag == "body":
                while len(nodes) > 1 and nodes[-1].tag == "head":
                    open_.pop()
                gone, visible = _style(attributes)
                root.hidden = root.hidden or gone
                root.visible = root.visible if visible is None else visible
        else:
            moved = _start(html, open_, tag, attributes, at)
            if moved is not None:
                at = moved
        try:
            item = next(found) if moved is None else found.send(moved)
        except StopIteration:
            item = None
    text(at, size)
    return root


def _start(html: str, open_: _Open, tag: str, attributes: str, at: int) -> int | None:
    """Puts a start tag's element into the tree; the position after its content where that is raw text."""
    nodes, places = open_.nodes, open_.places
    if nodes[-1].tag == "head" and tag not in _HEAD:
        open_.pop()  # the head ends where its content can't be
    if tag in _BREAKOUT and nodes[-1].foreign and nodes[-1].tag not in _INTEGRATION[nodes[-1].foreign]:
        while nodes[-1].foreign and nodes[-1].tag not in _INTEGRATION[nodes[-1].foreign]:
            open_.pop()
    if tag in ("input", "textarea", "select") and places.get("select"):  # none of these can be in a select
        open_.close(places["select"][-1])
    if tag in _ENDS_P and places.get("p") and (i := places["p"][-1]) > open_.last(_SCOPES):
        open_.close(i)
    if tag in _IMPLIED:
        ended, limit = _IMPLIED[tag]
        if (i := open_.last(ended)) > open_.last(limit):
            open_.close(i)
        if tag in ("tr", "thead", "tbody", "tfoot"):
            if (i := open_.last(("tr",) if tag == "tr" else ("tr", "thead", "tbody", "tfoot"))) > open_.last(("table",)):
                open_.close(i)
    above = nodes[-1]
    gone, visible = _style(attributes)
    foreign = tag if tag in ("svg", "math") else "" if above.foreign and above.tag in _INTEGRATION[above.foreign] else above.foreign
    if tag in ("option", "optgroup"):  # a hidden option is shown while it is the selected one
        gone = False
    hidden = above.hidden or gone or (tag in HIDDEN if not foreign else tag in _UNDRAWN[foreign])
    visible = visible if visible is not None else above.visible and not (foreign == "math" and tag == "mphantom")
    muted = foreign == "svg" and (tag == "svg" or above.muted) and tag not in ("text", "foreignobject")
    if foreign and attributes.rstrip().endswith("/"):
        return None
    if tag in RAW:
        size = len(html)
        end = _RAW_END[tag].search(html, at)
        stop = end.start() if end else size
        if tag in ("textarea", "xmp") and not hidden and visible:
            node = Node("pre")
            node.children.append(unescape(html[at:stop]) if tag == "textarea" else html[at:stop])
            nodes[-1].children.append(node)
        return min(size, (html.find(">", stop) + 1) or size) if end else size
    if tag in VOID:
        if not hidden and visible:
            nodes[-1].children.append(Node(tag, attributes))
        return None
    node = Node(tag, attributes, hidden, visible, foreign, muted)
    if not hidden:
        above.children.append(node)
    open_.push(node)
    return None


_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}


def width(s: str) -> int:
    """Columns of a line: wide characters take two, combining ones none."""
    return len(s) if s.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in s)


class _Flow:
    """Lines in the making: collapsed spaces, pending blank lines, and the indents of the lists and quotes around.

    An indent is (its first line's prefix, the prefix of all lines down to it, whether it has a line, its pending blank lines). Blank lines
    before an indent's first line and after its last are the surrounding one's.
    """

    def __init__(self, depth: int = 0) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.depth = depth
        self.frames: list[list] = [["", "", False, 0]]
        self.fresh = 1  # indents without a line, the innermost ones

    def enter(self, first: str) -> None:
        above = self.frames[-1][1]
        rest = above if len(above) >= INDENT else above + " " * len(first)
        self.frames.append([first, rest, False, 0])
        self.fresh += 1

    def leave(self) -> bool:
        """Ends the innermost indent; whether it had a line."""
        self.line()
        had = self.frames.pop()[2]
        if not had:
            self.fresh -= 1
        return had

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if s[:1] == " " and (not self.parts or self.parts[-1][-1:] == " "):
            s = s[1:]
        if s:
            self.parts.append(s)

    def line(self, force: bool = False) -> None:
        s = "".join(self.parts).rstrip(" ")
        self.parts.clear()
        if s or force:
            self.put(s)

    def put(self, line: str) -> None:
        frames, k = self.frames, len(self.frames) - self.fresh
        if k:
            started = frames[k - 1]
            if started[3]:
                self.lines += [started[1].rstrip()] * started[3]
                started[3] = 0
        if self.fresh:
            prefix = frames[k - 1][1] if k else ""
            for f in frames[k:]:
                if f[0] and len(prefix) < INDENT + 16:
                    prefix += f[0]
                f[2], f[3] = True, 0
            self.fresh = 0
        else:
            prefix = frames[-1][1]
        self.lines.append((prefix + line).rstrip() if prefix else line)

    def block(self, gap: int) -> None:
        self.line()
        if gap > self.frames[-1][3]:
            self.frames[-1][3] = gap


def _shown(select: Node) -> list[str]:
    """Texts of a select that are seen: those of a list box, or the one selected, which is the first that can be unless marked."""
    size = select.get("size") or ""
    box = select.get("multiple") is not None or (size.isdecimal() and int(size[:9]) > 1)
    out: list[str] = []
    options: list[tuple[Node, bool]] = []

    def label(n: Node) -> str:
        return ((n.get("label") if n.visible else None) or _plain(n)).strip()

    todo = [(c, False, False) for c in reversed(select.children)]
    while todo:
        c, off, gone = todo.pop()
        if isinstance(c, str):
            continue
        dropped = gone or _style(c.attributes)[0]
        if c.tag == "option":
            options.append((c, off or c.get("disabled") is not None))
            if not dropped:
                out.append(label(c))
            continue
        if c.tag == "optgroup" and c.visible and not dropped and (name := c.get("label")):
            out.append(name)
        off = off or (c.tag == "optgroup" and c.get("disabled") is not None)
        todo += [(x, off, dropped) for x in reversed(c.children)]
    if not box:
        chosen = [o for o, _ in options if o.get("selected") is not None][-1:] or [o for o, off in options if not off][:1]
        out = [label(o) for o in chosen]
    return [x for x in out if x]


def _plain(node: Node) -> str:
    """The text below a node as it stands."""
    out: list[str] = []
    todo = node.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "select":
            out.append("\n".join(_shown(c)))
        else:
            todo += c.children[::-1]
    return "".join(out)


def _span(n: Node, name: str, most: int) -> int:
    value = n.get(name) if n.attributes else None
    if not value or not value.isdecimal():
        return 1
    return most if len(value) > 9 else min(most, int(value)) or (most if name == "rowspan" else 1)


def _rows(table: Node) -> tuple[list[list[Node]], list[Node | str]]:
    """The cells of each row, and what stands in the table outside of cells."""
    rows: list[list[Node]] = []
    other: list[Node | str] = []
    loose: list[Node] | None = None  # cells without a row: an implied one
    todo: list[Node | str] = table.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            if c.strip():
                other.append(c)
        elif c.tag in ("thead", "tbody", "tfoot"):
            loose = None
            todo += c.children[::-1]
        elif c.tag == "tr":
            loose = None
            rows.append([x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")])
            other += [x for x in c.children if (x.strip() if isinstance(x, str) else x.tag not in ("td", "th"))]
        elif c.tag in ("td", "th"):
            if loose is None:
                loose = []
                rows.append(loose)
            loose.append(c)
        else:
            other.append(c)
    return rows, other


def _aligned(rows: list[list[tuple[list[str], int, int]]], flow: _Flow) -> None:
    """Puts rows of (lines, colspan, rowspan) cells in columns; a spanned place stays empty below its cell."""
    taken: dict[int, int] = {}  # column -> the last row that a cell from above reaches
    widths: dict[int, int] = {}
    placed: list[list[tuple[int, list[str], int]]] = []
    for y, row in enumerate(rows):
        k, out = 0, []
        for lines, span, down in row:
            while taken.get(k, -1) >= y:
                k += 1
            out.append((k, lines, span))
            if span == 1:
                widths[k] = max(widths.get(k, 0), max(map(width, lines), default=0))
            if down > 1:
                for x in range(k, k + span):
                    taken[x] = y + down - 1
            k += span
        placed.append(out)
    columns = sorted(widths)
    starts = [0]
    for k in columns:
        starts.append(starts[-1] + widths[k] + 2)

    def left(k: int) -> int:
        """Where column k begins; columns that no single cell has take no room."""
        return starts[bisect_left(columns, k)]

    for out in placed:
        for y in range(max((len(lines) for _, lines, _ in out), default=0)):
            parts, column = [], 0
            for k, lines, _ in out:
                if y >= len(lines) or not lines[y]:
                    continue
                want = left(k)
                if parts:
                    want = max(want, column + 2)
                if want > PADDED:
                    want = column + 2 * bool(parts)
                parts.append(" " * (want - column) + lines[y])
                column = want + width(lines[y])
            flow.put("".join(parts).rstrip())


def _set(node: Node, flow: _Flow) -> None:
    """Sets all that is below a node into flow."""
    # what is left to do, the next last: children to set, or something to call
    todo: list[tuple[Iterator[Node | str], _Flow] | Callable[[], object]] = [(iter(node.children), flow)]
    while todo:
        top = todo[-1]
        if callable(top):
            todo.pop()
            top()
            continue
        children, flow = top
        c = next(children, None)
        if c is None:
            todo.pop()
            continue
        if isinstance(c, str):
            flow.text(c)
            continue
        tag = c.tag
        if tag == "br":
            flow.line(force=True)
        elif tag == "hr":
            flow.block(1)
        elif tag == "img":
            alt = c.get("alt") if c.attributes else None
            if alt:
                flow.text(alt)
        elif tag == "input":
            kind = (c.get("type") or "text").lower()
            if kind in ("button", "submit", "reset") and (value := c.get("value")):
                flow.text(value)
        elif tag == "select":
            for k, x in enumerate(_shown(c)):
                if k:
                    flow.line()
                flow.text(x)
        elif tag == "text" and c.foreign:
            flow.block(0)
            todo += [lambda f=flow: f.block(0), (iter(c.children), flow)]
        elif tag in VOID:
            continue
        elif tag == "pre":
            flow.block(1)
            body = _plain(c).replace("\r\n", "\n").removeprefix("\n").rstrip("\n")
            if body.strip():
                for x in body.split("\n"):
                    flow.put(x.rstrip())
            flow.block(1)
        elif tag == "table":
            flow.block(1)
            rows, other = _rows(c)
            end = lambda f=flow: f.block(1)
            if flow.depth >= ALIGNED or all(len(r) < 2 for r in rows):  # nothing to align: rows are lines
                steps: list = []
                for r in rows:
                    steps += [flow.line, lambda f=flow: f.enter("")]
                    for k, x in enumerate(r):
                        if k:
                            steps.append(lambda f=flow: f.parts.append("  ") if f.parts else None)
                        steps.append((iter(x.children), flow))
                    steps.append(flow.leave)
                steps += [lambda f=flow: f.block(0), end]
                todo += [*reversed(steps), flow.line, (iter(other), flow)]
            else:
                cells = [[(_Flow(flow.depth + 1), _span(x, "colspan", 1_000), _span(x, "rowspan", 65_534), x) for x in r] for r in rows]

                def lay(cells=cells, f=flow) -> None:
                    f.line()
                    for r in cells:
                        for g, *_ in r:
                            g.line()
                    _aligned([[(g.lines, span, down) for g, span, down, _ in r] for r in cells], f)

                todo += [end, lay, *[(iter(x.children), g) for r in cells for g, _, _, x in r], flow.line, (iter(other), flow)]
        elif tag in ("ul", "ol", "menu"):
            flow.block(0)
            todo += [lambda f=flow: f.block(0), (_items(c, flow, todo), flow)]
        elif tag in ("blockquote", "dd"):
            gap = 1 if tag == "blockquote" else 0
            flow.block(gap)
            flow.enter("  ")
            todo += [lambda f=flow, g=gap: (f.leave(), f.block(g)), (iter(c.children), flow)]
        elif tag in BLOCKS:
            gap = 1 if tag in SPACED else 0
            flow.block(gap)
            todo += [lambda f=flow, g=gap: f.block(g), (iter(c.children), flow)]
        else:
            todo.append((iter(c.children), flow))


def _items(node: Node, flow: _Flow, todo: list) -> Iterator[Node | str]:
    """The children of a list, each item with its marker; an item without text takes a number and no line."""
    ordered = node.tag == "ol"
    start = node.get("start") if node.attributes and ordered else None
    number = int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1
    for c in node.children:
        if isinstance(c, Node) and c.tag == "li":
            flow.line()
            flow.enter(f"{number}. " if ordered else "- ")
            number += 1
            todo += [flow.leave, (iter(c.children), flow)]
            yield ""
        else:
            yield c
            flow.line()  # what it had is set by now


def render(html: str) -> str:
    """The visible text of a page, as it is laid out; "" for one without any."""
    root = parse(html)
    if root.hidden:
        return ""
    flow = _Flow()
    _set(root, flow)
    flow.line()
    return "\n".join(flow.lines).strip("\n")


def html_text(pages: DataFrame) -> DataFrame:
    """Each row of pages (page_id, url) with text, the rendering of its html.

    A null html gives null text, an empty page "". Repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(2)
            out = [render(t) if (t := html[i].as_py()) is not None else None for i in range(len(html))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return shared.apply_rows(pages, {c: pages[c] for c in ("page_id", "url", "html")}, run, f"page_id {kinds['page_id']}, url string, text string")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return html_text(shared.table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
SQL: dict[str, str] = {}
