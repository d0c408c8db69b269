"""HTML extraction: a small tree builder and a layout-aware text renderer.

The tree builder knows void elements, raw-text elements, implied end tags and
ignores what the page leaves open or closes twice. Visibility rules then drop
what a browser would not show, and the renderer keeps block spacing, list
markers, preformatted text and tables with aligned columns. Both work with
explicit stacks and look the open elements up by name, so time is in proportion
to the page, however deep or broken it is.
"""

from __future__ import annotations

import html
import re
import textwrap
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element classes of the HTML standard, and display rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist input".split())
#: Parts of pictures and formulas that are not drawn.
UNDRAWN = {
    "svg": frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr address".split())
BLOCK = PARAGRAPH | frozenset(
    "html body div section article aside nav header footer main form li dt dd details summary figcaption legend hgroup menu center caption thead tbody tfoot tr option optgroup dialog search".split()
)
CLOSES_P = PARAGRAPH | frozenset("div section article aside nav header footer main form details menu figcaption hgroup center dialog search li dd dt".split())
#: An opening tag ends these open elements, unless one of the limits comes first.
IMPLIED_END = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "thead": (frozenset({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
SCOPE = frozenset("table td th caption button object template html".split())
CELL_SCOPE = frozenset({"td", "th", "table"})
#: The standard's largest colspan and rowspan.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65_534
#: Cells left of others break their lines at WRAP characters; lines that keep their form pad up to PAD; deeper levels are indented no further than INDENT.
WRAP, PAD, INDENT = 60, 120, 80
#: A table is padded to at most so many times its own size.
ROOM = 20
#: Tables nested deeper are laid out as blocks, each cell on its own lines.
NESTED = 16

_SPECIAL = re.compile(r"<!--(?:-?>|.*?(?:-->|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
# A quoted run stands straight after the "=" of an attribute; elsewhere a quote is a character like others.
_REST = re.compile(r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+)*+)>", re.S)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^\s>]*+)))?+")
_STYLE = re.compile(r"\b(display|visibility)\s*:\s*([a-z-]+)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


class _Open:
    """The open elements, and at which depths each name stands."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.depths: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.stack.pop().name].pop()

    def last(self, names: frozenset[str]) -> int:
        """Depth of the innermost open element with one of the names; 0 without any."""
        return max((d[-1] for n in names if (d := self.depths.get(n))), default=0)

    def end_implied(self, names: frozenset[str], limits: frozenset[str]) -> None:
        while (depth := self.last(names)) > self.last(limits):
            self.cut(depth)


def parse(page: str) -> Node:
    """The element tree of a page."""
    root = Node("#root")
    opened = _Open(root)
    at, last_end, quotes = 0, page.rfind(">"), True

    def add(text: str) -> None:
        if text:
            opened.stack[-1].children.append(html.unescape(text))

    held = 0  # where text that is not added yet begins
    while (start := page.find("<", at)) >= 0:
        if page[start + 1: start + 2] in ("!", "?"):
            special = _SPECIAL.match(page, start)
            add(page[held:start])
            if special["cdata"] is not None:
                opened.stack[-1].children.append(special["cdata"])
            at = held = special.end()
            continue
        tag = _TAG.match(page, start)
        if not tag or tag.end() > last_end:
            at = start + 1
            continue
        rest = _REST.match(page, tag.end()) if quotes else None
        if rest:
            attrs, stop = rest[1], rest.end()
        else:  # some quote is not closed by the end of the page: from here on quotes are ordinary characters
            quotes, stop = False, page.index(">", tag.end()) + 1
            attrs = page[tag.end(): stop - 1]
        add(page[held:start])
        at = held = stop
        name = tag[2].lower()
        if tag[1]:
            _end(opened, name)
            continue
        if name in CLOSES_P:
            opened.end_implied(frozenset({"p"}), SCOPE)
        if name in IMPLIED_END:
            opened.end_implied(*IMPLIED_END[name])
        node = Node(name, _attributes(attrs) if attrs else {})
        opened.stack[-1].children.append(node)
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            close = _CLOSERS[name].search(page, at)
            raw = page[at: close.start() if close else len(page)]
            at = held = close.end() if close else len(page)
            node.children.append(html.unescape(raw) if name == "textarea" else raw)
            continue
        opened.push(node)
    add(page[held:])
    return root


def _end(opened: _Open, name: str) -> None:
    """An end tag: its element and all inside it end. One that is not open is
    ignored, as is that of an inline element outside the table cell."""
    if name == "br" or name == "p" and not opened.depths.get("p"):
        opened.stack[-1].children.append(Node(name))
        return
    depth = opened.last(frozenset({name}))
    if depth and (name in BLOCK or name in CELL_SCOPE or depth > opened.last(CELL_SCOPE)):
        opened.cut(depth)


def _styles(node: Node) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in _STYLE.findall(node.attrs["style"])} if "style" in node.attrs else {}


class _Page:
    """Lines under construction, with blank lines collapsed like margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.kept: list[bool] = []  # lines that keep their form: preformatted ones, and those of tables
        self.parts: list[str] = []
        self.gap = 0  # blank lines due before the next line
        self.space = False
        self.marker = ""
        self.indents = [""]

    def text(self, text: str) -> None:
        words = _BLANK.split(text)
        if words[0] == "" and self.parts:
            self.space = True
        inner = " ".join(w for w in words if w)
        if inner:
            self.parts.append(" " + inner if self.space and self.parts else inner)
            self.space = words[-1] == ""
        elif self.parts and len(words) > 1:
            self.space = True

    def indent(self, by: str) -> None:
        self.indents.append(self.indents[-1] + by if len(self.indents[-1]) + len(by) <= INDENT else self.indents[-1])

    def line(self, text: str, kept: bool = False) -> None:
        indent = self.indents[-1]
        if self.marker:
            indent, self.marker = self.indents[-2] + self.marker, ""
        if self.gap and self.lines:
            self.lines += [""] * self.gap
            self.kept += [False] * self.gap
        self.gap = 0
        self.lines.append((indent + text).rstrip())
        self.kept.append(kept)

    def end_line(self) -> None:
        if self.parts:
            self.line("".join(self.parts))
        self.parts, self.space = [], False

    def block(self, margin: int) -> None:
        self.end_line()
        self.gap = max(self.gap, margin)


@dataclass
class _Cell:
    lines: list[str]
    kept: list[bool]
    columns: int
    rows: int
    at: int = 0

    def wrap(self, width: int) -> None:
        """Break lines at spaces; a word longer than the width stays whole."""
        out: list[str] = []
        for line, kept in zip(self.lines, self.kept):
            lead = line[: len(line) - len(line.lstrip())]
            out += [line] if kept or len(line) <= width else textwrap.wrap(
                line, width, subsequent_indent=lead, break_long_words=False, break_on_hyphens=False, drop_whitespace=True
            )
        self.lines = out


@dataclass
class _Table:
    outer: _Page
    rows: list[list[_Cell]] = field(default_factory=list)


def _place(rows: list[list[_Cell]]) -> None:
    """Gives each cell its column, past the cells that reach down from rows above."""
    hanging: list[list[int]] = []  # [first column, column behind, row behind], neighbours that end together as one
    for r, row in enumerate(rows):
        if not row:
            continue
        hanging = [h for h in hanging if h[2] > r]
        column, k, added = 0, 0, []
        for cell in row:
            while k < len(hanging) and hanging[k][0] <= column:
                column, k = max(column, hanging[k][1]), k + 1
            cell.at = column
            column += cell.columns
            if cell.rows > 1:
                added.append([cell.at, column, r + cell.rows])
        if added:
            merged: list[list[int]] = []
            for h in sorted(hanging + added):
                if merged and merged[-1][1] == h[0] and merged[-1][2] == h[2]:
                    merged[-1][1] = h[1]
                else:
                    merged.append(h)
            hanging = merged


def _aligned(rows: list[list[_Cell]]) -> list[str]:
    """Rows of cells as lines, cells of one column under each other."""
    _place(rows)
    rows = [row for row in rows if any(any(c.lines) for c in row)]
    # Columns in which no cell begins take no room.
    starts = sorted({c.at for row in rows for c in row})
    number = {at: k for k, at in enumerate(starts)}
    ends = [*starts, float("inf")]
    width = [0] * len(starts)
    placed = []
    for row in rows:
        own = []
        for c in row:
            first = number[c.at]
            behind = first + 1
            while behind < len(starts) and ends[behind] < c.at + c.columns:
                behind += 1
            if behind < len(starts):
                c.wrap(WRAP)
            if behind == first + 1:
                width[first] = max(width[first], min(PAD, max(map(len, c.lines), default=0)))
            own.append((first, behind, c.lines))
        placed.append(own)
    # A table made to be mostly padding is not padded, so the output stays in proportion to the page.
    upto = [0]
    for w in width:
        upto.append(upto[-1] + w + 3)
    room = sum(upto[own[-1][1]] * max(len(lines) for *_, lines in own) for own in placed)
    padded = room <= ROOM * sum(10 + sum(map(len, lines)) for own in placed for *_, lines in own)
    out = []
    for own in placed:
        for h in range(max(len(lines) for *_, lines in own)):
            shown = [(a, b, lines[h] if h < len(lines) else "") for a, b, lines in own]
            if h:
                while shown and not shown[-1][2]:
                    shown.pop()
            if not padded:
                out.append(" | ".join(text for *_, text in shown))
                continue
            parts, column = [], 0
            for first, behind, text in shown:
                parts += [" " * w for w in width[column:first]]
                parts.append(text.ljust(sum(width[first:behind]) + 3 * (behind - first - 1)))
                column = behind
            out.append(" | ".join(parts).rstrip())
    return out


def _number(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"-?\d{1,9}", text.strip()) else default


def _options(select: Node) -> list[Node | str]:
    """What a closed selection box shows: the content of the chosen option, in a box of several rows all of it."""
    if "multiple" in select.attrs or _number(select.attrs.get("size", ""), 1) > 1:
        return select.children
    options, todo = [], list(reversed(select.children))
    while todo:
        node = todo.pop()
        if isinstance(node, Node):
            if node.name == "option":
                options.append(node)
            else:
                todo += reversed(node.children)
    chosen = [o for o in options if "selected" in o.attrs][-1:] or [o for o in options if "disabled" not in o.attrs][:1] or options[:1]
    return [" ", *(chosen[0].children or [chosen[0].attrs.get("label", "")]), " "] if chosen else []


def render(root: Node) -> str:
    """All visible text of a tree, laid out."""
    page = _Page()
    tables: list[_Table] = []
    lists: list[list] = []  # [is ordered, next number]
    cells: list[int] = []
    shown = [True]
    pre = deep = 0  # open preformatted elements, open tables that are laid out as blocks
    inside = dict.fromkeys(UNDRAWN, 0)
    todo: list[tuple[bool, Node | str]] = [(False, root)]
    while todo:
        leaving, node = todo.pop()
        if isinstance(node, str):
            if not shown[-1]:
                continue
            if pre:
                first, *more = node.split("\n")
                page.parts.append(first)
                for x in more:
                    page.line("".join(page.parts), kept=True)
                    page.parts = [x]
            elif not (tables and len(cells) < len(tables) and not deep and not node.strip()):
                page.text(node)
            continue
        name = node.name
        if name == "table":
            if not leaving and (deep or len(tables) == NESTED):
                deep += 1
            is_deep = deep > 0
            deep -= leaving and is_deep
        is_block = name in BLOCK or name == "text" and inside["svg"] or deep and name in ("td", "th")
        margin = 1 if name in PARAGRAPH and not (name in ("ul", "ol") and lists) else 0
        if not leaving:
            style = _styles(node) if node.attrs else {}
            if name in HIDDEN or "hidden" in node.attrs or style.get("display") == "none" or name == "dialog" and "open" not in node.attrs:
                continue
            if inside["svg"] and name in UNDRAWN["svg"] or inside["math"] and name in UNDRAWN["math"]:
                continue
            visible = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility"), shown[-1])
            if name == "br":
                if page.parts:
                    page.end_line()
                else:
                    page.gap = max(page.gap, 1)
                continue
            if name == "img":
                page.text(f" {node.attrs['alt']} " if visible and node.attrs.get("alt", "").strip() else "")
                continue
            if is_block:
                page.block(margin)
            if name == "hr":
                continue
            children = node.children
            if name == "pre":
                pre += 1
                if children and isinstance(children[0], str) and children[0].startswith("\n"):
                    children = [children[0][1:], *children[1:]]
            elif name in ("ul", "ol", "menu"):
                lists.append([name == "ol", _number(node.attrs.get("start", ""), 1)])
            elif name == "li":
                ordered = lists[-1] if lists else [False, 1]
                if ordered[0]:
                    ordered[1] = _number(node.attrs.get("value", ""), ordered[1])
                mark = f"{ordered[1]}. " if ordered[0] else "- "
                ordered[1] += 1
                if page.marker:
                    page.line("")
                page.indent(" " * len(mark))
                page.marker = mark if visible else ""
            elif name == "dd" or name == "blockquote":
                page.indent("  ")
            elif name == "table":
                if not is_deep:
                    tables.append(_Table(page))
            elif name == "tr" and tables and not deep:
                tables[-1].rows.append([])
            elif name in ("td", "th") and tables and not deep:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                cells.append(len(tables))
                page = _Page()
            elif name == "select":
                children = _options(node)
            elif name in inside:
                inside[name] += 1
            shown.append(visible)
            todo.append((True, node))
            todo += [(False, child) for child in reversed(children)]
            continue
        shown.pop()
        if name == "pre":
            pre -= 1
        elif name in ("ul", "ol", "menu"):
            lists.pop()
        elif name == "li":
            page.end_line()
            if page.marker:
                page.line("")
            page.indents.pop()
        elif name == "dd" or name == "blockquote":
            page.end_line()
            page.indents.pop()
        elif name in ("td", "th") and cells and cells[-1] == len(tables) and not deep:
            page.end_line()
            columns = min(max(_number(node.attrs.get("colspan", ""), 1), 1), MAX_COLSPAN)
            rows = _number(node.attrs.get("rowspan", ""), 1)
            tables[-1].rows[-1].append(_Cell(page.lines, page.kept, columns, min(rows, MAX_ROWSPAN) if rows > 0 else MAX_ROWSPAN))
            cells.pop()
            page = tables[-1].outer
        elif name == "table" and not is_deep:
            page.end_line()
            for line in _aligned(tables.pop().rows):
                page.line(line, kept=True)
        elif name in inside:
            inside[name] -= 1
        if is_block:
            page.block(margin)
    page.end_line()
    return "\n".join(page.lines).strip("\n")


def html_to_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of every page, from its ``html``.

    Null and empty pages give an empty text. Markup that is never closed is
    closed by the end of the page; a page without markup is its own text with
    white space collapsed. Each page is worked on alone, so repeated rows give
    equal results, and an empty table gives none. Only page_id and html are
    read. Hidden elements give nothing; what is made visible again inside an
    invisible one counts, as do the texts of pictures and formulas and the
    chosen option of a selection box. A cell keeps its paragraphs and lists, as
    lines under each other; a column left of others breaks its lines at WRAP
    characters, a cell across columns or rows stands where it begins. Output is
    in proportion to the page: see INDENT, ROOM and NESTED.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [html_to_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                ],
                names=["page_id", "text", "n_chars", "n_lines"],
            )

    schema = T.StructType([
        T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("n_lines", T.LongType()),
    ])
    return pages.select("page_id", "html").mapInArrow(extract, schema)
