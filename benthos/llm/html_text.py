"""Visible text of web pages, laid out as blocks, lists and aligned tables.

A small tree builder closes what HTML closes by implication (paragraphs, list items, table
parts, options) and supplies rows and cells that were left out; rules for visibility drop
what a browser does not show. A renderer then walks the tree with a stack of its own, so
nesting of any depth is fine: blocks start lines, paragraphs and headings keep a blank line
around them, lists are indented and numbered, preformatted text keeps its spaces, and table
cells are padded to their column's width.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript datalist iframe noembed noframes object audio video canvas".split())
# what may stand in a head; anything else ends it
IN_HEAD = frozenset("head html base basefont bgsound link meta title noscript noframes style script template".split())
# SVG and MathML: text is drawn in these only, and never inside those
DRAWN = {"svg": frozenset("text tspan textpath tref a".split()), "math": frozenset("mi mo mn ms mtext".split())}
UNDRAWN = {"svg": frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter style script".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
# elements of SVG and MathML whose content is HTML again, and HTML elements that end an open svg or math
INNER = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
OUTER = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table fieldset hr".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog dir div dt figcaption footer form header legend li main menu nav section summary caption tbody thead tfoot tr optgroup option".split())
CLOSES_P = BLOCK - frozenset("html body caption tbody thead tfoot tr dd dt li option optgroup legend".split()) | frozenset(["li", "dd", "dt"])
# an element closes these when they are open nearer than any of the listed borders
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DECLARATION = re.compile(r"(?:[^;\"'(]++|\"[^\"]*+\"|'[^']*+'|\([^)]*+\)|[\"'(])+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"\s*([+-]?\d{1,8})")
# inputs whose value a browser shows: as the label of a button, or as text
BUTTONS = frozenset("submit button reset".split())
UNREAD = frozenset("hidden password checkbox radio file color range image".split())
#: Columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _style(style: str) -> dict[str, str]:
    """The last value of each property that can hide an element, the important ones first."""
    found: dict[str, tuple[str, bool]] = {}
    if "display" in (low := style.lower()) or "visibility" in low:
        for declaration in _DECLARATION.findall(_COMMENT.sub("", low)):
            name, _, value = declaration.partition(":")
            value, _, flag = value.partition("!")
            name, value, strong = name.strip(), value.strip(), flag.strip() == "important"
            if name in ("display", "visibility", "content-visibility") and value and (strong or not found.get(name, ("", False))[1]):
                found[name] = (value, strong)
    return {name: value for name, (value, _) in found.items()}


class Node:
    """``kind`` is svg or math inside those; ``unseen`` is inherited visibility, ``hidden`` ends the whole branch."""

    __slots__ = ("tag", "attributes", "children", "hidden", "unseen", "kind")

    def __init__(self, tag: str, attributes: str = "", unseen: bool = False, kind: str = ""):
        self.tag, self.children, self.kind, self.unseen, self.attributes = tag, [], kind, unseen, {}
        self.hidden = tag in UNDRAWN[kind] if kind else tag in HIDDEN
        if attributes and not attributes.isspace():
            for name, *value in _ATTRIBUTE.findall(attributes):
                self.attributes.setdefault(name.lower(), unescape("".join(value)))
            a = self.attributes
            style = _style(a["style"]) if "style" in a else {}
            if kind == "svg":
                style = {k: a[k].strip().lower() for k in ("display", "visibility") if k in a} | style
            display = style.get("display", "block" if tag in BLOCK else "inline")
            skipped = style.get("content-visibility") == "hidden" and display not in ("inline", "contents") and not display.startswith("table-") and tag not in ("tbody", "thead", "tfoot", "tr")
            self.hidden |= ("hidden" in a and not kind) or display == "none" or skipped or (tag == "dialog" and "open" not in a)
            if (shown := style.get("visibility")) in ("visible", "initial", "hidden", "collapse"):
                self.unseen = shown in ("hidden", "collapse")

    @property
    def inner(self) -> bool:
        """Whether HTML starts again inside this element of SVG or MathML."""
        return bool(self.kind) and self.tag in INNER[self.kind]

    def add_text(self, text: str) -> None:
        if not self.unseen and (not self.kind or self.tag in DRAWN[self.kind] or self.inner):
            self.children.append(text)


def parse(html: str) -> Node:
    """The element tree; text nodes are strings."""
    root = Node("#root")
    path, at, n = [root], 0, len(html)
    opened: Counter[str] = Counter()

    def push(node: Node) -> None:
        path.append(node)
        opened[node.tag] += 1

    def cut(i: int) -> None:
        for x in path[i:]:
            opened[x.tag] -= 1
        del path[i:]

    def close(tags: frozenset, borders: frozenset) -> None:
        """End the open elements down to the outermost of ``tags`` that no border hides."""
        left, last = sum(opened[t] for t in tags), 0
        for i in range(len(path) - 1, 0, -1):
            if not left or path[i].tag in borders or path[i].inner:
                break
            if path[i].tag in tags:
                left, last = left - 1, i
        if last:
            cut(last)

    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        closing, tag, attributes, text = m.groups()
        if text is not None:
            if path[-1].tag == "head" and not text.isspace():
                cut(len(path) - 1)
            path[-1].add_text(unescape(text) if "&" in text else text)
        elif tag is not None:
            tag = tag.lower()
            if path[-1].tag == "head" and (tag == "br" if closing else tag not in IN_HEAD):
                cut(len(path) - 1)
            if closing:
                if tag == "br":
                    path[-1].children.append(Node("br"))
                    continue
                wall = frozenset(["table"]) if tag not in ("table", "body", "html") else frozenset()
                found = False
                for i in range(len(path) - 1, 0, -1) if opened[tag] else ():
                    if path[i].tag == tag:
                        found = True
                        cut(i)
                        break
                    if path[i].tag in wall or path[i].inner:
                        break
                if tag == "p" and not found and (not path[-1].kind or path[-1].inner):  # the end of a paragraph that is not open is an empty one
                    path[-1].children.append(Node("p", unseen=path[-1].unseen))
                continue
            if path[-1].kind and not path[-1].inner and (tag in OUTER or tag == "font" and re.search(r"\b(?:color|face|size)\s*=", attributes, re.I)):
                while path[-1].kind and not path[-1].inner:
                    cut(len(path) - 1)
            kind = tag if tag in ("svg", "math") else "" if path[-1].inner else path[-1].kind
            if path[-1].kind == "math" and tag in ("mglyph", "malignmark"):
                kind = "math"
            if not kind and tag in CLOSES_P:
                close(frozenset(["p"]), frozenset(["table", "td", "th", "li", "div", "article", "section", "body"]))
            if not kind and tag in IMPLIED:
                close(*IMPLIED[tag])
            if not kind and tag in ("td", "th") and path[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr", unseen=path[-1].unseen)
                path[-1].children.append(row)
                push(row)
            node = Node(tag, attributes, path[-1].unseen, kind)
            path[-1].children.append(node)
            if kind:
                if not attributes.endswith("/"):
                    push(node)
            elif tag in RAW:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                inside = html[at : stop.start() if stop else n]
                node.add_text(unescape(inside) if tag == "textarea" else inside)
                at = stop.end() if stop else n
            elif tag not in VOID and not attributes.endswith("/"):
                push(node)
            elif tag not in VOID and tag in BLOCK:
                push(node)
    return root


class _Flow:
    """Lines under construction: pending space, wanted blank lines, indent."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.gap, self.indent, self.mark = [], False, 0, 0, ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *more = s.split("\n")
            self._put(first)
            for x in more:
                self.end()
                self._put(x) if x else self.lines.append("")
            return
        words = _SPACE.sub(" ", s)
        if words == " " or not words:
            self.space |= words == " " and bool(self.line)
            return
        if words[0] == " " and self.line or self.space:
            self._put(" ")
        self.space = words[-1] == " "
        self._put(words.strip(" "))

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            mark, self.mark = self.mark, ""
            self.line.append(" " * (self.indent - len(mark)) + mark if mark else " " * self.indent)
        self.line.append(s)

    def end(self, blank: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
            self.gap = 1
        self.space = False
        if blank:
            self.gap = 2

    def done(self) -> list[str]:
        self.end()
        return self.lines


def _width(s: str) -> int:
    """Places that a text takes in a monospaced line: wide characters two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in s)


def _integer(node: Node, name: str, default: int) -> int:
    m = _NUMBER.match(node.attributes.get(name, ""))
    return int(m[1]) if m else default


class _Cell:
    __slots__ = ("lines", "columns", "rows")

    def __init__(self, node: Node):
        self.lines: list[str] = []
        self.columns = min(MOST_COLUMNS, max(1, _integer(node, "colspan", 1)))
        rows = _integer(node, "rowspan", 1)
        self.rows = MOST_ROWS if rows == 0 else min(MOST_ROWS, max(1, rows))


def _table(rows: list[list[_Cell]]) -> list[str]:
    """Rows of cells as text lines with aligned columns; a cell that spans several is put in its first row and column."""
    placed: list[list[tuple[int, _Cell]]] = []
    taken: dict[int, int] = {}  # column: rows that a cell from above still takes
    for r in rows:
        at, own, new = 0, [], []
        for cell in r:
            while at in taken:
                at += 1
            own.append((at, cell))
            if cell.rows > 1:
                new.append((at, cell))
            at += cell.columns
        taken = {c: k - 1 for c, k in taken.items() if k > 1}
        for start, cell in new:
            taken |= dict.fromkeys(range(start, start + cell.columns), cell.rows - 1)
        placed.append(own)
    placed = [r for r in placed if any(any(c.lines) for _, c in r)]
    starts = sorted({at for r in placed for at, _ in r})  # columns in which no cell starts are not drawn
    number = {at: i for i, at in enumerate(starts)}
    end_of = lambda at, cell: bisect_left(starts, at + cell.columns)
    width = [0] * len(starts)
    spread = []
    for r in placed:
        for at, cell in r:
            w, i, j = max(map(_width, cell.lines), default=0), number[at], end_of(at, cell)
            if j - i > 1:
                spread.append((j - i, i, j, w))
            else:
                width[i] = max(width[i], w)
    for _, i, j, w in sorted(spread):
        width[j - 1] += max(0, w - sum(width[i:j]) - 3 * (j - i - 1))
    out = []
    for r in placed:
        for k in range(max(len(c.lines) for _, c in r)):
            line, i = [], 0
            for at, cell in r:
                while i < number[at]:
                    line.append(" " * width[i])
                    i += 1
                text, j = cell.lines[k] if k < len(cell.lines) else "", end_of(at, cell)
                line.append(text + " " * (sum(width[i:j]) + 3 * (j - i - 1) - _width(text)))
                i = j
            out.append(" | ".join(line).rstrip(" "))
    return out


def _drawn_apart(node: Node, flow: _Flow) -> None:
    """Texts of a drawing and rows of a formula are lines; what a formula sets apart gets a space."""
    if node.tag in ("text", "foreignobject", "mtr", "mlabeledtr") or node.tag == "math" and node.attributes.get("display", "").lower() == "block":
        flow.end()
    elif node.tag in ("mtd", "mfrac"):
        flow.space |= bool(flow.line)


def render(root: Node) -> str:
    flows, tables, lists = [_Flow()], [], []
    keep = 0
    todo: list = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            flow.text(node, keep > 0)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th"):
                lines = flows.pop().done()
                if tables and tables[-1]:
                    tables[-1][-1].append(cell := _Cell(node))
                    cell.lines = [x for x in lines if x] or [""]  # a cell keeps its lines together
                else:
                    flows[-1].lines.extend(lines)
            elif tag == "table":
                flow = flows[-1]
                for line in _table(tables.pop()):
                    flow.end()
                    flow._put(line)
                flow.end(True)
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                flow.indent -= 2 if tag != "ol" else 3
                flow.end(not lists)
            elif tag == "pre":
                keep -= 1
                flow.end(True)
            elif tag in ("blockquote", "dd"):
                flow.end(tag == "blockquote")
                flow.indent -= 2
            elif tag == "textarea":
                keep -= 1
            elif node.kind:
                _drawn_apart(node, flow)
            elif tag in BLOCK:
                flow.end(tag in SPACED)
            continue
        if node.hidden:
            continue
        if node.kind:
            _drawn_apart(node, flow)
            todo.append((node, True))
            token = node.kind == "math" and tag in DRAWN["math"]
            inside = [_SPACE.sub(" ", x).strip(" ") if token and isinstance(x, str) else x for x in node.children]
            if tag == "mfrac":  # numerator and denominator are drawn apart
                inside = [y for x in inside for y in (x, " ")][:-1]
            todo.extend((x, False) for x in reversed(inside))
            continue
        if tag == "br":
            if flow.line:
                flow.end()
            else:
                flow.gap = 2
            continue
        if tag == "hr":
            flow.end(True)
            continue
        if tag == "input":
            kind = node.attributes.get("type", "text").strip().lower()
            if not node.unseen and kind not in UNREAD:
                flow.text(node.attributes.get("value", "") or ("" if kind in BUTTONS else node.attributes.get("placeholder", "")), False)
            continue
        if tag == "details" and "open" not in node.attributes:  # closed: its summary only
            node.children = [x for x in node.children if isinstance(x, Node) and x.tag == "summary"][:1]
        if tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            flows.append(_Flow())
        elif tag in ("td", "th"):
            flows.append(_Flow())
        elif tag == "table":
            flow.end(True)
            tables.append([])
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.end(not lists)
            down = tag == "ol" and "reversed" in node.attributes
            items = sum(isinstance(x, Node) and x.tag == "li" for x in node.children) if down else 1
            lists.append([tag, _integer(node, "start", items), -1 if down else 1])
            flow.indent += 2 if tag != "ol" else 3
        elif tag == "li":
            flow.end()
            if lists and lists[-1][0] == "ol":
                lists[-1][1] = _integer(node, "value", lists[-1][1])
                flow.mark = "" if node.unseen else f"{lists[-1][1]}. "
                lists[-1][1] += lists[-1][2]
            elif lists:
                flow.mark = "" if node.unseen else "- "
        elif tag == "pre":
            flow.end(True)
            keep += 1
        elif tag in ("blockquote", "dd"):
            flow.end(tag == "blockquote")
            flow.indent += 2
        elif tag == "textarea":
            if flow.space:
                flow._put(" ")
                flow.space = False
            keep += 1
            node.children = [x.replace("\r\n", "\n").removeprefix("\n").rstrip("\n") for x in node.children]
        elif tag in BLOCK:
            flow.end(tag in SPACED)
        if tag in ("option", "optgroup") and not node.unseen and (label := node.attributes.get("label")):
            flow.text(label, False)
            if tag == "option":  # its label is shown in place of its text
                node.children = []
        todo.append((node, True))
        todo.extend((x, False) for x in reversed(node.children))
    return "\n".join(flows[0].done()).strip("\n")


def extract(html: str) -> str:
    """All visible text of a page; an empty page gives an empty text."""
    return render(parse(html))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars, n_lines) per row of ``pages`` (page_id, html).

    Null and empty html give an empty text. Malformed markup never fails: a lone ``<`` is
    text, unclosed elements end with the page. Repeated rows are rendered each, a null
    page_id stays null, other columns are not read. Empty in, empty out.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts = [extract(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=["page_id", "text", "n_chars", "n_lines"])

    return pages.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
