"""Layout-aware HTML rendering: a tree builder, visibility rules and a line writer.

The builder knows void and raw-text elements, end tags that others imply (p, li, dt, dd, tr,
td, ...) and end tags without a start.  Not shown: what browsers do not show (head, script,
style, template, noscript, ..., [hidden], display: none, visibility: hidden but where a
descendant is visible again, inputs, closed details and dialogs; of SVG and MathML titles,
descriptions, metadata, defs, even where use draws them, and annotations).  Everything else is:
formulas as the text of their elements, SVG labels and matrix rows on lines of their own, blocks
on lines of their own, paragraphs, headings, lists and tables set apart by an empty line,
line breaks, pre as it is, list items with bullets or numbers by depth.  Cells keep their blocks,
lists, pre and tables and stand side by side, each line in its column, over the rows and columns
that they span.  A line too long for its columns, of more than WIDE characters, has its line to
itself: the cells to its right begin below it, in their columns.  So no text is cut or wrapped and
padding is at most WIDE characters a column.

Null or empty html: empty text.  No length limit; depth is not bound by Python's stack.
Repeated rows are rendered each.  Empty table: no rows.  Further columns stay, with the text
in a column of a name that is given.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDE = 60
GAP = "  "
#: Fixed values of HTML: the most columns and rows that a cell spans.
COLSPAN, ROWSPAN = 1000, 65534
#: Fixed values of HTML: inputs that show their value, and what they show without one.
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}
#: Fixed values of HTML: element names by the role that they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("rp head title script style template noscript noembed noframes iframe object audio video canvas datalist input link meta base param source track area map #unseen".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu dir fieldset".split())
BLOCK = SPACED | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav option optgroup section summary search tr caption #label".split())
CLOSES_P = BLOCK - frozenset("body html tr caption option optgroup legend".split())
#: Start tag -> the open elements that it ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Within svg and math: elements that are not drawn, lines of their own, HTML again, and HTML start tags that end them.
FOREIGN_UNSEEN = frozenset("title desc metadata defs annotation annotation-xml".split())
FOREIGN_LINES = frozenset("text mtr mlabeledtr".split())
HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_P_LIMIT = frozenset("button td th caption table object html".split())
_P = frozenset(["p"])
_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?|[\s/]*=")
_SPAN = re.compile(r"[ \t\n\f\r]*\+?([0-9]+)")
_GAP = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(html: str, at: int) -> tuple[dict, int, bool]:
    """The attributes from there on, the place behind the tag (-1: it does not end), and whether it ends in />."""
    out: dict[str, str] = {}
    last = -1
    while at < len(html):
        m = _ATTRIBUTE.match(html, at)
        if m and m.end() > at:
            if m[1]:
                out.setdefault(m[1].lower(), unescape(next((x for x in m.groups()[1:] if x is not None), "")))
            at = last = m.end()
        elif html[at] == ">":
            return out, at + 1, html[at - 1] == "/" and last < at
        elif html[at] in "\"'" and html.find(html[at], at + 1) < 0:
            return out, -1, False
        else:
            at += 1
    return out, -1, False


def parse(html: str) -> Node:
    root = Node("#root", {})
    stack = [root]
    foreign = [False]  # whether children of the open elements are SVG or MathML
    renamed: list[tuple[Node, str]] = []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a name are

    def pop_to(k: int) -> None:
        for x in stack[k:]:
            places[x.tag].pop()
        del stack[k:], foreign[k:]

    def nearest(tags) -> int:
        """Where the last open element of tags is; 0: none is open."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, limit) -> None:
        """Ends an open element of tags within the nearest of limit: of rows and cells the outermost, else the nearest."""
        wall = nearest(limit)
        if "table" not in limit or tags is _P:
            found = nearest(tags)
        else:
            beyond = [p[bisect_right(p, wall)] for t in tags if (p := places.get(t)) and p[-1] > wall]
            found = min(beyond, default=0)
        if found > wall:
            pop_to(found)

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            stack[-1].children.append(html[at:])
            break
        if lt > at:
            stack[-1].children.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if foreign[-1] and html.startswith("<![CDATA[", lt):
            end = html.find("]]>", lt + 9)
            stack[-1].children.append(html[lt + 9 : n if end < 0 else end].replace("&", "&amp;"))
            at = n if end < 0 else end + 3
            continue
        ahead = html[lt + 1 : lt + 2]
        closing = ahead == "/"
        name = _NAME.match(html, lt + 1 + closing)
        if not name:
            if ahead in "!?" and ahead or closing:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                stack[-1].children.append("<")
                at = lt + 1
            continue
        tag, at = name[0].lower(), name.end()
        if html[at : at + 1] == ">":
            attributes, at, alone = {}, at + 1, False
        else:
            attributes, at, alone = _attributes(html, at)
            if at < 0:
                break
        if closing:
            if places.get(tag):
                k = places[tag][-1]
                if tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or nearest(("td", "th", "table")) <= k:
                    pop_to(k)
            elif tag in ("br", "p"):
                stack[-1].children.append(Node(tag, {}))
            continue
        if foreign[-1] and tag in BREAKOUT:
            k = len(stack) - 1
            while foreign[k]:
                k -= 1
            pop_to(k + 1)
        if tag in CLOSES_P and places.get("p"):
            close(_P, _P_LIMIT)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        inside = foreign[-1]
        if inside or tag in ("svg", "math"):
            for k in ("display", "visibility"):  # as style, which goes before them
                if k in attributes:
                    attributes["style"] = f"{k}:{attributes[k]};{attributes.get('style', '')}"
            if inside and tag in FOREIGN_UNSEEN:
                renamed.append((node, "#unseen"))
            elif inside and tag in FOREIGN_LINES:
                renamed.append((node, "#label"))
            elif inside and tag == "mtd":
                node.children.append(" ")
            if alone:
                continue
        if tag == "input" and (label := BUTTONS.get(attributes.get("type", "").strip().lower())) is not None:
            stack[-1].children[-1] = Node("span", attributes)
            stack[-1].children[-1].children.append(attributes.get("value", label).replace("&", "&amp;"))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            node.children.append(html[at : end.start()] if end else html[at:])
            if not end:
                break
            gt = html.find(">", end.end())
            at = n if gt < 0 else gt + 1
            continue
        places[tag].append(len(stack))
        stack.append(node)
        again = tag in HTML_AGAIN or tag == "annotation-xml" and attributes.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")
        foreign.append(tag in ("svg", "math") or inside and not again)
    for node, name in renamed:
        node.tag = name
    return root


class Writer:
    """Lines of text: white space collapses, block borders ask for so many line ends."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.want, self.space, self.prefix, self.mark = 0, False, "", ""
        self.fresh = True

    def border(self, lines: int) -> None:
        self.space = False
        if not self.fresh or self.out:
            self.want = max(self.want, lines)

    def _begin(self) -> None:
        if self.want and self.out:
            self.out.append("\n" * self.want)
            self.fresh = True
        self.want = 0
        if self.fresh:
            if self.prefix or self.mark:
                self.out.append(self.prefix[: len(self.prefix) - len(self.mark)] + self.mark if self.mark else self.prefix)
            self.mark, self.fresh = "", False
        elif self.space:
            self.out.append(" ")
        self.space = False

    def text(self, raw: str) -> None:
        if "&" in raw:
            raw = unescape(raw)
        x = _GAP.sub(" ", raw)
        bare = x.strip(" ")
        if not bare:
            self.space |= bool(x) and not self.fresh
            return
        if x[0] == " ":
            self.space = not self.fresh and not self.want
        self._begin()
        self.out.append(bare)
        self.space = x[-1] == " "

    def line(self, x: str) -> None:
        """A line as it is."""
        if x:
            self._begin()
            self.out.append(x)
        self.new_line()

    def new_line(self) -> None:
        self.space = False
        if self.fresh and not self.want and self.out or self.want:
            self.want += 1
        elif self.out:
            self.want = 1

    def value(self) -> str:
        return "".join(self.out).strip("\n")


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether the node's subtree is laid out, and whether its own text is visible."""
    if node.tag in UNSEEN:
        return False, False
    a = node.attributes
    if a:
        if "hidden" in a:
            return False, False
        if "style" in a:
            for name, value in _STYLE.findall(a["style"]):
                if name.lower() == "display" and value.lower() == "none":
                    return False, False
                if name.lower() == "visibility":
                    visible = value.lower() not in ("hidden", "collapse")
    if node.tag == "dialog" and "open" not in a:
        return False, False
    return True, visible


def _span(text: str, most: int) -> int:
    """The number that an attribute begins with, 1 where there is none."""
    m = _SPAN.match(text)
    return min(int(m[1][:9]), most) if m else 1


def _rows(table: Node, visible: bool) -> tuple[list, list[tuple[int, list]], list]:
    """Captions, rows (row group, cells as node, visible, columns, rows), and what stands in no cell."""
    captions, rows, loose = [], [], []
    groups, bare = 0, None
    todo: list = [(c, visible, 0) for c in reversed(table.children)]
    while todo:
        c, seen, group = todo.pop()
        if isinstance(c, str):
            if c.strip():
                loose.append((c, seen))
            continue
        laid, own = _shown(c, seen)
        if not laid:
            continue
        if c.tag in ("tr", "td", "th"):
            if c.tag == "tr" or bare is None or bare[0] != group:
                rows.append((group, []))
                bare = None if c.tag == "tr" else rows[-1]
            for x in c.children if c.tag == "tr" else [c]:
                if isinstance(x, Node) and x.tag in ("td", "th"):
                    laid, cell = _shown(x, own)
                    if laid:
                        a = x.attributes
                        rows[-1][1].append((x, cell, _span(a.get("colspan", ""), COLSPAN) or 1, _span(a.get("rowspan", ""), ROWSPAN)))
                elif isinstance(x, Node) or x.strip():
                    loose.append((x, own))
        elif c.tag in ("thead", "tbody", "tfoot"):
            groups, bare = groups + 1, None
            todo += [(x, own, groups) for x in reversed(c.children)]
        elif c.tag == "caption":
            captions.append((c, own))
        elif c.tag not in ("col", "colgroup"):
            loose.append((c, own))
    return captions, rows, loose


class Cell:
    """Lines in the columns from start to end (behind), down to the row last; done of them are written."""

    __slots__ = ("start", "end", "last", "lines", "done", "wide")

    def __init__(self, start: int, end: int, last: int, lines: list[str]) -> None:
        self.start, self.end, self.last, self.lines, self.done, self.wide = start, end, last, lines, 0, 0


def _grid(rows: list[tuple[int, list]], pre: bool, tables: dict) -> list[list[Cell]]:
    """The cells of each row in their columns; one that spans rows keeps its columns in those below, in its row group."""
    last = [0] * len(rows)
    for r in range(len(rows) - 1, -1, -1):
        last[r] = last[r + 1] if r + 1 < len(rows) and rows[r + 1][0] == rows[r][0] else r
    out, held = [], []
    for r, (_, row) in enumerate(rows):
        held = sorted((c for c in held if c.last >= r), key=lambda c: c.start)
        here, k = [], 0
        for node, seen, columns, deep in row:
            for c in held:
                if c.start <= k < c.end:
                    k = c.end
            end = min([k + columns, *(c.start for c in held if c.start > k)])
            text = _flow(node.children, seen, pre, tables)
            here.append(Cell(k, end, min(r + deep - 1, last[r]) if deep else last[r], text.split("\n") if text else []))
            k = end
        held += [c for c in here if c.last > r]
        out.append(here)
    return out


def _table(table: Node, visible: bool, pre: bool, tables: dict) -> list[str]:
    captions, rows, loose = _rows(table, visible)
    out: list[str] = []
    for x, seen in (*captions, *loose):
        if text := _flow([x], seen, pre, tables):
            out += text.split("\n")
    grid = _grid(rows, pre, tables)
    cells = [c for row in grid for c in row]
    starts = sorted({c.start for c in cells})  # a column in which no cell starts takes no room
    for c in cells:
        c.start, c.end = bisect_left(starts, c.start), bisect_left(starts, c.end)
    width = [0] * len(starts)
    for c in sorted(cells, key=lambda c: c.end - c.start):
        need = max((len(x) for x in c.lines if len(x) <= WIDE), default=0)
        have = sum(width[c.start : c.end]) + len(GAP) * (c.end - c.start - 1)
        width[c.end - 1] += max(0, need - have)
    place = [0]
    for w in width:
        place.append(place[-1] + w + len(GAP))
    for c in cells:
        room = place[c.end] - len(GAP) - place[c.start]
        c.wide = max((k + 1 for k, x in enumerate(c.lines) if len(x) > room), default=0)
    going: list[Cell] = []  # from rows above, with lines left
    for r, row in enumerate(grid):
        here = sorted(going + row, key=lambda c: c.start)
        top, height, tops = 0, 0, []
        for k, c in enumerate(here):
            wide = max(0, c.wide - c.done) if k + 1 < len(here) else 0
            height = max(height, top + (wide if c.last > r else len(c.lines) - c.done))
            tops.append(top)
            top += wide
        lines: list[list[str]] = [[] for _ in range(height)]
        filled = [0] * height
        for c, top in zip(here, tops):
            for y in range(top, min(height, top + len(c.lines) - c.done)):
                if x := c.lines[c.done + y - top]:
                    lines[y].append(" " * (place[c.start] - filled[y]) + x)
                    filled[y] = place[c.start] + len(x)
            c.done += max(0, min(height - top, len(c.lines) - c.done))
        out += ["".join(x) for x in lines]
        going = [c for c in here if c.last > r and c.done < len(c.lines)]
    return out


def render(children: list, visible: bool = True) -> str:
    """The text of nodes.  Inner tables become lines before those that hold them, so nesting needs no recursion."""
    found, tables = [], {}
    todo = [(c, visible, False) for c in children]
    while todo:
        x, seen, pre = todo.pop()
        if isinstance(x, str):
            continue
        laid, seen = _shown(x, seen)
        if laid:
            if x.tag == "table":
                found.append((x, seen, pre))
            pre = pre or x.tag in ("pre", "xmp")
            todo += [(c, seen, pre) for c in x.children]
    for x, seen, pre in reversed(found):
        tables[x] = _table(x, seen, pre, tables)
    return _flow(children, visible, False, tables)


def _flow(children: list, visible: bool, pre: bool, tables: dict) -> str:
    w = Writer()
    lists: list[list] = []  # open lists: bullet or next number
    todo: list = [("node", c, visible, pre) for c in reversed(children)]
    while todo:
        kind, x, seen, pre = todo.pop()
        if kind == "end":
            x()
            continue
        if isinstance(x, str):
            if not seen:
                continue
            if pre:
                first, *rest = unescape(x).replace("\r\n", "\n").split("\n")
                if first:
                    w._begin()
                    w.out.append(first)
                for y in rest:
                    w.new_line()
                    if y:
                        w._begin()
                        w.out.append(y)
            else:
                w.text(x)
            continue
        laid, seen = _shown(x, seen)
        if not laid:
            continue
        tag = x.tag
        if tag == "br":
            w.new_line()
            continue
        if tag == "table":
            w.border(2)
            for y in tables.pop(x):
                w.line(y)
            w.border(2)
            continue
        inner = x.children
        if tag == "details" and "open" not in x.attributes:
            inner = [c for c in inner if isinstance(c, Node) and c.tag == "summary"]
        if tag in BLOCK or tag in ("td", "th"):
            gap = 2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists) else 1
            w.border(gap)
            if tag in ("ul", "ol", "menu", "dir"):
                start = x.attributes.get("start", "1")
                lists.append([int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1] if tag == "ol" else [None])
                todo.append(("end", lambda: (lists.pop(), w.border(2 if not lists else 1)), None, None))
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] is not None:
                    value = x.attributes.get("value", "")
                    if value.lstrip("-").isdigit() and len(value) < 10:
                        lists[-1][0] = int(value)
                    mark = f"{lists[-1][0]}. "
                    lists[-1][0] += 1
                old = w.prefix
                w.prefix += " " * len(mark)
                w.mark = mark

                def end(old=old) -> None:
                    w.prefix, w.mark = old, ""
                    w.border(1)

                todo.append(("end", end, None, None))
            else:
                todo.append(("end", lambda gap=gap: w.border(gap), None, None))
        todo += [("node", c, seen, pre or tag in ("pre", "xmp")) for c in reversed(inner)]
    return w.value()


def html_to_text(html: str | None) -> str:
    return render(parse(html).children) if html else ""


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the visible text of the html column."""
    own = [f for f in pages.schema.fields if f.name != text]
    schema = T.StructType([*own, T.StructField(text, T.StringType())])

    def run(batches):
        for b in batches:
            texts = [html_to_text(x) for x in b.column(b.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in own), pa.array(texts, pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)
