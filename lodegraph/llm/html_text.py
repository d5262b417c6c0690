"""Layout-aware text of HTML pages.

A tree builder takes tags as browsers' rules imply them (a block ends an open paragraph, an item the item before it, a
cell the cell before it, the first thing a head can't hold the head, a cell without a row starts one, unclosed tags
end with their parents; a slash before the end of a tag closes nothing but in SVG and MathML); the renderer walks the
tree: hidden elements give nothing, blocks stand on lines of their own with one empty line between paragraphs, lists get
markers and indentation (``start``, ``reversed``, ``value``), cells of a table are padded to the width of their columns,
where cells over several columns or rows keep the others in place and wide characters count as two, and ``pre`` keeps
its spacing. All text that a reader would see is kept, navigation, footers and the text of drawings included; of a
select that is the shown option, or all options where it is a list box.

Hidden: the attribute ``hidden`` unless the style sets a display, and a style with display none, each with all it contains;
a style with visibility hidden or collapse, but for what is visible again within; the same by rules of the page's own ``<style>`` whose
selectors name an element, classes or an id, by their weight; closed ``details`` but for their summary and ``dialog`` that isn't
open. What is hidden from screen readers only
(``aria-hidden``) is text like any other.

Defined cases: null or empty HTML gives an empty text; a tag that never ends is text from its ``<`` on, markup within it
included, and an unclosed comment or script hides what follows, so each page is read once, in time linear in its length; elements
nested deeper than ``DEPTH`` join their ancestor at that depth, and cells of a table wider than ``WIDE`` aren't aligned, which changes the layout only; repeated
rows come back repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, text_column

DEPTH = 256
#: Columns of the screen beyond which a table's cells aren't aligned but stand two blanks apart, so that short rows stay short.
WIDE = 500
# Fixed values of the HTML standard: element classes by their names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link datalist iframe object canvas audio video noembed noframes desc defs symbol metadata annotation".split())
#: Elements of other languages: a slash closes tags in them, and each text of a drawing stands apart.
FOREIGN = frozenset(("svg", "math"))
MOST_COLUMNS, MOST_ROWS = 1000, 65_534  # of a cell
BLOCKS = frozenset(
    "address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table "
    "caption thead tbody tfoot tr ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
#: An opening tag -> the open elements it ends, and the elements that shield them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: What may stand in these elements; any other tag or text ends them.
HOLDS = {
    "head": frozenset("head base basefont bgsound link meta title noscript noframes style script template".split()),
    "colgroup": frozenset("col template".split()),
}
SECTIONS = frozenset("thead tbody tfoot".split())
#: A part of a table -> the elements it may stand in; what is open within the nearest of them ends.
CONTEXT = {
    **dict.fromkeys(("td", "th"), SECTIONS | {"tr", "table"}),
    "tr": SECTIONS | {"table"},
    **dict.fromkeys((*SECTIONS, "caption", "colgroup"), frozenset({"table"})),
    "col": frozenset({"colgroup", "table"}),
}
_COMMENT_TAG = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
# quotes count after = only; nothing is tried twice, so a tag is read in one pass
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_MAY_HIDE = re.compile("hidden|style", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARATION = re.compile(r"(?:\"[^\"]*\"|'[^']*'|\([^)]*\)|[^;])+")
_SPACE = re.compile(r"[ \t\n\r\f]+")


_AT_RULE = re.compile(r"@[^{};]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\})")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_COMPOUND = re.compile(r"[a-z][a-z0-9]*|[.#][\w-]+", re.I)


class Node:
    __slots__ = ("attributes", "children", "look", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.look = tag, attributes, [], {}


def attributes(node: Node) -> dict[str, str]:
    """Names in lower case and values; of repeated names the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(node.attributes):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def style(value: str) -> dict[str, str]:
    """Properties and values of a style attribute: the last of a name counts, the last important one before it."""
    found: dict[str, tuple[bool, str]] = {}
    for declaration in _DECLARATION.findall(_COMMENT.sub("", value)):
        name, _, what = declaration.partition(":")
        what, mark, _ = what.partition("!")
        name, what = name.strip().lower(), what.strip().lower()
        if what and (mark or not found.get(name, (False, ""))[0]):
            found[name] = (bool(mark), what)
    return {name: what for name, (_, what) in found.items()}


def shown(node: Node, inherited: bool) -> tuple[bool, bool]:
    """Whether the element is laid out at all, and whether its own text is visible."""
    if node.tag in HIDDEN:
        return False, False
    if not node.look and node.tag != "dialog" and not _MAY_HIDE.search(node.attributes):
        return True, inherited
    own = attributes(node)
    look = node.look | style(own.get("style", ""))
    if node.tag == "dialog" and "open" not in own:
        look.setdefault("display", "none")
    visibility = look.get("visibility", "")
    visible = visibility == "visible" or inherited and visibility not in ("hidden", "collapse")
    return look.get("display", "none" if "hidden" in own else "") != "none", visible


def rules(sheet: str) -> dict[str, list[tuple]]:
    """The rules of a style sheet that hide or show: by one part of their selector, (weight, all parts, property, value).

    Selectors are an element's name, classes and id, alone or in a list; those that look at other elements or states, and
    rules within others, aren't followed.
    """
    found: dict[tuple, tuple] = {}
    for order, (selectors, body) in enumerate(_RULE.findall(_AT_RULE.sub("", _COMMENT.sub("", sheet)))):
        look = {k: v for k, v in style(body).items() if k in ("display", "visibility")}
        for selector in selectors.split(",") if look else ():
            parts = _COMPOUND.findall(selector.strip())
            if parts and "".join(parts) == selector.strip():
                names = frozenset(x if x[0] in ".#" else x.lower() for x in parts)
                weight = (sum(x[0] == "#" for x in names), sum(x[0] == "." for x in names), len(names), order)
                found.update({(names, k): (weight, v) for k, v in look.items()})
    often = Counter(x for names, _ in found for x in names)
    out: dict[str, list[tuple]] = {}
    for (names, k), (weight, v) in found.items():
        out.setdefault(min(names, key=lambda x: (often[x], x)), []).append((weight, names, k, v))
    return out


def _prepare(root: Node) -> None:
    """Give nodes what the page's own style sheets say of them, and leave of closed details their summary."""
    nodes, sheets, closed = [], [], []
    todo = [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [x for x in node.children if not isinstance(x, str)]
        if node.tag == "style":
            sheets.append("".join(x for x in node.children if isinstance(x, str)))
        elif node.tag == "details" and "open" not in attributes(node):
            closed.append(node)
    for node in closed:
        node.children = [x for x in node.children if not isinstance(x, str) and x.tag == "summary"][:1]
    known = rules("\n".join(sheets)) if sheets else {}
    for node in nodes if known else ():
        own = attributes(node) if "class" in node.attributes.lower() or "id" in node.attributes.lower() else {}
        names = {node.tag, *(f".{x}" for x in own.get("class", "").split()), *([f"#{own['id']}"] if own.get("id") else [])}
        for _, needs, k, v in sorted((r for x in names for r in known.get(x, ())), key=lambda r: r[0]):
            if needs <= names:
                node.look[k] = v


def _number(value: str | None, least: int, most: int, default: int) -> int:
    """A whole number as attributes give it: what stands behind its digits is ignored."""
    found = re.match(r"\s*([+-]?\d{1,9})(?!\d)", value or "", re.A)
    return min(int(found[1]), most) if found and int(found[1]) >= least else default


def _width(text: str) -> int:
    """Columns of a fixed-width screen: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _text(stack: list[Node], text: str) -> None:
    if stack[-1].tag in HOLDS and text.strip(" \t\n\r\f"):
        stack.pop()
    stack[-1].children.append(text)


def _place(stack: list[Node], tag: str) -> None:
    """End what a part of a table can't stand in and open the row that a cell implies."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in CONTEXT[tag]:
            del stack[i + 1 :]
            if tag in ("td", "th") and stack[i].tag != "tr" and len(stack) < DEPTH:
                row = Node("tr")
                stack[i].children.append(row)
                stack.append(row)
            break
        if stack[i].tag in ("table", "template"):
            break


def tree(page: str) -> Node:
    """The tree of a page, its children being texts and nodes."""
    root = Node("#root")
    stack, at = [root], 0
    while at < len(page):
        begin = page.find("<", at)
        while begin >= 0 and not (page[begin + 1 : begin + 2] in ("!", "?") or page[begin + 1 : begin + 3].lstrip("/")[:1].isalpha() and page[begin + 1 : begin + 3].isascii()):
            begin = page.find("<", begin + 1)
        if begin < 0:
            _text(stack, html.unescape(page[at:]))
            break
        if begin > at:
            _text(stack, html.unescape(page[at:begin]))
        if page[begin + 1] in "!?":
            comment = _COMMENT_TAG.match(page, begin)
            end = comment.end() if comment else page.find(">", begin) + 1
            if not end:
                _text(stack, html.unescape(page[begin:]))
                break
            at = end
            continue
        found = _TAG.match(page, begin)
        if not found:
            _text(stack, html.unescape(page[begin:]))
            break
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "td", "th") and tag not in BLOCKS and tag not in ("td", "th"):
                    break  # an inline end tag doesn't reach out of a cell
            continue
        ends, shields = ENDS.get(tag, ({"p"}, set()) if tag in BLOCKS else (set(), set()))
        if tag in ENDS and tag in BLOCKS:
            ends = ends | {"p"}
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in shields:
                break
            if stack[i].tag in ends:
                del stack[i:]
                if tag not in ENDS:
                    break
            elif tag not in ENDS and stack[i].tag in BLOCKS:
                break
        if stack[-1].tag in HOLDS and tag not in HOLDS[stack[-1].tag]:
            stack.pop()
        if tag in CONTEXT:
            _place(stack, tag)
        node = Node(tag, found[3])
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            node.children.append(html.unescape(page[at : close.start() if close else len(page)]))
            end = page.find(">", close.start()) if close else -1
            at = end + 1 if end >= 0 else len(page)
        elif tag not in VOID and len(stack) < DEPTH:
            if not found[3].rstrip().endswith("/") or tag not in FOREIGN and not any(x.tag in FOREIGN for x in stack):
                stack.append(node)
    return root


class Writer:
    """Lines of text: inline text is gathered, white space folded, blocks broken."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0

    def text(self, x: str, keep: bool = False) -> None:
        if keep:
            first, *rest = x.split("\n")
            self.now.append(first)
            for line in rest:
                self.line_break()
                self.now.append(line)
        else:
            self.now.append(_SPACE.sub(" ", x))

    def line_break(self) -> None:
        self.lines.append("".join(self.now))
        self.now = []

    def block(self, gap: int) -> None:
        """End the line; before the next text stand ``gap`` empty lines at least."""
        line = "".join(self.now)
        self.now = []
        if line.strip():
            self.lines.append(line)
        if self.lines and gap and self.lines[-1] != "":
            self.lines.append("")

    def result(self, fold: bool = True) -> list[str]:
        self.block(0)
        out: list[str] = []
        for line in self.lines:
            line = _fold(line) if fold else line.rstrip()
            if line or out and out[-1]:
                out.append(line)
        while out and not out[-1]:
            out.pop()
        return out


def _fold(line: str) -> str:
    body = line.lstrip("\x00")
    if body != line:  # a line of fixed spacing is marked by a leading zero
        return body.rstrip()
    return re.sub(" +", " ", line).strip(" ")


def render(node: Node, out: Writer, pre: bool = False, visible: bool = True) -> None:
    for child in node.children:
        if isinstance(child, str):
            if not visible:
                continue
            if pre:
                first, *rest = child.split("\n")
                out.now.append(first)
                for line in rest:
                    out.line_break()
                    out.now.append("\x00" + line)
            else:
                out.text(child)
            continue
        tag = child.tag
        there, seen = shown(child, visible)
        if not there:
            continue
        if tag == "br":
            out.line_break()
        elif tag == "img":
            out.text(attributes(child).get("alt", "") if seen else "")
        elif tag == "select":
            if seen:
                _select(child, out)
        elif tag == "table":
            _fixed(out, _table(child, seen), 1)
        elif tag in ("ul", "ol", "menu", "dir"):
            _fixed(out, _list(child, seen), 0)
            out.block(1 if node.tag not in ("li", "nav") else 0)
        elif tag == "pre":
            out.block(1)
            inner = Writer()
            inner.now.append("\x00")
            render(child, inner, True, seen)
            _fixed(out, inner.result(), 1)
        elif tag in BLOCKS:
            gap = 1 if tag in SPACED else 0
            out.block(gap)
            render(child, out, pre, seen)
            out.block(gap)
        elif tag == "text":  # of a drawing
            out.text(" ")
            render(child, out, pre, seen)
            out.text(" ")
        else:
            render(child, out, pre, seen)


def _fixed(out: Writer, lines: list[str], gap: int) -> None:
    out.block(gap)
    out.lines.extend("\x00" + x if x else "" for x in lines)
    out.block(gap)


def _options(node: Node, off: bool = False) -> Iterator[tuple[Node, dict[str, str], bool]]:
    """Groups and options of a select in order: the element, its attributes, whether it is disabled."""
    for child in node.children:
        if not isinstance(child, str):
            own = attributes(child)
            if child.tag in ("option", "optgroup"):
                yield child, own, off or "disabled" in own
            if child.tag != "option":
                yield from _options(child, off or child.tag == "optgroup" and "disabled" in own)


def _select(node: Node, out: Writer) -> None:
    """The option that a closed select shows: the last selected one, else the first that can be chosen."""
    own, found = attributes(node), list(_options(node))
    if "multiple" in own or own.get("size", "").strip() not in ("", "0", "1"):
        for child, its, _ in found:
            if all(shown(child, True)):
                out.block(0)
                _option(child, its, out)
                out.block(0)
        return
    options = [x for x in found if x[0].tag == "option"]
    chosen = [x for x in options if "selected" in x[1]][-1:] or [x for x in options if not x[2]][:1]
    for child, its, _ in chosen:
        _option(child, its, out)


def _option(node: Node, own: dict[str, str], out: Writer) -> None:
    if own.get("label") or node.tag == "optgroup":
        out.text(own.get("label", ""))
    else:
        render(node, out)


def _inner(node: Node, visible: bool = True) -> list[str]:
    inner = Writer()
    if node.tag == "select":
        if visible:
            _select(node, inner)
    else:
        render(node, inner, False, visible)
    return inner.result()


def _list(node: Node, visible: bool = True) -> list[str]:
    """Items with a dash or their number; what an item holds besides its first line is indented below it."""
    own = attributes(node)
    items = [(child, *shown(child, visible)) for child in node.children if not isinstance(child, str)]
    step = -1 if "reversed" in own else 1
    count = sum(child.tag == "li" and there for child, there, _ in items)
    number = _number(own.get("start"), -(10**9), 10**9, count if step < 0 else 1)
    seen = iter(items)
    lines: list[str] = []
    for child in node.children:
        if isinstance(child, str):
            lines += [x for x in [_fold(_SPACE.sub(" ", child))] if x and visible]
            continue
        _, there, sees = next(seen)
        if not there:
            continue
        body = _inner(child, sees)
        if child.tag == "li":
            number = _number(attributes(child).get("value"), -(10**9), 10**9, number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += step
            lines += [(mark if i == 0 else " " * len(mark)) + x for i, x in enumerate(body)]
        else:
            lines += ["  " + x for x in body]
    return lines


def _rows(node: Node, visible: bool) -> Iterator[tuple[Node, bool, Node]]:
    """Rows of a table, whether their text is visible, and what they stand in."""
    for child in node.children:
        if not isinstance(child, str):
            there, seen = shown(child, visible)
            if there and child.tag == "tr":
                yield child, seen, node
            elif there and child.tag in SECTIONS:
                yield from _rows(child, seen)


def _loose(node: Node) -> Iterator[Node | str]:
    """What stands in a table or its sections outside of rows."""
    for child in node.children:
        if isinstance(child, str) or child.tag not in SECTIONS | {"tr", "colgroup", "col"}:
            yield child
        elif child.tag in SECTIONS and shown(child, True)[0]:
            yield from _loose(child)


class Covered:
    """Columns that cells from the rows above cover: disjoint pieces with the row in which they end, and the free columns between them.

    Each piece is put in, cut and taken out a bounded number of times, and the first free column is looked up, so a table of
    wide and tall cells costs no more than its cells.
    """

    def __init__(self):
        self.starts: list[int] = []
        self.pieces: dict[int, tuple[int, int]] = {}  # start -> end, row
        self.free: list[int] = [0]
        self.free_end: dict[int, float] = {0: float("inf")}
        self.ends: list[tuple[int, int, int]] = []  # row, start, end: a heap

    def first_free(self, at: int) -> int:
        i = bisect_right(self.free, at) - 1
        return at if i >= 0 and self.free_end[self.free[i]] > at else self.free[i + 1]

    def cover(self, a: int, b: int, row: int) -> None:
        """Columns a to b - 1 are covered up to ``row``, whatever covered them before."""
        i = max(bisect_right(self.starts, a) - 1, 0)
        j = bisect_left(self.starts, b)
        old = [(x, *self.pieces.pop(x)) for x in self.starts[i:j]]
        new = sorted([(a, b, row), *(p for s, e, r in old for p in ((s, min(e, a), r), (max(s, b), e, r)) if p[0] < p[1])])
        self.starts[i:j] = [s for s, _, _ in new]
        for s, e, r in new:
            self.pieces[s] = (e, r)
            heappush(self.ends, (r, s, e))
        i = max(bisect_right(self.free, a) - 1, 0)
        j = bisect_left(self.free, b)
        gaps = [(x, self.free_end.pop(x)) for x in self.free[i:j]]
        rest = [p for s, e in gaps for p in ((s, min(e, a)), (max(s, b), e)) if p[0] < p[1]]
        self.free[i:j] = [s for s, _ in rest]
        self.free_end.update(rest)

    def reach(self, row: int) -> None:
        """Free what ends before ``row``."""
        while self.ends and self.ends[0][0] <= row:
            r, s, e = heappop(self.ends)
            if self.pieces.get(s) != (e, r):
                continue  # cut since
            del self.pieces[s]
            del self.starts[bisect_left(self.starts, s)]
            i = bisect_left(self.free, s)
            if i < len(self.free) and self.free[i] == e:
                e = self.free_end.pop(self.free.pop(i))
            if i and self.free_end[self.free[i - 1]] == s:
                s = self.free[i - 1]
            else:
                self.free.insert(i, s)
            self.free_end[s] = e


def _cells(node: Node, visible: bool) -> Iterator[list[tuple[int, int, list[str]]]]:
    """The cells of each row: first column, columns, lines. Cells that reach down from rows above keep their columns."""
    part, covered, number = None, Covered(), 0
    for row, seen, parent in _rows(node, visible):
        if parent is not part:
            covered, part = Covered(), parent  # no cell reaches out of its part of the table
        covered.reach(number)
        cells: list[tuple[int, int, list[str]]] = []
        below: list[tuple[int, int, int]] = []
        at = 0
        for cell in row.children:
            own: dict[str, str] = {}
            if isinstance(cell, str):
                if not cell.strip() or not seen:
                    continue
                body = [_fold(_SPACE.sub(" ", cell))]
            else:
                there, sees = shown(cell, seen)
                if not there:
                    continue
                own, body = attributes(cell), _inner(cell, sees)
            at = covered.first_free(at)
            columns = _number(own.get("colspan"), 1, MOST_COLUMNS, 1)
            rows = _number(own.get("rowspan"), 0, MOST_ROWS, 1) or MOST_ROWS
            if rows > 1:
                below.append((at, at + columns, number + rows))
            cells.append((at, columns, body))
            at += columns
        for piece in below:
            covered.cover(*piece)
        number += 1
        yield cells


def _table(node: Node, visible: bool = True) -> list[str]:
    """The caption and what stands outside of rows, then rows whose cells begin at the same place in every row."""
    loose = Node("div")
    loose.children.extend(_loose(node))
    lines = _inner(loose, visible)
    grid = list(_cells(node, visible))
    width: dict[int, int] = {}  # of the columns where a cell begins
    for cells in grid:
        for at, columns, body in cells:
            most = max(map(_width, body), default=0)
            width[at] = max(width.get(at, 0), most if columns == 1 else 0)
    begun = sorted(width)
    for cells in grid:
        for at, columns, body in cells:
            if columns > 1:  # a cell over several columns widens the last of them, where they are too narrow together
                covered = begun[bisect_left(begun, at) : bisect_left(begun, at + columns)]
                need = max(map(_width, body), default=0) - 2 * (len(covered) - 1)
                if need > 0:
                    width[covered[-1]] += max(0, need - sum(map(width.__getitem__, covered)))
    begins, place = {}, 0
    for column in begun:
        begins[column], place = place, place + width[column] + 2
    for cells in grid:
        for k in range(max((len(body) for _, _, body in cells), default=0)):
            line, filled = [], 0
            for at, _, body in cells:
                if k < len(body) and body[k]:
                    line += [" " * (begins[at] - filled if place <= WIDE else 2 if line else 0), body[k]]
                    filled = begins[at] + _width(body[k])
            lines.append("".join(line).rstrip())
    return lines


def page_text(page: str | None) -> str:
    """The visible text of one page."""
    out, root = Writer(), tree((page or "").replace("\x00", ""))
    _prepare(root)
    render(root, out)
    return "\n".join(out.result())


def extract(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """One row per page: ``key`` and ``text``."""
    small_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([page_text(x.as_py()) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, "text"])

    return spread(pages.select(F.col(key), text_column(pages, markup).alias("html"))).mapInArrow(run, f"`{key}` {kind}, text string")
