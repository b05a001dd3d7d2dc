"""All visible text of web pages, laid out as a reader sees it.

A small tree builder reads the markup: it closes what the language closes by itself (paragraphs before
blocks, list items, table parts), opens rows for cells without one, moves what may not stand in a table
before it, ignores end tags without a start, and keeps script, style and title as raw text. The tags of html, head and body open nothing: both ends of a head may be left out, all that may
stand in it is unseen by itself, and anything else belongs to the body. Elements that are not shown are left out:
titles, scripts, templates, ``hidden``, ``display: none``, closed details and dialogs; of what ``visibility: hidden`` covers,
only descendants that are visible again are shown. In a style, the last declaration of a property counts, an important one first. The rest is rendered into lines:
blocks stand on their own lines with blank lines where browsers put margins, list items get bullets
or numbers and indented continuations, table cells are padded to columns by their width on screen, and preformatted text
keeps its white space. Indentation stops growing at ``INDENT`` blanks, so deep lists do not multiply their text. Nothing visible is dropped, boilerplate included.

Edge cases: a very long page is rendered at once in its task, in time that grows with its length; NULL and empty pages have the text ``""``; broken markup never fails; nesting has
no limit, since nothing recurses; repeated rows are rendered one by one; an empty
table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from unicodedata import combining, east_asian_width

from pyspark.sql import DataFrame

from tankline.llm.common import map_rows

#: Blanks between the columns of a table.
GUTTER = "  "
#: Lines are not indented further than this.
INDENT = 80

# The most columns and rows that a cell may cover.
COLUMNS, ROWS = 1000, 65534

# Names of elements, as the language defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template title meta link base noembed noframes iframe datalist param source track area".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table ul "
    "caption thead tbody tfoot tr td th".split()
)
MARGINS = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
LISTS = frozenset("ul ol menu dir".split())
CLOSES_PARAGRAPH = BLOCKS - frozenset("option optgroup caption thead tbody tfoot tr td th body html".split())
#: What a start tag closes, and the elements beyond which it does not look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table", "template")),
    "td": (("td", "th"), ("tr", "table", "template")),
    "th": (("td", "th"), ("tr", "table", "template")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table", "template")),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table", "template")),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table", "template")),
}
SECTIONS = ("thead", "tbody", "tfoot")
#: Within a table, what each of its parts may stand in, from the outermost on.
WITHIN = {"td": (SECTIONS, ("tr",)), "th": (SECTIONS, ("tr",)), "tr": (SECTIONS,), "col": (("colgroup",),), **dict.fromkeys(("caption", "colgroup", *SECTIONS), ())}
#: What holds only parts of a table; anything else that stands in it is shown before the table.
FRAME = frozenset(("table", "tr", "colgroup", *SECTIONS))
TABLE = frozenset(("table", "tr", "td", "th", *SECTIONS))
#: An end tag does not reach beyond these; one of ``TABLE`` only not beyond a template.
SCOPES = frozenset("table td th caption template html".split())

#: A comment, a tag (up to the first > outside quotes, or, if quotes do not match, the first one), another declaration.
MARKUP = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<(?P<other>[!?/][^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NUMBER = re.compile(r"\s*([+-]?\d{1,10})")
#: Kinds of input whose value stands on the page as text, and those whose value is a label.
TEXT_INPUTS = frozenset(("", "text", "search", "email", "url", "tel", "number", "date", "time", "month", "week", "datetime-local"))
BUTTONS = frozenset("submit button reset".split())
GAPS = re.compile(r"[ \t\n\f\r]+")


@dataclass
class Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)
    #: Whether its own marks are visible; ``_cover`` takes away the text that is not.
    visible: bool = True

    def number(self, name: str, default: int) -> int:
        found = NUMBER.match(self.attributes.get(name, ""))
        return int(found[1]) if found else default

    @property
    def shown(self) -> bool:
        a = self.attributes
        if self.name in UNSEEN or "hidden" in a or ("style" in a and self.style("display") == "none"):
            return False
        return not (self.name == "dialog" and "open" not in a) and not (self.name == "input" and a.get("type", "").lower() == "hidden")

    def style(self, name: str) -> str:
        """The value that the element's own style gives to a property, in lower case."""
        found, first = "", False
        for declaration in self.attributes.get("style", "").lower().split(";"):
            key, colon, value = declaration.partition(":")
            if colon and key.strip() == name:
                important = value.rstrip().endswith("important") and "!" in value
                if important or not first:
                    found, first = value.partition("!")[0].strip(), important
        return found


def _cover(root: Element) -> Element:
    """Takes the text out of elements that are not visible; visibility is inherited until a descendant sets it anew."""
    todo = [(root, True)]
    while todo:
        element, visible = todo.pop()
        own = element.style("visibility") if "style" in element.attributes else ""
        visible = own not in ("hidden", "collapse") if own in ("visible", "hidden", "collapse") else visible
        element.visible = visible
        if not visible:
            element.children = [x for x in element.children if not isinstance(x, str)]
        todo += [(x, visible) for x in element.children if isinstance(x, Element)]
    return root


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    return found


class Builder:
    """Puts start tags, end tags and text into a tree."""

    def __init__(self) -> None:
        self.root = Element("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by name, without the root

    def text(self, text: str) -> None:
        if text and self.open[-1].name in FRAME and not GAPS.fullmatch(text):
            self._stray(text)
        elif text:
            self.open[-1].children.append(text)

    def _last(self, *names: str) -> int:
        """The place of the innermost open element of ``names``, else 0."""
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=0)

    def _table(self) -> int:
        """The place of the innermost open table, 0 if there is none or a template is nearer."""
        table = self._last("table", "template")
        return table if self.open[table].name == "table" else 0

    def _stray(self, node: Element | str) -> None:
        """Puts what may not stand in the open part of a table before the table."""
        table = self._table()
        if table:
            self.open[table - 1].children.insert(-1, node)  # an open table is the last child
        else:
            self.open[-1].children.append(node)

    def _part(self, name: str, table: int) -> None:
        """Closes what cannot hold this part of a table; a cell gets the row that it lacks."""
        depth = table + 1
        for names in WITHIN[name]:
            if depth < len(self.open) and self.open[depth].name in names:
                depth += 1
        self._close_to(depth)
        if name in ("td", "th") and self.open[-1].name != "tr":
            self.start("tr", {}, False)

    def _close_to(self, depth: int) -> None:
        while len(self.open) > max(depth, 1):
            self.places[self.open.pop().name].pop()

    def _imply(self, names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Closes the outermost open element of ``names`` within the nearest of ``stops``."""
        stop = self._last(*stops)
        found = [places[k] for name in names if (places := self.places.get(name)) and (k := bisect_right(places, stop)) < len(places)]
        if found:
            self._close_to(min(found))

    def start(self, name: str, attributes: dict[str, str], closed: bool) -> None:
        if name in ("html", "head", "body"):
            return
        if name in CLOSES_PARAGRAPH:
            self._imply(("p",), ("table", "td", "th", "caption", "button"))
        table = self._table() if name in WITHIN or name == "table" or self.open[-1].name in FRAME else 0
        if table and name in WITHIN:
            self._part(name, table)
        elif table and name == "table" and self._last("td", "th", "caption") < table:
            self._close_to(table)
        elif table and name == "form" and self.open[-1].name in FRAME:
            return  # its cells stay in their row
        elif name in IMPLIED:
            self._imply(*IMPLIED[name])
        element = Element(name, attributes)
        if self.open[-1].name in FRAME and name not in WITHIN:
            self._stray(element)
        else:
            self.open[-1].children.append(element)
        if name not in VOID and not closed:
            self.places[name].append(len(self.open))
            self.open.append(element)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {}, True)
        place = self._last(name)
        if place and place >= self._last(*(("template",) if name in TABLE else SCOPES)):
            self._close_to(place)


def parse(html: str) -> Element:
    builder, at = Builder(), 0
    stop, comments = html.rfind(">") + 1, html.rfind("<!--")
    while True:
        m = MARKUP.search(html, at, len(html) if at <= comments else stop)
        if not m:
            builder.text(unescape(html[at:]))
            return builder.root
        builder.text(unescape(html[at : m.start()]))
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            builder.end(name)
            continue
        rest = m["rest"]
        builder.start(name, _attributes(rest) if rest else {}, rest.endswith("/") and name not in BLOCKS and name not in RAW)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            raw = html[at : end.start() if end else len(html)]
            builder.text(unescape(raw) if name in ("textarea", "title") else raw)
            at = end.end() if end else len(html)
            builder.end(name)


#: A line, or a marker and the lines behind it.
Line = str | tuple[str, list]


class Lines:
    """Lines under construction: an open line of running text and the finished ones.

    Lines that stand behind a marker are kept with it, and get it and their indentation when all are done.
    """

    def __init__(self) -> None:
        self.done: list[Line] = []
        self.words: list[str] = []
        self.gap = False
        self.margin = 0

    def _put(self, line: Line) -> None:
        if self.done:
            self.done.extend([""] * self.margin)
        self.margin = 0
        self.done.append(line)

    def text(self, text: str) -> None:
        """Running text, in which white space is one blank, and none at a line's ends."""
        words = GAPS.sub(" ", text)
        if words.startswith(" "):
            self.gap = True
        core = words.strip(" ")
        if core:
            if self.gap and self.words:
                self.words.append(" ")
            self.words.append(core)
            self.gap = words.endswith(" ")

    def flush(self) -> None:
        if self.words:
            self._put("".join(self.words))
        self.words, self.gap = [], False

    def new_line(self) -> None:
        """A forced line end: ends the open line, or leaves an empty one."""
        if self.words:
            self.flush()
        elif self.done and not self.margin:
            self._put("")

    def space(self, lines: int) -> None:
        self.flush()
        self.margin = max(self.margin, lines)

    def block(self, lines: list[str]) -> None:
        self.flush()
        for line in lines:
            self._put(line)

    def marked(self, marker: str, lines: list[Line]) -> None:
        self.flush()
        if lines:
            self._put((marker, lines))

    def finished(self) -> list[Line]:
        self.flush()
        while self.done and not self.done[-1]:
            self.done.pop()
        return self.done


def _flat(lines: list[Line]) -> list[str]:
    out: list[str] = []
    todo: list[tuple[Iterator[Line], str, str]] = [(iter(lines), "", "")]  # what stands before the next line and before later ones
    while todo:
        rest, first, pad = todo.pop()
        for line in rest:
            if isinstance(line, str):
                out.append((first + line).rstrip() if first else line)
                first = pad
            else:
                todo.append((rest, pad, pad))
                todo.append((iter(line[1]), first + line[0], (pad + " " * len(line[0]))[: max(INDENT, len(pad))]))
                break
    while out and not out[-1]:
        out.pop()
    return out


def _rendered(element: Element) -> list[str]:
    """The lines of an element's content. Parts with lines of their own are rendered on a stack, not by recursion."""
    open_parts, lines = [_flow(element.children)], None
    while open_parts:
        try:
            part = open_parts[-1].send(lines)
        except StopIteration as end:
            open_parts.pop()
            lines = end.value
        else:
            open_parts.append(_flow(part.children))
            lines = None
    return _flat(lines)


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, place = divmod(n - 1, 26)
        out = chr(97 + place) + out
    return out


def _roman(n: int) -> str:
    out = ""
    for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
        out, n = out + sign * (n // value), n % value
    return out


def _number(n: int, kind: str) -> str:
    """A list number in the style of its ``type``; decimal where that has none."""
    if kind in ("a", "A") and n > 0:
        text = _letters(n)
    elif kind in ("i", "I") and 0 < n < 4000:
        text = _roman(n)
    else:
        return str(n)
    return text.upper() if kind.isupper() else text


def _items(element: Element) -> Iterator[Element | str | tuple[str, Element]]:
    """The children of a list, its items with their markers."""
    items = [x for x in element.children if isinstance(x, Element) and x.name == "li" and x.shown]
    down = "reversed" in element.attributes
    number, kind = element.number("start", len(items) if down else 1), element.attributes.get("type", "")
    for child in element.children:
        if isinstance(child, Element) and child.name == "li":
            if child.shown:
                number = child.number("value", number)
                marker = f"{_number(number, child.attributes.get('type', kind))}. " if element.name == "ol" else "- "
                yield marker if child.visible else "", child
                number += -1 if down else 1
        else:
            yield child


@dataclass
class Grid:
    table: Element


#: Asks for the lines of elements and gets them sent.
Part = Generator[Element, list[Line], list[Line] | None]


def _width(text: str) -> int:
    """Columns that a text takes on screen: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 1 + (east_asian_width(c) in "WF") for c in text)


def _rows(table: Element) -> Iterator[tuple[int, Element]]:
    """The rows that are shown, each with the number of its part of the table."""
    part = 0
    for child in table.children:
        if isinstance(child, Element) and child.shown:
            if child.name == "tr":
                yield part, child
            elif child.name in SECTIONS:
                part += 1
                yield from ((part, row) for _, row in _rows(child))
                part += 1


def _grid(table: Element, out: Lines) -> Part:
    """The rows of a table; a cell over several columns or rows fills its first place.

    Only columns in which some cell starts take room.
    """
    grid: list[dict[int, tuple[list[Line], int]]] = []
    taken: dict[int, int] = {}  # rows that a cell above still covers, by column
    last = 0
    for part, row in _rows(table):
        if part != last:
            taken, last = {}, part  # no cell reaches beyond its part
        cells, column = {}, 0
        below = {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row.children:
            if not (isinstance(cell, Element) and cell.name in ("td", "th") and cell.shown):
                continue
            while taken.get(column):
                column += 1
            wide = min(max(1, cell.number("colspan", 1)), COLUMNS)
            high = cell.number("rowspan", 1)
            high = ROWS if high == 0 else min(max(1, high), ROWS)
            cells[column] = ((yield cell), wide)
            if high > 1:
                below.update((c, high - 1) for c in range(column, column + wide))
            column += wide
        taken = below
        grid.append(cells)
    if all(len(cells) == 1 and 0 in cells for cells in grid if cells):
        for cells in grid:
            out.marked("", cells[0][0] if cells else [])
        return
    flat = [{c: (_flat(lines), wide) for c, (lines, wide) in cells.items()} for cells in grid]
    widths: dict[int, int] = {c: 0 for cells in flat for c in cells}
    for cells in flat:
        for c, (lines, wide) in cells.items():
            if wide == 1:
                widths[c] = max(widths[c], max(map(_width, lines), default=0))
    places, at = {}, 0
    for c in sorted(widths):
        places[c], at = at, at + widths[c] + len(GUTTER)
    for cells in flat:
        height = max((len(lines) for lines, _ in cells.values()), default=0)
        rows, ends = [[] for _ in range(height)], [0] * height
        for c in sorted(cells):
            for i, text in enumerate(cells[c][0]):
                if text:
                    gap = max(places[c] - ends[i], len(GUTTER)) if rows[i] else places[c]
                    rows[i] += [" " * gap, text]
                    ends[i] += gap + _width(text)
        out.block(["".join(line).rstrip() for line in rows])


def _flow(nodes: Iterable[Element | str]) -> Part:
    """Renders nodes one below the other."""
    out = Lines()
    todo: list = [iter(nodes)]  # nodes still to come; a number is the margin after an element, a pair an item of a list, a grid the rows of a table
    while todo:
        node = next(todo[-1], None)
        if node is None:
            todo.pop()
        elif isinstance(node, str):
            out.text(node)
        elif isinstance(node, int):
            out.space(node)
        elif isinstance(node, Grid):
            yield from _grid(node.table, out)
        elif isinstance(node, tuple):
            out.marked(node[0], (yield node[1]) or [""])
        elif not node.shown:
            continue
        elif node.name == "br":
            out.new_line()
        elif node.name == "input":
            if node.visible and node.attributes.get("type", "").strip().lower() in BUTTONS | TEXT_INPUTS:
                out.text(f" {node.attributes.get('value', '')} ")
        elif node.name not in BLOCKS:
            todo.append(iter(node.children))
        else:
            name, margin = node.name, int(node.name in MARGINS)
            out.space(margin)
            todo.append(iter((margin,)))
            if name in LISTS:
                todo.append(_items(node))
            elif name == "table":
                todo += iter((Grid(node),)), iter([x for x in node.children if isinstance(x, Element) and x.name == "caption"])
            elif name == "pre":
                out.block(_preformatted(node))
            elif name == "hr":
                out.block(["---"] if node.visible else [])
            elif name in ("blockquote", "dd"):
                out.marked("    ", (yield node))
            elif name == "li":
                out.marked("- " if node.visible else "", (yield node) or [""])
            elif name == "details" and "open" not in node.attributes:
                todo.append(x for x in node.children if isinstance(x, Element) and x.name == "summary")
            else:
                todo.append(iter(node.children))
    return out.finished()


def _preformatted(node: Element) -> list[str]:
    pieces, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            pieces.append(x)
        elif x.name == "br":
            pieces.append("\n")
        elif x.shown:
            todo += reversed(x.children)
    text = "".join(pieces).replace("\r\n", "\n").replace("\r", "\n")
    return [line.rstrip() for line in text.removeprefix("\n").rstrip("\n").split("\n")] if text.strip() else []


def visible_text(html: str | None) -> str:
    return "\n".join(_rendered(_cover(parse(html)))).replace("\xa0", " ") if html else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id`` and the visible ``text`` of every page."""
    return map_rows(pages.select("page_id", "html"), "page_id long, text string", lambda ids, html: (ids, [visible_text(h) for h in html]), rows=64)
