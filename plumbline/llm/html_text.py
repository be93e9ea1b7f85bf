"""HTML extraction by layout-aware rendering.

A tree builder handles void elements, implied end tags and implied rows; visibility
rules leave out what a browser doesn't show; the renderer writes all visible text
with block spacing, list markers, preformatted text and aligned table cells. Nothing
recurses but tables inside table cells, whose depth is bounded.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
#: Elements that show no text of their own content.
UNSEEN = set("head script style template noscript iframe noembed noframes object audio video canvas datalist select textarea title meta link".split())
#: Elements of svg and math that browsers don't draw where they stand.
UNDRAWN = set("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
#: Elements with a blank line around them, and elements that only start a new line.
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
LINED = set("address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav section summary tr thead tbody tfoot td th option optgroup text".split())
BLOCKS = SPACED | LINED
#: A start tag closes open elements of these names, looking no further up than the names in the third place.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "option", "optgroup", "caption", "text"}
#: An open p is looked for no further up than these.
P_SCOPE = {"td", "th", "table", "caption", "button", "html", "body"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
MAY_HIDE = re.compile(r"hidden|style", re.I)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))(?![\w-])", re.I)
NUMBER = re.compile(r"\s*(-?\d{1,9})")
BLANKS = re.compile(r"[ \t\n\r\f\v]+")

#: Elements nested deeper become siblings, as in browsers.
DEPTH = 512
#: Lines of cells are wrapped between words beyond this width; tables in cells are drawn as tables up to this depth.
CELL_WIDTH, TABLE_DEPTH = 100, 64
#: The most columns and rows that a cell can span, as in browsers.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Node:
    __slots__ = ("tag", "attributes", "children", "drawn")

    def __init__(self, tag: str, attributes: str = "", drawn: bool = True) -> None:
        self.tag, self.attributes, self.children, self.drawn = tag, attributes, [], drawn


def tree(source: str) -> Node:
    """The element tree of a page, whatever it lacks."""
    root = Node("#root")
    stack = [root]
    open_: dict[str, int] = {}

    def push(node: Node) -> None:
        if len(stack) < DEPTH:
            stack.append(node)
            open_[node.tag] = open_.get(node.tag, 0) + 1

    def cut(i: int) -> None:
        for node in stack[i:]:
            open_[node.tag] -= 1
        del stack[i:]

    def close(names: set[str], until: set[str]) -> None:
        if not any(open_.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                cut(i)
                return
            if stack[i].tag in until:
                return

    at, end = 0, len(source)
    # Nothing after the last ">" can be a whole tag; looking for one from every "<" would take forever.
    last = max(source.rfind(">"), source.rfind("<!"))
    while at < end:
        m = TAG.search(source, at) if at <= last else None
        if m is None:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            inline = tag not in BLOCKS and tag not in UNSEEN and tag not in ("svg", "math")
            for i in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                # An inline end tag doesn't reach out of a block, nor a block's out of a cell.
                if (inline and stack[i].tag in BLOCKS) or (tag != "table" and stack[i].tag == "table") or (tag not in ("table", "tr", "thead", "tbody", "tfoot", "td", "th") and stack[i].tag in ("td", "th")):
                    break
            continue
        if tag in CLOSES_P:
            close({"p"}, P_SCOPE)
        while tag in CLOSES and stack[-1].tag != "#root":
            before = len(stack)
            close(*CLOSES[tag])
            if len(stack) == before:
                break
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        foreign = open_.get("svg") or open_.get("math")
        node = Node(tag, attributes, not (foreign and tag in UNDRAWN))
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and (foreign or tag in ("svg", "math", "path")):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            node.children.append(source[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        push(node)
    return root


def attributes_of(raw: str) -> dict[str, str]:
    """Values by lower-case name; of two of a name, the first counts."""
    values: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        values.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return values


def number(node: Node, name: str, other: int) -> int:
    """An attribute's leading number."""
    m = NUMBER.match(attributes_of(node.attributes).get(name, "")) if name in node.attributes.lower() else None
    return int(m[1]) if m else other


def hides(attributes: str) -> bool:
    """Whether the attributes named hidden or style keep an element from being shown."""
    if not MAY_HIDE.search(attributes):
        return False
    values = attributes_of(attributes)
    if "hidden" in values and values["hidden"].strip().lower() != "until-found":
        return True
    return bool(HIDING.search(values.get("style", "")))


def seen(node: Node) -> bool:
    return node.drawn and node.tag not in UNSEEN and not (node.attributes and hides(node.attributes))


class Page:
    """Lines under way: text waits for the blank lines and marker that precede it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""
        self.space = False

    def end(self, gap: int) -> None:
        """End the line; at least gap newlines stand before the next text."""
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
            self.gap = 1
        self.space = False
        if self.lines:
            self.gap = max(self.gap, gap)

    def start(self) -> None:
        if not self.line:
            if self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
            if self.marker:
                self.line.append("".join(self.indent[:-1]) + self.marker)
                self.marker = ""
            elif self.indent:
                self.line.append("".join(self.indent))
            self.space = False

    def text(self, data: str) -> None:
        words = BLANKS.split(html.unescape(data))
        for i, word in enumerate(words):
            self.space |= i > 0
            if word:
                fresh = not self.line
                self.start()
                if self.space and not fresh:
                    self.line.append(" ")
                self.space = False
                self.line.append(word)

    def whole(self, lines: list[str]) -> None:
        for line in lines:
            self.start()
            self.line.append(line)
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
            self.gap = 1

    def done(self) -> str:
        self.end(1)
        return "\n".join(self.lines)


def wrapped(lines: list[str]) -> list[str]:
    """Lines cut at blanks where they are longer than CELL_WIDTH; a longer word is a line of its own."""
    out = []
    for line in lines:
        while len(line) > CELL_WIDTH:
            cut = line.rfind(" ", 1, CELL_WIDTH + 1)
            if cut < 0 or not line[:cut].strip():
                cut = line.find(" ", CELL_WIDTH)
            if cut < 0:
                break
            out.append(line[:cut].rstrip(" "))
            line = line[cut + 1 :]
        out.append(line)
    return out


def drawn(table: Node, depth: int) -> list[str]:
    """A table as lines: cells of a row side by side, columns aligned."""
    rows: list[list[list[str]]] = []
    captions: list[str] = []
    held: dict[int, int] = {}
    todo = list(reversed(table.children))
    while todo:
        row = todo.pop()
        if isinstance(row, str) or not seen(row):
            if isinstance(row, str) and row.strip():
                captions += rendered([row], depth).split("\n")
            continue
        if row.tag in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(row.children))
            continue
        if row.tag != "tr":
            text = rendered([row], depth)
            captions += text.split("\n") if text else []
            continue
        cells: list[list[str]] = []
        loose = []

        def skip(cells: list[list[str]] = cells) -> None:
            while held.get(len(cells), 0) > 0:
                held[len(cells)] -= 1
                cells.append([])

        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                loose.append(cell)
                continue
            if not seen(cell):
                continue
            skip()
            text = rendered(cell.children, depth)
            tall = min(max(1, number(cell, "rowspan", 1)), MOST_ROWS)
            for i in range(min(max(1, number(cell, "colspan", 1)), MOST_COLUMNS)):
                if tall > 1:
                    held[len(cells)] = tall - 1
                cells.append(wrapped(text.split("\n")) if text and not i else [])
        skip()
        text = rendered(loose, depth)
        captions += text.split("\n") if text else []
        if any(cells):
            rows.append(cells)
    width: dict[int, int] = {}
    for cells in rows:
        for i, lines in enumerate(cells):
            width[i] = max([width.get(i, 0), *(len(x) if len(x) <= CELL_WIDTH else 1 for x in lines)])
    out = captions
    for cells in rows:
        for k in range(max(map(len, cells))):
            parts = [(lines[k] if k < len(lines) else "").ljust(width[i]) for i, lines in enumerate(cells) if width[i]]
            out.append(" | ".join(parts).rstrip(" "))
    return out


def rendered(nodes: list, depth: int = 0) -> str:
    """The visible text of nodes."""
    page = Page()
    # (node or text, is it the end of the node, inside pre, [list kind, number] of the list around)
    todo: list[tuple] = [(n, False, False, None) for n in reversed(nodes)]
    while todo:
        node, over, pre, numbers = todo.pop()
        if isinstance(node, str):
            if pre:
                first, *more = html.unescape(node).expandtabs(8).replace("\r\n", "\n").split("\n")
                if first:
                    page.start()
                    page.line.append(first)
                for line in more:
                    page.start()
                    page.lines.append("".join(page.line))
                    page.line, page.gap = ([line] if line else []), (0 if line else 1)
            else:
                page.text(node)
            continue
        tag = node.tag
        if over:
            if tag in ("ul", "ol", "menu", "dir", "dl", "blockquote") and page.indent:
                page.end(1)
                page.indent.pop()
            if tag == "li":
                page.end(1)
                page.marker = ""
                page.indent.pop()
            if tag in BLOCKS:
                page.end(2 if tag in SPACED and not (tag in ("ul", "ol") and numbers is not None) else 1)
            elif tag == "q":
                page.text("”")
            continue
        if not seen(node):
            continue
        if tag == "br":
            if page.line:
                page.end(1)
            else:
                page.gap = max(page.gap, 2) if page.lines else 0
            continue
        if tag == "wbr":
            continue
        if tag in BLOCKS:
            page.end(2 if tag in SPACED and not (tag in ("ul", "ol") and numbers is not None) else 1)
        if tag == "table" and depth < TABLE_DEPTH:
            page.whole(drawn(node, depth + 1))
            page.end(2)
            continue
        inner = numbers
        if tag in ("ul", "menu", "dir", "ol"):
            inner = [tag == "ol", number(node, "start", 1)]
            page.indent.append("")
        elif tag == "li":
            mark = "- "
            if numbers and numbers[0]:
                mark = f"{numbers[1]}. "
            if numbers:
                numbers[1] += 1
            page.indent.append(" " * len(mark))
            page.marker = mark
        elif tag == "dl":
            page.indent.append("")
        elif tag == "blockquote":
            page.indent.append("> ")
        elif tag == "q":
            page.text("“")
        elif tag in ("td", "th"):
            inner = None
        todo.append((node, True, pre, numbers))
        todo.extend((c, False, pre or tag == "pre", inner) for c in reversed(node.children))
    return page.done()


def visible_text(source: str | None) -> str:
    """All visible text of a page; '' for null and for pages that show none."""
    return rendered(tree(source).children).strip("\n") if source else ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_lines), one row for each row of pages (page_id, url, html).

    Null and empty pages give an empty text of no lines; plain text without tags is all
    visible. Null ids and urls stay; repeated rows are rows of their own; an empty table
    gives none; other columns are not read. A page is read whole. Columns are
    aligned; a cell's lines are wrapped between words beyond 100 characters, and only a
    row with a longer word (as of an address) stands out of line, so that one word can't
    multiply a table's size."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x.as_py()) for x in batch.column(2)]
            lines = [len(t.split("\n")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], ["page_id", "url", "text", "n_lines"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_lines long")
