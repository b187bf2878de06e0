"""HTML extraction by layout-aware rendering.

A tree builder reads the markup leniently: implied html, head and body, optional end tags (p, li, dt, dd, option,
table parts), implied tbody and tr, void elements, raw text, misnested and missing end tags. Elements deeper than
``DEPTH`` become siblings, as in browsers. A renderer then walks the tree and emits the visible text: blocks on
lines of their own, paragraphs apart by a blank line, list items with markers and indents, preformatted text as it
is, table cells in aligned columns. Text areas, options, ``xmp``, formulas and the text of drawings are shown; scripts,
styles, the head, ``hidden``, ``display: none``, ``visibility: hidden``, inputs' values, titles within drawings and what
stands in for media that browsers show (audio, video, object, canvas, frames, ``noscript``) aren't.

Tables: cells are placed on the grid by their column and row spans (as far as the standard lets spans reach); a column
is as wide as its widest line. Lines of cells are wrapped at blanks to ``WRAP`` characters where a row has several
cells; a longer word is not broken, and what follows it in that line starts later. Columns in which no cell begins have
no width.

Both walks use explicit stacks, so that nesting and length are bounded by memory alone.

Defined cases: null or empty markup gives an empty text and title; null and repeated ids are passed on; rows are
independent; an empty table gives an empty result; other columns aren't read.
"""

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import slices

DEPTH, WRAP = 512, 72
#: The most columns and rows that the HTML standard lets a cell span.
COLUMNS, ROWS = 1000, 65534

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
TITLE_LIKE = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes datalist audio video object canvas title desc metadata defs".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre xmp blockquote figure table hr fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main nav optgroup option search section summary tr caption".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS, SECTIONS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
SCOPE = frozenset("html table td th caption template button object".split())
LISTS = frozenset("ul ol menu".split())
VERBATIM = frozenset(("pre", "xmp", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(text: str) -> dict:
    out: dict = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return out


class Builder:
    def __init__(self):
        self.root = Node("html")
        self.stack = [self.root]
        self.counts: dict[str, int] = {}
        self.title = None

    def push(self, tag: str, attrs: dict | None = None) -> Node:
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in VOID and len(self.stack) < DEPTH:
            self.stack.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1
        return node

    def pop_to(self, at: int) -> None:
        for node in self.stack[at:]:
            self.counts[node.tag] -= 1
        del self.stack[at:]

    def find(self, tags, until) -> int:
        """Index of the innermost open element among tags, before any in until; 0 if there is none."""
        if not any(self.counts.get(t) for t in tags):
            return 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in until:
                return 0
        return 0

    def close(self, tags, until) -> None:
        at = self.find(tags, until)
        if at:
            self.pop_to(at)

    def start(self, tag: str, rest: str) -> None:
        attrs = attributes(rest) if rest and not rest.isspace() else {}
        if tag in ("html", "body"):
            self.close(("head",), ())
            self.root.attrs = {**attrs, **self.root.attrs}
            return
        if tag not in HEAD_ONLY and tag != "head":
            self.close(("head",), ("template", "noscript"))
        if tag in ENDS_P:
            self.close(("p",), SCOPE)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        elif tag == "li":
            self.close(("li",), LISTS | SCOPE)
        elif tag in ("dt", "dd"):
            self.close(("dt", "dd"), {"dl"} | SCOPE)
        elif tag in ("option", "optgroup"):
            self.close(("option",) if tag == "option" else ("option", "optgroup"), {"select", "datalist"})
        elif tag in CELLS or tag == "tr" or tag in SECTIONS or tag in ("caption", "colgroup"):
            if not self.find(("table",), ("template",)):
                return
            self.close((*CELLS, "caption", "colgroup"), ("table",))
            if tag not in CELLS:
                self.close(("tr",), ("table",))
                if tag != "tr":
                    self.close(SECTIONS, ("table",))
            if tag in CELLS or tag == "tr":
                if not self.find(SECTIONS, ("table",)):
                    self.push("tbody")
                if tag != "tr" and not self.find(("tr",), ("table",)):
                    self.push("tr")
        self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.push("br")
        elif tag == "p" and not self.find(("p",), SCOPE):
            self.push("p")
            self.close(("p",), SCOPE)
        elif tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif tag in CELLS or tag == "tr" or tag in SECTIONS or tag in ("table", "caption"):
            self.close((tag,), () if tag == "table" else ("table",))
        elif tag in FORMATTING and (at := self.find((tag,), SCOPE)) and any(n.tag in BLOCKS for n in self.stack[at + 1 :]):
            self.counts[tag] -= 1  # misnested: the blocks inside stay open
            del self.stack[at]
        elif tag not in ("html", "body"):
            self.close((tag,), SCOPE)

    def text(self, text: str) -> None:
        if self.counts.get("head") and self.stack[-1].tag == "head" and not text.isspace():
            self.close(("head",), ())
        self.stack[-1].children.append(text)

    def feed(self, html: str) -> Node:
        at, n, lower = 0, len(html), None
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.text(unescape(html[at:]))
                break
            if lt > at:
                self.text(unescape(html[at:lt]))
            follow = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif follow in "!?" and follow:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            elif follow == "/" and (m := NAME.match(html, lt + 2)):
                end = html.find(">", m.end())
                at = n if end < 0 else end + 1
                self.end(m[0].lower())
            elif m := NAME.match(html, lt + 1):
                tag = m[0].lower()
                rest = REST.match(html, m.end())
                at = rest.end() + 1
                self.start(tag, rest[0])
                if tag in RAW or tag in TITLE_LIKE:
                    lower = html.lower() if lower is None else lower
                    lower = lower if len(lower) == n else re.sub("[A-Z]", lambda x: x[0].lower(), html)
                    end = lower.find(f"</{tag}", at)
                    body = html[at : n if end < 0 else end]
                    if tag in TITLE_LIKE:
                        if tag == "title" and self.title is None:
                            self.title = " ".join(unescape(body).split())
                        if tag == "title" and not self.counts.get("head"):
                            self.stack[-1].tag = "head" if self.stack[-1].tag == "title" else self.stack[-1].tag
                            self.counts["title"] = self.counts.get("title", 1) - 1
                            self.counts["head"] = self.counts.get("head", 0) + 1
                            self.close(("head",), ())
                        else:
                            if tag == "textarea":
                                self.text(unescape(body.removeprefix("\n")))
                            self.close((tag,), SCOPE)
                    else:
                        if tag == "xmp":
                            self.text(body.removeprefix("\n"))
                        self.close((tag,), ())
                    close = html.find(">", end) if end >= 0 else -1
                    at = n if close < 0 else close + 1
            else:
                self.text("<")
                at = lt + 1
        return self.root


class Flow:
    """Lines of one flow of blocks: the page or a table cell."""

    def __init__(self):
        self.lines, self.now, self.space, self.gap = [], [], False, 0
        self.indents, self.marker = [], None

    def flush(self) -> None:
        if self.now:
            self.put("".join(self.now).rstrip(" "))
        self.now, self.space = [], False

    def put(self, line: str) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        head = "".join(self.indents)
        if self.marker:
            head, self.marker = "".join(self.indents[:-1]) + self.marker, None
        self.lines.append((head + line).rstrip(" "))

    def block(self, blank: int) -> None:
        self.flush()
        self.gap = max(self.gap, blank)

    def inline(self, text: str) -> None:
        words = BLANKS.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        if (self.space or words[0] == " ") and self.now:
            self.now.append(" ")
        self.space = words[-1] == " "
        self.now.append(words.strip(" "))

    def literal(self, text: str) -> None:
        first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.now.append(first)
        for line in more:
            self.put("".join(self.now))
            self.now = [line]

    def br(self) -> None:
        if self.now:
            self.flush()
        elif self.lines:
            self.put("")


def wrap(line: str) -> list[str]:
    """The line in parts of at most ``WRAP`` characters, cut at blanks; longer words stay whole."""
    out = []
    while len(line) > WRAP:
        cut = line.rfind(" ", 0, WRAP + 1)
        cut = cut if cut > 0 and not line[:cut].isspace() else line.find(" ", WRAP)
        if cut < 0:
            break
        out.append(line[:cut].rstrip(" "))
        line = line[cut:].lstrip(" ")
    return [*out, line]


class Table:
    """Cells on a grid: each row is a list of (column, lines)."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.taken: list[tuple[int, int, int]] = []  # (first column, end, last row) of cells that reach further rows
        self.above: list[tuple[int, int, int]] = []  # those that reach this row and aren't passed yet, last first
        self.at = 0

    def row(self) -> None:
        self.taken = [t for t in self.taken if t[2] >= len(self.rows)]
        self.above = sorted(self.taken, reverse=True)
        self.rows.append([])
        self.at = 0

    def group(self) -> None:
        """Cells don't reach beyond their row group."""
        self.taken, self.above = [], []

    def cell(self, lines: list[str], attrs: dict) -> None:
        span = lambda name, most: min(int(v), most) if (v := attrs.get(name, "").strip()[:9]).isdecimal() and v.isascii() else 1
        columns, rows = max(1, span("colspan", COLUMNS)), span("rowspan", ROWS) or ROWS
        while self.above and self.above[-1][0] <= self.at:
            self.at = max(self.at, self.above.pop()[1])
        self.rows[-1].append((self.at, lines))
        if rows > 1:
            self.taken.append((self.at, self.at + columns, len(self.rows) + rows - 2))
        self.at += columns

    def lines(self) -> list[str]:
        rows = [[(c, [part for line in cell for part in wrap(line)] if len(r) > 1 else cell) for c, cell in r] for r in self.rows if any(cell for _, cell in r)]
        columns = sorted({c for r in rows for c, _ in r})
        place = {c: k for k, c in enumerate(columns)}
        widths = [0] * len(columns)
        for r in rows:
            for c, cell in r:
                widths[place[c]] = max([widths[place[c]], *(len(line) for line in cell if len(line) <= WRAP or len(r) == 1 and len(columns) == 1)])
        out = []
        for r in rows:
            by = {place[c]: cell for c, cell in r}
            for k in range(max(len(cell) for _, cell in r)):
                parts, last = [], max((i for i, cell in by.items() if k < len(cell) and cell[k]), default=-1)
                for i in range(last + 1):
                    cell = by.get(i, ())
                    parts.append((cell[k] if k < len(cell) else "").ljust(widths[i] if i < last else 0))
                out.append("  ".join(parts).rstrip(" "))
        return out


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or bool(a) and ("hidden" in a or "style" in a and INVISIBLE.search(a["style"]) is not None or node.tag == "input")


def render(root: Node) -> str:
    flow, flows, tables, lists, pre = Flow(), [], [], [], 0
    todo: list = [(root, True)]
    while todo:
        node, opening = todo.pop()
        if isinstance(node, str):
            if pre:
                flow.literal(node)
            else:
                flow.inline(node)
            continue
        tag = node.tag
        if opening:
            if hidden(node):
                continue
            if tag == "br":
                flow.br()
                continue
            if tag in BLOCKS:
                flow.block(1 if tag in PARAGRAPHS and not (tag in LISTS and lists) else 0)
            if tag == "hr":
                flow.put("---")
                flow.block(1)
                continue
            if tag in LISTS:
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.indents.append(" " * len(mark))
                flow.marker = mark
            elif tag in ("blockquote", "dd"):
                flow.indents.append("  ")
            elif tag in VERBATIM:
                pre += 1
            elif tag == "table":
                tables.append(Table())
            elif tag in SECTIONS and tables:
                tables[-1].group()
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in CELLS and tables and tables[-1].rows:
                flows.append((flow, lists, pre))
                flow, lists, pre = Flow(), [], 0
            todo.append((node, False))
            todo.extend((child, True) for child in reversed(node.children))
            continue
        if tag in CELLS and flows:
            flow.flush()
            cell = flow.lines
            flow, lists, pre = flows.pop()
            tables[-1].cell(cell, node.attrs)
        elif tag == "table":
            flow.flush()
            for line in tables.pop().lines():
                flow.put(line)
        elif tag in LISTS:
            flow.flush()
            lists.pop()
        elif tag == "li":
            flow.flush()
            flow.indents.pop()
            flow.marker = None
        elif tag in ("blockquote", "dd"):
            flow.flush()
            flow.indents.pop()
        elif tag in VERBATIM:
            pre -= 1
        if tag in BLOCKS:
            flow.block(1 if tag in PARAGRAPHS and not (tag in LISTS and lists) else 0)
    flow.flush()
    return "\n".join(flow.lines).strip("\n")


def extract(html: str | None) -> tuple[str, str]:
    """(title, visible text)."""
    builder = Builder()
    root = builder.feed(html or "")
    return builder.title or "", render(root)


def extractor(batches):
    import pyarrow as pa

    for batch in slices(batches, "html"):
        rows = [extract(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["page_id", "title", "text"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, text) of each page."""
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(extractor, "page_id bigint, title string, text string")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("bigint"))
