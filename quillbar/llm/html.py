"""Operator 6: layout-aware text extraction from HTML.

Method: the tags of the standard library's tokenizer build a tree, with end tags implied where HTML
implies them; hidden parts are left out; the tree is then walked once, with blank lines around blocks,
markers before list items, and the cells of a table, of several lines each if need be, padded to the width
of their columns; cells that span columns or rows keep their place. All visible text is emitted:
navigation, advertisements and footers too. What stands in a table outside its cells is shown before it, as
browsers do. Tables are laid out from the innermost outwards, at any depth. One scan and one map stage.

Visibility: attributes (hidden, style with display or visibility, open of dialog and details) decide, and
`visibility: visible` shows again what an element around it hides; style sheets are not evaluated.

Text is what a browser takes for text: an open comment or tag at the end of a page shows nothing, textarea, xmp and plaintext
show their tags as text, list items count by start, value, reversed and type. Columns are as wide as their text on a screen of fixed
width (wide characters count two, combining ones none); a column without text has no width, and a table whose alignment would be
more than PADDED times its text is shown without it, so a page's text is at most a small multiple of its html.

Cases: null html gives null text; empty or tagless html gives its own text; markup nested to any depth
is walked with an explicit stack; repeated rows give repeated results; an empty table gives no rows;
other columns are dropped first.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbar.llm.common import slices, table

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title datalist object iframe canvas audio video annotation annotation-xml".split())
#: Parts of SVG that are not drawn where they stand.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern".split())
#: Start tags that leave head open.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
BLOCKS = frozenset("address article aside blockquote body details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table textarea ul".split())
SPACED = frozenset("article blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre section table ul".split())
#: Open elements that a start tag ends, up to the nearest of the elements after them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_P_ENDS = BLOCKS - {"body", "html", "li", "dt", "dd", "textarea"}
_BARRIERS = frozenset({"button", "td", "th", "table", "caption", "html"})
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I).findall
#: Kinds of input whose value is no text on the screen.
_NO_TEXT = frozenset("hidden checkbox radio password file image color range".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Elements whose content is text, with character references but for the last two.
TEXT_ONLY = frozenset("textarea title xmp plaintext".split())
_COMMENT_END, _TAG_BEGIN = re.compile(r"--!?>"), re.compile(r"<[A-Za-z/!?]")
#: Most characters of an aligned table for each character and cell of it.
PADDED = 16
# Roman numerals.
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def _numeral(n: int, kind: str) -> str:
    """The marker of item n of a list of type 1, a, A, i or I."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, rest = divmod(n - 1, 26)
            out = chr(ord(kind) + rest) + out
        return out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, letters in _ROMAN:
            out += letters * (n // value)
            n %= value
        return out.upper() if kind == "I" else out
    return str(n)


def columns_wide(line: str) -> int:
    """Columns that a line takes on a screen of fixed width."""
    if line.isascii():
        return len(line)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in line)


def _whole(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"\s*[+-]?\d{1,9}\s*", value) else None


class Node:
    __slots__ = ("children", "closed", "hidden", "kind", "parts", "shown", "spans", "start", "step", "tag")

    def __init__(self, tag: str, attrs=(), shown: bool = True):
        self.tag, self.children = tag, []
        self.hidden, self.shown = tag in UNSEEN or tag == "dialog", shown
        self.closed, self.start, self.parts = tag == "details", None, False  # parts: holds parts of a table around it
        self.kind, self.step = None, 1
        self.spans = (1, 1) if tag in ("td", "th") else None
        if attrs:
            self._attributes(dict(attrs))

    def _attributes(self, named: dict) -> None:
        tag, shown = self.tag, self.shown
        style = {n.lower(): v.lower() for n, v in _STYLE(named["style"] or "")} if "style" in named else {}
        self.hidden = tag in UNSEEN or "hidden" in named or style.get("display") == "none" or (tag == "dialog" and "open" not in named)
        self.shown = style["visibility"] == "visible" if style.get("visibility") in ("visible", "hidden", "collapse") else shown
        self.closed = tag == "details" and "open" not in named
        if tag in ("ol", "li"):
            self.start = _whole(named.get("start" if tag == "ol" else "value"))
            self.kind = named["type"] if named.get("type") in ("1", "a", "A", "i", "I") else None
            self.step = -1 if "reversed" in named else 1
        if self.spans:
            self.spans = _span(named.get("colspan"), 1, 1000), _span(named.get("rowspan"), 0, 65534)
        if tag == "input" and self.shown and named.get("value") and (named.get("type") or "").lower() not in _NO_TEXT:
            self.children.append(named["value"])


def _span(value: str | None, least: int, most: int) -> int:
    """A number of columns or rows; 0 rows: all that follow."""
    n = int(value.strip()) if value and re.fullmatch(r"\s*\d{1,9}\s*", value) else 1
    return min(n, most) if n >= least else 1


class TreeBuilder(HTMLParser):
    """Builds the tree; ends of p, li, dt, dd, tr, td, th, option and table parts are implied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.held: Counter[str] = Counter()  # open elements of each name

    def _cut(self, at: int) -> None:
        for x in self.open[at:]:
            self.held[x.tag] -= 1
        del self.open[at:]

    def updatepos(self, i, j):
        return j  # line numbers are not asked for

    def parse_comment(self, i, report=1):
        raw = self.rawdata
        for empty in (">", "->"):
            if raw.startswith(empty, i + 4):
                return i + 4 + len(empty)
        end = _COMMENT_END.search(raw, i + 4)
        return end.end() if end else len(raw)  # an open one takes the rest of the page

    def _close(self, names, barriers) -> None:
        if not any(self.held[n] for n in names):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in barriers:
                return
            if tag in names:
                lowest = i
                while lowest > 1 and any(x.tag in names for x in self.open[1:lowest]):
                    upper = max((j for j in range(1, lowest) if self.open[j].tag in names), default=0)
                    if any(x.tag in barriers for x in self.open[upper + 1 : lowest]):
                        break
                    lowest = upper
                self._cut(lowest)
                return

    def _leave_head(self) -> None:
        """Ends an open head at what may not stand in it; templates and the like keep what is theirs."""
        if self.held["head"] and self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in _P_ENDS:
            self._close({"p"}, _BARRIERS)
        if tag in TABLE_PARTS:
            for x in reversed(self.open):
                if x.tag == "table" or x.parts:
                    break
                x.parts = True
        node = Node(tag, attrs, self.open[-1].shown)
        node.hidden |= tag in UNDRAWN and self.held["svg"] > 0
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.held[tag] += 1
        if tag in TEXT_ONLY:
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag not in BLOCKS:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if not self.held[tag]:
            if tag == "p":
                self.open[-1].children.append(Node("p"))
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return
            if self.open[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
                return

    def handle_data(self, data):
        if self.open[-1].tag in ("textarea", "title") and self.cdata_elem:
            data = entities.unescape(data)
        if data.strip(" \t\n\r\f"):
            self._leave_head()
        if self.held["svg"] and not self.held["text"] and not self.held["foreignobject"]:
            return  # SVG draws the strings of these alone
        if self.open[-1].shown:
            self.open[-1].children.append(data)


class Page:
    """Lines of output; white space collapses and blank lines never repeat."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.blank, self.marker = False, False, ""

    def text(self, data: str) -> None:
        for i, word in enumerate(_SPACE.split(data)):
            if i:
                self.space = True
            if word:
                if self.now:
                    self.now.append(" " * self.space)
                elif self.marker:
                    self.now.append(self.marker)
                    self.marker = ""
                self.now.append(word)
                self.space = False

    def end(self) -> None:
        if line := "".join(self.now).rstrip(" "):
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append(line)
            self.blank = False
        self.now, self.space = [], False

    def raw(self) -> None:
        """Ends a line of preformatted text, which may be empty."""
        if self.blank and self.lines:
            self.lines.append("")
        self.lines.append("".join(self.now).rstrip())
        self.now, self.blank = [], False

    def whole(self, lines: list[str]) -> None:
        self.end()
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines += lines
            self.blank = False


def _cells(table_node: Node) -> tuple[list[list[Node]], list[Node], list[Node | str], list[Node]]:
    """Rows of cells of a table without those of tables inside, its captions, what stands outside its
    cells and is shown before it, and tables outside its cells, which follow it."""
    rows, captions, before, after = [], [], [], []
    stack, loose = [(c, None) for c in reversed(table_node.children)], None
    while stack:
        node, row = stack.pop()
        if isinstance(node, str):
            if _SPACE.sub("", node):
                before.append(node)
        elif node.hidden:
            continue
        elif node.tag in ("td", "th"):
            if row is None:  # a row that no tag began
                if loose is None:
                    loose = []
                    rows.append(loose)
                row = loose
            row.append(node)
        elif node.tag == "caption":
            captions.append(node)
        elif node.tag == "table":
            after.append(node)
        elif node.tag in TABLE_PARTS or node.parts:
            if node.tag == "tr":
                row, loose = [], None
                rows.append(row)
            elif node.tag in TABLE_PARTS:
                row = loose = None
            stack += [(c, row) for c in reversed(node.children)]
        else:
            before.append(node)
    return [r for r in rows if r], captions, before, after


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """(first column, columns, lines) of the cells of each row, beside what rows above hold. Columns that are held are
    intervals (first, end, last row), in order, and those that hold alike are one."""
    placed, held = [], []
    for r, row in enumerate(rows):
        held = [x for x in held if x[2] >= r]
        at, cells, fresh, i = 0, [], [], 0
        for lines, across, down in row:
            while i < len(held) and held[i][0] <= at:
                at = max(at, held[i][1])
                i += 1
            cells.append((at, across, lines))
            if down != 1:
                fresh.append((at, at + across, r + down - 1 if down else len(rows)))
            at += across
        placed.append(cells)
        if fresh:
            merged = []
            for x in sorted(held + fresh):
                if merged and merged[-1][2] == x[2] and merged[-1][1] >= x[0]:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], x[1]), x[2])
                else:
                    merged.append(x)
            held = merged
    return placed


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table. rows: (lines, columns, rows) of each cell."""
    placed = _placed(rows)
    # Columns in which some text begins; others have no width. A cell has those within its span.
    begins = sorted({at for cells in placed for at, _, lines in cells if any(lines)})
    cells_of = [[(bisect_left(begins, at), bisect_left(begins, at + across), lines) for at, across, lines in cells] for cells in placed]
    width = [0] * len(begins)
    for wide in (False, True):  # cells that span columns widen the last of them if they must
        for cells in cells_of:
            for a, b, lines in cells:
                if b > a and (b - a > 1) == wide and any(lines):
                    need = max(map(columns_wide, lines)) - sum(width[a : b - 1]) - 3 * (b - a - 1)
                    width[b - 1] = max(width[b - 1], need)
    before = [0]
    for w in width:
        before.append(before[-1] + w + 3)
    height = [max((len(lines) for _, _, lines in cells), default=0) for cells in cells_of]
    said = sum(len(x) + 1 for cells in cells_of for _, _, lines in cells for x in lines)
    last = [max((b for _, b, lines in cells if any(lines)), default=0) for cells in cells_of]
    padded = sum(h * before[b] for h, b in zip(height, last, strict=True)) <= PADDED * (said + sum(map(len, cells_of))) + 4096
    out = []
    for cells, tall in zip(cells_of, height, strict=True):
        for i in range(tall):
            parts, free = [], 0
            for a, b, lines in cells:
                line = lines[i] if i < len(lines) else ""
                if not padded:
                    parts += [line] if line else []
                elif b > free:
                    parts += [" " * w for w in width[free:a]]
                    a, free = max(a, free), b
                    parts.append(line + " " * (before[b] - before[a] - 3 - columns_wide(line)))
                elif line:
                    parts.append(line)  # over a column that another cell holds
            if (text := " | ".join(parts).rstrip()).strip(" |"):
                out.append(text)
    return out


def _tables(root: Node) -> list[Node]:
    """Tables that are not hidden, each before those inside it."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if not isinstance(node, str) and not node.hidden:
            if node.tag == "table":
                found.append(node)
            stack += reversed(node.children)
    return found


def render(nodes: list, laid: dict[int, tuple]) -> list[str]:
    """Visible lines of the nodes. laid: what `_laid_out` gives for the tables among and below them."""
    page, stack, lists = Page(), [(x, False) for x in reversed(nodes)], []
    pre = 0
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            if pre:
                for i, line in enumerate(node.split("\n")):
                    if i:
                        page.raw()
                    page.now.append(line)
            else:
                page.text(node)
            continue
        tag = node.tag
        if node.hidden:
            continue
        if leaving:
            page.end()
            page.blank |= tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1)
            if tag == "table":
                page.whole(laid[id(node)][0])
                page.blank = True
            elif tag in ("ul", "ol"):
                lists.pop()
            elif tag == "li":
                page.marker = ""
            elif tag in ("pre", "textarea"):
                pre -= 1
            continue
        if tag == "br":
            line = bool(page.now)
            page.end()
            page.blank |= not line and bool(page.lines)
        elif tag == "hr":
            page.whole(["---"])
        elif tag == "table":
            _, before, after = laid[id(node)]
            stack += [(x, False) for x in reversed(after)]
            stack.append((node, True))
            stack += [(x, False) for x in reversed(before)]
        elif tag in BLOCKS:
            page.end()
            page.blank |= tag in SPACED and not (tag in ("ul", "ol") and lists)
            if tag in ("ul", "ol"):
                first = node.start
                if first is None:
                    first = 1 if node.step > 0 else sum(not isinstance(x, str) and x.tag == "li" and not x.hidden for x in node.children)
                lists.append([tag, first, node.kind or "1", node.step])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, "1", 1]
                kind[1] = kind[1] if node.start is None else node.start
                page.marker = "  " * max(0, len(lists) - 1) + ("- " if kind[0] == "ul" else f"{_numeral(kind[1], node.kind or kind[2])}. ")
                kind[1] += kind[3]
            elif tag in ("pre", "textarea"):
                pre += 1
            stack.append((node, True))
            inside = node.children
            if node.closed:
                inside = [x for x in inside if not isinstance(x, str) and x.tag == "summary"][:1]
            stack += [(c, False) for c in reversed(inside)]
        else:
            if tag in ("td", "th", "text", "option", "input"):
                page.space = True
            stack += [(c, False) for c in reversed(node.children)]
    page.end()
    return page.lines


def _laid_out(table_node: Node, laid: dict[int, tuple]) -> tuple[list[str], list, list]:
    """(lines of the table, what is shown before it, tables that follow it); those inside it are in laid."""
    rows, captions, before, after = _cells(table_node)
    lines = [x for caption in captions for x in render(caption.children, laid)]
    return lines + _aligned([[(render(c.children, laid), *c.spans) for c in r] for r in rows]), before, after


def extract(html: str) -> str:
    builder = TreeBuilder()
    # A tag that nothing ends shows nothing.
    open_tag = _TAG_BEGIN.search(html, html.rfind(">") + 1)
    builder.feed(html[: open_tag.start()] if open_tag else html)
    builder.close()
    laid: dict[int, tuple] = {}
    for node in reversed(_tables(builder.root)):  # the innermost first
        laid[id(node)] = _laid_out(node, laid)
    return "\n".join(render(builder.root.children, laid)).strip("\n")


def extract_text(df: DataFrame, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, (carried columns), text of every row's whole html."""
    kept = list(dict.fromkeys([key, *carry]))

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(0), 4 << 20):
                part = batch.slice(lo, hi - lo)
                texts = [None if h is None else extract(h) for h in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], [*part.schema.names[1:], "text"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(F.col(html).cast("string").alias("_html"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, f"{fields}, text string")


def op6(spark, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"), carry=("url",))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_text": op6}
ORACLES: dict[str, str] = {}
