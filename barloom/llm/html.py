"""Layout-aware rendering of HTML to the text a reader would see.

A small tree builder applies the rules of implied and optional tags (an open paragraph
ends where a block begins, list items and table cells end their predecessors, unknown
end tags are ignored).  The renderer leaves out what is not displayed and emits
everything else: blocks on lines of their own with blank lines around paragraphs,
headings and lists, marked and indented list items, and table cells in aligned columns,
spans in both directions included.  What is displayed follows from the elements, the
hidden attribute, style attributes and the style elements' rules for display and
visibility with selectors of tags, classes, ids and descendants; a visible element inside
an invisible one shows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.kernels import column
from barloom.llm.scratch import on_workers

#: Element classes of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist audio video canvas svg math object map meta link base param source track area".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option optgroup".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu dir".split())
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend summary".split())
#: A start tag ends these open elements, looking no further out than the listed ones.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: What may stand in a head; any other start tag, and text, ends an open one.
METADATA = frozenset("title meta link base basefont bgsound style script noscript noframes template head html".split())
#: End tags do not reach out of these.
FENCES = {"p": {"table", "td", "th", "body"}, "li": {"ul", "ol", "menu", "dir"}}
#: As in browsers, deeper elements become siblings.
DEEPEST = 250
#: Cells wider than this are not padded to, so a wide cell does not widen every row.
WIDEST = 80

#: As the HTML tokenizer reads a tag: a quote opens a value only directly after "=".
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?>[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^ \t\n\r\f>\"'][^ \t\n\r\f>]*)?)?)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?>[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"([^\"]*)\"?|'([^']*)'?|([^ \t\n\r\f>\"'][^ \t\n\r\f>]*))?)?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_COMPOUND = re.compile(r"(?:\*|[a-z][a-z0-9-]*)?(?:[.#][\w-]+)*", re.I)
_PART = re.compile(r"([.#]?)([\w-]+)")


def declarations(style: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a style: whether important, and the value."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in _DECLARATION.findall(style):
        key, new = name.lower(), (bool(important), value.lower())
        if key not in out or new[0] >= out[key][0]:
            out[key] = new
    return out


class Sheet:
    """The rules of a page's style elements that set display or visibility."""

    def __init__(self, css: str):
        #: (specificity, number, compounds from the innermost out, declarations)
        self.rules: list[tuple[tuple[int, int, int], int, list[list[tuple[str, str]]], dict[str, tuple[bool, str]]]] = []
        if re.search(r"display|visibility", css, re.I):
            self._read(re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", css, flags=re.S))

    def _read(self, css: str) -> None:
        at = 0
        while (brace := css.find("{", at)) >= 0:
            head, depth, end = css[at:brace].rpartition(";")[2].strip(), 1, brace + 1
            while end < len(css) and depth:
                depth += (css[end] == "{") - (css[end] == "}")
                end += 1
            body, at = css[brace + 1 : end - (depth == 0)], end
            if head.startswith("@"):
                if re.match(r"@media\b[^{]*\b(?:screen|all)\b", head, re.I) and not re.search(r"\bnot\b|\(", head):
                    self._read(body)
                continue
            found = declarations(body)
            for selector in head.split(",") if found else ():
                parts = selector.split()
                if parts and all(p and _COMPOUND.fullmatch(p) for p in parts):
                    chain = [[(kind, name if kind else name.lower()) for kind, name in _PART.findall(p)] for p in reversed(parts)]
                    flat = [kind for compound in chain for kind, _ in compound]
                    self.rules.append(((flat.count("#"), flat.count("."), flat.count("")), len(self.rules), chain, found))

    def of(self, node: Node) -> dict[str, tuple[bool, str]]:
        best: dict[str, tuple] = {}
        for weight, number, chain, found in self.rules:
            if _fits(node, chain):
                for name, (important, value) in found.items():
                    new = (important, weight, number, value)
                    if name not in best or new[:3] >= best[name][:3]:
                        best[name] = new
        return {name: (b[0], b[3]) for name, b in best.items()}


def _fits(node: Node, chain: list[list[tuple[str, str]]]) -> bool:
    if not _is(node, chain[0]):
        return False
    rest, up = 1, node.parent
    while rest < len(chain):
        if up is None:
            return False
        rest += _is(up, chain[rest])
        up = up.parent
    return True


def _is(node: Node, compound: list[tuple[str, str]]) -> bool:
    for kind, name in compound:
        if kind == "":
            if node.tag != name:
                return False
        elif kind == "#":
            if node.attributes().get("id") != name:
                return False
        elif name not in node.attributes().get("class", "").split():
            return False
    return True


class Node:
    __slots__ = ("_known", "attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children, self._known = tag, attrs, parent, [], None

    def attributes(self) -> dict[str, str]:
        """Of two attributes of one name the first counts."""
        if self._known is None:
            self._known = {}
            for m in _ATTRIBUTE.finditer(self.attrs):
                self._known.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return self._known

    def shown(self, sheet: Sheet | None, around: bool = True) -> tuple[bool, bool]:
        """Whether it is displayed at all, and whether its own text is visible in surroundings that are or are not."""
        if self.tag in UNSEEN:
            return False, around
        if not self.attrs and sheet is None:
            return self.tag != "dialog", around
        own = self.attributes()
        style = sheet.of(self) if sheet else {}
        for name, new in declarations(own.get("style", "")).items():
            if name not in style or new[0] >= style[name][0]:
                style[name] = new
        display, visibility = (style.get(x, (False, None))[1] for x in ("display", "visibility"))
        there = display != "none" if display else "hidden" not in own and (self.tag != "dialog" or "open" in own)
        return there, {"visible": True, "hidden": False, "collapse": False}.get(visibility, around)


def build(html: str) -> Node:
    """The tree of a document or fragment; text children are str."""
    root = Node("#root")
    stack = [root]
    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            _text(stack, html[at:])
            break
        if m.start() > at:
            _text(stack, html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            _close(stack, tag)
            continue
        if tag not in METADATA:
            _end_head(stack)
        if tag in ENDS_P:
            _end_until(stack, {"p"}, FENCES["p"])
        if tag in IMPLIED:
            _end_until(stack, *IMPLIED[tag])
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        node = Node(tag, m[3].strip(), stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            stop = close.start() if close else end
            text = html[at:stop]
            node.children.append(unescape(text) if tag in ("textarea", "title") else text)
            at = close.end() if close else end
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    return root


def _text(stack: list[Node], source: str) -> None:
    if _SPACE.sub("", source):
        _end_head(stack)
    stack[-1].children.append(unescape(source))


def _end_head(stack: list[Node]) -> None:
    """End an open head, unless a template or noscript in it takes what comes."""
    if stack[-1].tag == "head":
        stack.pop()


def _end_until(stack: list[Node], tags: set[str], fence: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in fence:
            return
        if stack[i].tag in tags:
            outermost = i
            while outermost > 1 and stack[outermost - 1].tag in tags:
                outermost -= 1
            del stack[outermost:]
            return


def _close(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br", "", stack[-1]))
        return
    fence = FENCES.get(tag, ())
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in fence or (stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "div")):
            return


class _Lines:
    """Lines under construction, with collapsed white space and pending blank lines; text shows while ``visible``."""

    def __init__(self, sheet: Sheet | None = None, visible: bool = True) -> None:
        self.sheet, self.visible = sheet, visible
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.mark = ""

    def inner(self) -> _Lines:
        return _Lines(self.sheet, self.visible)

    def text(self, s: str) -> None:
        if not self.visible:
            s = " "
        parts = _SPACE.split(s)
        if len(parts) == 1 and not s:
            return
        if parts[0] == "":
            self.space = True
        for i, word in enumerate(parts):
            if i:
                self.space = True
            if word:
                if self.space and self.line:
                    self.line.append(" ")
                self.space = False
                self._begin()
                self.line.append(word)

    def _begin(self) -> None:
        if not self.line:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            if self.mark:
                self.line.append(self.mark)
                self.mark = ""

    def verbatim(self, lines: list[str]) -> None:
        self.end()
        for x in lines:
            self._begin()
            self.done.append("".join(self.line) + x)
            self.line = []

    def end(self, gap: bool = False) -> None:
        if self.line:
            self.done.append("".join(self.line))
            self.line = []
        self.space = False
        self.gap = self.gap or gap

    def hard(self) -> None:
        if self.line:
            self.end()
        else:
            self._begin()
            self.end()
            if self.done and self.done[-1] != "":
                self.done.append("")
        self.space = False


def _render(node: Node, out: _Lines, number: list[int] | None = None) -> None:
    around = out.visible
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
            continue
        if child.tag == "br":
            out.hard()
            continue
        there, out.visible = child.shown(out.sheet, around)
        if there:
            _element(child, out, number)
        out.visible = around


def _element(child: Node, out: _Lines, number: list[int] | None) -> None:
    tag = child.tag
    if tag in ("ul", "ol", "menu", "dir"):
        nested = number is not None
        out.end(gap=not nested)
        start = child.attributes().get("start", "1") if tag == "ol" else ""
        _render(child, out, [int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1] if tag == "ol" else [])
        out.end(gap=not nested)
    elif tag == "li":
        out.end()
        inner = out.inner()
        _render(child, inner, number if number is not None else [])
        inner.end()
        mark = "* "
        if number:
            mark, number[0] = f"{number[0]}. ", number[0] + 1
        pad = " " * len(mark)
        out.verbatim([(mark if i == 0 else pad if x else "") + x for i, x in enumerate(inner.done)])
    elif tag == "table":
        out.end(gap=True)
        out.verbatim(_table(child, out))
        out.end(gap=True)
    elif tag == "pre":
        out.end(gap=True)
        text = _plain(child, out.sheet, out.visible).removeprefix("\n").expandtabs(8)
        out.verbatim([x.rstrip() for x in text.split("\n")] if text.strip() else [])
        out.end(gap=True)
    elif tag == "dd":
        out.end()
        inner = out.inner()
        _render(child, inner)
        inner.end()
        out.verbatim([("    " + x) if x else "" for x in inner.done])
    elif tag == "img":
        if alt := child.attributes().get("alt"):
            out.text(alt)
    elif tag == "input":
        own = child.attributes()
        if own.get("type", "text").lower() in ("text", "submit", "button", "reset", "search") and own.get("value"):
            out.text(own["value"])
    elif tag in BLOCK:
        out.end(gap=tag in SPACED)
        _render(child, out)
        out.end(gap=tag in SPACED)
    else:
        _render(child, out, number)


def _plain(node: Node, sheet: Sheet | None, visible: bool) -> str:
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(child if visible else re.sub(r"[^\n]", "", child))
        elif child.tag == "br":
            parts.append("\n")
        else:
            there, own = child.shown(sheet, visible)
            parts.append(_plain(child, sheet, own) if there else "")
    return "".join(parts)


def _number(node: Node, name: str, least: int) -> int:
    value = node.attributes().get(name, "1")
    return max(least, int(value)) if re.fullmatch(r"\d{1,3}", value) else 1


def _table(table: Node, out: _Lines) -> list[str]:
    #: Of each row, the column, the lines and the columns covered of each cell.
    rows: list[list[tuple[int, list[str], int]]] = []
    around: list[str] = []
    #: Rows that cells from above still cover, by column; for ever is -1.
    taken: dict[int, int] = {}

    def lines_of(node: Node, visible: bool) -> list[str]:
        inner = _Lines(out.sheet, visible)
        _render(node, inner)
        inner.end()
        return inner.done

    def row(tr: Node, visible: bool) -> None:
        cells, loose, at, below = [], Node("td"), 0, {c: n - (n > 0) for c, n in taken.items()}
        for c in tr.children:
            if isinstance(c, Node) and c.tag in ("td", "th"):
                there, own = c.shown(out.sheet, visible)
                if there:
                    while taken.get(at):
                        at += 1
                    wide, deep = _number(c, "colspan", 1), _number(c, "rowspan", 0)
                    cells.append((at, lines_of(c, own), wide))
                    if deep != 1:
                        below |= dict.fromkeys(range(at, at + wide), deep - 1)
                    at += wide
            elif not isinstance(c, str) or c.strip():
                loose.children.append(c)
        if loose.children:
            around.extend(lines_of(loose, visible))
        rows.append(cells)
        taken.clear()
        taken.update({c: n for c, n in below.items() if n})

    def walk(node: Node, visible: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    around.extend(lines_of(_wrap(c), visible))
                continue
            there, own = c.shown(out.sheet, visible)
            if not there:
                continue
            if c.tag == "tr":
                row(c, own)
            elif c.tag in ("tbody", "thead", "tfoot"):
                taken.clear()
                walk(c, own)
                taken.clear()
            elif c.tag in ("td", "th"):
                row(_wrap(c), visible)
            elif c.tag not in ("colgroup", "col"):
                around.extend(lines_of(_wrap(c), visible))

    walk(table, out.visible)
    width: dict[int, int] = {}
    for cells in rows:
        for at, text, span in cells:
            if span == 1:
                width[at] = max(width.get(at, 0), *(min(WIDEST, len(x)) for x in text), 0)
    columns = sorted(width)
    begins = [0, *accumulate(width[c] + 2 for c in columns)]
    lines = list(around)
    for cells in rows:
        for i in range(max((len(text) for _, text, _ in cells), default=0)):
            line = ""
            for n, (at, text, _) in enumerate(cells):
                if n or at:
                    line = (line + "  " * bool(line)).ljust(begins[bisect_left(columns, at)])
                line += text[i] if i < len(text) else ""
            lines.append(line.rstrip())
    return lines


def _wrap(child: Node | str) -> Node:
    node = Node("td")
    node.children.append(child)
    return node


def _styles(root: Node) -> Iterator[str]:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            yield from (x for x in node.children if isinstance(x, str))
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and (c.children or c.tag == "style")]


def visible_text(html: str | None) -> str | None:
    """All visible text of a page; null stays null, a page that shows nothing gives ''."""
    if html is None:
        return None
    root = build(html.replace("\r\n", "\n").replace("\0", ""))
    sheet = Sheet("\n".join(_styles(root)))
    out = _Lines(sheet if sheet.rules else None)
    _render(root, out)
    out.end()
    while out.done and out.done[-1] == "":
        out.done.pop()
    return "\n".join(x.rstrip() for x in out.done)


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the visible text of each whole page.

    A null page gives null, an empty or invisible one ''.  Other columns and repeated
    rows are kept; a column already called ``out`` is replaced.
    """
    on_workers(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                texts = [visible_text(x.as_py()) for x in column(rows, html)]
                yield pa.RecordBatch.from_arrays([*(column(rows, f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))
