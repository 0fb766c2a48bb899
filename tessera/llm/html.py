"""HTML extraction by layout-aware rendering.

A tree builder with implied tags turns markup, however broken, into a
tree; visibility rules drop what a browser would not show; a renderer
writes all visible text with block spacing, list markers, preformatted
text and aligned table cells.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_AT = re.compile(r"@[^{};@]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\}?)")
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
#: Blocks with an empty line before and after them.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
#: A start tag that ends an open ``p``.
ENDS_P = frozenset((BLOCK - {"body", "html", "option", "optgroup", "legend"}) | {"xmp", "hr"})
#: start tag -> (open elements that it ends, elements at which the search stops)
_LIST, _TABLE = frozenset("ul ol menu dir".split()), frozenset(["table"])
IMPLIED = {
    "li": (frozenset(["li"]), _LIST),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), _TABLE),
    "td": (frozenset("td th caption".split()), frozenset("table tr".split())),
    "th": (frozenset("td th caption".split()), frozenset("table tr".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), _TABLE),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), _TABLE),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), _TABLE),
    "caption": (frozenset(["caption"]), _TABLE),
    "colgroup": (frozenset(["colgroup", "caption"]), _TABLE),
}
#: An end tag does not reach past these.
BARRIER = frozenset("table td th caption button template".split())
IN_HEAD = frozenset("base link meta script style template title noscript head html".split())


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attr(self, name: str) -> str | None:
        """The value of an attribute, '' if it has none, None if it is absent."""
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return entities.unescape(m[2] or m[3] or m[4] or "")
        return None


def parse(source: str, sheets: list[str] | None = None) -> Node:
    """Build the tree; never fails, whatever the markup. Style sheets are added to ``sheets``."""
    root = Node("#root")
    stack, tags = [root], ["#root"]
    counts: dict[str, int] = {}
    at, size = 0, len(source)

    def pop_to(i: int) -> None:
        for t in tags[i:]:
            counts[t] -= 1
        del stack[i:], tags[i:]

    def close(names, stops) -> None:
        if any(counts.get(n) for n in names):
            found = 0
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] in names:
                    found = i
                elif tags[i] in stops:
                    break
            if found:
                pop_to(found)

    def push(tag: str, attrs: str = "") -> None:
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag not in VOID:
            stack.append(node)
            tags.append(tag)
            counts[tag] = counts.get(tag, 0) + 1

    match = _TOKEN.search
    while at < size:
        m = match(source, at)
        if m is None:
            m_start, m_end = size, size
        else:
            m_start, m_end = m.span()
        if m_start > at:
            text = source[at:m_start]
            if counts.get("head") and not text.isspace():
                close(("head",), ())
            if not (tags[-1] in ("table", "tr", "tbody", "thead", "tfoot", "colgroup") and text.isspace()):
                stack[-1].kids.append(entities.unescape(text) if "&" in text else text)
        at = m_end
        if m is None or m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "br":
                push("br")
            elif tag == "p" and not counts.get("p"):
                push("p")
                pop_to(len(tags) - 1)
            elif counts.get(tag):
                stops = () if tag in BARRIER or tag in ("tr", "tbody", "thead", "tfoot", "body", "html") else BARRIER
                for i in range(len(tags) - 1, 0, -1):
                    if tags[i] == tag:
                        pop_to(i)
                        break
                    if tags[i] in stops:
                        break
            continue
        if counts.get("head") and tag not in IN_HEAD:
            close(("head",), ())
        if tag in ("html", "body", "head") and counts.get(tag):
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
            if tag in ("td", "th") and tags[-1] in ("table", "tbody", "thead", "tfoot"):
                push("tr")
        if tag in ENDS_P and counts.get("p"):
            close(("p",), BARRIER)
        push(tag, m["attrs"] or "")
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            text = source[at : end.start() if end else size]
            at = end.end() if end else size
            stack[-1].kids.append(entities.unescape(text) if tag in ("textarea", "title") else text)
            if tag == "style" and sheets is not None:
                sheets.append(text)
            pop_to(len(tags) - 1)
    return root


@dataclass(frozen=True)
class Rule:
    """A style rule of one simple selector: a tag, classes and an id, any of them absent."""

    tag: str
    classes: frozenset
    ident: str
    weight: tuple
    display: str | None
    visibility: str | None

    def matches(self, tag: str, classes: set, ident: str | None) -> bool:
        return self.tag in ("", tag) and self.classes <= classes and self.ident in ("", ident)


def declared(text: str) -> tuple[str | None, str | None, bool]:
    """``display`` and ``visibility`` of a list of declarations, and whether one of them is important."""
    found: dict[str, str] = {}
    important = False
    for part in text.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in ("display", "visibility") and value:
            important |= value.endswith("!important")
            found[name] = value.removesuffix("!important").strip()
    return found.get("display"), found.get("visibility"), important


def rules_of(sheet: str) -> list[Rule]:
    """The rules of a style sheet that say whether something shows. At-rules and compound selectors are left out."""
    out = []
    for rule in _AT.sub("", _COMMENT.sub("", sheet)).split("}"):
        selectors, _, body = rule.partition("{")
        display, visibility, important = declared(body)
        if display is None and visibility is None:
            continue
        for selector in selectors.split(","):
            simple = _SIMPLE.fullmatch(selector.strip())
            if not simple or not simple[0]:
                continue
            marks = re.findall(r"[.#][\w-]+", simple[2])
            ids = [x[1:] for x in marks if x[0] == "#"]
            if len(ids) > 1:
                continue
            tag = (simple[1] or "").lower().replace("*", "")
            classes = frozenset(x[1:] for x in marks if x[0] == ".")
            weight = (important, len(ids), len(classes), bool(tag), len(out))
            out.append(Rule(tag, classes, "".join(ids), weight, display, visibility))
    return out


class Look:
    """Visibility rules of one page."""

    def __init__(self, sheets: list[str]):
        rules = rules_of("\n".join(sheets)) if any("display" in x or "visibility" in x for x in sheets) else []
        self.rules = sorted(rules, key=lambda r: r.weight)

    def of(self, node: Node) -> tuple[bool, str | None]:
        """Whether an element is left out, and what visibility it sets (none: that of its parent)."""
        tag = node.tag
        if tag in HIDDEN or tag == "dialog" and node.attr("open") is None:
            return True, None
        display = visibility = None
        found = []
        if self.rules:
            classes, ident = set((node.attr("class") or "").split()), node.attr("id")
            found = [r for r in self.rules if r.matches(tag, classes, ident)]
        for r in found:
            display, visibility = r.display or display, r.visibility or visibility
        if node.attrs and (low := node.attrs.lower()):
            if "style" in low:
                own = declared(node.attr("style") or "")
                display, visibility = own[0] or display, own[1] or visibility
                for r in found:
                    if r.weight[0]:
                        display, visibility = r.display or display, r.visibility or visibility
            if "hidden" in low and display is None and node.attr("hidden") is not None:
                return True, None
        return display == "none", visibility


def whole(text: str | None, least: int, most: int) -> int | None:
    """An integer attribute within bounds; none if it is absent or no number."""
    if text and re.fullmatch(r"\s*[+-]?\d{1,9}\s*", text):
        return max(least, min(most, int(text)))
    return None


class Writer:
    """Lines of text with collapsed white space and pending breaks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.indent = ""
        self.marker = ""

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words[:-1] if self.space else words)

    def put(self, content: str) -> None:
        pad = self.indent
        if self.marker:
            pad, self.marker = self.indent[: -len(self.marker)] + self.marker, ""
        self.lines.append((pad + content).rstrip())

    def flush(self) -> None:
        """End the line, if it has text."""
        if self.line:
            self.put("".join(self.line))
            self.line = []
        self.space = False

    def gap(self) -> None:
        """End the line and leave one empty line, unless a list item has just begun."""
        self.flush()
        if self.lines and self.lines[-1] and not self.marker:
            self.lines.append("")

    def pre(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").split("\n")
        if first:
            self.line.append(first)
        for x in rest:
            self.put("".join(self.line))
            self.line = [x] if x else []

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _kids(node: Node) -> list:
    """The children that may show: of a closed ``details`` only its summary."""
    if node.tag == "details" and node.attr("open") is None:
        return [k for k in node.kids if isinstance(k, Node) and k.tag == "summary"][:1]
    return node.kids


def run(task: Generator) -> list[str]:
    """Run a layout; the layouts that it asks for stand on a stack of their own, so that tables nest to any depth."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def layout(node: Node, look: Look, off: bool = False) -> Generator:
    """The visible lines of a subtree; ``off`` if its surroundings are invisible."""
    w = Writer()
    lists: list[list] = []  # [tag, number of the next item]
    pre = 0
    todo: list = [(node, None)]
    while todo:
        x, closing = todo.pop()
        if isinstance(x, str):
            if off:
                continue
            if pre:
                w.pre(x)
            else:
                w.text(x)
            continue
        tag = x.tag
        if closing is not None:
            indent, off = closing
            if tag in ("li", "dd", "blockquote"):
                w.flush()
                w.marker = ""
                w.indent = w.indent[: len(w.indent) - indent]
            elif tag in _LIST:
                lists.pop()
            elif tag in ("pre", "xmp", "textarea"):
                w.flush()
                pre -= 1
            if tag in SPACED and not (tag in _LIST and lists):
                w.gap()
            elif tag in BLOCK:
                w.flush()
            elif tag == "text":
                w.text(" ")
            continue
        gone, sight = look.of(x)
        if gone:
            continue
        before, off = off, sight in ("hidden", "collapse") if sight in ("hidden", "collapse", "visible") else off
        if tag == "br":
            if w.line:
                w.flush()
            elif w.lines and not off:
                w.put("")
            off = before
            continue
        if tag == "hr":
            w.gap()
            off = before
            continue
        if tag == "table":
            w.gap()
            for line in (yield table(x, look, off)):
                w.put(line)
            w.gap()
            off = before
            continue
        if tag in ("td", "th", "tr", "caption"):
            w.flush() if tag in ("tr", "caption") else w.text(" ")
        if tag in VOID:
            if tag == "input" and not off and (x.attr("type") or "text").lower() in ("submit", "button", "reset", "text"):
                w.text(x.attr("value") or "")
            off = before
            continue
        if tag in SPACED and not (tag in _LIST and lists):
            w.gap()
        elif tag in BLOCK:
            w.flush()
        elif tag == "text":
            w.text(" ")
        indent = 0
        if tag in _LIST:
            start = whole(x.attr("start"), -(10**9), 10**9) if tag == "ol" else None
            lists.append([tag, 1 if start is None else start])
        elif tag == "li":
            marker = "- "
            if lists and lists[-1][0] == "ol":
                value = whole(x.attr("value"), -(10**9), 10**9) if x.attrs else None
                if value is not None:
                    lists[-1][1] = value
                marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            indent = len(marker)
            w.indent += " " * indent
            w.marker = "" if off else marker
        elif tag in ("dd", "blockquote"):
            indent = 2
            w.indent += "  "
        elif tag in ("pre", "xmp", "textarea"):
            pre += 1
            if x.kids and isinstance(x.kids[0], str) and x.kids[0][:1] == "\n":
                x.kids[0] = x.kids[0][1:]
        todo.append((x, (indent, before)))
        todo.extend((k, None) for k in reversed(_kids(x)))
    return w.done()


#: The most columns and rows that a cell may span (fixed values of the public HTML standard).
SPANS = (1000, 65534)


def table(node: Node, look: Look, off: bool) -> Generator:
    """A table's lines: captions, then rows whose cells begin at the same columns.

    Cells take the first free column of their row; those that span rows
    keep their columns in the rows below.
    """
    out: list[str] = []
    rows: list[list[tuple[list[str], int, int]]] = []  # lines, first column, columns
    taken: dict[int, int] = {}  # column -> rows below that a cell still covers
    todo: list = [(k, off) for k in reversed(node.kids)]
    loose: list = []
    while todo:
        x, dark = todo.pop()
        if isinstance(x, str):
            if not dark:
                loose.append(x)
            continue
        gone, sight = look.of(x)
        if gone or x.tag in ("col", "colgroup") or (sight == "collapse" and x.tag in ("tr", "thead", "tbody", "tfoot")):
            continue
        seen = dark
        if sight in ("hidden", "collapse", "visible"):
            dark = sight != "visible"
        if x.tag == "caption":
            out += yield layout(cell_of(x.kids), look, dark)
        elif x.tag in ("thead", "tbody", "tfoot"):
            taken = {}
            todo += [(k, dark) for k in reversed(x.kids)]
        elif x.tag == "tr":
            row, at, new = [], 0, {}
            for c in x.kids:
                if isinstance(c, str):
                    if not dark:
                        loose.append(c)
                    continue
                gone, sight = look.of(c)
                if gone:
                    continue
                wide, deep, kids = 1, 1, [c]
                if c.tag in ("td", "th"):
                    kids = c.kids
                    if c.attrs:
                        wide = whole(c.attr("colspan"), 1, SPANS[0]) or 1
                        deep = whole(c.attr("rowspan"), 0, SPANS[1])
                        deep = 1 if deep is None else deep or SPANS[1]
                while at in taken:
                    at += 1
                inner = sight != "visible" if sight in ("hidden", "collapse", "visible") else dark
                row.append(((yield layout(cell_of(kids), look, inner)), at, wide))
                if deep > 1:
                    new |= dict.fromkeys(range(at, at + wide), deep - 1)
                at += wide
            taken = {k: n - 1 for k, n in taken.items() if n > 1} | new
            if any(lines for lines, _, _ in row):
                rows.append(row)
        else:
            loose.append(x)
        dark = seen
    if loose:
        out = (yield layout(cell_of(loose), look, off)) + out
    widths: list[int] = []
    for row in rows:
        for lines, at, wide in row:
            if len(widths) < at + wide:
                widths += [0] * (at + wide - len(widths))
            if wide == 1:
                widths[at] = max([widths[at], *map(len, lines)])
    begins = [0]
    for x in widths:
        begins.append(begins[-1] + x + 2)
    for row in rows:
        for k in range(max(len(lines) for lines, _, _ in row)):
            line = ""
            for lines, at, _ in row:
                if k < len(lines) and lines[k]:
                    line = line.ljust(max(begins[at], len(line) + 2 if line else 0)) + lines[k]
            out.append(line.rstrip())
    return out


def cell_of(kids: list) -> Node:
    """A nameless element of the given children."""
    cell = Node("#cell")
    cell.kids = kids
    return cell


def render(source: str | None) -> str:
    """All visible text of a page; null and empty pages give an empty text."""
    if not source:
        return ""
    sheets: list[str] = []
    root = parse(source, sheets)
    return "\n".join(run(layout(root, Look(sheets)))).replace("\xa0", " ").strip("\n")


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Render every page; one row for each row, no shuffle.

    Returns the id column as ``page_id``, ``text``, ``n_lines`` and
    ``n_words``. A null or empty page has an empty text; a repeated row is
    rendered again; a null id stays null; an empty table gives no rows;
    further columns are not read, whatever their names. A page of any
    length is rendered whole; tables and elements nest to any depth. Ties
    do not arise.

    Visible is what a browser with scripts would show by the markup: not
    heads, scripts, templates, closed details and dialogs, nor elements
    hidden by attribute, by their own style or by a style rule whose
    selector is a tag, a class, an id or a conjunction of these; a visible
    child of an invisible element shows. Text of SVG and MathML shows.
    """
    own = df.select(df[id_col].alias("page_id"), df[html_col].alias("html"))
    kind = own.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [render(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(texts, pa.string()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                    pa.array([len(t.split()) for t in texts], pa.int64()),
                ],
                names=["page_id", "text", "n_lines", "n_words"],
            )

    return own.mapInArrow(run, f"page_id {kind}, text string, n_lines bigint, n_words bigint")
