import random

from tessera.llm.html import extract, render
from tessera.llm.registry import QUERIES


def test_blocks_and_inline():
    assert render("<p>one <b>bold</b>  text<p>two<br>lines") == "one bold text\n\ntwo\nlines"
    assert render("<h1>T</h1>x<div>y</div>z") == "T\n\nx\ny\nz"


def test_implied_tags():
    assert render("<ul><li>a<li>b</ul>") == "- a\n- b"
    assert render("<dl><dt>t<dd>d<dt>u<dd>e</dl>") == "t\n  d\nu\n  e"
    assert render("<title>no</title><body>yes") == "yes"


def test_nested_lists_number_and_indent():
    assert render("<ol start=3><li>a<ul><li>b</ul><li>c</ol>") == "3. a\n   - b\n4. c"


def test_hidden():
    page = "<head><style>x</style></head><script>var a='</p>';</script><div hidden>h</div><p style='color:red; display : none'>n<p>v<template>t</template><!-- c --><noscript>s</noscript>"
    assert render(page) == "v"
    assert render("<details><summary>s</summary>hidden</details><details open><summary>t</summary>shown</details>") == "s\nt\nshown"


def test_tables_align():
    assert render("<table><tr><th>name<th>n<tr><td>a<td>1<tr><td>longer<td>22</table>") == "name    n\na       1\nlonger  22"
    assert render("<table><tr><td colspan=2>wide cell here<td>x<tr><td>a<td>b<td>c</table>").splitlines()[1].split() == ["a", "b", "c"]


def test_cells_that_span_rows_keep_their_column():
    page = "<table><tr><td rowspan=2>one<td>a<td>b<tr><td>two<td>c<tr><td>x<td>y<td>z</table>"
    assert render(page) == "one  a    b\n     two  c\nx    y    z"
    assert render("<table><tr><td>p<td rowspan=0>q<td>r<tr><td>s<td>t<tr><td>u<td>v</table>") == "p  q  r\ns     t\nu     v"


def test_drawings_and_formulas_show_text():
    assert render("a <svg><title>no</title><text>chart label</text><text>two</text></svg> b <math>x</math> c") == "a chart label two b x c"


def test_item_values():
    assert render("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"


def test_visibility_is_inherited_and_set_again():
    assert render("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b><p>no</p></div>z") == "yes\n\nz"
    assert render("<div style='display:none'>no <b style='display:block;visibility:visible'>no</b></div>z") == "z"


def test_style_rules():
    css = "<style>/* .z{} */ .h, #i{display:none} p.q{visibility:hidden} @media print{.r{display:none}} div .s{display:none} b.t{display:none !important}</style>"
    assert render(css + "<p class='a h'>1</p><p id=i>2</p><p class=q>3</p><i class=q>4</i><u class=r>5</u><s class=s>6</s><b class=t style='display:inline'>7</b><em class=h style='display:inline'>8</em>") == "4568"


def test_long_style_sheets_take_linear_time():
    for bad in ("@" * 300_000, "/*" * 300_000, "a " * 300_000, "{" * 300_000, "@media x{" * 50_000, ".a,:b " * 100_000):
        assert render(f"<style>.h{{display:none}} {bad}</style><p class=h>no<p>yes").endswith("yes")


def test_spans_are_wide_and_tables_deep():
    assert render("<table><tr><td colspan=300>w<td>x<tr>" + "<td>a" * 301 + "</table>").splitlines()[0].split() == ["w", "x"]
    page = "<table><tr><td>a<td>" * 300 + "<b>deep</b>"
    assert render(page).split() == ["a"] * 300 + ["deep"] and render(page).count("\n") == 0


def test_pre_keeps_spaces():
    assert render("<pre>\n a  b\n  c</pre>") == " a  b\n  c"


def test_entities_and_bare_signs():
    assert render("a &amp; b &lt;c&gt; &#233; 1 < 2") == "a & b <c> é 1 < 2"


def test_broken_markup_never_fails():
    r = random.Random(3)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li", "</li>", "<b>", "</b", "<!--", "-->", "<script>", "</script>", "<a href='", '"', ">", "text ", "&amp", "<pre>", "<![CDATA[", "</", "<"]
    for _ in range(400):
        render("".join(r.choice(bits) for _ in range(r.randint(0, 60))))
    assert render("<b>" * 100_000 + "deep") == "deep"
    assert render("<table><tr><td>" * 2000 + "deep") == "deep"
    assert render("<div " + "a" * 200_000) is not None


def test_extract(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (2, None), (3, ""), (None, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, html string").selectExpr("*", "'z' as text")
    got = sorted((str(x["page_id"]), x["text"], x["n_lines"], x["n_words"]) for x in extract(df).collect())
    assert got == [("1", "a", 1, 1), ("1", "a", 1, 1), ("2", "", 0, 0), ("3", "", 0, 0), ("None", "x", 1, 1)]
    assert extract(df.limit(0)).count() == 0


def test_query_keeps_all_visible_words(spark, sf):
    """Brute force: what stands outside tags, head, scripts, styles and comments, word by word."""
    import html
    import re

    got = {x["page_id"]: x["text"] for x in QUERIES["op1_html_extraction"](spark, sf).collect()}
    for x in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", x["html"])
        body = html.unescape(re.sub(r"<[^>]+>", " ", body))
        bullets = re.sub(r"(?m)^- ", "", got[x["page_id"]])
        assert "".join(bullets.split()) == "".join(body.split())


class Slow:
    """Another renderer of well-formed pages of divs, paragraphs, lists and tables: blocks as nested boxes of lines."""

    def __init__(self, page):
        from html.parser import HTMLParser

        root = ["#root", []]
        stack = [root]

        class P(HTMLParser):
            def handle_starttag(self, tag, attrs):
                node = [tag, [], dict(attrs)]
                stack[-1][1].append(node)
                stack.append(node)

            def handle_endtag(self, tag):
                assert stack.pop()[0] == tag

            def handle_data(self, data):
                stack[-1][1].append(data)

        P().feed(page)
        self.lines = self.box(root[1])

    def box(self, kids):
        """Lines of children; a None is an empty line that merges with its neighbours."""
        out, text = [], ""
        for k in [*kids, ["#end", []]]:
            if isinstance(k, str):
                text += k
                continue
            if text.split():
                out.append(" ".join(text.split()))
            text = ""
            if k[0] == "div":
                out += self.box(k[1])
            elif k[0] in ("p", "ul", "ol", "table"):
                out += [None, *getattr(self, k[0])(k), None]
        return out

    def p(self, k):
        return self.box(k[1])

    def ul(self, k, number=None):
        out = []
        for li in k[1]:
            mark = "- " if number is None else f"{number}. "
            number = None if number is None else number + 1
            inner = self.clean(self.box([["div", x[1]] if not isinstance(x, str) and x[0] == "p" else x for x in li[1]]))
            out += [(mark if i == 0 else " " * len(mark)) + l for i, l in enumerate(inner)]
        return out

    def ol(self, k):
        return self.ul(k, int(k[2].get("start", 1)))

    def table(self, k):
        grid, spots = {}, []
        for y, tr in enumerate(k[1]):
            x = 0
            for td in tr[1]:
                while (y, x) in grid:
                    x += 1
                for dy in range(int(td[2].get("rowspan", 1))):
                    grid[y + dy, x] = True
                spots.append((y, x, self.clean(self.box(td[1]))))
                x += 1
        wide = [max([0, *(len(l) for _, x, ls in spots if x == c for l in ls)]) for c in range(max([0, *(x + 1 for _, x, _ in spots)]))]
        out = []
        for y in range(len(k[1])):
            row = [(x, ls) for yy, x, ls in spots if yy == y]
            for i in range(max([0, *(len(ls) for _, ls in row)])):
                line = [" "] * (sum(wide) + 2 * len(wide))
                for x, ls in row:
                    if i < len(ls):
                        at = sum(wide[:x]) + 2 * x
                        line[at : at + len(ls[i])] = ls[i]
                out.append("".join(line).rstrip())
        return out

    @staticmethod
    def clean(lines):
        out = []
        for l in lines:
            if l is not None:
                out.append(l)
            elif out and out[-1] != "":
                out.append("")
        while out and out[-1] == "":
            out.pop()
        return out


def test_layout_equals_the_slow_renderer():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcxyz") for _ in range(r.randint(1, 6)))

    def text():
        return " ".join(word() for _ in range(r.randint(1, 4)))

    def block(depth):
        kind = r.choice(["p", "div", "ul", "ol", "table"] if depth else ["p", "div"])
        if kind == "p":
            return f"<p>{text()}</p>"
        if kind == "div":
            return f"<div>{text()}{block(depth - 1) if depth else ''}</div>"
        if kind == "table":
            rows, cols = r.randint(1, 4), r.randint(1, 3)
            spans = [r.choice([1, 1, 1, 2]) for _ in range(rows)]
            out = ""
            for y in range(rows):
                cells = cols - (1 if y and spans[y - 1] == 2 else 0)
                spans[y] = 1 if y and spans[y - 1] == 2 or y == rows - 1 else spans[y]
                out += "<tr>" + "".join(f"<td{' rowspan=2' if c == 0 and spans[y] == 2 else ''}>{block(depth - 1) if r.random() < 0.2 else text()}</td>" for c in range(cells)) + "</tr>"
            return f"<table>{out}</table>"
        start = f" start={r.randint(2, 12)}" if kind == "ol" and r.random() < 0.5 else ""
        items = "".join(f"<li>{text()}{'<div>' + text() + '</div>' if r.random() < 0.3 else ''}</li>" for _ in range(r.randint(1, 4)))
        return f"<{kind}{start}>{items}</{kind}>"

    for _ in range(300):
        page = "".join(block(2) for _ in range(r.randint(1, 4)))
        assert render(page).split("\n") == Slow.clean(Slow(page).lines), page


def test_query_spacing(spark, sf):
    """Blocks stand on lines of their own, items are marked, paragraphs are spaced."""
    import html
    import re

    flat = lambda x: " ".join(html.unescape(x).split())
    got = {x["page_id"]: x["text"] for x in QUERIES["op1_html_extraction"](spark, sf).collect()}
    for x in spark.read.parquet(f"{sf}/pages.parquet").collect():
        lines = got[x["page_id"]].split("\n")
        items = re.findall(r"<li><a [^>]*>([^<]*)</a></li>", x["html"])
        assert [l[2:] for l in lines if l.startswith("- ")] == [flat(i) for i in items]
        assert not any(a == b == "" for a, b in zip(lines, lines[1:]))
        for p in re.findall(r"<p>([^<]*)</p>", x["html"]):
            at = lines.index(flat(p)) if p.split() else None
            assert at is None or (lines[at - 1] == "" if at else True)
