import random
import re
from html.parser import HTMLParser

import pytest

from lexfold.llm.html_layout import extract, render
from lexfold.llm.queries import op9_html_layout

CASES = [
    ("<p>One<p>Two <b>bold</b>  text<br>next", "One\n\nTwo bold text\nnext"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>after", "- a\n- b\n\n  - c\n- d\n\nafter"),
    ("<ol start=3><li>x<li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"),
    ("a<table><tr><td>one<td>2<tr><td>three<td>44</table>b", "a\n\none   | 2\nthree | 44\n\nb"),
    ("<table><tr><th>k<th>v<tr><td colspan=2>wide cell<tr><td><td>x</table>", "k | v\nwide cell\n  | x"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r | 1\n  | 2"),
    ("<pre>\n a\n   b <b>c</b>\n</pre>d", " a\n   b c\n\nd"),
    ("x<script>var a='<p>no</p>'</script><style>p{}</style><!-- no --><template>no</template>y", "xy"),
    ("<div hidden>no</div><p style='color:red; display: none'>no<p style='display:block'>yes<span style=visibility:hidden>no</span>", "yes"),
    ("<details><summary>sum</summary>no</details><dialog>no</dialog><dialog open>yes</dialog>", "sum\nyes"),
    ("&lt;b&gt; &amp;amp; &copy 2020 &eacute;&#x41;&#0;", "<b> &amp; © 2020 éA�"),
    ("<head><title> The\n title </title>no</head><body>text", "no\ntext"),
    ("a < b and c<d e", "a < b and c"),
    ("<dl><dt>term<dd>def</dl>", "term\n    def"),
    ("<h1>T</h1>text<div>block</div>tail<hr>end", "T\n\ntext\nblock\ntail\n\n---\n\nend"),
    ("<a href='x>y'>link</a> <a href=\"unclosed>gone", "link"),
    ("<img alt='pic'><input type=hidden value=no><input type=submit value=Go>", "pic Go"),
    ("<select><option>a<option>no</select>e<textarea> t &amp;\n u</textarea>f", "a e t & u f"),
    ("<select><option>no<option selected>b<optgroup><option>no</optgroup></select>e", "b e"),
    ("<select><option disabled>no<option>c</select><select></select>", "c"),
    ("<select multiple><option>a<option>b</select>x<select size=3><optgroup><option>c</select>", "a\nb\nx\nc"),
    ("<a href=x>one<b><i><u><s><em><strong><small><big>two<a href=y>three</a>four", "onetwothreefour"),
    ("<table><tr><td>" + "w" * 80 + "<td>x<tr><td>a<td>y</table>", "w" * 80 + " | x\na" + " " * 80 + "| y"),
    ("<table><td>A<td>B</table>", "A | B"),
    ("<table><tbody><td>A</td></table>", "A"),
    ("<table><tr><td>a</td></tr><td>b</td></table>", "a\nb"),
    ("<table><tr><td>x<td>y</tr><caption>cap</caption></table>", "cap\nx | y"),
    ("<table><tbody><caption>cap</caption><td>x</table>", "cap\nx"),
    ("<table><caption>cap<td>x</table>", "cap\nx"),
    ("<table><colgroup><col><td>x</table>", "x"),
    ("<table><thead><th>k<th>v<tbody><td>x<td>y<tr><td>z</table>", "k | v\nx | y\nz"),
    ("<table><td>o<table><td>in</table></table>", "o\n\nin"),
    ("a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b", "a x=1 b"),
    ("<math><semantics><mi>x</mi><annotation encoding=tex>no</annotation></semantics></math>", "x"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>A</text><text>B <tspan>c</tspan></text></svg>d", "A B c d"),
    ("<svg><defs/><title/><path d='M0 0'/><g><text>A</text></g></svg>b", "A b"),
    ("<svg><foreignObject><p>in</p><desc>seen</desc></foreignObject></svg>", "in\n\nseen"),
    ("<map name=m><p>flow</p><area alt=no></map>", "flow"),
    ("<desc>seen</desc><p hidden/>no", "seen"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("html,text", CASES)
def test_layout(html, text):
    assert render(html)[1] == text


def test_every_cell_is_aligned_in_tables_of_any_shape():
    """Against a plain reading: a column begins where the widest cells before it, and three characters for each, end."""
    rng = random.Random(6)
    for _ in range(60):
        grid = [["".join(rng.choice("ab ") for _ in range(rng.choice((1, 3, 9, 70)))).strip() or "x" for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 5))]
        grid = [[" ".join(c.split()) for c in r] for r in grid]
        wide = [max(len(r[k]) for r in grid if k < len(r)) for k in range(max(map(len, grid)))]
        want = "\n".join(" | ".join(c.ljust(wide[k]) for k, c in enumerate(r)).rstrip() for r in grid)
        assert render("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in grid) + "</table>")[1] == want


def test_nested_lists_against_a_plain_reading():
    rng = random.Random(7)

    def page(depth):
        """(html, lines) of a list."""
        html, lines = "<ul>", []
        for k in range(rng.randrange(1, 4)):
            html += f"<li>i{k}"
            lines.append(f"- i{k}")
            if depth and rng.random() < 0.5:
                inner, below = page(depth - 1)
                html += inner
                lines += ["", *("  " + x if x else "" for x in below)]
        return html + "</ul>", lines

    for _ in range(40):
        html, lines = page(3)
        assert render(html)[1] == "\n".join(lines)


def test_a_table_that_would_be_mostly_blanks():
    rows = "".join(f"<tr><td>{'w' * 5000}<td>a" if not k % 300 else "<tr><td>b<td>c" for k in range(3000))
    text = render(f"<table>{rows}</table>")[1]
    assert len(text) < 100_000 and text.split("\n")[1] == "b | c" and text.count("| a") == 10


def test_titles():
    assert render("<head><title> A &amp;\n B </title>")[0] == "A & B"
    assert render("<p>x")[0] is None and render(None)[0] is None


def test_deep_and_long_pages():
    assert render("<div>" * 50_000 + "in")[1] == "in"
    assert render("<b>" * 3000 + "x" + "<ul><li>" * 700 + "y")[1].endswith("y")
    assert render("<p>" + "word " * 200_000)[1] == ("word " * 200_000).strip()
    assert render("<" * 200_000)[1] == "<" * 200_000
    assert render("<a '" * 30_000 + "x")[1] == ""
    assert render("<!--" * 50_000)[1] == "" and len(render("</" * 50_000)[1]) >= 0


class Plain(HTMLParser):
    """All visible text, by the standard library's parser, without layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "title"):
            self.off += 1
        elif tag in ("p", "br", "li", "div", "h1", "ul", "nav", "article", "footer", "body"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "title"):
            self.off -= 1
        elif tag in ("p", "li", "div", "h1", "ul", "nav", "article", "footer"):
            self.out.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def plain_words(html):
    p = Plain()
    p.feed(html or "")
    return re.split("[ \t\n\r\f]+", "".join(p.out).strip(" \t\n\r\f"))


def test_no_visible_word_is_lost(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op9_html_layout(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        words = re.split("[ \t\n\r\f]+", re.sub("^ *- ", "", r.text, flags=re.M).strip(" \t\n\r\f"))
        assert words == plain_words(pages[r.page_id]), r.page_id


def test_messy_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, None, ""), (3, "u", "<td>x</td><li>y")]
    df = spark.createDataFrame([(*r, "extra", "t") for r in rows], "page_id bigint, url string, html string, text string, title string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, None, "a"), (1, None, "a"), (None, None, ""), (2, None, ""), (3, None, "x\n- y")], key=str)
    assert extract(df.limit(0)).collect() == []
