import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.html_text import extracted, visible_text

CASES = [
    ("<p>One<p>Two<br>three", "One\n\nTwo\nthree"),
    ("<div>a</div><div>b <b>c</b>d</div>", "a\nb cd"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>after", "- x\n- y\n  - z\n\nafter"),
    ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<table><tr><th>Name<th>N<tr><td>Ann<td>1<tr><td>Bo<td>22</table>", "Name | N\nAnn  | 1\nBo   | 22"),
    ("<table><td>a<td>b</table>", "a | b"),
    ("<table><tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3</table>", "wide |   | x\n1    | 2 | 3"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r | 1\n  | 2"),
    ("<table><caption>Cap</caption><tr><td>v</table>", "Cap\nv"),
    ("<pre>a  b\n c</pre>d", "a  b\n c\n\nd"),
    ("<script>var t='</p>';</script><style>p{}</style>ok<!-- no --><template>no</template>", "ok"),
    ("<p hidden>no</p><p style='display:none'>no</p><p STYLE=\"visibility: hidden\">no<p>yes", "yes"),
    ("<head><title>T</title></head><body>a &amp; b &lt;c&gt; &#233;", "a & b <c> é"),
    ("<blockquote>q1<p>q2</blockquote>x", "> q1\n\n> q2\n\nx"),
    ("a < b and <3", "a < b and <3"),
    ("<p>open <b>bold<p>next</b> end", "open bold\n\nnext end"),
    ("<a title='x>y'>k</a><img alt=z><input value=v>", "k"),
    ("<div><p>a</div>b</p>", "a\n\nb"),
    ("<noscript>no</noscript><textarea>no</textarea><select><option>no</select>y", "y"),
    ("", ""), ("plain   text\n\nonly", "plain text only"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_layout(source, want):
    assert visible_text(source) == want


class Words(HTMLParser):
    """All words outside scripts and styles, whatever the layout."""

    def __init__(self):
        super().__init__()
        self.words, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


PIECES = st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<br>", " one ", " two ", "<!-- c -->", "<span class='x'>", "</span>", " three", "<h1>", "</h1>", "<pre>", "</pre>"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_no_visible_word_is_lost(source):
    reader = Words()
    reader.feed(source)
    reader.close()
    got = re.findall(r"one|two|three", visible_text(source))
    assert sorted(got) == sorted(re.findall(r"one|two|three", " ".join(reader.words)))


def test_deep_and_broken_pages_end():
    assert visible_text("<div>" * 30_000 + "x") == "x"
    assert "x" in visible_text("<table><tr><td>" * 200 + "x")
    assert visible_text("<a href=\"" * 5_000 + "t") is not None
    assert visible_text("<p" * 20_000) is not None
    assert len(visible_text("<p>word</p>" * 20_000).split()) == 20_000


def test_query(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b", "x"), (2, None, None, "y"), (None, "u", "", "z"), (1, "u", "<p>a<p>b", "x")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["url"], r["text"], r["n_lines"]) for r in extracted(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "a\n\nb", 3), (2, None, "", 0), (None, "u", "", 0), (1, "u", "a\n\nb", 3)], key=str)
    assert extracted(pages.limit(0)).collect() == []


@pytest.mark.parametrize(("source", "want"), [
    ("<p class=\"nav hidden md:block\">a<p title='the hidden cost of war'>b<p data-style=\"display:none\">c<p data-hidden>d", "a\n\nb\n\nc\n\nd"),
    ("<a href=\"x?style=display:none\">e</a><i title='style=\"display:none\"'>f</i>", "ef"),
    ("<p class=x hidden>no<p HIDDEN=''>no<p hidden=until-found>yes<p class='a' style='color:red; DISPLAY : none !important'>no<p style=visibility:hidden>no<p style='x-display:none'>too", "yes\n\ntoo"),
    ("E <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> F", "E x=2 F"),
    ("<p>see <svg><title>no</title><defs><text>no</text></defs><circle r=1 /><text>one</text><text>two</text></svg> end", "see\none\ntwo\nend"),
])
def test_only_attributes_of_their_own_hide(source, want):
    assert visible_text(source) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.lists(st.text("abcdefghij", min_size=1, max_size=20), min_size=1, max_size=30), min_size=3, max_size=3), min_size=1, max_size=5))
def test_cells_of_tables_are_aligned(rows):
    """Columns start at one place in every line, and each cell's words stand in its column in order."""
    source = "<table>" + "".join("<tr>" + "".join(f"<td data-colspan=3>{' '.join(cell)}" for cell in row) for row in rows) + "</table>"
    lines = visible_text(source).split("\n")
    bars = sorted({m.start() for line in lines for m in re.finditer(r"(?<= )\|(?= |$)", line)})
    assert len(bars) == 2
    columns = [[line[: bars[0]], line[bars[0] + 1 : bars[1]], line[bars[1] + 1 :]] for line in lines]
    for i in range(3):
        assert [w for line in columns for w in line[i].split()] == [w for row in rows for w in row[i]]


def test_wide_cells():
    long, address = " ".join(["word"] * 60), "http://" + "a" * 300
    text = visible_text(f"<table><tr><td>{long}<td>x<tr><td>{address}<td>y<tr><td colspan=1001>z<td rowspan='2'>r</table>")
    assert text.split().count("word") == 60 and address in text
    assert [line.index("|") for line in text.split("\n") if " | x" in line or (" | " in line and "http" not in line)] == [100] * 2
    assert visible_text("<table><tr><td>" * 40 + "in" + "</table>" * 40) == "in"
