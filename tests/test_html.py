"""Pages whose elements nest, stay open or cross."""

from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postloom.sources.html import extract_links, extract_pages
from postloom.sources.markup import elements, select, visible


def texts(page, *path):
    found = elements(page)
    return [visible(page, e, found).strip() for e in select(found, list(path))]


@pytest.mark.parametrize(
    "page,path,want",
    [
        ("<div data-testid=x><div>one</div><div>two</div></div><div>three</div>", ["div"], ["one\n\ntwo", "one", "two", "three"]),
        ("<div data-testid=x><div>one</div><div>two</div></div><div>three</div>", [("*", "data-testid", "x")], ["one\n\ntwo"]),
        ('<p id="a"><p id="b">b<div>c</div>', ["p"], ["", "b"]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e", ["li"], ["a\n\nb\nc", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["td"], ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["tr"], ["ab", "c"]),
        ("<b><div>one</b>two</div>three", ["div"], ["onetwo"]),
        ("<b><div>one</b>two</div>three", ["b"], ["one"]),
        ("<div>a<br>b<img src=x>c<hr/>d</div>", ["div"], ["a\nbcd"]),
        ("<div>open <span>ends</div> never", ["span"], ["ends"]),
        ("<section>to the <i>end", ["section"], ["to the end"]),
        ("</div><div>x</div></div>", ["div"], ["x"]),
        ("<div title='a > b'>x</div>", [("div", "title", "a > b")], ["x"]),
        ("<div title=\"it's>x</div>", ["div"], ["x"]),
        ("<DIV Data-X = 'q&amp;r'>x</Div>", [("*", "data-x", "q&r")], ["x"]),
        ("<div><!-- <div> --><script>if (a < b) '</div>'</script>x</div>y", ["div"], ["x"]),
        ("<title>a<b></title><b>c</b>", ["title"], ["a"]),
        ("<div>&eacute;&#8217;&#x27;&amp;lt;&nbsp;&copy;&unknown; &lt;b&gt;</div>", ["div"], ["é’'&lt; ©&unknown; <b>"]),
        ("<div a=1 a=2>x</div>", [("*", "a", "2")], []),
        ("<main><p class=c>x</p></main><p class=c>y</p>", ["main", ("p", "class", "c")], ["x"]),
        ("<div><div><p>x</p></div><p>y</p></div>", ["div", "div", "p"], ["x"]),
        ("", ["div"], []),
        ("no markup < at > all", ["div"], []),
    ],
)
def test_elements(page, path, want):
    assert texts(page, *path) == want


PIECES = st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<b>", "</b>", "<br>", "<td>", "<tr>", "<table>", "</table>", "<a href=x>", "</a>", "text ", "<!-- c -->", "<", ">", "&amp;", "<script>", "</script>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_any_page_gives_elements_that_fit_into_it(page):
    found = elements(page)
    assert all(0 <= e.open <= e.start <= e.end <= e.stop <= len(page) or e.end == e.stop == e.start for e in found)
    assert [e.open for e in found] == sorted(e.open for e in found)
    for e in found:
        visible(page, e, found)


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words = []

    def handle_data(self, data):
        self.words += data.split()


@st.composite
def well_formed(draw, depth=0):
    name = draw(st.sampled_from(["div", "section", "span", "article"]))
    inner = draw(st.lists(st.sampled_from(["one", "two &lt; three", "é &amp; ü"]) | (well_formed(depth + 1) if depth < 4 else st.just("leaf")), max_size=3))
    return f"<{name} class='c{depth}'>{' '.join(inner)}</{name}>"


@settings(max_examples=150, deadline=None)
@given(well_formed())
def test_same_words_as_a_parser(page):
    parser = Words()
    parser.feed(page)
    (whole,) = texts(page, ("*", "class", "c0"))
    assert whole.split() == parser.words


def test_fields_and_links(spark):
    page = "<h1>T &mdash; 1</h1><article>a<nav>menu<div>x</div></nav>b<div class='ad'>buy<div>now</div></div><p>c</article><li> - One.<li>one"
    rows = [(1, page, "u"), (2, None, None), (3, "", "v"), (4, "<li>x" * 3 + "<a href=' /a?b=1&amp;c '>l</a><a href>m</a><a name=q>n</a><a href='/a?b=1&amp;c'>o</a>", "w")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, html string, url string, title string")
    got = {r.page_id: (r.Title, r.Description, r.Qualifications, r.Link) for r in extract_pages(df).collect()}
    assert got == {1: ("T — 1", "ab\nc", ["One"], "u"), 2: (None, None, [], None), 3: ("", "", [], "v"), 4: ("", "", ["x", "xlmno"], "w")}
    links = extract_links(df, "https://s.example/p/")
    assert [(r.page_id, r.pos, r.link) for r in links.collect()] == [(4, 0, "https://s.example/a?b=1&c")]
    assert extract_pages(df.limit(0)).count() == 0


def test_long_page_is_read_in_one_pass(spark):
    page = "<div>" * 3000 + "x" + "</div>" * 3000 + "<b>" * 2000 + "<p>y" * 20_000
    found = elements(page)
    assert len(found) == 3000 + 2000 + 20_000 and len(select(found, ["div", "div", "div"])) == 2998


def test_pages_reach_a_worker_some_at_a_time(spark, capsys):
    rows = spark.createDataFrame([(1, "u", "<h1>a</h1><article>b</article>"), (2, "u", None)], "page_id bigint, url string, html string")
    for out in (extract_pages(rows), extract_links(rows, "https://x.org/")):
        out.explain()
        plan = capsys.readouterr().out
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    got = {r.page_id: (r.Title, r.Description, r.Qualifications) for r in extract_pages(rows).collect()}
    assert got == {1: ("a", "b", []), 2: (None, None, [])}
