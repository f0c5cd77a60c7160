import time

import pytest

from mixtally.llm.main_text import Page, decided, extract, inherited, main_text

RUNNING = "The people of the town said that it was the best of all the days that they had seen in the year."
MENU = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'


def test_blocks_of_a_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{MENU}<div class="cookie-banner">We use cookies for all of the things that we do on this site, and you are asked to agree to them.</div>
    <div id="page" class="has-sidebar"><article><header class="entry-header"><h1>A &amp; B</h1><p>By X on the first day of the month of may, in the year of the great flood and of the fire</p></header>
    <p>{RUNNING}<br>Then&nbsp;more &#8211; x &lt; y.<p>Short one.</p><script>var t="</p>";</script><ul><li>first<li>second</ul>
    <div class="ad-box">{RUNNING}</div><p>{RUNNING} <a href="/x">a link</a></p><aside>{RUNNING}</aside><form><label>{RUNNING}</label></form></article>
    <section id="comments"><article class="comment"><p>{RUNNING}</p></article></section></div><div class="sidebar"><p>{RUNNING}</p></div><footer>&copy; {RUNNING}</footer></body></html>"""
    assert main_text(page).split("\n\n") == ["A & B", f"{RUNNING} Then more – x < y.", "Short one.", "first", "second", RUNNING + " a link"]


def test_without_an_article_neighbours_decide():
    links = "".join(f'<div><a href="/{i}">Topic {i}</a></div>' for i in range(4))
    page = f"<body><div>{links}</div><div>A word by links</div>{links}<h2>Heading</h2><div>{RUNNING}</div><div>Ok.</div><div>{RUNNING}</div>{links}<div>Last</div></body>"
    assert main_text(page).split("\n\n") == ["Heading", RUNNING, "Ok.", RUNNING]


@pytest.mark.parametrize(
    "page",
    [
        # Wrappers whose class speaks of what stands beside the text.
        "<div class='layout content-with-sidebar'><h1>T</h1><p>{0}</p><p>Ok.</p></div><div class=sidebar><p>{0}</p></div>",
        "<div class='sidebar-right'><div><h1>T</h1><p>{0}</p><p>Ok.</p></div><div class='widget'><p>{0}</p></div></div>",
        "<body class='no-comments single ad-free'><div><h1>T</h1><p>{0}</p><p>Ok.</p></div></body>",
        # Notices, adverts, comments and forms of several makes.
        "<div role=alertdialog><p>{0}</p></div><main><h1>T</h1><p>{0}</p><p>Ok.</p><div id='respond'><p>{0}</p></div></main><div class='adsbygoogle'>{0}</div>",
        "<div class='site-header'><p>{0}</p></div><article><h1>T</h1><p>{0}</p><p>Ok.</p><section class='reader-comments'><article><p>{0}</p></article></section><form><p>{0}</p></form></article>",
        "<main><article><header><h1>T</h1><p>{0}</p></header><p>{0}</p><p>Ok.</p><footer><p>{0}</p></footer></article><section class='related-posts'><h2>More</h2><p>{0}</p></section></main>",
        "<table><tr><td class='nav'><a href=/>Home</a> {0}<td><h1>T</h1><p>{0}</p><p>Ok.</p></table><div class='page-footer'>{0}</div>",
    ],
)
def test_pages_of_many_makes(page):
    assert main_text("<html><body>" + MENU + page.format(RUNNING) + "</body></html>").split("\n\n") == ["T", RUNNING, "Ok."]


def test_labels():
    assert inherited([0, 1, 0, 0, -1, 0]) == [1, 1, 1, -1, -1, -1]
    assert inherited([1, 0, -1]) == [1, 1, -1] and inherited([0, 0]) == [1, 1] and inherited([]) == []
    assert decided("a b", ["a", "b"], 2, frozenset()) == -1 and decided("a b", ["a", "b"], 0, frozenset()) == 0
    assert decided("x" * 80, ["x" * 80], 0, None) == 1 and decided("x" * 80, ["x" * 80], 0, frozenset("a")) == 0


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<p>a <!-- b", "a"), ("<p>a<script>b", "a"), ("<p>a<", "a<"), ("<p>a<b", "a"), ("<p>1 < 2 &am &amp c", "1 < 2 &am & c"),
        ("<p title='a>b'>x</p>", "x"), ("<p hidden>x</p>y", "y"), ("<div style='display: none'>x</div>y", "y"), ("a<br>b<br><br>c", "a b\n\nc"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("a</p></div>b", "a\n\nb"),
        ("<p>a<noscript><p>b</p></noscript>c", "a\n\nc"), ("<svg/><p>x", "x"), ("<form><article><p>x</article></form>", "x"), ("<h1 class=header>x</h1>", "x"), ("<P>A</P><SCRIPT>b</SCRIPT>", "A"),
    ],
)
def test_odd_markup(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part", ["<p>", "<b>", "<div>", "</div>", "<!--", "<script>", '<a href="x', "<a ='", "<a>", "<", "&", "<div class='a ", "<td>", "x "])
def test_time_is_linear(part):
    def seconds(n):
        began = time.perf_counter()
        main_text(part * n)
        return time.perf_counter() - began

    assert seconds(80_000) < 0.2 + 16 * max(seconds(10_000), 0.01)


def test_every_text_is_in_a_block_once():
    page = Page("<div>a<p>b<b>c</b></div>d<ul><li>e<ul><li>f</ul>g</ul>h")
    assert page.texts == ["a", "bc", "d", "e", "f", "g", "h"]


def test_rows(spark):
    rows = [(1, "u", "<p>x</p>", 5), (1, "u", "<p>x</p>", 5), (None, None, None, 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted(extract(df).collect(), key=str) == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)], key=str)
    assert extract(df.limit(0)).collect() == []
    strange = df.selectExpr("CAST(page_id AS string) AS `a.b`", "html AS n_chars", "url")
    assert {tuple(r)[2:] for r in extract(strange, "a.b", "url", "n_chars").collect()} == {("x", 1), ("", 0)}
