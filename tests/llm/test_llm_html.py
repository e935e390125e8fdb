"""Main texts of pages of many shapes, of broken pages and of hostile ones."""

import time

import pytest

from corpuloom.llm import html_extract, queries, sql
from corpuloom.llm.html_extract import main_text

A = "The first paragraph of the article is long enough to count, has commas, and says something of its own."
B = "A second paragraph follows the first, and it goes on about the same matter for a while, as they do."
C = "The third and last paragraph ends the article, with a comma here, and a few more words to close it."
BODY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"{A}\n{B}\n{C}"
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>About</a></li></ul></nav>"
LONG = "Readers say many things here, at length, with commas, and none of it is a part of the article itself."

SHAPES = {
    "article": f"<html><body>{NAV}<article><h1>A title</h1>{BODY}</article><footer>&copy; someone, 2020</footer></body></html>",
    "divs": f"<body><div id=header><a href=/>Site</a></div><div class='content'><h1>A title</h1>{BODY}</div><div id='sidebar'><p>{LONG}</p></div><div class=footer>Imprint</div></body>",
    "main": f"<header><h1>The site</h1></header><main><h1>A title</h1>{BODY}</main><aside><p>{LONG}</p></aside>",
    "comments": f"<article><h1>A title</h1>{BODY}<section id='comments'><h2>Comments</h2>{'<article class=comment><p>' + LONG + '</p></article>'}</section></article>",
    "comments beside": f"<div class=post><h1>A title</h1>{BODY}</div><div class='comment-list'><div class='comment-body'><p>{LONG}</p><p>{LONG}</p></div></div>",
    "notices": f"<div class='cookie-notice'><p>{LONG}</p></div><div role=alert>{LONG}</div><article><h1>A title</h1><div class=ad>{LONG}</div>{BODY}<div class='newsletter-signup'><p>{LONG}</p></div></article>",
    "forms": f"<div class=entry-content><h1>A title</h1>{BODY}<form action=/s><label>Search, or <input name=q></label><p>{LONG}</p><button>Go</button><select><option>One<option>Two</select><textarea><p>{LONG}</textarea></form></div>",
    "scripts": f"<script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p > a {{ color: red }}</style><!-- <p>{LONG}</p> --><article><h1>A title</h1>{BODY}<script>var t = \"</p>\"</script><noscript><p>{LONG}</p></noscript></article>",
    "unclosed": f"<article><h1>A title<p>{A}<p><b>{B}<br><p>{C}</article><footer>Imprint",
    "header in the article": f"<body>{NAV}<article><header><h1>A title</h1><p>By somebody, in June</p></header>{BODY}<footer><p>{LONG}</p></footer></article>",
    "hidden": f"<article><h1>A title</h1><p hidden>{LONG}</p><div style='display: none'>{LONG}</div><span class=sr-only>Skip</span>{BODY}<p aria-hidden=true>{LONG}</p></article>",
    "layout names": f"<body class='has-sidebar no-header'><div class='content-sidebar-wrap'><div class='main-column'><h1>A title</h1>{BODY}</div><div class=sidebar><p>{LONG}</p></div></div></body>",
    "form about all": f"<body><form method=post><div class=page>{NAV}<div id=content><h1>A title</h1>{BODY}</div></div></form></body>",
    "menu without a name": f"<article><h1>A title</h1>{BODY}<ul><li><a href=/1>One thing</a></li><li><a href=/2>Another thing</a></li><li><a href=/3>A third thing</a></li></ul></article>",
    "sections": f"<div class=story><div class=part><h1>A title</h1><p>{A}</p></div><div class=ad>{LONG}</div><div class=part><p>{B}</p><p>{C}</p></div></div><div class=related><a href=/x>More</a></div>",
    "upper case": f"<BODY><NAV><A HREF=/>Home</A></NAV><ARTICLE CLASS=Story><H1>A title</H1>{BODY}</ARTICLE><SCRIPT>x</SCRIPT></BODY>",
    "inline advert": f"<article><h1>A title</h1>{BODY.replace('and it goes', '<span class=ad><span>Buy</span> now!</span>and it goes')}</article>",
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_the_article_alone_is_kept(shape):
    assert main_text(SHAPES[shape]) == "A title\n" + TEXT


def test_blocks_space_and_references():
    page = f"<article><h2>Two &amp; two&nbsp;make &#52;</h2><p>  {A}\n\n\t<i>again</i><b>and</b> &lt;again&gt;<br>&eacute;&#x1F600; </p><ul><li>one<li>two, <a href=/>linked</a></ul><table><tr><td>x<td>y</table><pre>a\n  b</pre>tail</article>"
    assert main_text(page) == f"Two & two make 4\n{A} againand <again> é😀\none\ntwo, linked\nx\ny\na b\ntail"


def test_pages_with_hardly_a_text():
    assert main_text(None) == main_text("") == main_text("   ") == main_text("<html><head><title>x</title></head><body></body></html>") == main_text("<nav>Home</nav>") == ""
    assert main_text("plain words") == "plain words"
    assert main_text("a < b and 3 <4, </ nothing>said") == "a < b and 3 <4, said"
    assert main_text("<p>x") == "x"
    assert main_text("<article><p>Short.</p></article><div>Other</div>") == "Short."
    assert main_text(f"<p>{A}</p><p>cut <a href='/x") == f"{A}\ncut"
    assert main_text(f"<p>{A}<!-- never closed <p>{B}") == A
    assert main_text(f"<p>{A}<script>never closed <p>{B}") == A


@pytest.mark.parametrize(
    "page",
    ["<div>" * 60_000 + "deep", "<div><p>" * 30_000 + "x", "<b><i>" * 60_000 + "x", "<" * 300_000, "<a '" * 90_000, '<a b="' * 70_000, "<!--" * 80_000, "<p>a</div>" * 40_000, "<span class=ad>" * 30_000 + "x" + "</span>" * 30_000,
     "<li>" * 90_000, "<td>x" * 60_000, "</section>" * 60_000, "<p>word, " * 60_000, "x" * 3_000_000, "&amp" * 300_000, "<script>" * 50_000, "<a b" + " " * 300_000, "<a " + "b = " * 90_000],
    ids=range(18),
)
def test_hostile_pages_take_time_in_proportion(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 6


def test_a_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>{A} {i}</p>" for i in range(20_000)) + "</article>"
    assert main_text(page) == "\n".join(f"{A} {i}" for i in range(20_000))


def test_rows_with_nulls_repeats_and_more_columns(spark):
    rows = [(1, "u", SHAPES["article"]), (1, "u", SHAPES["article"]), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "y" * 2_000_000)]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, id int")
    got = sorted(map(tuple, html_extract.extract(df).collect()), key=repr)
    title = "A title\n" + TEXT
    assert got == sorted([(1, "u", title, len(title))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", "y" * 2_000_000, 2_000_000)], key=repr)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(tuple, queries.op12_html(spark, sf).collect())) == sorted(c.sql(sql.OP12).fetchall())
