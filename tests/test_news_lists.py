"""Lists of news in HTML, read by rules."""

from __future__ import annotations

import pytest

from wayline.sources.news_lists import FIELDS, Page, items, list_items, path

CARDS = """<html><body><ul class="menu"><li>Home</li></ul>
<div class="list"><div class="card big"><h3><a href="/a?x=1&amp;y=2" title="First &lt;one&gt;">Line  <b>5</b>&nbsp;closed</a></h3><div class="date">1.03.2024</div><p class="lead">Some<br>text<script>var x = "<p>";</script>
<div class="card"><h3><a href=b>Second</a></h3></div></div>
<div class="card"><h3></h3><div class="date">no title</div></div>
<DIV CLASS='card'><H3><A HREF="/c">Third</A></H3><p>not the lead<p class="lead">the lead</div></div>"""


def rule(**paths):
    return {f: path(paths[f]) if f in paths else None for f in ["item", *FIELDS]}


def test_items_of_cards():
    got = items(CARDS, rule(item="div.list div.card", title="h3 a", date=".date", link="h3 a@href", lead="p.lead"))
    assert got[0] == {"title": "Line 5 closed", "date": "1.03.2024", "link": "/a?x=1&y=2", "lead": "Some text Second"}
    assert got[1] == {"title": "Third", "date": None, "link": "/c", "lead": "the lead"}
    assert len(got) == 2, "a card inside a card is part of it, one without a title is none"


def test_attributes_of_the_item_and_lists():
    html = "<ul><li data-id=1 class='news__item'>one<li data-id=2 class='news__item x'>two<ul><li>inner</li></ul></ul><table><tr><td>a<td>b<tr><td>c</table>"
    assert [(x["title"], x["link"]) for x in items(html, rule(item="li.news__item", title="*", link="@data-id"))] == [("inner", "2")]
    assert [x["title"] for x in items(html, rule(item="tr", title="td"))] == ["a", "c"]
    page = Page(html)
    assert [page.text(i) for i, n in enumerate(page.nodes) if n.tag in ("li", "td")] == ["one", "two inner", "inner", "a", "b", "c"]


@pytest.mark.parametrize("text", ["", "div..x", "a b[c]", " "])
def test_no_paths(text):
    with pytest.raises(ValueError, match="path"):
        path(text)


def test_many_sources_one_reader(spark):
    rules = spark.createDataFrame([("a", "div.card", "h3", ".date", "a@href", None), ("b", "#news p", "*", None, None, None)], "source string, item string, title string, date string, link string, lead string")
    pages = spark.createDataFrame([(1, "a", CARDS), (2, "b", "<div id=news><p><i>x</i> y<p><b>z</b></div><p><i>out</i>"), (3, "c", CARDS), (4, "a", None), (5, "a", "")], "page long, source string, html string")
    got = sorted((r["page"], r["n"], r["title"], r["date"], r["link"]) for r in list_items(pages, rules).collect())
    assert got == [(1, 0, "Line 5 closed", "1.03.2024", "/a?x=1&y=2"), (1, 1, "Third", None, "/c"), (2, 0, "x", None, None), (2, 1, "z", None, None)]


def test_sql_reads_references_without_semicolon(spark, tmp_path):
    """Texts cut off within a reference: the query and its SQL say the same."""
    import duckdb

    from wayline import registry

    registry.load()
    html = "<html><article><h1>A &amp; B &amp</h1><p>x &lt &#39 y &quot;z&nbsp</p></article></html>"
    spark.createDataFrame([(1, html)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = registry.QUERIES["news_in_pages"](spark, str(tmp_path)).select("title", "lead").collect()
    assert [tuple(r) for r in got] == con.execute(f"SELECT title, lead FROM ({registry.ORACLES['news_in_pages']})").fetchall() == [("A & B &", "x < ' y \"z")]
