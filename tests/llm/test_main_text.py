"""Main text of pages: planted pages, the article elements of the tables, and edge cases."""

import html
import re

import pytest

from cadencia.llm import main_text as mt

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tree(spark):
    return mt.learn(spark)


def test_tree_fits_its_table(tree):
    assert [mt.is_main(tree, x) for _, x in mt.labelled()] == [bool(y) for y, _ in mt.labelled()]


def article(page):
    """The article element's text by another way: its blocks are paragraphs and headings."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h\d)>", inner.group(1)) if inner else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_pages_of_the_table(spark, tree):
    rows = mt.extract(spark.read.parquet(f"{SF}/pages.parquet"), tree=tree).collect()
    assert rows and all(r.text == article(r.html) for r in rows)


TEXT = "The river rose again in the night and the lower fields were under water by the time the sun came up."
BOILER = "This is something that has nothing to do with the story but is as long as any paragraph of it could be."


@pytest.mark.parametrize(
    "box",
    [
        f"<nav><p>{BOILER}</p></nav>",
        f"<header><div>{BOILER}</div></header>",
        f"<footer>{BOILER}</footer>",
        f"<aside><p>{BOILER}</p></aside>",
        f'<div class="cookie-banner"><p>{BOILER}</p></div>',
        f'<div id="siteNotice">{BOILER}</div>',
        f"<div class='ad'>{BOILER}</div>",
        f"<form><p>{BOILER}</p><select><option>{BOILER}</select></form>",
        f"<script>document.write('<p>{BOILER}</p>')</script>",
        f"<style>p:before{{content:'{BOILER}'}}</style>",
        f"<!-- <p>{BOILER}</p> -->",
        f'<section class="comments"><h3>2 comments</h3><article class="comment"><p>{BOILER}</p></article></section>',
        f"<div style='display: none'>{BOILER}</div>",
        "<ul><li><a href='/1'>One of the links</a></li><li><a href='/2'>Another of the links</a></li></ul>",
    ],
)
@pytest.mark.parametrize("holder", ["article", "main", "div"])
def test_boxes_are_left_out(tree, box, holder):
    page = f"<html><head><title>Some title</title></head><body><{holder}><h1>Floods</h1><p>{TEXT}</p><p>{TEXT}</p></{holder}>{box}</body></html>"
    assert mt.main_text(tree, page) == f"Floods\n\n{TEXT}\n\n{TEXT}"
    if holder != "div" and "<ul>" not in box and "<header>" not in box:
        inside = f"<body><{holder}><h1>Floods</h1><p>{TEXT}</p>{box}<p>Ends.</p></{holder}></body>"
        assert mt.main_text(tree, inside) == f"Floods\n\n{TEXT}\n\nEnds."


def test_references_spaces_and_markup(tree):
    page = f"<article><p>{TEXT} Fish &amp; chips,\n\t caf&#233;&nbsp;&lt;b&gt;<b>bo</b>ld<br>next 1 < 2</p><P CLASS=x>{TEXT}</P></article>"
    assert mt.main_text(tree, page) == f"{TEXT} Fish & chips, café <b>bold next 1 < 2\n\n{TEXT}"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<html></html>", "<!--", "<script>x", '<a href="', "</div>" * 5, "&"])
def test_nothing_to_find(tree, page):
    assert mt.main_text(tree, page) == ""


def test_broken_and_deep_pages(tree):
    assert mt.main_text(tree, f'<div class="ad">Buy<article><p>{TEXT}</p></article>') == TEXT
    assert mt.main_text(tree, f"<article><p>{TEXT}<p>{TEXT}</b></i></section><foot") == f"{TEXT}\n\n{TEXT}"
    assert mt.main_text(tree, "<div>" * 200_000 + f"<p>{TEXT} {TEXT}" + "</div>" * 200_000) == f"{TEXT} {TEXT}"
    long = "word " * 400_000
    assert mt.main_text(tree, f"<article><p>{long}</p></article>") == long.strip()


def test_rows_and_extra_columns(spark, tree):
    page = f"<article><p>{TEXT}</p></article>"
    rows = [(1, page, "old"), (1, page, "old"), (2, None, None), (None, "", "x")]
    got = mt.extract(spark.createDataFrame(rows, "page_id long, html string, text string"), tree=tree)
    assert got.columns == ["page_id", "html", "text"]
    assert sorted(((r.page_id, r.text) for r in got.collect()), key=repr) == [(1, TEXT), (1, TEXT), (2, ""), (None, "")]
    assert mt.extract(got.where("page_id > 5"), tree=tree).collect() == []
