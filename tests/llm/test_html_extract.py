"""Pages that are deep, unclosed or oddly named, and columns named like the result's own."""

import time

import pytest
from pyspark.sql import functions as F

from tallyclerk.llm import html_extract

LONG = "Long text, with commas, and more. " * 20
DEEP = {
    "nested blocks with text": "<div>text, of some length here " * 50_000,
    "unclosed inline": "<b>" * 50_000 + "</i>" * 50_000,
    "items under a deep list": "<ul>" + "<div>" * 25_000 + "<li>x" * 25_000,
    "a paragraph out of scope": "<p><object>" + "<div>x" * 25_000,
    "nested inline in a paragraph": "<p>" + "<span>a" * 50_000 + "<div>b",
    "nested fieldsets": "<fieldset>" * 25_000 + "<input>" * 25_000,
    "paragraphs": "<p>x</p>" * 50_000,
}


@pytest.mark.parametrize("name", DEEP)
def test_time_is_linear(name):
    html_extract.main_text(DEEP[name][:5000])
    start = time.process_time()
    html_extract.main_text(DEEP[name])
    assert time.process_time() - start < 4


def test_names_do_not_end_the_contest():
    page = (
        "<body><nav><a href=x>menu</a></nav><article><p class='notice-of-intent'>First words, of the story.</p><fieldset>A box, with facts.</fieldset>"
        f"<p>{LONG}</p><fieldset><input>your name</fieldset><p class='notice'>we use cookies</p><div class='share'>share it</div></article></body>")
    got = html_extract.main_text(page)
    assert got.startswith("First words, of the story. A box, with facts. Long text")
    assert not any(x in got for x in ("menu", "your name", "cookies", "share it"))


def test_later_parts_of_one_kind_are_kept():
    page = f"<body><div class=post><p>{LONG}</p></div><div class=post>Short end, of it.</div><div class=sidebar>aside</div><div class=post><a href=x>only a link</a></div></body>"
    got = html_extract.main_text(page)
    assert got.endswith("Short end, of it.") and "aside" not in got and "only a link" not in got


def test_columns_that_clash(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 20_000 + "deep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "score")})
    got = sorted(((r.page_id, r.url, r.text) for r in html_extract.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", LONG.strip()), (1, "u", LONG.strip()), (2, None, ""), (None, "v", ""), (3, "w", "deep")], key=repr)
