"""Parsing in linear time, and the article by density where no element or several name it."""

import time

import pytest

from sitelens.llm import html_text

LONG, MORE = ("a " * 60).strip(), ("b " * 60).strip()


@pytest.mark.parametrize("page", [
    "<a '" * 250_000, "<a x='" * 160_000, '<a x=">" ' * 110_000, "<div>" * 60_000 + "</p>" * 60_000, "<div><span class=ad>" * 30_000, "<" * 1_000_000,
    "<script>" * 100_000, "<textarea>" * 100_000, "<!--" * 250_000, "<a <" * 250_000 + ">", "<p>" * 100_000, "</div>" * 150_000,
], ids=range(12))
def test_a_megabyte_of_broken_markup_takes_about_a_second(page):
    began = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - began < 5  # quadratic time would be minutes


@pytest.mark.parametrize("page, text", [
    ('<p title="it>hello', "hello"), ('<p title="a>b">c', "c"), ("<p title='>' x=\">\">c</p>", "c"), ("<p a'b>c'd", "c'd"), ("1 <2 and <b>3", "1 <2 and 3"), ("x <y and z", "x <y and z"),
    ("a<!-- b --x> c -->d", "ad"), ("a<!-- b", "a"), ("a<!doctype x>b", "ab"), ("<textarea>t</textarea>u", "u"), ("<textarea>t u", "t u"), ("<script>t u", ""), ("a</b></i>c", "ac"),
])
def test_markup(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize("page, text", [
    # No article or main element.
    (f"<body><div><ul><li><a href=x>{LONG}</a></li><li><a href=y>z</a></li></ul></div><div><div><h1>T</h1><p>{LONG}</p></div><div><p>{MORE}</p></div></div></body>", f"T\n\n{LONG}\n\n{MORE}"),
    # Several articles, of which one is short; one of links is none.
    (f"<body><article><p>{LONG * 5}</p><p>{MORE * 5}</p></article><article><p>c d</p></article><article><a href=x>other</a></article></body>", f"{LONG * 5}\n\n{MORE * 5}\n\nc d"),
    (f"<main><article><p>{LONG}</p></article><article><p>{MORE}</p></article></main>", f"{LONG}\n\n{MORE}"),
    # Subjects that sound like page parts stay, reader comments and adverts go.
    (f'<article><div class="social history"><p>{LONG}</p></div><section class="search-results-analysis"><p>{MORE}</p></section></article>', f"{LONG}\n\n{MORE}"),
    (f"<article><p>{LONG}</p><div class=comments><p>{MORE}</p><p>{MORE}</p></div><div class='ad'><p>{MORE}</p></div></article>", LONG),
    *((f'<div><div><p>{LONG}</p><p>{MORE}</p></div><div class="{c}"><p>{MORE} c</p><p>{MORE} d</p></div></div>', f"{LONG}\n\n{MORE}") for c in ("comment-list", "x comments-area", "cookie-banner", "newsletter-signup", "adContainer")),
    *((f'<div><div><p>{LONG}</p></div><div class="{c}"><p>{MORE}</p></div></div>', f"{LONG}\n\n{MORE}") for c in ("comments-on-policy", "list-section", "content-area", "box notice-text")),
])
def test_density_finds_the_article(page, text):
    assert html_text.extract(page) == text


def test_pages_of_a_table_equal_their_only_article(spark):
    """Brute force over the supplied pages, which all have one article: the blocks of what stands between its tags."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<(?!br)[^>]*>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.extract(r.html) == "\n\n".join(filter(None, blocks))


def test_null_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (1, None, "", "x"), (None, "u", "<p>a", "x"), (None, "u", "<p>a", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_text.extracted(rows).collect()) == [(0, "u", "a", 1), (0, "u", "a", 1), (1, "", "", 0), (1, "u", "", 0)]
    assert html_text.extracted(rows.limit(0)).count() == 0
