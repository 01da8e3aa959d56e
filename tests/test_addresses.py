"""Addresses in full: cases worked out by the rules of browsers, and some hundred pairs against the reader of elements."""

import itertools

import pytest
from pyspark.sql import functions as F

from sitelens.functions import addresses, dom

BASE = "https://Shop.Example:443/en/items/list.html?page=2#top"
CASES = [
    ("a.html", "https://shop.example/en/items/a.html"), ("./a", "https://shop.example/en/items/a"), ("../a", "https://shop.example/en/a"), ("../../../../a", "https://shop.example/a"), ("..", "https://shop.example/en/"), (".", "https://shop.example/en/items/"),
    ("a/./b/../c", "https://shop.example/en/items/a/c"), ("/x/../y/", "https://shop.example/y/"), ("/%2e%2E/y", "https://shop.example/y"), ("a//b", "https://shop.example/en/items/a//b"), ("?q=1", "https://shop.example/en/items/list.html?q=1"), ("#x", "https://shop.example/en/items/list.html?page=2#x"),
    ("", "https://shop.example/en/items/list.html?page=2"), ("//Other.Example/p", "https://other.example/p"), ("http://Other.Example:80/a/../b?x#y", "http://other.example/b?x#y"), ("HTTP://other.example", "http://other.example/"), ("https://u:p@other.example:8443/", "https://other.example:8443/"),
    ("https:page", "https://shop.example/en/items/page"), ("http:other.example/p", "http://other.example/p"), ("\\x\\y", "https://shop.example/x/y"), (" \n/a b\t ", "https://shop.example/a%20b"), ("/é?ü='<>", "https://shop.example/%C3%A9?%C3%BC=%27%3C%3E"), ("/\U0001f600", "https://shop.example/%F0%9F%98%80"),
    ("/a{b}`\"|^", "https://shop.example/a%7Bb%7D%60%22|^"), ("/100%/%41", "https://shop.example/100%/%41"), ("http://other.example:0080/", "http://other.example/"), ("http://[::1]:81/", "http://[::1]:81/"), ("a:b", None), ("mailto:a@b.example", None), ("javascript:x", None), ("http://", None), ("https://a b.example/", None),
    ("http://other.example:99999/", None), ("http://other.example:x/", None), ("/a:b", "https://shop.example/a:b"), ("./a:b", "https://shop.example/en/items/a:b"), ("?", "https://shop.example/en/items/list.html"), ("#", "https://shop.example/en/items/list.html?page=2"), (None, None),
]


def all_resolved(spark, pairs):
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, link string, base string")
    return [r.x for r in rows.select("k", addresses.resolved(F.col("link"), F.col("base")).alias("x")).orderBy("k").collect()]


def test_cases(spark):
    got = all_resolved(spark, [(link, BASE) for link, _ in CASES])
    assert [(c[0], x) for c, x in zip(CASES, got)] == CASES


def test_as_the_reader_of_elements(spark):
    """Where both follow browsers: no dots or empty segments in absolute links, none empty."""
    links = ["/a", "b", "../c?d=e", "./f#g", "/h i", "?j=k l", "#m", "//n.example/o", "http://P.example:81/q", "https://r.example:443/s?t", "mailto:u", "javascript:v", "../../../w", "x/", "y/../z", "é/ü", "tel:1", "/1'2", "/?3='4'", "5:6", "/7//8", "%20", "a+b", "/..", "./"]
    bases = ["http://a.example", "http://a.example/", "https://B.example:8080/x/y", "http://c.example:80/x/y/", "https://d.example/p?q=r", "http://u@e.example/é/", "https://f.example/a/b/c/d.html#e"]
    pairs = [p for p in itertools.product(links, bases)]
    assert len(pairs) > 150 and all_resolved(spark, pairs) == [dom.resolved(*p) for p in pairs]


@pytest.mark.parametrize("base", [None, "", "shop.example/a", "ftp://shop.example/"])
def test_bases_that_are_no_address(spark, base):
    assert all_resolved(spark, [("/a", base)]) == [None]


def test_only_expressions(spark):
    plan = spark.range(3).select(addresses.resolved(F.col("id").cast("string"), F.lit(BASE)).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
