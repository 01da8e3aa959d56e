"""Values worked out by hand for expressions."""

import pytest
from pyspark.sql import functions as F

from sitelens.functions import checks as C
from sitelens.functions import pages as P
from sitelens.functions import robots
from sitelens.functions.dialect import SPARK
from sitelens.operators import relational as R


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.selectExpr(f"{expr} AS x").first().x


@pytest.mark.parametrize("text, currency, amount", [("$1,299.00", "USD", 1299.0), ("US$ 5", "SGD", 5.0), ("12.5 USD", "USD", 12.5), ("none", None, None), ("$1,234,567,890.5", "USD", 1234567890.5), ("€1.299", "EUR", 1299.0), ("£1,5", "GBP", 1.5), ("$" + "1" * 200, None, None), ("CA$ 5", "AUD", 5.0)])
def test_price(spark, text, currency, amount):
    price = P.price(SPARK, "c", P.priced(SPARK, "c"))
    assert one(spark, price["currency"], c=text) == currency
    assert one(spark, price["amount"], c=text) == amount


def test_urls(spark):
    u = P.urls(SPARK)
    assert one(spark, u["clean_url"], url="https://WWW.Example.com/") == "example.com"
    assert one(spark, u["domain_id"], url="example.com") == "a379a6f6eeafb9a5"
    assert one(spark, u["normalized"], url=" a.example/x ") == "https://a.example/x"


def test_text_survives_many_tags_in_a_script(spark):
    page = "<script>" + "<" * 100_000 + "</script><p>a &amp;lt; b</p>"
    assert one(spark, P.plain(SPARK), h=page) == "a < b"


def test_word_boundary_is_ascii(spark):
    assert one(spark, SPARK.count("t", r"(?i)\b(urgent)\b"), t="éurgent URGENT") == 2


def test_robots_allow_wins(spark):
    df = spark.createDataFrame([("User-agent: *\nDisallow: /\nAllow: /a\nDisallow:\nUser-agent: other\nDisallow: /ab", "/ab")], "c string, p string")
    r = robots.rules(F.col("c"))
    row = df.select(r.alias("r"), robots.allowed(F.col("p"), r).alias("ok")).first()
    assert row.ok and row.r.disallow == ["/"] and row.r.delay_ms is None


def test_cursor_pages_cover_all_rows_once(spark):
    df = spark.createDataFrame([(k, float(k // 3)) for k in range(25)], "id long, v double")
    seen, after = [], None
    while True:
        rows = R.cursor_page(df, "v", "id", after, 10).collect()
        seen += [r.id for r in rows]
        if not rows or not rows[0].has_more:
            break
        last = min(rows, key=lambda r: (r.v, r.id))
        after = (last.v, last.id)
    assert sorted(seen) == list(range(25))


def test_replace_and_search(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c")], "k int, v string")
    assert {tuple(r) for r in R.replace_by(old, new, "k").collect()} == {(1, "a"), (2, "c")}
    assert R.search(old, ["v"], "a").count() == 0 and R.search(old, ["v"], "A", least=1).count() == 1


@pytest.mark.parametrize("href, found", [
    ("/a#b", "https://h.example/a"), ("//c.example/x", "https://c.example/x"), ("HTTP://d.example", "HTTP://d.example"), ("?p=2", "https://h.example/en/page?p=2"),
    ("next", "https://h.example/en/next"), ("", None), ("#top", None), ("mailto:a@b.c", None), ("javascript:void(0)", None), (None, None),
])
def test_links_are_resolved(spark, href, found):
    df = spark.createDataFrame([(href, "https://h.example/en/page?q=1#z")], "href string, url string")
    assert df.selectExpr(C.resolved(SPARK, "href") + " AS x").first().x == found


@pytest.mark.parametrize("host, of, inside", [("a.example", "a.example", True), ("b.a.example", "a.example", True), ("ba.example", "a.example", False), ("a.example", "b.a.example", False)])
def test_scope(spark, host, of, inside):
    assert one(spark, C.in_scope("h", "o"), h=host, o=of) is inside


def test_challenge_titles_come_first(spark):
    assert one(spark, C.challenge(SPARK), title="Just a Moment", h="captcha") == "challenge_title:just a moment"
    assert one(spark, C.challenge(SPARK), title="Shop", h="a CAPTCHA") == "challenge_body:captcha"
    assert one(spark, C.challenge(SPARK), title="Shop", h="wares") is None
