"""Links, policies and products of pages made by hand; what is expected is worked out from the rules, not by code."""

import time

import duckdb
import pytest

from sitelens.functions import dom
from sitelens.plans import dom_queries as D

SHOP = "https://www.shop.example/home?x=1"


@pytest.mark.parametrize("href, address, product", [
    ("/a/../b/./c#f", "https://www.shop.example/b/c", "https://www.shop.example/b/c"), ("//CDN.example:443/x", "https://cdn.example/x", "https://cdn.example/x"), ("?v=2&id=7&sku=%20a", "https://www.shop.example/home?v=2&id=7&sku=%20a", "https://www.shop.example/home?id=7&sku=+a"),
    ("/café x", "https://www.shop.example/caf%C3%A9%20x", "https://www.shop.example/caf%C3%A9%20x"), ("mailto:a@b.c", "mailto:a@b.c", None), ("#", "https://www.shop.example/home?x=1", None), ("http://[bad", "http://[bad", None), ("", "https://www.shop.example/home?x=1", None),
])
def test_addresses(href, address, product):
    assert dom.page_address(href, SHOP) == address
    assert dom.product_address(href, SHOP) == product


PAGE = """<html><head><title> My  Shop </title><script type="application/ld+json">{"@graph": [{"telephone": "+1 555", "email": "a@shop.example",
 "address": {"streetAddress": "1 Road", "addressLocality": "Town", "postalCode": "9"}, "sameAs": ["https://x.com/shop", 5]}, {"contactPoint": {"telephone": "+2"}}]}</script></head><body>
<nav><a href="/products/in-nav">Nav</a></nav>
<ul>
 <li class="product"><a href="/products/red-shoe?variant=3"><img src="/red.png" alt="Shoe picture"></a><h3>Red shoe</h3><span class="price"><del>$50.00</del> <ins>$39.50</ins></span></li>
 <li class="product"><a href="/products/red-shoe">Again</a></li>
 <li class="product"><a href="/products/hat">Sale</a><div class="product-title">Sale</div><p class="name">Straw hat</p><span>EUR 1,299.50</span></li>
</ul>
<div class="product-card"><a href="/x/thing">Thing one</a><b data-price="12" class="cost">US$ 0</b></div>
<section><section><section><section><section><section><p><a href="/blog/post">Blog</a> <a href="https://other.example/products/y">Other</a> <a href="/plain">Plain</a></p>
<div>Read our privacy policy <a href="/legal-notes">here</a></div></section></section></section></section></section></section>
<footer><a href="/imprint">Imprint</a><a href="/privacy" title="GDPR">P</a><a href="/returns-policy">Returns &amp; Exchange</a><a href="https://help.shop.example/terms">T</a></footer>
</body></html>"""


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("shop")
    spark.createDataFrame([(1, SHOP, PAGE), (2, SHOP, None), (3, None, "<a href='/products/z'>Zed</a>")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, "https://www.shop.example/privacy", 200, "text/html", "https://www.shop.example/privacy", "<title>Ours</title><body>How we treat personal data", None), (1, "https://www.shop.example/returns-policy", 403, "text/html", "https://www.shop.example/returns-policy", "", None),
                           (1, "https://help.shop.example/terms", 200, "text/html", "https://evil.example/terms", "<body>terms of use", None), (1, "https://www.shop.example/terms", 200, None, "https://www.shop.example/terms", "<body><h2>Rules</h2> terms of use", None)],
                          "page_id long, url string, status_code int, content_type string, final_url string, body string, rendered string").write.parquet(f"{path}/policy_fetches.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/renders.parquet")
    return str(path)


def test_policy_candidates(spark, shop):
    rows = {(r.policy, r.method, r.n): (r.address, r.rank) for r in D.policy_candidates(spark, shop).collect()}
    base = "https://www.shop.example"
    # Every link of the footer is a candidate of each policy; words add 100, addresses 50.
    assert rows["privacy", "homepage_html", 1] == (f"{base}/privacy", 170) and rows["privacy", "homepage_html", 2] == (f"{base}/imprint", 20)
    assert rows["refund", "homepage_html", 1] == (f"{base}/returns-policy", 170)
    assert rows["terms", "homepage_html", 1] == ("https://help.shop.example/terms", 70)
    assert [rows["terms", "common_paths", n] for n in (1, 2, 3)] == [(f"{base}/terms", 100), (f"{base}/terms-of-service", 90), (f"{base}/terms-and-conditions", 80)]
    assert rows["privacy", "keyword_proximity", 1] == (f"{base}/legal-notes", 40)
    assert max(n for _, _, n in rows) == 3


def test_policies_are_verified_in_turn(spark, shop):
    rows = {r.policy: r for r in D.policy_cascade(spark, shop).collect()}
    assert (rows["privacy"].method, rows["privacy"].note, rows["privacy"].title) == ("homepage_html", "Content contains policy keywords", "Ours")
    # Blocked, but found in the page itself with words and an address that say so.
    assert rows["refund"].note == "Bot protection (HTTP 403), browser verification failed, but verified via homepage_html with anchor text"
    # The footer's own link leads off the site; the next of the footer is taken, as its address sounds like a policy's.
    assert (rows["terms"].method, rows["terms"].url, rows["terms"].note) == ("homepage_html", "https://www.shop.example/privacy", "Content does not contain expected policy keywords")
    tried = {(r.policy, r.address): (r.verified, r.note) for r in D.policy_verification(spark, shop).filter("page_id = 1").collect()}
    assert tried["terms", "https://help.shop.example/terms"] == (False, "Redirected out of scope to https://evil.example/terms")
    assert tried["terms", "https://www.shop.example/terms"] == (True, "Content contains policy keywords")
    assert tried["privacy", "https://www.shop.example/imprint"] == (False, "Fetch error")
    notes = {r.page_id: r.notes for r in D.policy_summary(spark, shop).collect()}
    # Page 2 has the common paths only, whose fetches are missing; page 3 has no address.
    assert notes == {1: None, 2: "Missing: privacy, refund, terms", 3: "Missing: privacy, refund, terms"}


def test_products(spark, shop):
    rows = {r.path: r for r in D.sku_extract(spark, shop).collect()}
    assert set(rows) == {"/products/red-shoe", "/products/hat", "/x/thing"}
    shoe, hat, thing = rows["/products/red-shoe"], rows["/products/hat"], rows["/x/thing"]
    assert (shoe.product_url, shoe.title, shoe.currency, shoe.amount, shoe.original_amount, shoe.on_sale, shoe.image) == ("https://www.shop.example/products/red-shoe", "Red shoe", "USD", 39.5, 50.0, True, "https://www.shop.example/red.png")
    assert (shoe.confidence, hat.confidence, thing.confidence) == (95, 85, 50)
    # A badge is no title; a comma before three digits separates thousands.
    assert (hat.title, hat.currency, hat.amount, hat.on_sale, hat.image) == ("Straw hat", "EUR", 1299.5, False, None)
    # No product's address, but a title and a price; `S$` comes before `$`, and an amount of nothing counts as none.
    assert (thing.title, thing.price_text, thing.currency, thing.amount) == ("Thing one", "S$ 0", "SGD", None)
    assert [r.path for r in sorted(rows.values(), key=lambda r: r.n)] == ["/products/red-shoe", "/products/hat", "/x/thing"]


def test_notes_of_what_was_left_out(spark, shop):
    rows = {r.page_id: r for r in D.sku_summary(spark, shop).collect()}
    one = rows[1]
    assert (one.n, one.with_price, one.with_title, one.with_image, one.top_currency) == (3, 3, 3, 1, "USD")
    assert one.notes == "Scanned 13 links|Skipped 5 navigation/footer links|Skipped 1 excluded paths|Skipped 1 duplicate URLs|Skipped 1 external domain links|Skipped 2 non-product links"
    assert (rows[2].n, rows[2].notes, rows[3].n, rows[3].notes) == (0, "", 0, "Scanned 1 links")


def test_readings(spark, shop):
    row = D.page_readings(spark, shop).filter("page_id = 1").first()
    assert row.snippet == "My  Shop"
    assert row.linked.split("\n") == ["PHONE: +1 555", "EMAIL: a@shop.example", "ADDRESS: 1 Road, Town, 9", "SOCIAL: https://x.com/shop", "PHONE: +2"]
    assert row.readable.startswith("--- Structured Data (JSON-LD) ---\nPHONE: +1 555") and "\nRed shoe" in row.readable
    assert row.body_text.startswith("Nav Red shoe$50.00 $39.50 Again")


def test_deep_and_broken_pages():
    assert len(list(dom.links("<div>" * 5000 + "<a href=/x>y" * 300, SHOP))) == 300
    assert list(dom.links(None, None)) == [] and list(dom.links("<a>x</a><a href>", SHOP))[0]["address"] == "https://www.shop.example/home?x=1"


@pytest.mark.parametrize("page", [
    "<a '" * 100_000, '<a x=">" ' * 60_000, "<div>" * 40_000 + "</p>" * 40_000, "<!--" * 100_000, "<div>privacy policy" * 20_000 + "<a href=/x>y</a>" * 3000, "<div>" * 40 + "<a href='/x'>t</a>" * 5000 + "<b class=price>1</b><img src=x>", "<script>" * 50_000,
], ids=range(7))
def test_pages_are_read_in_linear_time(page):
    began = time.perf_counter()
    list(dom.links(page, SHOP))
    assert time.perf_counter() - began < 5  # quadratic time would be minutes


def test_what_a_card_shows_grows_with_the_page_only():
    """Prices of a card of n links and n spans: as many as the page holds, not as many for each link."""
    counts = []
    for n in (100, 200, 400):
        page = "<article class=product>" + "".join(f"<a href='/products/{k}'>Item {k}</a><span>${k}.50</span>" for k in range(n)) + "</article>"
        rows = list(dom.links(page, SHOP))
        assert len(rows) == n and {r["card"] for r in rows} == {0}
        counts.append(sum(len(r["prices"]) + len(r["titles"]) for r in rows))
    assert counts[1] <= 2.1 * counts[0] and counts[2] <= 2.1 * counts[1]
    assert all(r["prices"] == [] and r["card"] is None for r in dom.links("<article><a href=/x>y</a><span>$1</span></article>", SHOP, products=False))


def test_links_of_a_card_share_its_price(spark):
    page = "<ul><li class=product><a href='/products/a'>First name</a><a href='/products/b'>Second name</a><span class=price>$5.00</span></li></ul>"
    rows = D.products_of(spark.createDataFrame([(1, SHOP, page), (2, SHOP, page.replace("5", "6"))], "page_id long, url string, html string")).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.title, r.amount) for r in rows] == [(1, "First name", 5.0), (1, "Second name", 5.0), (2, "First name", 6.0), (2, "Second name", 6.0)]


def test_runs_over_pages_with_more_cards_than_a_run_takes(spark, tmp_path):
    """Pages of 1, 2, 199 to 201 and 260 cards, of even and odd ids, as the SQL has them."""
    rows, k = [], 0
    for size, cards in enumerate((1, 2, 199, 200, 201, 260, 3, 201, 260)):
        for _ in range(cards):
            k += 1
            rows.append((k, f"part {k} of a shop", "Brand#1", size, 900.0 + k % 100))
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    columns = "page_id, n, product_url, title, currency, amount, confidence"
    got = sorted(tuple(r) for r in D.sku_run(spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(db.sql(f"SELECT {columns} FROM ({D.sku_run_sql()})").fetchall())
