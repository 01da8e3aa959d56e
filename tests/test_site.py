"""Signals, rules and comparisons of scans made by hand; what is expected is worked out from the rules, not by code."""

import pytest

from sitelens.functions import registration, robots, rules, values
from sitelens.functions import site as site_expressions
from sitelens.functions.dialect import SPARK
from sitelens.plans import compare_queries, record_queries, site_queries
from sitelens.sources import ingest
from pyspark.sql import functions as F

LOGIN = """<html><head><title>Buy now</title></head><body><form action="https://collect.example/in"><input type="password"><input type="submit"></form>
<script>eval("x"); location.href = "y";</script><meta http-equiv="refresh" content="0"><p>Hurry! Urgent: act now. Pay by visa, we are an official dealer. Mail boss@gmail.com</p>
<a href="https://twitter.com/one">t</a><a href="https://twitter.com/two">t</a></body></html>"""


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    """One bad site (1), one that answers nothing (2)."""
    path = str(tmp_path_factory.mktemp("site"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    put("pages", [(1, "http://www.bad.example/", LOGIN), (2, "https://gone.example/", None)], "page_id long, url string, html string")
    put("fetches", [(1, 200, "https://else.example/", "text/html", 4, 50, "Strict-Transport-Security: x\nServer: Vercel", False, False, None), (2, 404, "https://gone.example/", None, 0, 50, "", False, False, None)],
        "page_id long, status_code int, final_url string, content_type string, hops int, latency_ms int, headers string, favicon_ok boolean, seen_active boolean, seen_status int")
    put("dns", [(1, "192.0.2.1", "", "", False)], "page_id long, a_records string, aaaa_records string, ns_records string, mx_present boolean")
    put("tls", [(1, False, None, None, None)], "page_id long, https_ok boolean, cert_issuer string, valid_from long, valid_to long")
    put("registration", [(1, ingest.AS_OF_SECONDS - 40 * ingest.DAY, None, None, None, "rdap")], "page_id long, registered_at long, expires_at long, registrar string, error string, source string")
    put("robots", [(1, 200, "User-agent: *\n" + "Disallow: /x\n" * 11)], "page_id long, status_code int, content string")
    put("sitemaps", [], "page_id long, pos int, url string, status_code int, content string")
    put("probes", [(1, 0, "/terms", 301, "t" * 600), (1, 1, "/contact", 404, None)], "page_id long, pos int, path string, status_code int, text string")
    put("policy_links", [(1, "privacy", "u", True), (1, "refund", "u", False)], "page_id long, policy_type string, url string, verified_ok boolean")
    return path


def test_rules(spark, site):
    rows = {r.page_id: r for r in site_queries.assessments(spark, site).collect()}
    by = lambda r, kind: {x.key: x.points for x in r.applied if x.category == kind}
    assert by(rows[1], "phishing") == {"login_form_with_external_action": 30, "cross_domain_redirect": 15, "meta_refresh_redirect": 10, "js_redirect_hint": 10, "mismatch_input_vs_final": 15, "https_missing": 8, "missing_security_headers": 15, "eval_atob_in_scripts": 5}
    # Likelihood: no builder, no markup marks; robots good, no sitemap 15, no favicon 10, the title is short, so seo 0: 25: 50; 27.5 + 10 = 37.5.
    assert by(rows[1], "shell_company") == {"domain_age_under_90_days": 18, "poor_seo": 4, "missing_sitemap": 3, "generic_business_email": 15, "no_physical_address": 12, "no_phone_number": 10, "no_linkedin": 4, "no_mx_records": 5,
                                             "low_word_count": 4, "missing_contact_and_about": 12, "cross_domain_redirect": 12, "high_urgency_score": 5, "impersonation_hint": 6}
    assert by(rows[1], "compliance") == {"missing_refund_policy": 12, "missing_shipping_info": 8, "missing_about": 5, "no_sitemap": 3, "many_disallows": 4}
    # The contact rules count 25 of their 37 points.
    assert (rows[1].phishing, rows[1].shell_company, rows[1].compliance) == (100, 98, 32)
    assert rows[1].overall == 91 and rows[1].primary_type == "phishing"  # 60 + 0.4 * 230 / 3 = 90.67
    assert rows[1].confidence == 65  # 70 + 10 for robots - 15 for few words
    assert rows[2].confidence == 40 and "dns_failure" in by(rows[2], "shell_company") and "low_word_count" not in by(rows[2], "shell_company")
    assert rows[2].primary_type == "shell_company"


def test_reasons(spark, site):
    reasons = [r.reason for r in site_queries.risk_reasons(spark, site).filter("page_id = 1").orderBy("rank").collect()]
    assert reasons == ["[Phishing] Login form submits to external domain(s): collect.example", "[Shell Company] Domain is very new (40 days old)", "[Phishing] Site redirects to a different domain", "[Phishing] Final URL domain differs from input domain", "[Phishing] Missing 3 security header(s)"]


def test_signal_log(spark, site):
    rows = {r.name: r for r in site_queries.signal_log(spark, site).filter("page_id = 1").collect()}
    assert (rows["redirect_chain_length"].severity, rows["dns_ok"].severity, rows["mx_present"].severity, rows["https_ok"].severity, rows["csp_present"].severity, rows["hsts_present"].severity) == ("warning", "info", "warning", "risk_hint", "warning", "info")
    assert rows["domain_age_days"].severity == "risk_hint" and rows["domain_age_days"].value_number == 40
    assert len(rows["terms_snippet"].value_string) == 500 and "privacy_snippet" not in rows and "rdap_error" not in rows
    assert (rows["cert_issuer"].value_type, rows["cert_issuer"].value_string) == ("string", None)


def test_contacts(spark, site):
    row = site_queries.contact_rows(spark, site).filter("page_id = 1").first()
    assert (row.emails, row.phones, row.social) == (["boss@gmail.com"], [], ["https://twitter.com/one", "https://twitter.com/two"])
    shown = {r.page_id: r for r in site_queries.catalogue()["contact_candidates"][0](spark, site).collect()}
    assert (shown[1].twitter, shown[1].linkedin, shown[2].emails) == ("https://twitter.com/two", None, "")


def test_likelihood(spark, site):
    row = {r.page_id: r for r in site_queries.ai_likelihood(spark, site).collect()}
    assert (row[1].markup, row[1].seo_score, row[1].infrastructure, row[1].ai_score, row[1].ai_confidence, row[1].tech_hints) == (0, 0, 50, 38, 0, "vercel")
    assert row[1].reasons == "Missing sitemap.xml|Missing favicon|Minimal SEO setup"
    assert (row[2].ai_score, row[2].ai_confidence, row[2].reasons) == (50, 0, "Analysis unavailable")


def test_two_failed_artifacts(spark, tmp_path):
    rows = [(1, "https://a.example/", "shared words of two pages"), (2, "https://b.example/", "shared words of two pages")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 500, "application/pdf", "u"), (2, None, None, None)], "page_id long, status_code int, content_type string, final_url string").write.parquet(f"{tmp_path}/fetches.parquet")
    spark.createDataFrame([(2, 1), (1, 2)], "a long, b long").write.parquet(f"{tmp_path}/comparisons.parquet")
    rows = compare_queries.compare_full(spark, str(tmp_path)).collect()
    assert len(rows) == 1  # asked for both ways round
    r = rows[0]
    # Cosines of nothing are 0, overlaps of nothing are 1: 0.2 + 0.1 of structure, 0.35 of that in all.
    assert (r.text_score, r.dom_score, r.overall, r.confidence) == (0, 30, 11, 0)
    assert [r.reason_1, r.reason_2, r.reason_3, r.reason_4, r.reason_5] == ["Homepage text content covers different topics", "HTML structure shows some common patterns", "Similar section headings/H1-H2 patterns detected", "Similar distribution of forms, buttons, and links", "Low confidence: page blocked, minimal text, or non-HTML content detected"]


def test_pairs_come_from_content(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["alpha beta gamma", "alpha beta gamma", "alpha beta gamma", "delta epsilon", "delta alpha", None, "", "zeta"])], "id long, text string")
    terms = compare_queries.frequencies(docs)
    pairs = {(r.a, r.b) for r in compare_queries.pairs_by_rare_terms(terms).collect()}
    assert pairs == {(0, 1), (0, 2), (0, 4), (3, 4)}
    got = {(r.a, r.b): r.cosine for r in compare_queries.cosines(compare_queries.pairs_by_rare_terms(terms), terms).collect()}
    assert got[0, 1] == 1.0 and 0 < got[3, 4] < 1


@pytest.mark.parametrize("text, found", [
    ("2019-03-05", "2019-03-05T00:00:00Z"), ("2019-03-05T10:00:00Z", "2019-03-05T10:00:00Z"), ("2019/03/05", "2019-03-05T00:00:00Z"), ("05.03.2019", "2019-03-05T00:00:00Z"), ("5-Mar-2019", "2019-03-05T00:00:00Z"), ("05 mar 2019", "2019-03-05T00:00:00Z"),
    ("March 5, 2019", "2019-03-05T00:00:00Z"), ("Mar 5 2019", "2019-03-05T00:00:00Z"), ("Foo 5, 2019", None), ("5-Foo-2019", None), ("", None), (None, None),
])
def test_dates(spark, text, found):
    assert spark.createDataFrame([(text,)], "x string").select(registration.iso(F.col("x")).alias("y")).first().y == found


def test_robots_readers(spark):
    text = ingest.ROBOTS[2]
    df = spark.createDataFrame([(text,)], "c string")
    r = df.select(*(robots.rules(F.col("c"), x).alias(n) for n, x in (("d", robots.DISCOVERY), ("c", robots.COMPARISON), ("l", robots.LAYERED), ("n", robots.COUNTER)))).first()
    assert (r.d.disallow, r.c.disallow, r.l.disallow, r.n.disallow) == (["/tmp"], [], [], [""])
    assert len(r.d.sitemaps) == 2 and len(r.l.sitemaps) == 1


@pytest.mark.parametrize("scores, overall, primary", [((35, 10, 5), 28, "phishing"), ((0, 0, 0), 0, "phishing"), ((10, 50, 50), 45, "shell_company"), ((100, 100, 100), 100, "phishing"), ((5, 5, 30), 23, "compliance")])
def test_overall_scores(spark, scores, overall, primary):
    df = spark.createDataFrame([scores], "phishing int, shell_company int, compliance int")
    assert tuple(df.selectExpr(rules.OVERALL, rules.PRIMARY).first()) == (overall, primary)


@pytest.mark.parametrize("days, points", [(-1, 30), (29, 30), (30, 18), (89, 18), (90, 12), (179, 12), (180, 8), (364, 8), (365, 5), (729, 5), (730, 0), (None, 0)])
def test_age_tiers(spark, days, points):
    assert spark.createDataFrame([(days,)], "days int").selectExpr(record_queries.age_points() + " AS x").first().x == points


@pytest.mark.parametrize("a, b, words, confidence", [
    ((True, None, True), (True, None, True), 150, 80), ((False, "robots_disallow", False), (True, None, True), 150, 0), ((False, "challenge_title:just a moment", True), (False, "robots", True), 150, 0), ((False, "challenge_body:captcha", True), (True, None, True), 149, 0),
    ((False, "timeout", True), (True, None, True), 150, 30), ((True, None, True), (True, None, True), 10, 60), ((True, None, False), (True, None, True), 150, 50),
])
def test_confidence_of_comparisons(spark, a, b, words, confidence):
    df = spark.createDataFrame([(*a, *b, words, words)], "a_ok boolean, a_reason string, a_has_text boolean, b_ok boolean, b_reason string, b_has_text boolean, a_word_count int, b_word_count int")
    assert df.selectExpr(f"{compare_queries.confidence()} AS x").first().x == confidence


def test_a_batch_is_bounded():
    assert [record_queries.batch_size(x) for x in (None, 5, 80)] == [10, 5, 50]


#: For each suspicious pattern a text that has it, as often as it needs.
SUSPECT = [
    "Hahaha·Round", "Neck•Line version", "Straight  tube pants", "big smell type", "Best quality low price", "warehouse direct shipping", "flash sale 50% off", "very much good product", "welcome to our store purchase", "shipping from quick", "Chinese size",
    "please check size chart carefully please see chart before please read chart before", "just 3 remaining now", "buy today receive gift", "women fashion vintage slim", "the is very and the were too", "this is a very that are an so", "5 star item fast delivery excellent quality quick shipping",
    "good shop recommended", "perfect for daily wear and travel",
]


def test_every_suspicious_pattern_passes_its_guard(spark):
    for k, (pattern, _, _, least) in enumerate(values.SUSPICIOUS):
        row = spark.createDataFrame([(SUSPECT[k],)], "t string").selectExpr(f"{SPARK.count('t', '(?i)' + pattern)} AS n", f"{site_expressions.may_be('lower(t)', k)} AS may").first()
        assert row.n >= least and row.may, (k, row)
