"""Notes under requests by hand: order, unsound bodies, unknown notes and domains, flags; sitemaps listed once."""

import json

from sitelens.operators import notes
from sitelens.plans import site_queries


def outcome(spark, asked):
    held = spark.createDataFrame([("a", 1, "old", "note", None), ("b", 2, "b", "note", None)], "note_id string, domain_id long, content string, type string, decision string")
    domains = spark.createDataFrame([(1,), (2,), (2,)], "domain_id long")
    rows = [(k, at, kind, domain, note, json.dumps(body) if body is not None else None) for k, (at, kind, domain, note, body) in enumerate(asked)]
    return notes.answered(held, domains, spark.createDataFrame(rows, "request_id long, at int, kind string, domain_id long, note_id string, body string"))


def test_requests_see_those_before_them(spark):
    out = outcome(spark, [
        (1, "edit", 1, "a", {"content": "one"}), (3, "edit", 1, "a", {"content": "three"}), (2, "edit", 1, "a", {"content": "two"}), (3, "delete", 2, "b", None), (4, "edit", 2, "b", {"content": "late"}), (5, "delete", 2, "b", None),
        (6, "edit", 2, "a", {"content": "another's"}), (7, "delete", 1, "none", None), (8, "edit", 1, "a", {"content": ""}), (9, "edit", 1, "none", {}), (10, "move", 1, "a", {}), (11, None, 1, "a", None),
    ])
    assert {r.request_id: r.status for r in out.answers.collect()} == {0: 200, 1: 200, 2: 200, 3: 200, 4: 404, 5: 404, 6: 404, 7: 404, 8: 400, 9: 400, 10: 400, 11: 400}
    assert [tuple(r) for r in out.notes.collect()] == [("a", 1, "three", "note", None)]


def test_new_notes_and_the_flags_of_reviews(spark):
    out = outcome(spark, [
        (1, "create", 1, None, {"content": "x"}), (2, "create", 1, None, {}), (3, "create", 9, None, {"content": "x"}), (3, "create", 9, None, {}), (5, "create", 2, None, {"type": "review", "riskDecision": "risky"}),
        (4, "create", 2, None, {"type": "review", "riskDecision": "not_risky", "content": "y"}), (6, "create", 1, None, None),
    ])
    assert {r.request_id: r.status for r in out.answers.collect()} == {0: 201, 1: 400, 2: 404, 3: 400, 4: 201, 5: 201, 6: 400}
    assert {tuple(r) for r in out.notes.filter("note_id LIKE 'new-%'").collect()} == {("new-0", 1, "x", "note", None), ("new-4", 2, "", "review", "risky"), ("new-5", 2, "y", "review", "not_risky")}
    assert [tuple(r) for r in out.flags.collect()] == [(2, True)]


def test_no_requests(spark):
    out = outcome(spark, [(1, "delete", 1, "a", None)])
    none = notes.answered(out.notes, out.notes.select("domain_id"), spark.createDataFrame([], "request_id long, at int, kind string, domain_id long, note_id string, body string"))
    assert none.answers.count() == none.flags.count() == 0 and none.notes.count() == 1


def test_a_sitemap_that_robots_names_is_listed_once(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("pages", [(1, "https://a.example/x", "<p>x")], "page_id long, url string, html string")
    put("robots", [(1, 200, "User-agent: *\nSitemap: https://a.example/sitemap.xml\nSitemap: https://a.example/other.xml")], "page_id long, status_code int, content string")
    row = site_queries.signals(spark, str(tmp_path)).first()
    assert row.sitemap_urls_found == "https://a.example/sitemap.xml,https://a.example/other.xml,https://a.example/sitemap_index.xml"
