"""Bounded expansion of sitemaps on answers made by hand: order, budgets, indexes, blocked and missing files."""

import pytest
from pyspark.sql import functions as F

from sitelens.functions import robots
from sitelens.operators import frontier
from sitelens.plans import record_queries


def xml(*locs, index=False):
    body = "".join(f"<url><loc> {x} </loc></url>" for x in locs)
    return f"<sitemapindex>{body}</sitemapindex>" if index else f"<urlset>{body}</urlset>"


@pytest.fixture(scope="module")
def run(spark):
    def go(seeds, answers, policy, rules=None):
        s = spark.createDataFrame([(p, u) for p, u in seeds], "page_id long, urls array<string>")
        may = None
        if rules is not None:
            r = spark.createDataFrame(list(rules.items()), "page_id long, content string")
            s = s.join(r, "page_id", "left").select("page_id", "urls", robots.rules(F.col("content"), robots.DISCOVERY).alias("rule"))
            may = lambda url, rule: robots.allowed(F.regexp_extract(url, "^[a-z]+://[^/]*(.*)", 1), rule, fold=True)
        a = spark.createDataFrame(answers, "page_id long, pos int, url string, status_code int, content string")
        rows = frontier.expanded(s, a, policy, may)
        return rows, {(r.page_id, r.level, r.place): (r.url, r.ok, r.is_index, r.url_count, list(r.locs)) for r in rows.collect()}

    return go


def test_the_fetch_layer_spends_five_fetches_in_order(run):
    answers = [
        (1, 0, "a", 200, xml("c1", "c2", "c3", "c4", index=True)), (1, 1, "b", 200, xml("p1", "p2")), (1, 2, "c1", 200, xml(*(f"q{k}" for k in range(130)))), (1, 3, "c2", 404, xml("never")),
        (1, 4, "c3", 200, xml("deep", index=True)), (1, 5, "deep", 200, xml("too deep")), (1, 6, "c1", 200, xml("a second answer")),
        (2, 0, "a", 200, xml("x", index=True)), (2, 1, "x", 200, xml("y")),
    ]
    _, got = run([(1, ["a", "b"]), (2, ["a", "b", "c", "d", "e", "f"]), (3, []), (4, ["a"])], answers, frontier.LAYERED)
    assert got[1, 0, 1] == ("a", True, True, 0, ["c1", "c2", "c3", "c4"]) and got[1, 0, 2] == ("b", True, False, 2, ["p1", "p2"])
    # Three fetches are left: the first answer to c1 with a hundred addresses of 130, the missing c2, and c3, whose children are not followed.
    assert got[1, 1, 1] == ("c1", True, False, 130, [f"q{k}" for k in range(100)])
    assert got[1, 1, 2] == ("c2", False, False, 0, []) and got[1, 1, 3] == ("c3", True, True, 0, ["deep"])
    assert [k for k in got if k[0] == 2] and all(k[1] == 0 for k in got if k[0] == 2) and sum(k[0] == 2 for k in got) == 5  # nothing is left for its index
    assert not any(k[0] == 3 for k in got) and got[4, 0, 1] == ("a", False, False, 0, [])
    assert sum(k[0] == 1 for k in got) == 5


def test_discovery_takes_three_files_two_children_of_an_index_and_five_in_all(run):
    index = lambda n: xml(*(f"https://s.example/{n}/sitemap-{k}.xml" for k in range(4)))  # noqa: E731  an index by the names that it lists
    answers = [(1, k, f"https://s.example/{n}", 200, index(n)) for k, n in enumerate("abcd")] + [(1, 9, "https://s.example/b/sitemap-1.xml", 200, xml("https://s.example/contact", "https://s.example/x"))]
    answers += [(2, 0, "https://t.example/m", 200, xml("https://t.example/x", "https://t.example/about", "https://t.example/x", "")), (2, 1, "https://t.example/n", 200, "<sitemapindex><loc>https://t.example/plain</loc></sitemapindex>")]
    rows, got = run([(1, [f"https://s.example/{n}" for n in "abcd"]), (2, ["https://t.example/n", "https://t.example/m"])], answers, frontier.DISCOVERY)
    children = [got[1, 1, k][0] for k in range(1, 6)]
    assert children == [f"https://s.example/{n}/sitemap-{k}.xml" for n, k in (("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0))] and (1, 1, 6) not in got
    assert (1, 0, 4) not in got
    assert not got[2, 0, 1][2]  # its element alone makes no index here
    found = {(r.page_id, r["loc"]): tuple(r["at"]) for r in frontier.discovered(rows).collect()}
    assert sorted(k for k in found if k[0] == 1) == [(1, "https://s.example/contact"), (1, "https://s.example/x")]
    assert [k[1] for k in sorted((k for k in found if k[0] == 2), key=found.get)] == ["https://t.example/plain", "https://t.example/x", "https://t.example/about"]


def test_a_blocked_file_spends_the_budget(run):
    answers = [(1, 0, "https://s.example/no/a.xml", 200, xml("p")), (1, 1, "https://s.example/ok.xml", 200, xml("q"))]
    _, got = run([(1, ["https://s.example/no/a.xml", "https://s.example/ok.xml"])], answers, frontier.DISCOVERY, {1: "User-agent: *\nDisallow: /no"})
    assert got == {(1, 0, 1): ("https://s.example/no/a.xml", False, False, 0, []), (1, 0, 2): ("https://s.example/ok.xml", True, False, 1, ["q"])}
    _, free = run([(1, ["https://s.example/no/a.xml"])], answers, frontier.DISCOVERY, {1: None})
    assert free[1, 0, 1][1]


def test_nulls_and_empty_tables(run):
    answers = [(1, 0, "a", None, xml("p")), (1, 1, "b", 200, None), (None, 2, "a", 200, xml("p"))]
    rows, got = run([(1, ["a", "b"])], answers, frontier.LAYERED)
    assert [x[1] for x in got.values()] == [False, False] and frontier.discovered(rows).count() == 0
    assert run([], answers, frontier.LAYERED)[1] == {} and len(run([(1, ["a"])], [], frontier.DISCOVERY)[1]) == 1


def test_contact_pages_by_three_steps(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    url = "https://www.s.example/"
    drawn = "<a href='https://far.example/contact'>Contact</a><a href='/team'>Team</a><a href='mailto:a@s.example'>Contact</a><a href='/hilfe/contact-us'>Write</a><a href='/contact'>Contact</a>"
    put("pages", [(k, url, "<p>x") for k in range(1, 5)], "page_id long, url string, html string")
    put("renders", [(1, url, drawn), (2, url, drawn), (3, url, drawn), (4, url, "<a href='/team'>Team</a>")], "page_id long, url string, html string")
    put("probes", [(1, 0, "/contact", 404, None), (1, 1, "/about", 200, "x")], "page_id long, pos int, path string, status_code int, text string")
    put("sitemaps", [(2, 0, "m", 200, xml("https://s.example/contact"))], "page_id long, pos int, url string, status_code int, content string")
    got = {r.page_id: (r.contact_page, r.step) for r in record_queries.contact_discovery(spark, str(tmp_path)).collect()}
    assert got == {1: ("/about", 1), 2: ("https://s.example/contact", 2), 3: ("https://www.s.example/hilfe/contact-us", 3), 4: (None, None)}
