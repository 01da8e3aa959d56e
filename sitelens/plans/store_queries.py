"""Queries of checks, probes, stored rows and their read models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import values as V
from ..functions.dialect import DUCK, SPARK
from ..operators import relational as R
from ..sources import ingest, views
from . import page_queries as Q
from .relational_queries import STARS, L, O, S, scans, t

TITLE = r"(?i)<title[^>]*>([^<]*)</title>"


def page_checks(spark, sf):
    df = Q.texts(spark, sf).withColumn("title", F.expr(SPARK.first("h", TITLE)))
    return Q.project(df, C.page(SPARK))


def page_checks_sql() -> str:
    return Q.select(C.page(DUCK), f"SELECT *, {DUCK.first('h', TITLE)} AS title FROM ({Q.with_text(DUCK)})")


def link_scope(spark, sf):
    return Q.project(views.pages(spark, sf), C.links(SPARK))


def site_links(spark, sf):
    return Q.project(views.pages(spark, sf), C.site_links(SPARK))


def security_headers(spark, sf):
    """Which security headers a page has, how many of them are missing, and its server."""
    lines = F.filter(F.split("headers", "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))), F.trim(F.regexp_replace(x, "^[^:]*:", ""))))
    df = ingest.read(spark, sf, "fetches").select("page_id", F.map_from_entries(pairs).alias("m"))
    has = {k: F.map_contains_key("m", name) for k, name in V.SECURITY_HEADERS.items()}
    missing = sum(((~c).cast("int") for c in has.values()), F.lit(0))
    return df.select("page_id", *(c.alias(k) for k, c in has.items()), missing.alias("missing"), F.try_element_at("m", F.lit("server")).alias("server"), F.try_element_at("m", F.lit("x-powered-by")).alias("powered_by"))


def security_headers_sql() -> str:
    has = {k: f"list_contains(names, '{name}')" for k, name in V.SECURITY_HEADERS.items()}
    value = lambda name: f"(list_filter(ls, lambda x: starts_with(lower(x), '{name}:')))[1]"
    missing = " + ".join(f"CAST(NOT {c} AS INTEGER)" for c in has.values())
    inner = f"SELECT page_id, ls, list_transform(ls, lambda x: lower(trim(split_part(x, ':', 1)))) AS names FROM (SELECT page_id, string_split(headers, chr(10)) AS ls FROM ({ingest.sql('fetches', 'duck')}))"
    return f"SELECT page_id, {', '.join(f'{c} AS {k}' for k, c in has.items())}, {missing} AS missing, trim(split_part({value('server')}, ':', 2)) AS server, trim(split_part({value('x-powered-by')}, ':', 2)) AS powered_by FROM ({inner})"


def policy_probes(spark, sf):
    """Each domain's latest answer at every probed path, as one row: found paths, and what is missing."""
    paths = F.array(*map(F.lit, V.PROBED_PATHS))
    logs = views.view(spark, sf, views.LOGS).withColumn("path", F.element_at(paths, (F.col("log_id") % len(V.PROBED_PATHS) + 1).cast("int")))
    last = R.latest_per_key(logs.select("domain_id", "path", "log_id", "status_code", "created_at"), ["domain_id", "path"], "created_at", "log_id")
    found = F.sort_array(F.collect_list(F.when((F.col("status_code") >= 200) & (F.col("status_code") < 400), F.col("path"))))
    has = lambda *xs: F.arrays_overlap("found", F.array(*map(F.lit, xs)))
    df = last.groupBy("domain_id").agg(found.alias("found"))
    return df.select("domain_id", F.array_join("found", ",").alias("found"), has("/privacy", "/privacy-policy").alias("privacy"), has("/terms", "/terms-of-service").alias("terms"), F.size(F.array_except(paths, "found")).alias("missing"))


def policy_probes_sql() -> str:
    paths = "[" + ", ".join(f"'{p}'" for p in V.PROBED_PATHS) + "]"
    logs = f"SELECT *, {paths}[log_id % {len(V.PROBED_PATHS)} + 1] AS path FROM {L}"
    last = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, path ORDER BY created_at DESC, log_id DESC) AS k FROM ({logs})) WHERE k = 1"
    ok = "status_code BETWEEN 200 AND 399"
    flag = lambda *xs: f"coalesce(bool_or(path IN ({', '.join(repr(x) for x in xs)}) AND {ok}), false)"
    return f"SELECT domain_id, coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE {ok}), '') AS found, {flag('/privacy', '/privacy-policy')} AS privacy, {flag('/terms', '/terms-of-service')} AS terms, CAST({len(V.PROBED_PATHS)} - count(*) FILTER (WHERE {ok}) AS INTEGER) AS missing FROM ({last}) GROUP BY domain_id"


def liveness(spark, sf):
    """A domain is up when its HEAD or else its GET answers; the status is GET's, or HEAD's without one."""
    logs = views.view(spark, sf, views.LOGS)
    last = lambda odd, name: R.latest_per_key(logs.filter(F.col("log_id") % 2 == odd).select("domain_id", "log_id", "status_code", "created_at"), ["domain_id"], "created_at", "log_id").select("domain_id", F.col("status_code").alias(name))
    ok = lambda c: F.coalesce((F.col(c) >= 200) & (F.col(c) < 400), F.lit(False))
    status = F.when(ok("head"), F.col("head")).when(ok("got"), F.col("got")).otherwise(F.coalesce("got", "head"))
    return last(0, "head").join(last(1, "got"), "domain_id", "full").select("domain_id", (ok("head") | ok("got")).alias("up"), status.alias("status"))


def liveness_sql() -> str:
    last = lambda odd: f"SELECT domain_id, status_code FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC, log_id DESC) AS k FROM {L} WHERE log_id % 2 = {odd}) WHERE k = 1"
    ok = lambda c: f"coalesce({c} BETWEEN 200 AND 399, false)"
    h, g = "h.status_code", "g.status_code"
    return f"SELECT coalesce(h.domain_id, g.domain_id) AS domain_id, {ok(h)} OR {ok(g)} AS up, CASE WHEN {ok(h)} THEN {h} WHEN {ok(g)} THEN {g} ELSE coalesce({g}, {h}) END AS status FROM ({last(0)}) h FULL JOIN ({last(1)}) g ON h.domain_id = g.domain_id"


def sku_list(spark, sf):
    """The first page of offers on sale that match a text, dearest first, ties by order and position."""
    df = R.search(views.view(spark, sf, views.OFFERS), ["title"], "RE").filter("on_sale AND amount >= 900")
    return R.offset_page(df.select("order_id", "pos", "title", "currency"), [F.col("title"), F.col("order_id"), F.col("pos")], page=1, size=50)


def needs_scoring(spark, sf):
    """Completed scans of domains that have no assessment (an error event of value 150 or more stands for one)."""
    done = t(spark, sf, "events").filter("event_type = 'error' AND value >= 150").select(F.col("user_id").alias("domain_id"))
    return scans(spark, sf).filter("status = 'completed'").join(done, "domain_id", "left_anti").select("scan_id", "domain_id")


def replaced(spark, sf):
    """Stored offers of orders that a new run covers, replaced by the new run's."""
    offers = views.view(spark, sf, views.OFFERS).select("order_id", "pos", "currency")
    return R.replace_by(offers.filter("currency <> 'EUR'"), offers.filter("currency = 'EUR'"), "order_id")


def review_flag(spark, sf):
    """A conversation's flag after its latest user turn; note and turn are cleared where the flag is false."""
    turns = t(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    last = R.latest_per_key(turns, ["conv_id"], "turn", "text").withColumn("flag", F.coalesce(F.length("text") % 2 == 0, F.lit(False)))
    return last.select("conv_id", "flag", F.when(F.col("flag"), F.col("text")).alias("note"), F.when(F.col("flag"), F.col("turn")).alias("at"))


def effective_status(spark, sf):
    """The status of a domain's latest scan; a failed one counts as completed where the domain has data."""
    last = R.latest_per_key(scans(spark, sf), ["domain_id"], "created_at", "scan_id")
    data = t(spark, sf, "events").filter("event_type in ('purchase', 'signup')").select(F.col("user_id").alias("domain_id")).distinct().withColumn("has", F.lit(True))
    status = F.when((F.col("status") == "failed") & F.col("has"), "completed").otherwise(F.col("status"))
    return last.join(data, "domain_id", "left").select("domain_id", "scan_id", status.alias("status"))


def domain_search(spark, sf):
    """The five domains found that were scanned last, with their number of scans."""
    s = scans(spark, sf).groupBy("domain_id").agg(F.count("*").alias("scans"), F.max("created_at").alias("last"))
    found = R.search(t(spark, sf, "customer").select(F.col("c_custkey").alias("domain_id"), F.col("c_name").alias("name")), ["name"], "00", case=True)
    return found.join(s, "domain_id").orderBy(F.desc("last"), F.desc("domain_id")).limit(5)


def json_response(spark, sf):
    body = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("id")).alias("region"))
    return t(spark, sf, "nation").select("n_nationkey", F.to_json(body).alias("body"))


def catalogue() -> dict:
    """name -> (query, SQL)."""
    on_sale = f"SELECT order_id, pos, title, currency FROM {O} WHERE on_sale AND amount >= 900 AND contains(lower(title), 're')"
    return {
        "page_checks": (page_checks, page_checks_sql()),
        "link_scope": (link_scope, Q.select(C.links(DUCK), views.pages_sql())),
        "site_links": (site_links, Q.select(C.site_links(DUCK), views.pages_sql())),
        "security_headers": (security_headers, security_headers_sql()),
        "policy_probes": (policy_probes, policy_probes_sql()),
        "liveness": (liveness, liveness_sql()),
        "sku_list": (sku_list, f"{on_sale} ORDER BY title, order_id, pos LIMIT 50"),
        "needs_scoring": (needs_scoring, f"SELECT scan_id, domain_id FROM {S} WHERE status = 'completed' AND domain_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value >= 150)"),
        "replace_by_key": (replaced, f"SELECT order_id, pos, currency FROM {O} x WHERE currency = 'EUR' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = x.order_id AND l_returnflag = 'N')"),
        "review_flag": (review_flag, "SELECT conv_id, flag, CASE WHEN flag THEN text END AS note, CASE WHEN flag THEN turn END AS at FROM (SELECT *, coalesce(length(text) % 2 = 0, false) AS flag, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k FROM conversations WHERE role = 'user') WHERE k = 1"),
        "effective_status": (effective_status, f"SELECT domain_id, scan_id, CASE WHEN status = 'failed' AND domain_id IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'signup')) THEN 'completed' ELSE status END AS status FROM ({STARS}) WHERE k = 1"),
        "domain_search": (domain_search, f"SELECT c_custkey AS domain_id, c_name AS name, count(*) AS scans, max(created_at) AS last FROM customer JOIN {S} ON domain_id = c_custkey WHERE contains(c_name, '00') GROUP BY 1, 2 ORDER BY last DESC, domain_id DESC LIMIT 5"),
        "json_response": (json_response, "SELECT n_nationkey, CAST(to_json({'id': n_nationkey, 'name': n_name, 'region': {'id': n_regionkey}}) AS VARCHAR) AS body FROM nation"),
    }
