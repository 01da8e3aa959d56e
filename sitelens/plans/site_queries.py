"""Queries over all records of a scan: signals, risk, likelihood, contacts, robots and sitemaps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import robots, rules, site
from ..functions import values as V
from ..functions.dialect import DUCK, SPARK
from ..operators import frontier
from ..operators.shared import written
from ..sources import ingest
from .page_queries import named, project, select, texts, with_text

KEY = "page_id"
ROBOTS = len(ingest.ROBOTS)


def robots_rows(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, robots_status, robots_ok, robots_valid, disallow_count, robots_sitemaps of each scan's robots.txt."""
    ok = F.coalesce(F.col("status_code").between(200, 399), F.lit(False))
    r = robots.rules(F.when(ok, F.col("content")), robots.COUNTER)
    df = ingest.read(spark, sf, "robots").select(KEY, F.col("status_code").alias("robots_status"), ok.alias("robots_ok"), (ok & robots.is_robots(F.col("content"))).alias("robots_valid"), r.alias("r"))
    return df.select(KEY, "robots_status", "robots_ok", "robots_valid", F.coalesce(F.size("r.disallow"), F.lit(0)).alias("disallow_count"), F.coalesce(F.array_join("r.sitemaps", ","), F.lit("")).alias("robots_sitemaps"))


def by_file(column: str, values: list) -> str:
    """SQL: the value that belongs to the stand-in's robots file of a page."""
    return "CASE page_id % " + str(ROBOTS) + "".join(f" WHEN {k} THEN {v}" for k, v in enumerate(values)) + f" END AS {column}"


def robots_sql() -> str:
    """Worked out by hand for the files of the stand-in."""
    one = "'https://a.example.org/one.xml'"
    facts = f"SELECT page_id, status_code, {by_file('n', [2, 1, 1, 0, 12])}, {by_file('maps', [one, repr(''), one, repr(''), repr('')])}, {by_file('valid', ['true', 'true', 'true', 'false', 'true'])} FROM ({ingest.sql('robots', 'duck')})"
    ok = "status_code = 200"
    return f"SELECT page_id, status_code AS robots_status, {ok} AS robots_ok, {ok} AND valid AS robots_valid, CASE WHEN {ok} THEN n ELSE 0 END AS disallow_count, CASE WHEN {ok} THEN maps ELSE '' END AS robots_sitemaps FROM ({facts})"


def source(name: str) -> str:
    """A table of a scan for DuckDB."""
    if name == "page":
        return f"({select(site.page(DUCK), with_text(DUCK))})"
    return f"({robots_sql() if name == 'robots' else ingest.sql(name, 'duck')})"


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What signals, likelihood and contacts read of a page, for queries that need more than one of them: a page's text is stripped once."""
    page = texts(spark, sf).selectExpr(KEY, "url", "h", "t", *named(site.read_for_builders(SPARK)))
    return written(project(page, site.page(SPARK) | site.generated(SPARK) | site.contacts(SPARK)))


def signals(spark: SparkSession, sf: str, page: DataFrame | None = None) -> DataFrame:
    """One row of signals for each scan. Pages are reduced to narrow rows before any record is joined."""
    frames = {n: ingest.read(spark, sf, n) for n in ("fetches", "dns", "tls", "registration", "sitemaps", "probes")}
    frames |= {"page": page.select(KEY, *site.page(SPARK)) if page else project(texts(spark, sf), site.page(SPARK)), "robots": robots_rows(spark, sf)}
    return project(spark.sql(site.assembled(SPARK, lambda n: "{" + n + "}"), **frames), site.joined(SPARK))


def signals_sql() -> str:
    return select(site.joined(DUCK), site.assembled(DUCK, source))


def flat(q) -> dict[str, str]:
    """Signals with lists as text, for results."""
    return {c: q.joined(c, ",") if c in ("external_form_actions", "external_script_domains") else c for c in site.joined(q)}


def ai_rows(spark, sf, page: DataFrame | None = None) -> DataFrame:
    first = ingest.read(spark, sf, "sitemaps").filter("pos = 0").select(KEY, (F.col("status_code").between(200, 399) & robots.is_sitemap(F.col("content"))).alias("sitemap_valid"))
    if page:
        df = page.select(KEY, *site.generated(SPARK))
    else:
        df = project(texts(spark, sf).selectExpr(KEY, "url", "h", "t", *named(site.read_for_builders(SPARK))), site.generated(SPARK))
    for other in (ingest.read(spark, sf, "fetches").select(KEY, "headers", "favicon_ok"), robots_rows(spark, sf).select(KEY, "robots_valid"), first):
        df = df.join(other, KEY, "left")
    df = project(df, site.likelihood(SPARK))
    return df.selectExpr("*", f"{site.AI_SCORE} AS ai_score", f"{site.AI_CONFIDENCE} AS ai_confidence", f"{site.AI_NOTES} AS notes")


def ai_sql() -> str:
    page = f"SELECT *, {', '.join(named(site.read_for_builders(DUCK)))} FROM ({with_text(DUCK)})"
    first = f"SELECT page_id, status_code BETWEEN 200 AND 399 AND regexp_matches(content, '(?i)<urlset|<sitemapindex|<url>|<loc>') AS sitemap_valid FROM ({ingest.sql('sitemaps', 'duck')}) WHERE pos = 0"
    df = f"SELECT g.*, f.headers, f.favicon_ok, b.robots_valid, s.sitemap_valid FROM ({select(site.generated(DUCK), page)}) g LEFT JOIN {source('fetches')} f USING (page_id) LEFT JOIN {source('robots')} b USING (page_id) LEFT JOIN ({first}) s USING (page_id)"
    return f"SELECT *, {site.AI_SCORE} AS ai_score, {site.AI_CONFIDENCE} AS ai_confidence, {site.AI_NOTES} AS notes FROM ({select(site.likelihood(DUCK), df)})"


def ai_flat(q) -> dict[str, str]:
    lists = ("tech_hints", "ai_markers", "suspicious_content_patterns", "reasons")
    return {c: q.joined(c, "|") if c in lists else c for c in (*site.likelihood(q), "ai_score", "ai_confidence", "notes")}


def ai_likelihood(spark, sf):
    """The likelihood that a page is generated, from its markup and infrastructure, with reasons; no model."""
    return project(ai_rows(spark, sf), ai_flat(SPARK))


def ai_layered(spark, sf):
    """The second reading of the same, with its own patterns and points."""
    robots_found = ingest.read(spark, sf, "robots").select(KEY, (F.col("status_code") == 200).alias("robots_found"))
    df = project(texts(spark, sf).withColumn("low", F.lower("h")), site.layered(SPARK)).join(ingest.read(spark, sf, "fetches").select(KEY, "headers", "final_url"), KEY, "left")
    df = df.join(robots_found, KEY, "left").join(signals(spark, sf).select(KEY, (F.col("sitemap_url_count") > 0).alias("sitemap_found")), KEY, "left")
    return project(project(df, site.layered_joined(SPARK)), site.layered_scores(SPARK))


def ai_layered_sql() -> str:
    df = f"SELECT g.*, f.headers, f.final_url, b.status_code = 200 AS robots_found, s.sitemap_url_count > 0 AS sitemap_found FROM ({select(site.layered(DUCK), f'SELECT *, lower(h) AS low FROM ({with_text(DUCK)})')}) g LEFT JOIN {source('fetches')} f USING (page_id) LEFT JOIN ({ingest.sql('robots', 'duck')}) b USING (page_id) LEFT JOIN ({signals_sql()}) s USING (page_id)"
    return select(site.layered_scores(DUCK), select(site.layered_joined(DUCK), df))


#: Contact pages in the order in which they are tried.
CONTACT_PATHS = ["/contact", "/contact-us", "/contactus", "/pages/contact", "/pages/contact-us", "/about", "/about-us"]


def contact_pages(spark, sf) -> DataFrame:
    """The contact page of a scan: the first path that answers, else the first address of its sitemaps that names one."""
    order = F.array_position(F.array(*map(F.lit, CONTACT_PATHS)), F.col("path")).cast("int")
    paths = ingest.read(spark, sf, "probes").filter(F.col("path").isin(CONTACT_PATHS) & F.col("status_code").between(200, 399)).select(KEY, F.struct(F.lit(1).alias("step"), order.alias("pos"), F.col("path").alias("page")).alias("x"))
    maps = ingest.read(spark, sf, "sitemaps").filter(F.col("status_code").between(200, 399)).select(KEY, "pos", F.posexplode_outer(robots.contact_locations(F.col("content"))).alias("at", "page")).filter("page IS NOT NULL")
    maps = maps.select(KEY, F.struct(F.lit(2).alias("step"), (F.col("pos") * 1000 + F.col("at")).cast("int").alias("pos"), "page").alias("x"))
    return paths.unionAll(maps).groupBy(KEY).agg(F.min("x").alias("x")).select(KEY, F.col("x.page").alias("contact_page"), F.col("x.step").alias("step"))


def contact_pages_sql() -> str:
    paths = ", ".join(f"({k}, '{p}')" for k, p in enumerate(CONTACT_PATHS, 1))
    # Of the stand-in's sitemaps the first is an index; each other one names two contact pages.
    maps = f"SELECT page_id, 2 AS step, pos * 1000 + i AS pos, CASE i WHEN 1 THEN concat('https://a.example.org/contact/', page_id) ELSE 'https://a.example.org/Contact-Us' END AS page FROM ({ingest.sql('sitemaps', 'duck')}), (VALUES (1), (2)) w(i) WHERE pos > 0 AND status_code = 200"
    return f"SELECT page_id, arg_min(page, step * 1000000 + pos) AS contact_page, CAST(min(step) AS INTEGER) AS step FROM (SELECT page_id, 1 AS step, o.pos, p.path AS page FROM {source('probes')} p JOIN (VALUES {paths}) o(pos, path) ON p.path = o.path WHERE p.status_code BETWEEN 200 AND 399 UNION ALL {maps}) GROUP BY page_id"


def contact_rows(spark, sf, page: DataFrame | None = None) -> DataFrame:
    """emails, phones, social, contact_page of each scan; a scan without any has empty lists."""
    other = project(ingest.read(spark, sf, "probes").filter("path = '/contact' AND status_code BETWEEN 200 AND 399"), site.candidates(SPARK, "text"))
    other = other.select(KEY, F.col("emails").alias("emails_c"), F.col("phones").alias("phones_c"))
    own = page.select(KEY, *site.contacts(SPARK)) if page else project(texts(spark, sf), site.contacts(SPARK))
    df = own.join(other, KEY, "left").join(contact_pages(spark, sf).drop("step"), KEY, "left")
    none = F.array().cast("array<string>")
    return project(df.withColumns({c: F.coalesce(c, none) for c in ("emails_c", "phones_c")}), site.gathered(SPARK))


def contact_sql() -> str:
    other = select(site.candidates(DUCK, "text"), f"SELECT * FROM {source('probes')} WHERE path = '/contact' AND status_code BETWEEN 200 AND 399")
    df = f"SELECT c.page_id, c.emails, c.phones, c.social, coalesce(o.emails, []) AS emails_c, coalesce(o.phones, []) AS phones_c, p.contact_page FROM ({select(site.contacts(DUCK), with_text(DUCK))}) c LEFT JOIN ({other}) o USING (page_id) LEFT JOIN ({contact_pages_sql()}) p USING (page_id)"
    return select(site.gathered(DUCK), df)


def contact_flat(q) -> dict[str, str]:
    return {"emails": q.joined("emails", ","), "phones": q.joined("phones", ","), "contact_page": "contact_page", **site.networks(q)}


def scoring_rows(spark, sf) -> DataFrame:
    """Signals with contacts, likelihood and verified policies, and the rules that hold."""
    links = ingest.read(spark, sf, "policy_links").filter("verified_ok").groupBy(KEY).agg(*(F.max(F.col("policy_type") == k).alias(f"verified_{k}") for k in ("privacy", "refund", "terms")))
    page = page_rows(spark, sf)
    ai = ai_rows(spark, sf, page).select(KEY, "suspicious_content_patterns", "has_robots_txt", "has_sitemap", "free_hosting", "seo_score", "is_boilerplate", "ai_score", "ai_confidence")
    contact = contact_rows(spark, sf, page)
    contact = contact.select("*", F.expr(site.networks(SPARK)["linkedin"]).alias("linkedin"), F.array().cast("array<string>").alias("addresses"))
    df = signals(spark, sf, page).join(contact, KEY, "left").join(ai, KEY, "left").join(links, KEY, "left")
    df = df.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("verified_privacy", "verified_refund", "verified_terms")})
    return df.selectExpr("*", f"{rules.applied(SPARK)} AS applied")


def scoring_sql() -> str:
    verified = ", ".join(f"coalesce(bool_or(policy_type = '{k}'), false) AS verified_{k}" for k in ("privacy", "refund", "terms"))
    contact = f"SELECT *, {site.networks(DUCK)['linkedin']} AS linkedin, CAST([] AS VARCHAR[]) AS addresses FROM ({contact_sql()})"
    flags = ", ".join(f"coalesce(v.verified_{k}, false) AS verified_{k}" for k in ("privacy", "refund", "terms"))
    df = f"SELECT s.*, c.* EXCLUDE (page_id), a.* EXCLUDE (page_id), {flags} FROM ({signals_sql()}) s LEFT JOIN ({contact}) c ON s.page_id = c.page_id LEFT JOIN (SELECT page_id, suspicious_content_patterns, has_robots_txt, has_sitemap, free_hosting, seo_score, is_boilerplate, ai_score, ai_confidence FROM ({ai_sql()})) a ON s.page_id = a.page_id LEFT JOIN (SELECT page_id, {verified} FROM {source('policy_links')} WHERE verified_ok GROUP BY page_id) v ON s.page_id = v.page_id"
    return f"SELECT *, {rules.applied(DUCK)} AS applied FROM ({df})"


TYPES = tuple(rules.CATEGORIES)


def scored(q) -> dict[str, str]:
    return {t: t for t in TYPES} | {"overall": rules.OVERALL, "primary_type": rules.PRIMARY, "confidence": "confidence"}


def assessments(spark, sf, *more: str) -> DataFrame:
    """applied, the three scores, overall, type and confidence of each scan; all zero for a scan without a page address. more: other columns, as SQL."""
    own = [x.rpartition(" AS ")[2] for x in more]
    df = scoring_rows(spark, sf).selectExpr(KEY, "applied", *more, *named(rules.scores(SPARK) | {"confidence": rules.confidence()}))
    return df.selectExpr(KEY, "applied", *own, *named(scored(SPARK)))


def assessments_sql() -> str:
    df = select(rules.scores(DUCK) | {"confidence": rules.confidence()}, f"SELECT * FROM ({scoring_sql()})", (KEY, "applied"))
    return select(scored(DUCK), df, (KEY, "applied"))


def risk_scores(spark, sf):
    return assessments(spark, sf).drop("applied")


#: Reasons of an assessment.
REASONS = 5


def risk_reasons(spark, sf):
    """The weightiest reasons of a scan, each text once; equal points keep the order of the rules."""
    sort = F.expr("array_sort(applied, (a, b) -> CASE WHEN a.points <> b.points THEN b.points - a.points ELSE a.n - b.n END)")
    # A reason is told once: the first of equal texts in this order.
    once = F.filter("x", lambda r, i: F.array_position(F.transform("x", lambda y: y["reason"]), r["reason"]) == i + 1)
    df = assessments(spark, sf).select(KEY, sort.alias("x")).select(KEY, F.slice(once, 1, REASONS).alias("x"))
    df = df.select(KEY, F.posexplode_outer("x").alias("i", "x")).filter("x IS NOT NULL")
    names = F.create_map(*(F.lit(v) for kv in rules.CATEGORIES.items() for v in kv))
    return df.select(KEY, (F.col("i") + 1).alias("rank"), F.concat(F.lit("["), names[F.col("x.category")], F.lit("] "), "x.reason").alias("reason"), F.col("x.points").alias("points"))


def unnested(sql: str) -> str:
    return f"SELECT page_id, x.* FROM (SELECT page_id, unnest(applied) AS x FROM ({sql}))"


def risk_reasons_sql() -> str:
    name = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.CATEGORIES.items()) + " END"
    once = f"SELECT page_id, reason, max(points) AS points, arg_min(category, n - points * 1000) AS category, min(n - points * 1000) AS o FROM ({unnested(assessments_sql())}) GROUP BY page_id, reason"
    return f"SELECT * EXCLUDE (o, category) FROM (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) AS INTEGER) AS rank, concat('[', {name}, '] ', reason) AS reason, points, category, o FROM ({once})) WHERE rank <= {REASONS}"


def signal_paths(spark, sf):
    """Which rules hold, as `type.rule`, each once, in the order of the rules."""
    paths = F.array_distinct(F.transform("applied", lambda x: F.concat(x["category"], F.lit("."), x["key"])))
    return assessments(spark, sf).select(KEY, F.array_join(paths, ",").alias("paths"), F.size(paths).alias("n"))


def signal_paths_sql() -> str:
    return f"SELECT page_id, coalesce(string_agg(category || '.' || key, ',' ORDER BY n), '') AS paths, CAST(count(*) AS INTEGER) AS n FROM ({unnested(assessments_sql())}) GROUP BY page_id"


def failed_assessments(spark, sf):
    """Assessments of inputs that are no address, so that nothing can be scored: all zero, of no confidence."""
    pages, customers = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "customer"))
    inputs = pages.select(F.col(KEY).alias("id"), F.col("url").alias("input")).unionAll(customers.select("c_custkey", "c_name"))
    bad = inputs.filter(~F.coalesce(F.col("input").rlike("(?i)^https?://[^/?#]+"), F.lit(False)))
    zero = {t: F.lit(0) for t in (*TYPES, "overall", "confidence")}
    return bad.select("id", *(c.alias(k) for k, c in zero.items()), F.lit("shell_company").alias("primary_type"), F.concat(F.lit("Assessment failed: Invalid URL: "), F.coalesce("input", F.lit(""))).alias("notes"))


def severity(c: str) -> str:
    return f"CASE WHEN {c} > 70 THEN 'risk_hint' WHEN {c} > 40 THEN 'warning' ELSE 'info' END"


def scoring_entries(q) -> list[str]:
    entry = lambda name, c, s, kind="number": q.struct(name=f"'{name}'", value_type=f"'{kind}'", value_number=f"CAST({c} AS INT)" if kind == "number" else "CAST(NULL AS INT)", value_string=c if kind == "string" else f"CAST(NULL AS {'STRING' if q.name == 'spark' else 'VARCHAR'})", severity=s)
    return [
        entry("overall_risk_score", "overall", severity("overall")), *(entry(f"{t}_score", t, severity(t)) for t in TYPES),
        entry("confidence", "confidence", "CASE WHEN confidence < 50 THEN 'warning' ELSE 'info' END"), entry("primary_risk_type", "primary_type", "'info'", "string"),
    ]


def scoring_log(spark, sf):
    """Each assessment as rows of a log, with severities by score."""
    return assessments(spark, sf).selectExpr(KEY, f"inline_outer(array({', '.join(scoring_entries(SPARK))}))")


def scoring_log_sql() -> str:
    return f"SELECT page_id, x.* FROM (SELECT page_id, unnest([{', '.join(scoring_entries(DUCK))}]) AS x FROM ({assessments_sql()}))"


HINT, WARN, INFO = "risk_hint", "warning", "info"


def log_entries() -> list[tuple[str, str, str, str, str]]:
    """(category, name, type, severity where it holds, condition) of every signal that is logged."""
    n, b, s, j = "number", "boolean", "string", "json"
    info = lambda category, kind, *names: [(category, x, kind, INFO, "true") for x in names]
    over = lambda category, name, kind, severity, condition: [(category, name, kind, severity, condition)]
    raised = lambda category, severity, *names: [(category, x, b, severity, x) for x in names]
    lacking = lambda category, severity, *names: [(category, x, b, severity, f"NOT {x}") for x in names]
    return [
        *info("reachability", n, "status_code"), *lacking("reachability", HINT, "is_active"), *info("reachability", n, "latency_ms", "bytes"), *info("reachability", s, "content_type", "final_url"),
        *info("reachability", s, "html_title"), *over("reachability", "homepage_text_word_count", n, WARN, "homepage_text_word_count < 150"), *raised("reachability", HINT, "bot_protection_detected"),
        *over("redirects", "redirect_chain_length", n, WARN, "redirect_chain_length > 3"), *raised("redirects", HINT, "cross_domain_redirect"), *raised("redirects", WARN, "meta_refresh_present", "js_redirect_hint"), *raised("redirects", HINT, "mismatch_input_vs_final_domain"),
        *info("dns", j, "a_records", "aaaa_records", "ns_records"), *lacking("dns", WARN, "mx_present"), *lacking("dns", HINT, "dns_ok"),
        *lacking("tls", HINT, "https_ok"), *info("tls", s, "cert_issuer"), *info("tls", n, "cert_valid_from", "cert_valid_to"), *over("tls", "days_to_expiry", n, WARN, "days_to_expiry < 14"), *raised("tls", WARN, "expiring_soon"),
        *lacking("headers", WARN, "hsts_present", "csp_present", "xfo_present", "xcto_present"), *info("headers", b, "referrer_present"),
        *info("robots_sitemap", b, "robots_fetched"), *info("robots_sitemap", n, "robots_status"), *info("robots_sitemap", j, "sitemap_urls_found"), *info("robots_sitemap", n, "sitemap_url_count", "disallow_count_for_user_agent_star"),
        *info("policy_pages", j, "found_paths"), *info("policy_pages", s, "privacy_snippet", "terms_snippet", "contact_snippet"),
        *over("forms", "password_input_count", n, WARN, "password_input_count > 0"), *info("forms", n, "email_input_count"), *raised("forms", WARN, "login_form_present"), *over("forms", "external_form_actions", j, HINT, "external_form_actions <> ''"),
        *over("third_party", "external_script_domains", j, WARN, "n_scripts > 10"), *raised("third_party", HINT, "obfuscation_hint", "eval_atob_hint"),
        *over("content", "urgency_score", n, WARN, "urgency_score > 5"), *over("content", "extreme_discount_score", n, WARN, "extreme_discount_score > 5"), *info("content", b, "payment_keyword_hint"), *raised("content", WARN, "impersonation_hint"),
        *info("rdap", n, "registered_at", "expires_at"), *over("rdap", "domain_age_years", n, WARN, "domain_age_years < 1"), *over("rdap", "domain_age_days", n, HINT, "domain_age_days < 90"), *info("rdap", s, "registrar"), *lacking("rdap", WARN, "rdap_available"), *over("rdap", "rdap_error", s, WARN, "true"),
    ]


#: Signals that are logged only where there are any.
ONLY_WHERE_SET = ("privacy_snippet", "terms_snippet", "contact_snippet", "rdap_error")


def log_sql(q, rows: str) -> list[str]:
    null = lambda kind: f"CAST(NULL AS {kind})"
    text = "STRING" if q.name == "spark" else "VARCHAR"
    out = []
    for category, name, kind, level, condition in log_entries():
        shown = f"substr({name}, 1, {site.SNIPPET})"
        # A value that is not there is logged as text.
        out.append(q.struct(category=f"'{category}'", name=f"'{name}'", value_type=f"CASE WHEN {name} IS NULL THEN 'string' ELSE '{kind}' END", value_number=f"CAST({name} AS DOUBLE)" if kind == "number" else null("DOUBLE"),
                            value_string=shown if kind == "string" else null(text), value_boolean=name if kind == "boolean" else null("BOOLEAN"), value_json=name if kind == "json" else null(text),
                            severity=f"CASE WHEN {condition} THEN '{level}' ELSE 'info' END", dropped=f"({name} IS NULL OR {name} = '')" if name in ONLY_WHERE_SET else "false"))
    return out


def signal_log(spark, sf):
    """Every signal of a scan as a row: category, name, typed value, severity; texts are cut to 500 characters."""
    df = signals(spark, sf).selectExpr(KEY, "size(external_script_domains) AS n_scripts", *named(flat(SPARK)))
    return df.selectExpr(KEY, f"inline_outer(array({', '.join(log_sql(SPARK, ''))}))").filter("NOT dropped").drop("dropped")


def signal_log_sql() -> str:
    df = f"SELECT page_id, len(external_script_domains) AS n_scripts, {', '.join(named(flat(DUCK)))} FROM ({signals_sql()})"
    return f"SELECT page_id, x.* EXCLUDE (dropped) FROM (SELECT page_id, unnest([{', '.join(log_sql(DUCK, ''))}]) AS x FROM ({df})) WHERE NOT x.dropped"


def robots_variants(spark, sf):
    """robots.txt as three readers take it, and whether discovery and comparison may fetch the page's own path."""
    ok = F.coalesce(F.col("status_code").between(200, 399), F.lit(False))
    content = F.when(ok, F.col("content"))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(KEY, F.expr(P.urls(SPARK)["path"]).alias("path"))
    df = pages.join(ingest.read(spark, sf, "robots"), KEY, "left")
    df = df.select(KEY, "path", robots.rules(content, robots.DISCOVERY).alias("d"), robots.rules(content, robots.COMPARISON).alias("c"), robots.rules(content, robots.LAYERED).alias("l"))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c.replace(".", "_"))
    return df.select(KEY, *map(listed, ("d.allow", "d.disallow", "d.sitemaps", "c.allow", "c.disallow", "l.allow", "l.disallow", "l.sitemaps")), F.col("d.delay_ms").alias("d_delay_ms"), F.col("l.delay_ms").alias("l_delay_ms"),
                     robots.allowed(F.col("path"), F.col("d"), fold=True).alias("may_discover"), robots.allowed(F.col("path"), F.col("c"), fold=True).alias("may_compare"))


def robots_variants_sql() -> str:
    """Worked out by hand for the files of the stand-in."""
    many = "'" + ",".join(f"/d{k}" for k in range(12)) + "'"
    one, none, odd = "'https://a.example.org/one.xml'", "''", "'/en # not this'"
    facts = {
        "d_allow": ["'/private/open'", none, none, none, none], "d_disallow": ["'/private'", odd, "'/tmp'", none, many], "d_sitemaps": [one, none, "'https://a.example.org/one.xml,https://a.example.org/one.xml'", none, none],
        "c_allow": ["'/private/open'", none, none, none, none], "c_disallow": ["'/private'", odd, none, none, many],
        "l_allow": ["'/Private/Open'", none, none, none, none], "l_disallow": ["'/private'", "'/EN # not this'", none, none, many], "l_sitemaps": [one, none, one, none, none],
    }
    delays = {"d_delay_ms": [2000, 0, "NULL", "NULL", "NULL"], "l_delay_ms": [2000, 500, "NULL", "NULL", "NULL"]}
    path = f"lower({P.urls(DUCK)['path']})"
    blocked = lambda first: f"CASE page_id % {ROBOTS} WHEN 0 THEN starts_with(path, '/private') AND NOT starts_with(path, '/private/open') WHEN 2 THEN {first} WHEN 4 THEN regexp_matches(path, '^/d[0-9]') ELSE false END"
    inner = f"SELECT page_id, status_code = 200 AS ok, {path} AS path, {', '.join(by_file(k, v) for k, v in (facts | delays).items())} FROM pages JOIN (SELECT page_id, status_code FROM ({ingest.sql('robots', 'duck')})) USING (page_id)"
    columns = [f"CASE WHEN ok THEN {k} ELSE '' END AS {k}" for k in facts] + [f"CASE WHEN ok THEN CAST({k} AS INTEGER) END AS {k}" for k in delays]
    gates = {"may_discover": blocked("starts_with(path, '/tmp')"), "may_compare": blocked("false")}
    return f"SELECT page_id, {', '.join(columns)}, {', '.join(f'NOT (ok AND {c}) AS {k}' for k, c in gates.items())} FROM ({inner})"


def sitemap_parse(spark, sf):
    """Addresses of the first five sitemaps of a scan that answer, which of them are indexes, and contact pages."""
    n = F.expr("row_number() OVER (PARTITION BY page_id ORDER BY pos)")
    df = ingest.read(spark, sf, "sitemaps").withColumn("k", n).filter("k <= 5 AND status_code BETWEEN 200 AND 399")
    index = F.col("content").contains("<sitemapindex")
    df = df.select(KEY, "pos", index.alias("is_index"), F.posexplode_outer(robots.locations(F.col("content"))).alias("place", "loc")).filter("loc IS NOT NULL")
    return df.withColumn("contact", ~F.col("is_index") & F.col("loc").rlike(V.CONTACT_ADDRESS))


def sitemap_parse_sql() -> str:
    """The stand-in's first file is an index of three files; every other one has the page, its contact page and another."""
    first = "SELECT page_id, pos, true AS is_index, i AS place, concat('https://a.example.org/', page_id, '/sitemap', [1, 3, 4][i + 1], '.xml') AS loc FROM s, (VALUES (0), (1), (2)) w(i) WHERE pos = 0"
    rest = "SELECT page_id, pos, false, i, [url, concat('https://a.example.org/contact/', page_id), 'https://a.example.org/Contact-Us'][i + 1] FROM s JOIN (SELECT page_id, url FROM pages) USING (page_id), (VALUES (0), (1), (2)) w(i) WHERE pos > 0"
    return f"WITH s AS (SELECT page_id, pos FROM ({ingest.sql('sitemaps', 'duck')}) WHERE pos < 5 AND status_code = 200) SELECT page_id, pos, is_index, CAST(place AS INTEGER) AS place, loc, NOT is_index AND regexp_matches(loc, '{V.CONTACT_ADDRESS}') AS contact FROM ({first} UNION ALL {rest})"


#: Sitemaps that are tried at the root of every site.
WELL_KNOWN = ["/sitemap.xml", "/sitemap_index.xml"]


def sitemap_fetches(spark, sf, policy: frontier.Policy) -> DataFrame:
    """The sitemaps of each scan that a policy fetches: those of robots.txt and at well-known places, then the children of indexes."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(KEY, F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1).alias("root"))
    ok = F.coalesce(F.col("status_code").between(200, 399), F.lit(False))
    discovery = policy is frontier.DISCOVERY
    df = pages.join(ingest.read(spark, sf, "robots"), KEY, "left").select(KEY, "root", robots.rules(F.when(ok, F.col("content")), robots.DISCOVERY if discovery else robots.LAYERED).alias("rule"))
    known = F.array(*(F.concat("root", F.lit(p)) for p in WELL_KNOWN))
    maps = F.coalesce("rule.sitemaps", F.array().cast("array<string>"))
    urls = F.when(F.size(maps) > 0, maps).otherwise(known) if discovery else F.array_distinct(F.concat(maps, known))
    may = (lambda url, rule: robots.allowed(F.expr(P.urls(SPARK)["path"]), rule, fold=True)) if discovery else None
    return frontier.expanded(df.select(KEY, urls.alias("urls"), "rule"), ingest.read(spark, sf, "sitemaps"), policy, may)


def sitemap_tree(spark, sf):
    """The five fetches at most of a scan's sitemaps by level and order, with the entries of each and the addresses kept of it."""
    return sitemap_fetches(spark, sf, frontier.LAYERED).select(KEY, "level", "place", "url", "status_code", "is_index", "url_count", F.size("locs").alias("n_discovered"), F.array_join("locs", ",").alias("discovered"))


def sitemap_fetches_sql(discovery: bool) -> str:
    """All that a policy fetches, over the stand-ins' tables; robots.txt as worked out above."""
    well = ", ".join(f"concat(root, '{p}')" for p in WELL_KNOWN)
    maps = "d_sitemaps" if discovery else "l_sitemaps"
    listed = f"CASE WHEN {maps} = '' THEN [] ELSE string_split({maps}, ',') END"
    urls = f"CASE WHEN {maps} = '' THEN [{well}] ELSE string_split({maps}, ',') END" if discovery else f"list_concat({listed}, [{well}])"
    first = "SELECT page_id, CAST(k AS INTEGER) AS place, url, blocked FROM s" if discovery else "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS place, url, blocked FROM (SELECT page_id, url, min(k) AS k, any_value(blocked) AS blocked FROM s GROUP BY 1, 2)"
    index = "len(list_filter(locs, lambda x: contains(x, 'sitemap') AND ends_with(x, '.xml'))) > 0" if discovery else "contains(content, '<sitemapindex')"
    most, of_index = (3, 2) if discovery else (5, 5)
    left = "5" if discovery else "5 - n"
    # Of the files of robots.txt that the stand-in hands out none blocks a sitemap.
    answer = lambda level, front: f"SELECT f.page_id, {level} AS level, f.place, f.url, a.status_code, coalesce(a.is_index, false) AS is_index, CASE WHEN a.is_index THEN 0 ELSE coalesce(a.n, 0) END AS url_count, coalesce(a.locs, []) AS locs FROM {front} f LEFT JOIN a ON a.page_id = f.page_id AND a.url = f.url"
    return rf"""
    WITH r AS (SELECT * FROM ({robots_variants_sql()})), p AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root FROM pages),
    s AS (SELECT page_id, unnest(urls) AS url, unnest(range(1, len(urls) + 1)) AS k, false AS blocked FROM (SELECT page_id, {urls} AS urls FROM p JOIN r USING (page_id))),
    f0 AS (SELECT * FROM ({first}) WHERE place <= {most}),
    a AS (SELECT page_id, url, status_code, {index} AS is_index, locs, CAST(len(regexp_extract_all(content, '(?i)<url>')) AS INTEGER) AS n FROM (
      SELECT page_id, url, status_code, CASE WHEN status_code BETWEEN 200 AND 399 THEN content END AS content, list_transform(regexp_extract_all(CASE WHEN status_code BETWEEN 200 AND 399 THEN content END, '(?is)<loc>\s*([^<]+?)\s*</loc>', 1), lambda x: trim(x)) AS locs FROM ({ingest.sql('sitemaps', 'duck')}))),
    t0 AS ({answer(0, 'f0')}), n AS (SELECT page_id, count(*) AS n FROM f0 GROUP BY 1),
    c AS (SELECT page_id, place AS parent, unnest(list_slice(locs, 1, {of_index})) AS url, unnest(range(1, len(list_slice(locs, 1, {of_index})) + 1)) AS k FROM t0 WHERE is_index),
    f1 AS (SELECT page_id, place, url FROM (SELECT page_id, url, {left} AS budget, CAST(row_number() OVER (PARTITION BY page_id ORDER BY parent, k) AS INTEGER) AS place FROM c JOIN n USING (page_id)) WHERE place <= budget),
    t1 AS ({answer(1, 'f1')})
    SELECT * FROM t0 UNION ALL SELECT * FROM t1"""


def sitemap_tree_sql() -> str:
    return f"SELECT page_id, CAST(level AS INTEGER) AS level, place, url, status_code, is_index, url_count, CAST(len(list_slice(locs, 1, 100)) AS INTEGER) AS n_discovered, array_to_string(list_slice(locs, 1, 100), ',') AS discovered FROM ({sitemap_fetches_sql(False)})"


def catalogue() -> dict:
    """name -> (query, SQL)."""
    return {
        "site_signals": (lambda spark, sf: project(signals(spark, sf), flat(SPARK)), select(flat(DUCK), signals_sql())),
        "signal_log": (signal_log, signal_log_sql()),
        "risk_scores": (risk_scores, f"SELECT * EXCLUDE (applied) FROM ({assessments_sql()})"),
        "risk_reasons": (risk_reasons, risk_reasons_sql()),
        "signal_paths": (signal_paths, signal_paths_sql()),
        "failed_assessments": (failed_assessments, "SELECT id, 0 AS phishing, 0 AS shell_company, 0 AS compliance, 0 AS overall, 0 AS confidence, 'shell_company' AS primary_type, 'Assessment failed: Invalid URL: ' || input AS notes FROM (SELECT page_id AS id, url AS input FROM pages UNION ALL SELECT c_custkey, c_name FROM customer) WHERE NOT (starts_with(lower(input), 'http://') OR starts_with(lower(input), 'https://'))"),
        "scoring_log": (scoring_log, scoring_log_sql()),
        "ai_likelihood": (ai_likelihood, select(ai_flat(DUCK), ai_sql())),
        "ai_layered": (ai_layered, ai_layered_sql()),
        "contact_candidates": (lambda spark, sf: project(contact_rows(spark, sf), contact_flat(SPARK)), select(contact_flat(DUCK), contact_sql())),
        "contact_pages": (contact_pages, contact_pages_sql()),
        "robots_rules": (robots_variants, robots_variants_sql()),
        "sitemap_parse": (sitemap_parse, sitemap_parse_sql()),
        "sitemap_tree": (sitemap_tree, sitemap_tree_sql()),
    }
