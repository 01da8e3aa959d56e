"""Queries over registrations, fetches, stored rows and what is shown of them, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import dom, registration, requests
from ..functions import pages as P
from ..functions import values as V
from ..functions.dialect import DUCK, SPARK
from ..operators import datapoints, frontier, keyed_store, nested, sinks
from ..operators import relational as R
from ..sources import ingest, views
from ..streaming import state, timers
from . import compare_queries, dom_queries, page_queries, site_queries
from .relational_queries import AS_OF, S, scans, t

# ---- registrations

#: Ages of registrations are counted to here.
REGISTERED_BY, REGISTERED_BY_SECONDS = "1999-01-01", 915148800
TLDS = ["com", "io", "museum", "de"]
#: How a registry may put a date (pattern for Spark, for DuckDB, text around it), and the form of a text without one.
FORMS = [
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", "Domain Name: X\nCreation Date: {d}\nRegistrar: One Registrar  \n"), ("yyyy-MM-dd", "%Y-%m-%d", "Created: {d}\nSponsoring Registrar: Two"), ("dd-MMM-yyyy", "%d-%b-%Y", "  Registered on: {d}\n  Registrar:\n Three"),
    ("yyyy/MM/dd", "%Y/%m/%d", "[Created on]   {d}"), ("dd.MM.yyyy", "%d.%m.%Y", "created: {d}\nregistrar: FOUR-REG"), ("MMMM dd, yyyy", "%B %d, %Y", "Creation Date: {d}"), ("dd MMM yyyy", "%d %b %Y", "Registered on: {d}"), ("yyyy-MM-dd", "%Y-%m-%d", "Registration Time: {d}"), ("yyyy", "%Y", "since {d}\nRegistrar: Five"),
]
REGISTRAR = ["One Registrar", "Two", "Three", None, "FOUR-REG", None, None, None, "Five"]


def registrations(spark, sf) -> DataFrame:
    """o_orderkey, domain, answered, body, text: what registries say, in the forms in which they do."""
    texts = "CASE o_orderkey % " + str(len(FORMS)) + " " + " ".join(f"WHEN {k} THEN replace('{x}', '{{d}}', date_format(o_orderdate, '{f.replace(chr(39), chr(92) + chr(39))}'))" for k, (f, _, x) in enumerate(FORMS)) + " END"
    texts = texts.replace("\n", "\\n")
    stamp = "date_format(o_orderdate, 'yyyy-MM-dd')"
    card = """concat('{"roles":["registrar"],"handle":"H', o_orderkey, '"', CASE WHEN o_orderkey % 2 = 0 THEN concat(',"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Card ', o_orderkey, '"]]]') ELSE '' END, '}')"""
    body = f"""concat('{{"events":[{{"eventAction":"last changed","eventDate":"2001-01-01T00:00:00Z"}},{{"eventAction":"registration","eventDate":"', {stamp}, 'T00:00:00Z"}},{{"eventAction":"registration","eventDate":"1900-01-01T00:00:00Z"}}],"entities":[{{"roles":["abuse"],"handle":"A"}},', {card}, '],"status":["active"]}}')"""
    tld = "element_at(array(" + ", ".join(f"'{x}'" for x in TLDS) + "), CAST(o_orderkey % 4 AS INT) + 1)"
    return t(spark, sf, "orders").selectExpr("o_orderkey", f"concat('D', o_orderkey, '.', {tld}) AS domain", "o_orderkey % 5 <> 3 AS answered", f"{body} AS body", f"{texts} AS text")


def registration_lookup(spark, sf):
    """What is known of each domain, from JSON or text, its age and the points that the age takes."""
    df = registration.looked_up(registrations(spark, sf))
    listed = registration.listed(F.lower(F.substring_index("domain", ".", -1)))
    out = df.select("o_orderkey", listed.alias("listed"), "created", "changed", "registrar", F.array_join("status", ",").alias("status"), "error", "server", "source", registration.age_days(F.col("created"), REGISTERED_BY_SECONDS).alias("days"))
    return out.withColumns({"years": F.round(F.col("days") / 365.25, 1) + 0.0, "points": F.expr(age_points())})


def age_points() -> str:
    s = V.SHELL
    tiers = [(30, "domain_age_under_30_days"), (90, "domain_age_under_90_days"), (180, "domain_age_under_180_days"), (365, "domain_age_under_1_year"), (730, "domain_age_under_2_years")]
    return "CASE WHEN days IS NULL THEN 0 " + " ".join(f"WHEN days < {n} THEN {s[k]}" for n, k in tiers) + " ELSE 0 END"


def registration_sql() -> str:
    """From the dates themselves, not from what the registries make of them."""
    tld = "[" + ", ".join(f"'{x}'" for x in TLDS) + "][o_orderkey % 4 + 1]"
    servers = "CASE tld WHEN 'com' THEN 'https://rdap.verisign.com/com/v1/' WHEN 'de' THEN 'https://rdap.denic.de/' WHEN 'museum' THEN 'https://rdap.org/' END"
    named = "CASE o_orderkey % 9 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(REGISTRAR) if x) + " END"
    # The stamp of the first form keeps its time of day.
    written = "CASE WHEN o_orderkey % 9 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN o_orderkey % 9 < 8 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') END"
    inner = f"SELECT o_orderkey, o_orderdate, {tld} AS tld, o_orderkey % 5 <> 3 AND {tld} <> 'io' AS rdap, {named} AS named, {written} AS written FROM orders"
    mid = f"""SELECT o_orderkey, tld IN ('com', 'de') AS listed, CASE WHEN rdap THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') ELSE written END AS created, CASE WHEN rdap THEN '2001-01-01T00:00:00Z' END AS changed,
      CASE WHEN NOT rdap THEN named WHEN o_orderkey % 2 = 0 THEN concat('Card ', o_orderkey) ELSE concat('H', o_orderkey) END AS registrar, CASE WHEN rdap THEN 'active' ELSE '' END AS status,
      CASE WHEN NOT rdap AND written IS NULL THEN '{V.NO_DATES}' END AS error, CASE WHEN rdap THEN {servers} END AS server, CASE WHEN rdap THEN 'rdap' WHEN written IS NOT NULL THEN 'whois' END AS source FROM ({inner})"""
    aged = f"SELECT *, CAST(floor(({REGISTERED_BY_SECONDS} - epoch(strptime(created, '%Y-%m-%dT%H:%M:%SZ'))) / 86400) AS INTEGER) AS days FROM ({mid})"
    return f"SELECT *, round(days / 365.25::DOUBLE, 1) + 0.0::DOUBLE AS years, {age_points()} AS points FROM ({aged})"


# ---- fetches

#: Redirects that a fetch follows, and characters of a body that it keeps.
REDIRECTS, BODY = 10, 512 * 1024


def fetch_outcomes(spark, sf):
    """Where a chain of answers ends: at the first that is no redirect, that leads off the site, or after ten."""
    df = ingest.read(spark, sf, "hops").join(t(spark, sf, "pages").select("page_id", F.expr(SPARK.sub(P.host(SPARK), r"^www\.", "")).alias("own")), "page_id")
    host = F.expr(SPARK.sub(P.host(SPARK, "location"), r"^www\.", ""))
    off = F.coalesce((host != F.col("own")) & ~host.endswith(F.concat(F.lit("."), "own")), F.lit(False))
    stop = ~F.col("status_code").between(300, 399) | F.col("location").isNull() | off | (F.col("hop") >= REDIRECTS)
    ends = df.withColumns({"stop": stop, "off": off}).groupBy("page_id").agg(F.min(F.when(F.col("stop"), F.struct("hop", "status_code", "url", "location", "off"))).alias("x"))
    foreign = F.col("x.off") & F.col("x.status_code").between(300, 399)
    final = F.when(foreign, F.col("x.location")).otherwise(F.col("x.url"))
    ok = F.coalesce(F.col("x.status_code").between(200, 399), F.lit(False))
    return ends.select("page_id", F.col("x.hop").alias("redirects"), F.col("x.status_code").alias("status_code"), final.alias("final_url"), F.coalesce(foreign, F.lit(False)).alias("left_site"), ok.alias("ok"))


def fetch_outcomes_sql() -> str:
    """The stand-in's chains have page_id % 13 redirects, every eleventh page's leading off the site at the second."""
    return """SELECT page_id, CAST(n AS INTEGER) AS redirects, CAST(CASE WHEN n = page_id % 13 AND NOT off THEN CASE WHEN page_id % 4 = 3 THEN 500 ELSE 200 END ELSE 302 END AS INTEGER) AS status_code,
      CASE WHEN off THEN 'https://far.example.net/' ELSE concat(origin, '/hop', n) END AS final_url, off AS left_site, off OR n < page_id % 13 OR page_id % 4 <> 3 AS ok
      FROM (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS origin, page_id % 11 = 5 AND page_id % 13 >= 2 AS off, CASE WHEN page_id % 11 = 5 AND page_id % 13 >= 2 THEN 1 ELSE least(10, page_id % 13) END AS n FROM pages)"""


#: Marks of shops that scripts draw, and links to products from which such a page counts as whole.
DRAWN_SHOPS, SHOP_LINKS = ["shoplazza", "window.__shoplazza", "cdn.shopify.com", "Shopify.theme"], 5


def page_marks(q) -> dict[str, str]:
    """What of a fetched page (h) tells whether a browser must draw it."""
    drawn = "(" + " OR ".join(f"contains(h, '{m}')" for m in DRAWN_SHOPS) + ")"
    return {
        "empty_shop": f"({drawn} AND CAST({q.count('h', '(?i)/products?/')} AS INT) < {SHOP_LINKS})",
        "challenge": "(" + " OR ".join(f"contains(h, '{m}')" for m in V.CHALLENGE_MARKS) + " OR (contains(h, 'Enable JavaScript') AND length(h) < 10000))",
        "scripted": C.any_of(q, "h", V.SCRIPTED), "fetched": "CAST(length(h) AS INT)",
    }


def source_columns() -> dict[str, str]:
    """Which reading of a page is taken, over page_marks(), its answer and how long it is as drawn."""
    ok = "coalesce(status_code BETWEEN 200 AND 399 AND contains(content_type, 'text/html'), false)"
    lost, better = f"(NOT {ok} OR challenge OR empty_shop)", "(scripted AND coalesce(drawn > fetched, false))"
    return {
        "empty_shop": "empty_shop", "challenge": "challenge", "escalated": "(coalesce(status_code IN (401, 403), false) OR scripted)",
        "source": f"CASE WHEN {lost} THEN CASE WHEN drawn IS NULL THEN 'none' ELSE 'browser' END WHEN {better} THEN 'browser' ELSE 'http' END", "kept": f"CASE WHEN {lost} OR {better} THEN drawn ELSE fetched END",
    }


def page_source(spark, sf):
    """Whether a page is read as it was fetched or as a browser drew it. Both are reduced to marks and lengths before they meet."""
    drawn = ingest.read(spark, sf, "renders").select("page_id", F.length("html").alias("drawn"))
    page = page_queries.project(views.pages(spark, sf), page_marks(SPARK))
    df = page.join(ingest.read(spark, sf, "fetches").select("page_id", "status_code", "content_type"), "page_id", "left").join(drawn, "page_id", "left")
    return page_queries.project(df, source_columns())


def page_source_sql() -> str:
    marks = page_queries.select(page_marks(DUCK), views.pages_sql())
    return page_queries.select(source_columns(), f"SELECT m.*, CAST(length(r.html) AS INTEGER) AS drawn, f.status_code, f.content_type FROM ({marks}) m LEFT JOIN ({ingest.sql('renders', 'duck')}) r USING (page_id) LEFT JOIN ({ingest.sql('fetches', 'duck')}) f USING (page_id)")


def artifact_store(spark, sf):
    """Pages as they are stored: cut html and text, and hashes of the whole."""
    df = page_queries.texts(spark, sf).select("page_id", *sinks.artifact("h", "t", V.STORED_HTML, V.STORED_TEXT))
    return df.select("page_id", F.length("html_snippet").alias("html_kept"), F.length("text_snippet").alias("text_kept"), "html_sha256", "text_sha256", F.md5("text_snippet").alias("text_md5"))


def artifact_store_sql() -> str:
    return f"SELECT page_id, CAST(length(substr(h, 1, {V.STORED_HTML})) AS INTEGER) AS html_kept, CAST(length(substr(t, 1, {V.STORED_TEXT})) AS INTEGER) AS text_kept, sha256(h) AS html_sha256, sha256(t) AS text_sha256, md5(substr(t, 1, {V.STORED_TEXT})) AS text_md5 FROM ({page_queries.with_text(DUCK)})"


#: For how long a stored page is taken instead of a new one.
TTL = "INTERVAL 24 HOURS"


def cached_artifacts(spark, sf):
    """For each domain the latest stored result of a day, where that one is good; else it must be fetched anew."""
    day = scans(spark, sf).filter(F.col("created_at") >= F.expr(f"timestamp'{AS_OF}' - interval 24 hours"))
    last = R.latest_per_key(day, ["domain_id"], "created_at", "scan_id").filter("status = 'completed'").select("domain_id", "scan_id")
    ids = scans(spark, sf).select("domain_id").distinct()
    return ids.join(last, "domain_id", "left").select("domain_id", "scan_id", F.col("scan_id").isNull().alias("fetch"))


def cached_artifacts_sql() -> str:
    last = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC, scan_id DESC) AS k FROM {S} WHERE created_at >= TIMESTAMP '{AS_OF}' - {TTL}) WHERE k = 1 AND status = 'completed'"
    return f"SELECT domain_id, l.scan_id, l.scan_id IS NULL AS fetch FROM (SELECT DISTINCT domain_id FROM {S}) LEFT JOIN ({last}) l USING (domain_id)"


# ---- read models

#: Score above which a domain is shown as risky.
HIGH_RISK = 60


def dashboard_totals(spark, sf):
    """All sites, active ones, those seen on the last day, and risky ones."""
    risk = site_queries.assessments(spark, sf).select("page_id", "overall")
    df = ingest.read(spark, sf, "fetches").select("page_id", F.col("status_code").between(200, 399).alias("active"), "latency_ms").join(risk, "page_id", "left")
    return df.agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.count_if(F.col("overall") > HIGH_RISK).alias("high_risk"), F.sum("latency_ms").cast("long").alias("latency"))


def dashboard_totals_sql() -> str:
    return f"SELECT count(*) AS total, count(*) FILTER (WHERE status_code BETWEEN 200 AND 399) AS active, count(*) FILTER (WHERE overall > {HIGH_RISK}) AS high_risk, CAST(sum(latency_ms) AS BIGINT) AS latency FROM ({ingest.sql('fetches', 'duck')}) LEFT JOIN ({site_queries.assessments_sql()}) USING (page_id)"


#: Rows of each relation that a domain's page shows.
SHOWN = {"scans": 10, "logs": 100, "inputs": 10}


def domain_detail(spark, sf):
    """A domain with its latest scans, logs, inputs, data points, notes, orders and flag, each as one list; none is empty text."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("domain_id"), "event_id", "event_type", "ts", "value")

    def listed(df: DataFrame, name: str, order: list, text, k: int | None) -> DataFrame:
        if k:
            df = R.top_per_parent(df, "domain_id", order, k)
        else:
            df = df.withColumn("rank", F.row_number().over(R.W.partitionBy("domain_id").orderBy(*order)))
        return df.groupBy("domain_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("x")))), lambda r: r["x"]), ",").alias(name))

    newest = [F.desc("ts"), F.desc("event_id")]
    ids = F.col("event_id").cast("string")
    points = R.latest_per_key(e, ["domain_id", "event_type"], "ts", "event_id")
    notes = t(spark, sf, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("domain_id"), "turn", F.length("text").alias("n"))
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("domain_id"), "o_orderkey", "o_orderdate")
    parts = [
        listed(e, "scans", newest, ids, SHOWN["scans"]), listed(e.filter("event_type = 'view'"), "logs", [F.asc("ts"), F.asc("event_id")], ids, SHOWN["logs"]), listed(e.filter("event_type = 'click'"), "inputs", newest, ids, SHOWN["inputs"]),
        listed(points, "points", [F.asc("event_type")], F.concat_ws(":", "event_type", ids), None), listed(notes, "notes", [F.desc("turn"), F.desc("n")], F.concat_ws(":", F.col("turn").cast("string"), F.col("n").cast("string")), None),
        listed(orders, "orders", [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderkey").cast("string"), SHOWN["inputs"]),
    ]
    df = t(spark, sf, "customer").select(F.col("c_custkey").alias("domain_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("flagged"))
    for part in parts:
        df = df.join(part, "domain_id", "left")
    return df.na.fill("", ["scans", "logs", "inputs", "points", "notes", "orders"])


def domain_detail_sql() -> str:
    newest = "ts DESC, event_id DESC"
    ranked = lambda source, order, key="user_id": f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {source}"
    part = lambda name, source, order, text, k, key="user_id": f"(SELECT {key} AS domain_id, string_agg({text}, ',' ORDER BY k) AS {name} FROM ({ranked(source, order, key)}) WHERE k <= {k} GROUP BY 1) {name}_"
    points = f"({ranked('events', newest, 'user_id, event_type').replace('AS k', 'AS latest')})"
    parts = {
        "scans": part("scans", "events", newest, "event_id", SHOWN["scans"]), "logs": part("logs", "(SELECT * FROM events WHERE event_type = 'view')", "ts, event_id", "event_id", SHOWN["logs"]),
        "inputs": part("inputs", "(SELECT * FROM events WHERE event_type = 'click')", newest, "event_id", SHOWN["inputs"]), "points": part("points", f"(SELECT * EXCLUDE (latest) FROM {points} WHERE latest = 1)", "event_type", "event_type || ':' || event_id", 1 << 40),
        "notes": part("notes", "(SELECT * FROM conversations WHERE role = 'user')", "turn DESC, length(text) DESC", "concat_ws(':', turn, length(text))", 1 << 40, "conv_id"), "orders": part("orders", "orders", "o_orderdate DESC, o_orderkey DESC", "o_orderkey", SHOWN["inputs"], "o_custkey"),
    }
    joins = " ".join(f"LEFT JOIN {sql} ON {n}_.domain_id = c_custkey" for n, sql in parts.items())
    return f"SELECT c_custkey AS domain_id, c_name AS name, c_acctbal < 0 AS flagged, {', '.join(f'coalesce({n}, {chr(39) * 2}) AS {n}' for n in parts)} FROM customer {joins}"


#: Rows of a page of domains, and where it begins: after the domain that was checked then.
PAGE, AFTER = 50, ("2001-03-01 00:00:00", 1 << 40)


def checked_domains(spark, sf) -> DataFrame:
    """Domains with the moment of their last scan; null without any."""
    last = t(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_checked"))
    domains = t(spark, sf, "customer").select(F.col("c_custkey").alias("domain_id"), F.col("c_name").alias("name"))
    return domains.join(last, F.col("domain_id") == F.col("o_custkey"), "left").drop("o_custkey")


def domain_relations(spark, sf, scans: int, inputs: int, details: bool) -> list[nested.Relation]:
    """Scans of a domain with their logs and signals, its latest data points, inputs and notes."""
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    lines = t(spark, sf, "lineitem")
    below = [
        nested.Relation("logs", lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_orderkey", [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], ["l_linenumber", "l_returnflag"], SHOWN["logs"]),
        nested.Relation("signals", lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_linestatus"), "l_orderkey", [F.asc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey")], ["l_linenumber", "l_linestatus"], SHOWN["logs"]),
    ]
    events = t(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    points = R.latest_per_key(events, ["user_id", "event_type"], "ts", "event_id")
    notes = t(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("n"))
    out = [
        nested.Relation("scans", orders, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], ["o_orderkey", "o_orderstatus"], scans, "o_orderkey", below if details else []),
        nested.Relation("points", points, "user_id", [F.asc("event_type")], ["event_type", "event_id"]),
        nested.Relation("inputs", events.filter("event_type = 'click'"), "user_id", [F.desc("ts"), F.desc("event_id")], ["event_id"], inputs),
    ]
    return out + [nested.Relation("notes", notes, "conv_id", [F.desc("turn"), F.desc("n")], ["turn", "n"])] * details


def as_text(name: str, item) -> Column:
    """An array of structs as text: items by commas."""
    return F.array_join(F.transform(name, item), ",").alias(name)


def domain_page(spark, sf):
    """A page of domains, the last checked first, each with ten scans and their logs and signals, data points, inputs and notes."""
    rows = nested.cursor_list(checked_domains(spark, sf), "last_checked", "domain_id", AFTER, PAGE, domain_relations(spark, sf, SHOWN["scans"], SHOWN["inputs"], True))
    part = lambda a, b: lambda x: F.concat_ws(":", x[a].cast("string"), x[b].cast("string"))
    logs = lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"], F.array_join(F.transform(x["logs"], part("l_linenumber", "l_returnflag")), "+"), F.array_join(F.transform(x["signals"], part("l_linenumber", "l_linestatus")), "+"))
    return rows.select("place", "domain_id", "name", "has_more", "next_cursor", as_text("scans", logs), as_text("points", part("event_type", "event_id")), as_text("inputs", lambda x: x["event_id"].cast("string")), as_text("notes", part("turn", "n")))


def domain_list(spark, sf):
    """The first page of the list of domains: the latest scan, five inputs and the data points of each."""
    rows = nested.cursor_list(checked_domains(spark, sf), "last_checked", "domain_id", None, 100, domain_relations(spark, sf, 1, 5, False))
    part = lambda a, b: lambda x: F.concat_ws(":", x[a].cast("string"), x[b].cast("string"))
    return rows.select("place", "domain_id", "name", "has_more", "next_cursor", as_text("scans", part("o_orderkey", "o_orderstatus")), as_text("points", part("event_type", "event_id")), as_text("inputs", lambda x: x["event_id"].cast("string")))


def domain_page_sql(after: tuple | None, size: int, scans: int, inputs: int, details: bool) -> str:
    begin = f"WHERE last_checked < TIMESTAMP '{after[0]}' OR last_checked = TIMESTAMP '{after[0]}' AND domain_id < {after[1]}" if after else ""
    listed = lambda name, key, text, source, order, k: f"{name} AS (SELECT {key} AS id, string_agg({text}, ',' ORDER BY k) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {source}) WHERE k <= {k} GROUP BY 1)"
    lines = lambda name, text, order: f"{name} AS (SELECT l_orderkey, string_agg({text}, '+' ORDER BY k) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS k FROM lineitem) WHERE k <= {SHOWN['logs']} GROUP BY 1)"
    text = "concat_ws(':', o_orderkey, o_orderstatus, coalesce(logs, ''), coalesce(signals, ''))" if details else "concat_ws(':', o_orderkey, o_orderstatus)"
    parts = {
        "scans": listed("scans", "o_custkey", text, "(SELECT * FROM orders LEFT JOIN logs ON logs.l_orderkey = o_orderkey LEFT JOIN signals ON signals.l_orderkey = o_orderkey)", "o_orderdate DESC, o_orderkey DESC", scans),
        "points": listed("points", "user_id", "event_type || ':' || event_id", "(SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2)", "event_type", 1 << 40),
        "inputs": listed("inputs", "user_id", "CAST(event_id AS VARCHAR)", "(SELECT * FROM events WHERE event_type = 'click')", "ts DESC, event_id DESC", inputs),
    } | ({"notes": listed("notes", "conv_id", "concat_ws(':', turn, length(text))", "(SELECT * FROM conversations WHERE role = 'user')", "turn DESC, length(text) DESC", 1 << 40)} if details else {})
    return f"""
    WITH d AS (SELECT c_custkey AS domain_id, c_name AS name, max(o_orderdate) AS last_checked FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    p AS (SELECT *, CAST(row_number() OVER (ORDER BY last_checked DESC NULLS FIRST, domain_id DESC) AS INTEGER) AS place, count(*) OVER () > {size} AS has_more FROM d {begin}),
    {lines("logs", "concat_ws(':', l_linenumber, l_returnflag)", "l_linenumber, l_partkey, l_suppkey")}, {lines("signals", "concat_ws(':', l_linenumber, l_linestatus)", "l_shipdate, l_partkey, l_suppkey")}, {", ".join(parts.values())}
    SELECT place, domain_id, name, has_more, CASE WHEN has_more THEN last(domain_id) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_cursor, {", ".join(f"coalesce({n}, '') AS {n}" for n in parts)}
    FROM (SELECT * FROM p WHERE place <= {size}) p {" ".join(f"LEFT JOIN {n} ON {n}.id = domain_id" for n in parts)}"""


#: Scans that a batch takes: as asked, fifty at most, ten where nothing is asked.
def batch_size(asked: int | None = None) -> int:
    return min(asked if asked is not None else 10, 50)


def batch_outcomes(spark, sf):
    """The batch of domains without a purchase that were seen last, and how many of their latest scans are good."""
    done = t(spark, sf, "events").filter("event_type = 'purchase' AND value > 100").select(F.col("user_id").alias("domain_id"))
    last = R.latest_per_key(scans(spark, sf), ["domain_id"], "created_at", "scan_id").join(done, "domain_id", "left_anti")
    batch = last.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(batch_size(80))
    return batch.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"))


BATCH_SQL = f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS success, count(*) FILTER (WHERE status = 'failed') AS failed FROM (SELECT status FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC, scan_id DESC) AS k FROM {S}) WHERE k = 1 AND domain_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100) ORDER BY created_at DESC, scan_id DESC LIMIT 50)"


def sort_order(field: str, descending: bool = True) -> list:
    """Order of a list of offers by a field that may be chosen; any other means the newest. Nulls count as greatest, as stores do."""
    field = {"amount": "amount", "title": "title", "confidence": "confidence"}.get(field, "created")
    return [F.col(field).desc_nulls_first() if descending else F.col(field).asc_nulls_last(), F.col("id")]


def history_page(spark, sf):
    """A page of comparisons of a score at least, with the text in either name, best first, and how many pages there are."""
    names = t(spark, sf, "customer").select("c_custkey", "c_name")
    df = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.pmod(F.floor("o_totalprice"), F.lit(101)).cast("int").alias("score"), F.col("o_orderpriority").alias("other"))
    df = df.filter("score >= 40").join(names, F.col("o_custkey") == F.col("c_custkey"))
    found = R.search(df, ["c_name", "other"], "hi")
    size, page = 20, 2
    total = found.agg(F.count("*").alias("total"))
    rows = R.offset_page(found.select("id", "score"), [F.desc("score"), F.desc("id")], page, size)
    return rows.withColumn("total", total.scalar()).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


HISTORY_SQL = "WITH f AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) % 101 AS INTEGER) AS score FROM orders JOIN customer ON o_custkey = c_custkey WHERE floor(o_totalprice) % 101 >= 40 AND (contains(lower(c_name), 'hi') OR contains(lower(o_orderpriority), 'hi'))) SELECT id, score, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 20.0) AS BIGINT) AS pages FROM f ORDER BY score DESC, id DESC LIMIT 20 OFFSET 20"


def offer_page(spark, sf):
    """Offers of a page by amount, those without one first; and the summary, whose share of priced offers is of all offers over those found."""
    o = views.view(spark, sf, views.OFFERS).select(F.concat_ws("-", F.col("order_id").cast("string"), F.col("pos").cast("string")).alias("id"), "title", F.when(F.col("pos") != 3, F.round("amount", 4)).alias("amount"), F.lit(None).cast("int").alias("confidence"), F.lit(0).alias("created"))
    found = R.search(o, ["title"], "an")
    rows = R.offset_page(found.select("id", "title", "amount", "confidence", "created"), sort_order("amount"), 1, 50).select("id", "amount")
    one = lambda df, c: df.agg(c).scalar()
    out = rows.withColumns({"total": one(found, F.count("*")), "with_price": one(o, F.count_if(F.col("amount").isNotNull())), "average": one(found, F.round(F.avg("amount"), 4))})
    return out.withColumn("percent", F.when(F.col("total") > 0, F.floor(100 * F.col("with_price") / F.col("total") + 0.5)).otherwise(0).cast("long"))


OFFER_SQL = f"WITH o AS (SELECT concat_ws('-', order_id, pos) AS id, title, CASE WHEN pos <> 3 THEN round(amount, 4) END AS amount FROM ({views.OFFERS})), f AS (SELECT * FROM o WHERE contains(lower(title), 'an')), s AS (SELECT count(*) AS total, round(avg(amount), 4) AS average, (SELECT count(amount) FROM o) AS with_price FROM f) SELECT id, amount, total, with_price, average, CAST(CASE WHEN total > 0 THEN floor(100.0::DOUBLE * with_price / total + 0.5) ELSE 0 END AS BIGINT) AS percent FROM (SELECT id, amount FROM f ORDER BY amount DESC NULLS FIRST, id LIMIT 50), s"


#: For how long a scan without an end counts as running.
RUNNING = "5 minutes"
MEANINGFUL = ["domain_risk_assessment", "ai_generated_likelihood", "domain_intel_signals", "homepage_sku_summary", "contact_details", "policy_links"]
#: Which of an event's types stands for which kind of data.
POINT_KEYS = dict(zip(["purchase", "signup", "view", "click", "error"], [*MEANINGFUL[:4], "other"]))


def scan_table(spark, sf):
    """Domains in order of their last check (never counts as longest ago), with the status that is shown and whether a scan still runs."""
    last = R.latest_per_key(scans(spark, sf), ["domain_id"], "created_at", "scan_id")
    key = F.create_map(*(F.lit(x) for kv in POINT_KEYS.items() for x in kv))
    data = t(spark, sf, "events").filter("value > 20").filter(key[F.col("event_type")].isin(MEANINGFUL)).select(F.col("user_id").alias("domain_id")).distinct().withColumn("has", F.lit(True))
    df = t(spark, sf, "customer").select(F.col("c_custkey").alias("domain_id")).join(last, "domain_id", "left").join(data, "domain_id", "left")
    shown = F.when((F.col("status") == "failed") & F.coalesce("has", F.lit(False)), "completed").otherwise(F.col("status"))
    running = F.col("status").isin("pending", "processing") & (F.col("created_at") > F.expr(f"timestamp'{AS_OF}' - interval {RUNNING}"))
    df = df.select("domain_id", shown.alias("status"), F.coalesce(running, F.lit(False)).alias("running"), "created_at")
    return df.orderBy(F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).desc(), "domain_id").select("domain_id", "status", "running")


SCAN_TABLE_SQL = f"SELECT c_custkey AS domain_id, CASE WHEN status = 'failed' AND EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND value > 20 AND event_type <> 'error') THEN 'completed' ELSE status END AS status, coalesce(status IN ('pending', 'processing') AND created_at > TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTES, false) AS running FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC, scan_id DESC) AS k FROM {S}) WHERE k = 1) ON domain_id = c_custkey"


def notes_newest(spark, sf):
    """Notes of a conversation, the newest first, as reviews (of users) or notes."""
    df = t(spark, sf, "conversations").withColumn("place", F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC)"))
    return df.select("conv_id", "place", "turn", F.when(F.col("role") == "user", "review").otherwise("note").alias("kind"))


def fetch_log(spark, sf):
    """Every fetch of a scan in order, and the first by source."""
    logs = views.view(spark, sf, views.LOGS).withColumn("source", F.element_at(F.array(F.lit("robots"), F.lit("homepage"), F.lit("sitemap")), (F.col("log_id") % 3 + 1).cast("int")))
    place = F.expr("row_number() OVER (PARTITION BY domain_id ORDER BY created_at, log_id)")
    good = F.min(F.when(F.col("status_code").between(200, 399), F.struct("source", "log_id"))).over(R.W.partitionBy("domain_id"))["log_id"]
    return logs.select("domain_id", "log_id", place.alias("place"), good.alias("first_good"))


FETCH_LOG_SQL = f"WITH l AS (SELECT *, ['robots', 'homepage', 'sitemap'][log_id % 3 + 1] AS source FROM ({views.LOGS})), g AS (SELECT domain_id, log_id AS first_good FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY source, log_id) AS k FROM l WHERE status_code BETWEEN 200 AND 399) WHERE k = 1) SELECT domain_id, log_id, CAST(row_number() OVER (PARTITION BY domain_id ORDER BY created_at, log_id) AS INTEGER) AS place, first_good FROM l LEFT JOIN g USING (domain_id)"

#: What a reader prefers where nothing is set.
DEFAULTS = {"click": "10", "view": "light", "theme": "system"}


def preferences(spark, sf):
    """The value of each preference: the last that was set, else the default."""
    sets = t(spark, sf, "events").select(F.col("event_type").alias("key"), "event_id", "ts", F.get_json_object("props", "$.k").alias("value"))
    last = R.latest_per_key(sets, ["key"], "ts", "event_id").select("key", F.col("value").alias("own"))
    defaults = spark.createDataFrame(list(DEFAULTS.items()), "key string, value string")
    return defaults.join(last, "key", "full").select("key", F.coalesce("own", "value").alias("value"), F.col("own").isNull().alias("is_default"))


PREFERENCES_SQL = "SELECT coalesce(d.key, l.key) AS key, coalesce(own, value) AS value, own IS NULL AS is_default FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in DEFAULTS.items()) + ") d(key, value) FULL JOIN (SELECT event_type AS key, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS own FROM events GROUP BY 1) l ON d.key = l.key"


def new_scans(spark, sf):
    """What a request to scan an address appends: its domain (once), the input, and a scan; an address that is none appends nothing."""
    asked = t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("input")).unionAll(t(spark, sf, "conversations").select(F.col("conv_id") * 1000 + F.col("turn"), F.col("role")))
    df = page_queries.project(asked, {"domain": P.urls(SPARK, "input")["domain"], "domain_id": P.urls(SPARK, "input")["domain_id"], "input": "input"}, ("id",))
    df = df.filter(F.col("domain").rlike(r"^[^\s.]+(\.[^\s.]+)+\z"))
    first = df.groupBy("domain_id").agg(F.min("id").alias("id"), F.first("domain").alias("value")).select(F.lit("domain").alias("kind"), "domain_id", "id", "value")
    inputs = df.select(F.lit("input").alias("kind"), "domain_id", "id", F.col("input").alias("value"))
    return first.unionAll(inputs).unionAll(df.select(F.lit("scan"), "domain_id", "id", F.lit("pending")))


def new_scans_sql() -> str:
    u = P.urls(DUCK, "input")
    df = f"SELECT id, input, {u['domain']} AS domain, {u['domain_id']} AS domain_id FROM (SELECT page_id AS id, url AS input FROM pages UNION ALL SELECT conv_id * 1000 + turn, role FROM conversations)"
    return rf"WITH d AS (SELECT * FROM ({df}) WHERE regexp_matches(domain, '^[^\s.]+(\.[^\s.]+)+$')) SELECT 'domain' AS kind, domain_id, min(id) AS id, any_value(domain) AS value FROM d GROUP BY domain_id UNION ALL SELECT 'input', domain_id, id, input FROM d UNION ALL SELECT 'scan', domain_id, id, 'pending' FROM d"


def scan_status(spark, sf):
    """The status of an id: that of the scan, else of the latest scan of the domain with that id."""
    last = R.latest_per_key(scans(spark, sf), ["domain_id"], "created_at", "scan_id")
    ids = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return R.resolve(ids, scans(spark, sf), last, "id", "scan_id", "domain_id", "status")


SCAN_STATUS_SQL = f"SELECT o_orderkey AS id, coalesce(s.status, l.status) AS status FROM orders LEFT JOIN ({S}) s ON s.scan_id = o_orderkey LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC, scan_id DESC) AS k FROM {S}) WHERE k = 1) l ON l.domain_id = o_orderkey"

def rescans(spark, sf):
    """What asking for a rescan by a scan's or a domain's id appends: a pending scan of the domain, unless one still runs;
    with how many it has and which one its results are replaced by. An id that is neither appends nothing."""
    s = scans(spark, sf)
    last = R.latest_per_key(s, ["domain_id"], "created_at", "scan_id")
    counts = s.groupBy("domain_id").agg(F.count("*").alias("scans"))
    asked = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    found = R.resolve(asked, s.withColumn("d", F.col("domain_id")), last.withColumn("d", F.col("domain_id")), "id", "scan_id", "domain_id", "d").filter("d IS NOT NULL")
    once = found.groupBy(F.col("d").alias("domain_id")).agg(F.min("id").alias("asked_by"))
    running = F.col("status").isin("pending", "processing") & (F.col("created_at") > F.expr(f"timestamp'{AS_OF}' - interval {RUNNING}"))
    df = once.join(last, "domain_id").filter(~running).join(counts, "domain_id")
    return df.select("domain_id", "asked_by", F.col("scan_id").alias("replaces"), "scans", F.lit("pending").alias("status"))


RESCAN_SQL = f"WITH s AS ({S}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC, scan_id DESC) AS k FROM s) WHERE k = 1), a AS (SELECT coalesce(s.domain_id, l.domain_id) AS d, min(o_orderkey) AS asked_by FROM orders LEFT JOIN s ON s.scan_id = o_orderkey LEFT JOIN l ON l.domain_id = o_orderkey GROUP BY 1) SELECT l.domain_id, asked_by, l.scan_id AS replaces, (SELECT count(*) FROM s x WHERE x.domain_id = l.domain_id) AS scans, 'pending' AS status FROM a JOIN l ON l.domain_id = a.d WHERE NOT (l.status IN ('pending', 'processing') AND l.created_at > TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTES)"


def comparisons_left(spark, sf):
    """Comparisons after those of some pages are deleted, whichever side the page stands on, and how many each page keeps."""
    df = compare_queries.tfidf_pairs(spark, sf).select("a", "b")
    gone = t(spark, sf, "labels").filter("quality = 0").select("doc_id").distinct()
    for side in "ab":
        df = df.join(gone.withColumnRenamed("doc_id", side), side, "left_anti")
    sides = df.select(F.col("a").alias("doc_id")).unionAll(df.select("b"))
    return sides.groupBy("doc_id").agg(F.count("*").alias("n"))


COMPARISONS_LEFT_SQL = f"WITH c AS ({compare_queries.tfidf_sql()}), g AS (SELECT doc_id FROM labels WHERE quality = 0), k AS (SELECT a, b FROM c WHERE a NOT IN (SELECT doc_id FROM g) AND b NOT IN (SELECT doc_id FROM g)) SELECT doc_id, count(*) AS n FROM (SELECT a AS doc_id FROM k UNION ALL SELECT b FROM k) GROUP BY 1"

# Words and colours that scores are shown by (greatest score, text), the last for all above.
SHADES = [(30, "success"), (50, "warning"), (70, "caution"), (None, "destructive")]
RISKS = [(20, "Very Low"), (40, "Low"), (60, "Moderate"), (80, "High"), (None, "Very High")]
LIKELY = [(20, "Very Unlikely"), (40, "Unlikely"), (60, "Uncertain"), (80, "Likely"), (None, "Very Likely")]


def shown(c: str, steps: list) -> str:
    return "CASE " + " ".join(f"WHEN {c} <= {n} THEN '{x}'" if n is not None else f"ELSE '{x}'" for n, x in steps) + " END"


def shown_columns() -> list[str]:
    return [f"{shown('overall', SHADES)} AS shade", f"{shown('overall', RISKS)} AS risk", f"{shown('ai_score', LIKELY)} AS likelihood", "CASE WHEN confidence < 30 THEN 'caution' WHEN confidence < 60 THEN 'warning' ELSE 'success' END AS sureness"]


def scores_shown(spark, sf):
    """How scores are put: shades, risk, likelihood, sureness, and whether anything is known of contacts."""
    known = "size(emails) > 0 OR size(phones) > 0 OR contact_page IS NOT NULL AS has_contact"
    df = site_queries.assessments(spark, sf, known, "ai_score").filter("page_id IS NOT NULL")
    return df.selectExpr("page_id", "has_contact", *shown_columns())


def scores_shown_sql() -> str:
    contact = f"SELECT page_id, len(emails) > 0 OR len(phones) > 0 OR contact_page IS NOT NULL AS has_contact FROM ({site_queries.contact_sql()})"
    return f"SELECT page_id, has_contact, {', '.join(shown_columns())} FROM (SELECT page_id, overall, confidence FROM ({site_queries.assessments_sql()})) JOIN (SELECT page_id, ai_score FROM ({site_queries.ai_sql()})) USING (page_id) JOIN ({contact}) USING (page_id)"


#: Pages that a crawl takes of a site, and how many of them may go first.
CRAWLED, PRIORITY = 50, 10
FIRST_PAGES = ["/contact", "/about", "/team", "/company"]


def crawl_frontier(spark, sf):
    """The pages that a crawl of each site takes: its home page, ten that matter, others up to the cap, each once; with what each is. Addresses come
    from the sitemaps that discovery fetches: three, and five children of those that are indexes."""
    found = frontier.discovered(site_queries.sitemap_fetches(spark, sf, frontier.DISCOVERY))
    matters = F.expr(" OR ".join(f"contains(lower(loc), '{p}')" for p in FIRST_PAGES))
    found = found.withColumn("step", F.when(matters, 1).otherwise(2)).withColumn("k", F.expr("row_number() OVER (PARTITION BY page_id, step ORDER BY at)")).filter(f"step = 2 AND k < {CRAWLED} OR k <= {PRIORITY}")
    every = t(spark, sf, "pages").select("page_id", F.col("url").alias("loc"), F.lit(0).alias("step"), F.lit(0).alias("k")).unionByName(found.select("page_id", "loc", "step", "k"))
    taken = every.withColumn("n", F.expr("row_number() OVER (PARTITION BY page_id ORDER BY step, k)")).filter(F.col("n") <= CRAWLED)
    once = taken.groupBy("page_id", "loc").agg(F.min("n").alias("n")).withColumn("place", F.expr("row_number() OVER (PARTITION BY page_id ORDER BY n)"))
    kind = F.when(F.col("n") == 1, "homepage").when(F.lower("loc").rlike("contact|get-in-touch|reach-us"), "contact_page").otherwise("crawl")
    return once.select("page_id", "place", "loc", kind.alias("kind"))


def crawl_frontier_sql() -> str:
    matters = " OR ".join(f"contains(lower(loc), '{p}')" for p in FIRST_PAGES)
    rows = f"SELECT page_id, level * 1000000000 + place * 1000000 + unnest(range(1, len(locs) + 1)) AS seq, unnest(locs) AS loc FROM ({site_queries.sitemap_fetches_sql(True)}) WHERE NOT is_index OR level > 0"
    found = f"SELECT page_id, loc, min(seq) AS seq, CASE WHEN {matters} THEN 1 ELSE 2 END AS step FROM ({rows}) GROUP BY ALL"
    ranked = f"SELECT page_id, loc, step, row_number() OVER (PARTITION BY page_id, step ORDER BY seq) AS k FROM ({found})"
    every = f"SELECT page_id, url AS loc, 0 AS step, 0 AS k FROM pages UNION ALL SELECT page_id, loc, step, k FROM ({ranked}) WHERE step = 2 OR k <= {PRIORITY}"
    taken = f"SELECT page_id, loc, min(n) AS n FROM (SELECT page_id, loc, row_number() OVER (PARTITION BY page_id ORDER BY step, k) AS n FROM ({every})) WHERE n <= {CRAWLED} GROUP BY 1, 2"
    return f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS INTEGER) AS place, loc, CASE WHEN n = 1 THEN 'homepage' WHEN regexp_matches(lower(loc), 'contact|get-in-touch|reach-us') THEN 'contact_page' ELSE 'crawl' END AS kind FROM ({taken})"


def internal_links(spark, sf):
    """The distinct pages of a site that its page links to, in full and without a slash at the end, as one list."""
    df = dom_queries.links(spark, sf).filter(~dom_queries.no_page("href")).withColumn("to", F.expr(P.host(SPARK, "address"))).withColumn("own", F.expr(P.host(SPARK)))
    df = df.filter("to = own AND to <> ''").select("page_id", F.regexp_replace("address", "/$", "").alias("link")).distinct()
    return df.groupBy("page_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("link")), "\n")).alias("digest"))


def internal_links_sql() -> str:
    return f"SELECT page_id, count(*) AS n, md5(string_agg(link, chr(10) ORDER BY link)) AS digest FROM (SELECT DISTINCT page_id, regexp_replace(address, '/$', '') AS link FROM ({dom_queries.plain_links_sql()})) GROUP BY page_id"


#: Links that lead to contact pages by their text or address, and paths that need no look.
CONTACT_WORDS, CONTACT_PATHS = r"(?i)contact|get in touch|reach us|support", r"(?i)^/(contact|contact-us|contactus|get-in-touch|reach-us|support/contact)(/.*)?\z|/(contact|contact-us|contactus|get-in-touch|reach-us)/?\z"
CONTACT_IN_PATH = "(?i)contact|support|help|enquir|get-in-touch|reach-us"


def contact_links(spark, sf):
    """Links of a page that may lead to its contact page, by text or address, and whether their path alone is trusted."""
    df = dom_queries.links(spark, sf).filter(~dom_queries.no_page("href") & dom_queries.in_scope("address", subdomains=False))
    df = df.withColumn("path", F.lower(F.expr(C.path(SPARK, "address")))).filter(F.expr(f"{SPARK.has('text', CONTACT_WORDS)} OR {SPARK.has('path', CONTACT_IN_PATH)}"))
    probes = ingest.read(spark, sf, "probes").select("page_id", F.col("path"), F.lit("probe").alias("text")).filter(F.col("path").contains("contact"))
    every = df.select("page_id", "path", "text").unionByName(probes)
    return every.select("page_id", "path", "text", F.expr(SPARK.has("path", CONTACT_PATHS)).alias("trusted"))


def contact_links_sql() -> str:
    own = f"SELECT page_id, lower(regexp_extract(address, '^[a-z]+://[^/]*(/.*)$', 1)) AS path, text FROM ({dom_queries.plain_links_sql()})"
    return f"SELECT page_id, path, text, {DUCK.has('path', CONTACT_PATHS)} AS trusted FROM (SELECT * FROM ({own}) WHERE {DUCK.has('text', CONTACT_WORDS)} OR {DUCK.has('path', CONTACT_IN_PATH)} UNION ALL SELECT page_id, path, 'probe' FROM ({ingest.sql('probes', 'duck')}) WHERE contains(path, 'contact'))"


def contact_discovery(spark, sf):
    """The contact page of a scan by three steps: paths that answer, sitemaps, and links of the page as a browser drew it. Links are
    looked for only where the first two find none, and the first trusted one in page order is taken."""
    known = site_queries.contact_pages(spark, sf)
    drawn = ingest.read(spark, sf, "renders").join(known.select("page_id"), "page_id", "left_anti")
    df = dom.link_rows(drawn).filter(~dom_queries.no_page("href") & dom_queries.in_scope("address", subdomains=False))
    path = F.lower(F.expr(C.path(SPARK, "address")))
    df = df.withColumn("path", path).filter(F.expr(f"({SPARK.has('text', CONTACT_WORDS)} OR {SPARK.has('path', CONTACT_IN_PATH)}) AND {SPARK.has('path', CONTACT_PATHS)}"))
    third = df.groupBy("page_id").agg(F.min_by("address", "pos").alias("contact_page")).withColumn("step", F.lit(3))
    pages = t(spark, sf, "pages").select("page_id")
    return pages.join(known.unionByName(third), "page_id", "left").select("page_id", "contact_page", "step")


def contact_discovery_sql() -> str:
    """No link of the supplied pages leads to a contact page by its path."""
    return f"SELECT page_id, contact_page, step FROM (SELECT page_id FROM pages) LEFT JOIN ({site_queries.contact_pages_sql()}) USING (page_id)"


def contact_trust(spark, sf):
    """Whether the probed contact pages are contact pages: by their path, or else by what they say."""
    df = ingest.read(spark, sf, "probes").filter("path LIKE '%contact%' OR path LIKE '%about%'").withColumn("h", F.coalesce("text", F.lit("")))
    return page_queries.project(df, trust_columns(SPARK), ("page_id", "path"))


def trust_columns(q) -> dict[str, str]:
    in_path = q.has("path", CONTACT_IN_PATH)
    marks = C.n_of(q, "h", V.CONTACT_MARKS)
    return {"trusted": f"CASE WHEN {q.has('path', CONTACT_PATHS)} THEN true WHEN status_code IN (401, 403) OR length(h) < 500 THEN {in_path} ELSE {marks} >= 1 END", "marks": marks}


def hosting(spark, sf):
    """Free hosts of sites, by either list: by the end of the host, or anywhere in the address."""
    df = t(spark, sf, "supplier").selectExpr("s_suppkey", f"{host_addresses('spark')} AS url")
    return page_queries.project(df, hosting_columns(SPARK), ("s_suppkey",))


def host_addresses(engine: str) -> str:
    hosts = [*(s for s, *_ in V.FREE_HOSTS), "example.com/x.vercel.app", "netlify.app.example.org"]
    pick = f"element_at(array({', '.join(repr(h) for h in hosts)}), CAST(s_suppkey % {len(hosts)} AS INT) + 1)" if engine == "spark" else f"[{', '.join(repr(h) for h in hosts)}][s_suppkey % {len(hosts)} + 1]"
    return f"concat('https://Shop', s_suppkey, '.', {pick})"


def hosting_columns(q) -> dict[str, str]:
    ends = lambda s: f"right({P.host(q)}, {len(s) + 1}) = '.{s}'"
    return {
        "name": "CASE " + " ".join(f"WHEN {ends(s)} THEN '{n}'" for s, n, _ in V.FREE_HOSTS) + " END", "score": "CASE " + " ".join(f"WHEN {ends(s)} THEN {k}" for s, _, k in V.FREE_HOSTS) + " ELSE 0 END",
        "layered": "CASE " + " ".join(f"WHEN contains(lower(url), '.{s}') THEN '{n}'" for s, n in V.LAYERED_HOSTS) + " END",
    }


def header_pick(spark, sf):
    """The headers that tell what a site is made with, whatever their case; null without one."""
    lines = F.filter(F.split("headers", "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))), F.trim(F.regexp_replace(x, "^[^:]*:", ""))))
    m = F.map_filter(F.map_from_entries(pairs), lambda k, v: k.isin("server", "x-powered-by", "x-generator"))
    df = ingest.read(spark, sf, "fetches").select("page_id", m.alias("m"))
    return df.select("page_id", *(F.try_element_at("m", F.lit(k)).alias(k.replace("-", "_")) for k in ("server", "x-powered-by", "x-generator")), F.size("m").alias("n"))


def header_pick_sql() -> str:
    return "SELECT page_id, concat('web', page_id % 3) AS server, CASE page_id % 4 WHEN 3 THEN 'Next.js' END AS x_powered_by, NULL::VARCHAR AS x_generator, CASE page_id % 4 WHEN 3 THEN 2 ELSE 1 END AS n FROM pages"


def policy_map(spark, sf):
    """Every probed path of a site with whether it exists, as a map, and how many do; by the loose and the strict reading."""
    df = ingest.read(spark, sf, "probes")
    entry = F.struct("path", F.struct(F.col("status_code").between(200, 399).alias("exists"), F.col("status_code").alias("status")).alias("x"))
    m = df.groupBy("page_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.count_if(F.col("status_code") == 200).alias("strict"))
    held = F.map_filter("m", lambda k, v: v["exists"])
    listed = F.array_join(F.array_sort(F.map_keys(held)), ",")
    return m.select("page_id", F.size("m").alias("paths"), F.size(held).alias("n"), "strict", listed.alias("found"), F.coalesce(F.try_element_at(held, F.lit("/contact"))["exists"], F.lit(False)).alias("contact"))


def policy_map_sql() -> str:
    return f"SELECT page_id, CAST(count(*) AS INTEGER) AS paths, CAST(count(*) FILTER (WHERE status_code < 400) AS INTEGER) AS n, count(*) FILTER (WHERE status_code = 200) AS strict, coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE status_code < 400), '') AS found, bool_or(path = '/contact' AND status_code < 400) AS contact FROM ({ingest.sql('probes', 'duck')}) GROUP BY page_id"


def fenced_json(spark, sf):
    """Answers that may stand in a code fence, read as JSON; null where they are none."""
    text = F.expr("CASE event_id % 4 WHEN 0 THEN concat('```json\\n', props, '\\n```') WHEN 1 THEN concat('```', props, '```') WHEN 2 THEN props ELSE concat('no ', props) END")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```\z", ""))
    df = t(spark, sf, "events").select("event_id", F.from_json(bare, "k int, missing struct<deep: string>").alias("x"))
    return df.select("event_id", F.col("x.k").alias("k"), F.coalesce("x.missing.deep", F.lit("none")).alias("deep"))


FENCED_SQL = "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, 'none' AS deep FROM events"

# ---- stored runs

datapoints.register("contact_details", "Contact details", lambda spark, sf: site_queries.contact_rows(spark, sf).select("page_id", "emails", "contact_page"))
datapoints.register("domain_risk_assessment", "Risk assessment", lambda spark, sf: site_queries.risk_scores(spark, sf).select("page_id", "overall", "primary_type"))


def data_points(spark, sf):
    """Every registered kind of data of every scan, as JSON."""
    return datapoints.extracted(spark, sf)


def data_points_sql() -> str:
    contact = f"SELECT page_id, 'contact_details' AS key, 'Contact details' AS label, CAST(CASE WHEN contact_page IS NULL THEN to_json({{'emails': emails}}) ELSE to_json({{'emails': emails, 'contact_page': contact_page}}) END AS VARCHAR) AS value FROM ({site_queries.contact_sql()})"
    risk = f"SELECT page_id, 'domain_risk_assessment', 'Risk assessment', CAST(to_json({{'overall': overall, 'primary_type': primary_type}}) AS VARCHAR) FROM ({site_queries.assessments_sql()})"
    return f"{contact} UNION ALL {risk}"


def stored_runs(spark, sf):
    """What a store holds after its sinks have run: a log appended to twice, a history and its latest values, and offers
    of runs of which a later one replaces some and an empty one none."""
    at = state.folder(spark)
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    for part in ("event_type = 'view'", "event_type <> 'view'"):
        sinks.append_log(e.filter(part), f"{at}/log")
        sinks.upsert(e.filter(part), f"{at}/history")
    offers = views.view(spark, sf, views.OFFERS).select((F.col("order_id") % 8).cast("int").alias("run"), "order_id", "pos", "currency")
    for part in ("currency <> 'EUR'", "currency = 'EUR' AND run < 3", "currency = 'none'"):
        sinks.replace_run(offers.filter(part), f"{at}/offers", "run")
    last = sinks.latest(spark, f"{at}/history", ["user_id", "event_type"], "ts", "event_id")
    count = lambda df, name, total: df.agg(F.count("*").alias("n"), F.sum(total).cast("long").alias("total")).select(F.lit(name).alias("name"), "n", "total")
    return count(spark.read.parquet(f"{at}/log"), "log", "event_id").unionAll(count(last, "latest", "event_id")).unionAll(count(spark.read.parquet(f"{at}/offers"), "offers", "order_id"))


STORED_SQL = f"SELECT 'log' AS name, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events UNION ALL SELECT 'latest', count(*), CAST(sum(event_id) AS BIGINT) FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 UNION ALL SELECT 'offers', count(*), CAST(sum(order_id) AS BIGINT) FROM ({views.OFFERS}) WHERE (order_id % 8 < 3) = (currency = 'EUR')"


def comparison_readback(spark, sf):
    """Comparisons as they are stored, with reasons and numbers as JSON, and read back; the readable reasons come first to last."""
    df = compare_queries.compare_full(spark, sf)
    stored = df.select("a", "b", "overall", F.to_json(F.array(*(f"reason_{k}" for k in range(1, 6)))).alias("reasons"), F.to_json(F.struct("text_score", "dom_score", "confidence")).alias("scores"))
    read = stored.withColumns({"reasons": F.from_json("reasons", "array<string>"), "scores": F.from_json("scores", "text_score int, dom_score int, confidence int")})
    return read.select("a", "b", "overall", "scores.text_score", "scores.dom_score", "scores.confidence", F.size("reasons").alias("n"), F.array_join("reasons", "|").alias("reasons"))


def comparison_readback_sql() -> str:
    reasons = ", ".join(f"{e} AS {c}" for c, e in compare_queries.reasons().items())
    return f"{compare_queries.compared_sql()} SELECT a, b, overall, text_score, dom_score, confidence, 5 AS n, concat_ws('|', reason_1, reason_2, reason_3, reason_4, reason_5) AS reasons FROM (SELECT *, {reasons} FROM m)"


def new_store(spark, kind: str, key: str, columns: str) -> keyed_store.KeyedStore:
    at = state.folder(spark)
    return keyed_store.KeyedStore(spark, f"{kind}_{at.rpartition('-')[2]}", at, key, columns, int(spark.conf.get("spark.sql.shuffle.partitions")))


def signature_store(spark, sf):
    """Signatures by the hash of the text: those of labelled documents are stored first, then all documents ask for theirs, and only
    texts that are not stored are computed."""
    docs = t(spark, sf, "documents").select("doc_id", "text").filter(F.col("text").rlike(r"\S")).withColumn("text_sha256", F.sha2("text", 256))
    store = new_store(spark, "signatures", "text_sha256", "signature ARRAY<DOUBLE>")
    compute = lambda df: compare_queries.signatures(df).select("text_sha256", "signature")
    store.ensure(docs.join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("text_sha256", "text"), compute)
    out = store.get_or_create(docs, ["text"], compute)
    total = F.aggregate(F.transform("signature", lambda x: F.round(x, 6)), F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", F.size("signature").alias("n"), F.round(total, 4).alias("total"), "reused")


SIGNATURE_STORE_SQL = rf"""
WITH g AS ({compare_queries.SIGNATURE_SQL}), d AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE regexp_matches(text, '\S'))
SELECT doc_id, CAST(count(*) AS INTEGER) AS n, round(sum(value), 4) AS total, any_value(sha) IN (SELECT sha FROM d WHERE doc_id IN (SELECT doc_id FROM labels)) AS reused FROM g JOIN d USING (doc_id) GROUP BY doc_id
"""


def artifact_cache(spark, sf):
    """Pages by the hash of their html: those that have a label are stored first; then all ask for their cut text and its hash, and only unknown html
    is stripped."""
    pages = t(spark, sf, "pages").select("page_id", F.col("html").alias("h")).withColumn("html_sha256", F.sha2("h", 256))
    store = new_store(spark, "artifacts", "html_sha256", "html_kept INT, text_kept INT, text_sha256 STRING")

    def compute(df: DataFrame) -> DataFrame:
        df = df.withColumn("t", F.expr(P.plain(SPARK)))
        return df.select("html_sha256", F.length(F.substring("h", 1, V.STORED_HTML)).alias("html_kept"), F.length(F.substring("t", 1, V.STORED_TEXT)).alias("text_kept"), F.sha2("t", 256).alias("text_sha256"))

    store.ensure(pages.join(t(spark, sf, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").select("html_sha256", "h"), compute)
    return store.get_or_create(pages, ["h"], compute).select("page_id", "html_kept", "text_kept", "text_sha256", "reused")


def artifact_cache_sql() -> str:
    return f"SELECT page_id, html_kept, text_kept, text_sha256, html_sha256 IN (SELECT sha256(html) FROM pages WHERE page_id IN (SELECT doc_id FROM labels)) AS reused FROM ({artifact_store_sql()})"


# ---- requests


def request_checks(spark, sf):
    """Requests made of the tables' rows, each against its schema: new scans of pages and of names that are no address, notes of turns, lists
    of offers by what events ask for, flags of labels, comparisons of sources and languages. What is right, else path and code of each error."""
    body = lambda df, kind, key, schema, **fields: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), requests.body(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))), schema).alias("r"))
    pages = t(spark, sf, "pages").select(F.col("page_id").alias("id"), "url").unionAll(t(spark, sf, "customer").select("c_custkey", "c_name"))
    source = F.element_at(F.array(*map(F.lit, ("search", "api", "web"))), (F.col("id") % 3 + 1).cast("int"))
    turns, labels, docs = (t(spark, sf, x) for x in ("conversations", "labels", "documents"))
    note = F.when(F.col("role") == "user", "note").when(F.col("role") == "assistant", "review").otherwise(F.col("role"))
    events = t(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    given = F.create_map(F.lit("page"), F.col("k"), F.lit("pageSize"), F.col("event_id").cast("string"), F.lit("minConfidence"), F.floor("value").cast("string"), F.lit("sortBy"), F.when(F.col("event_type") == "view", "title").when(F.col("event_type") == "click", "").otherwise(F.col("event_type")))
    rows = [
        body(pages, "new_scan", "id", requests.NEW_SCAN, url=F.col("url"), source=source),
        body(turns, "note", "turn", requests.NEW_NOTE, content=F.when(F.col("turn") % 4 > 0, F.col("text")), type=note, riskDecision=F.when(F.col("turn") % 2 == 0, "risky")),
        body(turns, "note_change", "turn", requests.NOTE_CHANGE, content=F.col("text")),
        body(labels, "flag", "doc_id", requests.RISK_FLAG, isRisky=F.col("toxic") == 1), body(labels, "flag_as_number", "doc_id", requests.RISK_FLAG, isRisky=F.col("toxic")),
        body(docs, "comparison", "doc_id", requests.COMPARISON, urlA=F.col("source"), urlB=F.col("lang")),
        events.select(F.lit("offers").alias("kind"), F.col("event_id").alias("id"), requests.parameters(given, requests.OFFERS).alias("r")),
    ]
    text = lambda r: F.array_join(F.transform(r["errors"], lambda e: F.concat_ws(":", e["path"], e["code"])), ",")
    shown = [df.select("kind", "id", F.col("r.ok").alias("ok"), text(F.col("r")).alias("errors"), F.to_json("r.value").alias("value")) for df in rows]
    out = reduce(DataFrame.unionAll, shown)
    return out.groupBy("kind", "ok", "errors").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count("value").alias("values"))


REQUEST_SQL = """
WITH i AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT c_custkey, c_name FROM customer),
x AS (
  SELECT 'new_scan' AS kind, id, [CASE WHEN NOT regexp_matches(lower(url), '^https?://[^/?#]+') THEN 'url:invalid_format' END, CASE WHEN id % 3 = 2 THEN 'source:invalid_value' END] AS e FROM i
  UNION ALL SELECT 'note', turn, CASE WHEN turn % 4 > 0 AND length(text) > 5000 OR role NOT IN ('user', 'assistant') THEN [CASE WHEN turn % 4 > 0 AND length(text) > 5000 THEN 'content:too_big' END, CASE WHEN role NOT IN ('user', 'assistant') THEN 'type:invalid_value' END]
    ELSE [CASE WHEN NOT CASE role WHEN 'user' THEN turn % 4 > 0 AND coalesce(text, '') <> '' ELSE turn % 2 = 0 END THEN ':custom' END] END FROM conversations
  UNION ALL SELECT 'note_change', turn, [CASE WHEN text IS NULL THEN 'content:invalid_type' WHEN text = '' THEN 'content:too_small' WHEN length(text) > 5000 THEN 'content:too_big' END] FROM conversations
  UNION ALL SELECT 'flag', doc_id, [CASE WHEN toxic IS NULL THEN 'isRisky:invalid_type' END] FROM labels UNION ALL SELECT 'flag_as_number', doc_id, ['isRisky:invalid_type'] FROM labels
  UNION ALL SELECT 'comparison', doc_id, [CASE WHEN source IS NULL THEN 'urlA:invalid_type' WHEN source = '' THEN 'urlA:too_small' END, CASE WHEN lang IS NULL THEN 'urlB:invalid_type' WHEN lang = '' THEN 'urlB:too_small' END] FROM documents
  UNION ALL SELECT 'offers', event_id, [CASE WHEN CAST(props ->> '$.k' AS BIGINT) < 1 THEN 'page:too_small' END, CASE WHEN event_id < 1 THEN 'pageSize:too_small' WHEN event_id > 100 THEN 'pageSize:too_big' END,
    CASE WHEN floor(value) < 0 THEN 'minConfidence:too_small' WHEN floor(value) > 100 THEN 'minConfidence:too_big' END, CASE WHEN event_type NOT IN ('view', 'click') THEN 'sortBy:invalid_value' END] FROM events)
SELECT kind, errors = '' AS ok, errors, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, count(*) FILTER (WHERE errors = '') AS values FROM (SELECT kind, id, array_to_string(list_filter(e, lambda y: y IS NOT NULL), ',') AS errors FROM x) GROUP BY ALL
"""


# ---- streams


def stream_status(spark, sf):
    """The state of each scan's domain: an end stands once it is reached, until then the latest step."""
    return state.merged(spark, state.status(state.source(spark, sf, "events")), ["user_id"])


STATUS_SQL = "SELECT user_id, arg_max(status, (ended, ts, event_id)) AS status, max(ts) AS seen FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status, event_type IN ('purchase', 'error') AS ended FROM events) GROUP BY user_id"


def stream_stale(spark, sf):
    """Steps of work that no other followed within five minutes, each with the moment it turned stale; steps whose five minutes
    the watermark has not passed are still open."""
    rows = state.appended(spark, timers.work(state.source(spark, sf, "events")))
    return rows.filter("stale").select(F.col("key").alias("user_id"), "event_id", "status", F.col("at").cast("timestamp_ntz").alias("stale_at"))


def stream_transitions(spark, sf):
    """Changes of status of each user's work: a step is one unless the open step has its status; an end or staleness closes the work."""
    rows = state.appended(spark, timers.work(state.source(spark, sf, "events")))
    return rows.filter("NOT stale").select(F.col("key").alias("user_id"), "event_id", "status", F.col("at").cast("timestamp_ntz").alias("moment"))


def stream_cache(spark, sf):
    """Requests with the fetch that serves each: one stored within 24 hours, or its own."""
    rows = state.appended(spark, timers.requests(state.source(spark, sf, "events")))
    return rows.select(F.col("key").alias("user_id"), "event_id", F.col("stored_at").cast("timestamp_ntz").alias("stored_at"), "fetched")


WORK_SQL = f"SELECT scan_id AS event_id, domain_id AS user_id, status, created_at AS moment, lag(status) OVER w AS before, lag(created_at) OVER w AS before_at, lead(created_at) OVER w AS next_at FROM ({views.SCANS}) WINDOW w AS (PARTITION BY domain_id ORDER BY created_at, event_id)"
STALE_SQL = f"SELECT user_id, event_id, status, moment + INTERVAL 5 MINUTES AS stale_at FROM ({WORK_SQL}) WHERE status IN ('pending', 'processing') AND (next_at - moment > INTERVAL 5 MINUTES OR next_at IS NULL AND moment + INTERVAL 5 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES)"
TRANSITIONS_SQL = f"SELECT user_id, event_id, status, moment FROM ({WORK_SQL}) WHERE before IS NULL OR before IN ('completed', 'failed') OR moment - before_at > INTERVAL 5 MINUTES OR before <> status"
CACHE_SQL = """
WITH RECURSIVE f AS (
  SELECT user_id, min(ts) AS stored_at FROM events GROUP BY 1
  UNION ALL SELECT f.user_id, min(e.ts) FROM f JOIN events e ON e.user_id = f.user_id AND e.ts - f.stored_at > INTERVAL 24 HOURS GROUP BY f.user_id, f.stored_at
), k AS (SELECT e.user_id, event_id, ts, max(stored_at) AS stored_at FROM events e JOIN f ON f.user_id = e.user_id AND stored_at <= ts GROUP BY ALL)
SELECT user_id, event_id, stored_at, ts = stored_at AS fetched FROM k
"""


def catalogue() -> dict:
    """name -> (query, SQL)."""
    trust = page_queries.select(trust_columns(DUCK), f"SELECT *, coalesce(text, '') AS h FROM ({ingest.sql('probes', 'duck')}) WHERE path LIKE '%contact%' OR path LIKE '%about%'", ("page_id", "path"))
    return {
        "registration_lookup": (registration_lookup, registration_sql()),
        "fetch_outcomes": (fetch_outcomes, fetch_outcomes_sql()),
        "page_source": (page_source, page_source_sql()),
        "artifact_store": (artifact_store, artifact_store_sql()),
        "cached_artifacts": (cached_artifacts, cached_artifacts_sql()),
        "dashboard_totals": (dashboard_totals, dashboard_totals_sql()),
        "domain_detail": (domain_detail, domain_detail_sql()),
        "domain_page": (domain_page, domain_page_sql(AFTER, PAGE, SHOWN["scans"], SHOWN["inputs"], True)),
        "domain_list": (domain_list, domain_page_sql(None, 100, 1, 5, False)),
        "batch_outcomes": (batch_outcomes, BATCH_SQL),
        "history_page": (history_page, HISTORY_SQL),
        "offer_page": (offer_page, OFFER_SQL),
        "scan_table": (scan_table, SCAN_TABLE_SQL),
        "notes_newest": (notes_newest, "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS INTEGER) AS place, turn, CASE role WHEN 'user' THEN 'review' ELSE 'note' END AS kind FROM conversations"),
        "fetch_log": (fetch_log, FETCH_LOG_SQL),
        "preferences": (preferences, PREFERENCES_SQL),
        "new_scans": (new_scans, new_scans_sql()),
        "scan_status": (scan_status, SCAN_STATUS_SQL),
        "rescans": (rescans, RESCAN_SQL),
        "comparisons_left": (comparisons_left, COMPARISONS_LEFT_SQL),
        "scores_shown": (scores_shown, scores_shown_sql()),
        "crawl_frontier": (crawl_frontier, crawl_frontier_sql()),
        "internal_links": (internal_links, internal_links_sql()),
        "contact_links": (contact_links, contact_links_sql()),
        "contact_discovery": (contact_discovery, contact_discovery_sql()),
        "contact_trust": (contact_trust, trust),
        "hosting": (hosting, page_queries.select(hosting_columns(DUCK), f"SELECT s_suppkey, {host_addresses('duck')} AS url FROM supplier", ("s_suppkey",))),
        "header_pick": (header_pick, header_pick_sql()),
        "policy_map": (policy_map, policy_map_sql()),
        "fenced_json": (fenced_json, FENCED_SQL),
        "data_points": (data_points, data_points_sql()),
        "stored_runs": (stored_runs, STORED_SQL),
        "comparison_readback": (comparison_readback, comparison_readback_sql()),
        "signature_store": (signature_store, SIGNATURE_STORE_SQL),
        "artifact_cache": (artifact_cache, artifact_cache_sql()),
        "request_checks": (request_checks, REQUEST_SQL),
        "stream_status": (stream_status, STATUS_SQL),
        "stream_stale": (stream_stale, STALE_SQL),
        "stream_transitions": (stream_transitions, TRANSITIONS_SQL),
        "stream_cache": (stream_cache, CACHE_SQL),
    }
