"""Queries of the relational core, the read models and streams, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators import relational as R
from ..sources import views
from ..streaming import state

#: The moment that ages are counted from.
AS_OF = "2024-01-31 00:00:00"
ACTIVE = ("pending", "processing")


def t(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scans(spark, sf):
    return views.view(spark, sf, views.SCANS)


def latest_per_key(spark, sf):
    df = t(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return R.latest_per_key(df, ["user_id", "event_type"], "ts", "event_id")


def topk_per_parent(spark, sf):
    df = R.top_per_parent(scans(spark, sf), "domain_id", [F.desc("created_at"), F.desc("scan_id")], 5)
    return df.select("domain_id", "scan_id", "status", "rank")


def domain_latest_scan(spark, sf):
    """Domains with their scan count and latest scan; a domain without scans has none."""
    s = scans(spark, sf)
    last = R.latest_per_key(s, ["domain_id"], "created_at", "scan_id")
    counts = s.groupBy("domain_id").agg(F.count("*").alias("n"))
    domains = t(spark, sf, "customer").select(F.col("c_custkey").alias("domain_id"), F.col("c_name").alias("name"))
    out = domains.join(counts, "domain_id", "left").join(last, "domain_id", "left")
    return out.select("domain_id", "name", F.coalesce("n", F.lit(0)).alias("scans"), "scan_id", "status")


def completed_first(spark, sf):
    """The scan that stands for a domain: the latest completed one, else the latest."""
    order = [F.desc(F.col("status") == "completed"), F.desc("created_at"), F.desc("scan_id")]
    return R.top_per_parent(scans(spark, sf), "domain_id", order).select("domain_id", "scan_id", "status")


def offset_page(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.offset_page(df, [F.col("o_totalprice").desc_nulls_first(), F.asc("o_orderkey")], page=3, size=20)


def cursor_page(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.cursor_page(df, "o_totalprice", "o_orderkey", (200000.0, 1 << 40), 20)


def backfill(spark, sf):
    """Documents with and without a label, and the share that has one."""
    docs, labels = t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels").select("doc_id")
    kinds = docs.join(labels, "doc_id", "left_semi").select(F.lit(1).alias("has")).unionAll(docs.join(labels, "doc_id", "left_anti").select(F.lit(0)))
    return kinds.agg(F.count("*").alias("total"), F.sum("has").cast("long").alias("with_label"), F.count_if(F.col("has") == 0).alias("without_label"),
                     F.coalesce(F.floor(F.try_divide(100 * F.sum("has"), F.count("*")) + 0.5).cast("int"), F.lit(100)).alias("percent"))


def polymorphic(spark, sf):
    """An id resolved as an order's, else as a customer's; the customer's name."""
    customers = t(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    orders = t(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "name")
    ids = t(spark, sf, "events").select(F.col("event_id").alias("id"))
    return R.resolve(ids, orders, customers, "id", "o_orderkey", "c_custkey", "name")


def dashboard(spark, sf):
    s = scans(spark, sf)
    recent = F.col("created_at") >= F.expr(f"timestamp'{AS_OF}' - interval 24 hours")
    stale = F.col("status").isin(*ACTIVE) & (F.col("created_at") < F.expr(f"timestamp'{AS_OF}' - interval 5 minutes"))
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status").isin(*ACTIVE)).alias("in_progress"),
                 F.count_if(recent).alias("last_day"), F.count_if(stale).alias("stale"))


def fetch_totals(spark, sf):
    s = F.col("status_code")
    return views.view(spark, sf, views.LOGS).groupBy("domain_id").agg(
        F.count("*").alias("total"), F.count_if((s >= 200) & (s < 400)).alias("success"), F.count_if(s.isNull() | (s >= 400)).alias("failed"), F.min("status_code").alias("lowest"))


def mode_first_seen(spark, sf):
    return R.mode_first_seen(views.view(spark, sf, views.OFFERS), "order_id", "currency", "pos")


def discount_summary(spark, sf):
    off = F.when(F.col("on_sale") & (F.col("original") > 0), (F.col("original") - F.col("amount")) / F.col("original") * 100)
    return views.view(spark, sf, views.OFFERS).groupBy("currency").agg(
        F.count("*").alias("n"), F.round(F.avg("amount"), 4).alias("average"), F.round(F.avg(off), 4).alias("discount"), F.count_if(F.col("on_sale")).alias("sales"),
        F.floor(100 * F.count_if(F.col("amount") > 1000) / F.count("*") + 0.5).cast("int").alias("dear_percent"))


def text_search(spark, sf):
    return R.search(t(spark, sf, "part"), ["p_name", "p_type"], "AN").select("p_partkey", "p_name")


def range_filters(spark, sf):
    """Half-open range, list, null test and threshold in one filter over stored columns, all pushed to the scan."""
    df = t(spark, sf, "events").filter(F.col("user_id").isin(*range(1, 40)) & F.col("event_type").isNotNull() & ((F.col("value") >= 20) & (F.col("value") < 40) | F.col("value").isNull()))
    return df.select("event_id", "user_id", "value")


def pair_lookup(spark, sf):
    """Unordered pairs of nations that trade, each once."""
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    l = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    df = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b"))
    return df.groupBy("a", "b").agg(F.count("*").alias("n"))


def set_operations(spark, sf):
    """Users by types of events: union, intersection and difference of two types, per day, from one row a user and day."""
    e = t(spark, sf, "events").filter(F.col("event_type").isin("view", "purchase")).groupBy(F.date_trunc("day", "ts").alias("day"), "user_id")
    df = e.agg(F.bool_or(F.col("event_type") == "view").alias("a"), F.bool_or(F.col("event_type") == "purchase").alias("b"))
    size = lambda c: F.count_if(F.expr(c)).cast("int")
    return df.groupBy("day").agg(size("a or b").alias("either"), size("a and b").alias("both"), size("a and not b").alias("only_view"))


def json_pick(spark, sf):
    df = t(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return df.groupBy("event_type").agg(F.sum("k").cast("long").alias("total"), F.count_if(F.col("k").isNull()).alias("missing"))


def nested_history(spark, sf):
    """The last three scans of a domain as one array of structs."""
    df = R.top_per_parent(scans(spark, sf), "domain_id", [F.desc("created_at"), F.desc("scan_id")], 3)
    rows = F.array_sort(F.collect_list(F.struct("rank", "scan_id", "status")))
    return df.groupBy("domain_id").agg(rows.alias("x")).select("domain_id", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["scan_id"].cast("string"), r["status"])), ",").alias("history"))


def state_pivot(spark, sf):
    df = t(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)
    return df.withColumn("effective", F.when((F.col("error") > 0) & (F.col("purchase") > 0), "completed").when(F.col("error") > 0, "failed").otherwise("pending"))


def cascade_delete(spark, sf):
    """Tables after the customers of a segment are deleted, by their row counts."""
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    gone = c.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    kept = R.cascade_delete({"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, gone, "c_custkey")
    lines = t(spark, sf, "lineitem").join(kept["orders"].select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    own = R.cascade_delete({"events": (t(spark, sf, "events"), "user_id"), "conversations": (t(spark, sf, "conversations"), "conv_id")}, gone, "c_custkey")
    tables = {**kept, "lineitem": lines, **own}
    return reduce(DataFrame.unionAll, (one(df, name) for name, df in tables.items()))


#: Which table refers to which: the graph that a delete follows.
GRAPH = [
    graph.Edge("nation", "n_regionkey", "region", "r_regionkey"),
    graph.Edge("customer", "c_nationkey", "nation", "n_nationkey"),
    graph.Edge("supplier", "s_nationkey", "nation", "n_nationkey", graph.SET_NULL),
    graph.Edge("orders", "o_custkey", "customer", "c_custkey"),
    graph.Edge("lineitem", "l_orderkey", "orders", "o_orderkey"),
    graph.Edge("events", "user_id", "customer", "c_custkey"),
    graph.Edge("conversations", "conv_id", "customer", "c_custkey"),
    graph.Edge("documents", "doc_id", "customer", "c_custkey"),
    graph.Edge("labels", "doc_id", "documents", "doc_id"),
    graph.Edge("embeddings", "vec_id", "documents", "doc_id"),
    graph.Edge("embeddings", "label", "region", "r_regionkey"),
]


def cascade_graph(spark, sf):
    """Every table after a region is deleted with all that refers to it: rows that stay and go, and references that became null."""
    names = ["region", *dict.fromkeys(e.child for e in GRAPH)]
    tables = {name: t(spark, sf, name) for name in names}
    after = graph.deleted(tables, GRAPH, "region", tables["region"].filter("r_name = 'ASIA'"))
    nulled = {e.child: e.column for e in GRAPH if e.action == graph.SET_NULL}
    one = lambda df, kind, name: df.agg(F.count("*").alias("n"), (F.count_if(F.col(nulled[name]).isNull()) if name in nulled else F.lit(0).cast("long")).alias("nulls")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "n", "nulls")
    return reduce(DataFrame.unionAll, (one(df, kind, name) for name, both in after.items() for kind, df in zip(("stays", "goes"), both)))


CASCADE_GRAPH_SQL = """
WITH r AS (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'), n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (FROM r)),
c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), d AS (SELECT doc_id FROM documents WHERE doc_id IN (FROM c)),
x AS (
  SELECT 'region' AS name, r_regionkey IN (FROM r) AS gone, 0 AS nulls FROM region UNION ALL SELECT 'nation', n_regionkey IN (FROM r), 0 FROM nation UNION ALL SELECT 'customer', c_nationkey IN (FROM n), 0 FROM customer
  UNION ALL SELECT 'supplier', false, CASE WHEN s_nationkey IN (FROM n) OR s_nationkey IS NULL THEN 1 ELSE 0 END FROM supplier UNION ALL SELECT 'orders', o_custkey IN (FROM c), 0 FROM orders UNION ALL SELECT 'lineitem', l_orderkey IN (FROM o), 0 FROM lineitem
  UNION ALL SELECT 'events', user_id IN (FROM c), 0 FROM events UNION ALL SELECT 'conversations', conv_id IN (FROM c), 0 FROM conversations UNION ALL SELECT 'documents', doc_id IN (FROM c), 0 FROM documents
  UNION ALL SELECT 'labels', doc_id IN (FROM d), 0 FROM labels UNION ALL SELECT 'embeddings', coalesce(vec_id IN (FROM d), false) OR coalesce(label IN (FROM r), false), 0 FROM embeddings)
SELECT name, kind, count(*) FILTER (WHERE coalesce(gone, false) = (kind = 'goes')) AS n, CAST(coalesce(sum(nulls) FILTER (WHERE coalesce(gone, false) = (kind = 'goes')), 0) AS BIGINT) AS nulls FROM x, (VALUES ('stays'), ('goes')) k(kind) GROUP BY name, kind
"""


def hash_dupes(spark, sf):
    df = t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return df.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


def notes_split(spark, sf):
    """Conversations as notes: turns by role, and the last assistant turn's length."""
    df = t(spark, sf, "conversations")
    last = F.max_by(F.when(F.col("role") == "assistant", F.length("text")), F.when(F.col("role") == "assistant", F.col("turn")))
    return df.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") != "user").alias("answered"), last.cast("long").alias("last_length"))


def stream_latest(spark, sf):
    return state.merged(spark, state.latest(state.source(spark, sf, "events")), ["user_id", "event_type"])


def stream_dedupe(spark, sf):
    return state.appended(spark, state.first_requests(state.source(spark, sf, "events")))


def stream_hourly(spark, sf):
    """Hours that the watermark has passed."""
    return state.appended(spark, state.hourly(state.source(spark, sf, "events")))


LATEST = "SELECT user_id, event_type, value, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"
S, L, O = f"({views.SCANS})", f"({views.LOGS})", f"({views.OFFERS})"
STARS = "SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC, scan_id DESC) AS k FROM " + S


def catalogue() -> dict:
    """name -> (query, SQL)."""
    return {
        "latest_per_key": (latest_per_key, LATEST),
        "topk_per_parent": (topk_per_parent, f"SELECT domain_id, scan_id, status, CAST(k AS INTEGER) AS rank FROM ({STARS}) WHERE k <= 5"),
        "domain_latest_scan": (domain_latest_scan, f"WITH s AS ({STARS}), n AS (SELECT domain_id, count(*) AS n FROM s GROUP BY 1) SELECT c_custkey AS domain_id, c_name AS name, coalesce(n, 0) AS scans, scan_id, status FROM customer LEFT JOIN n ON n.domain_id = c_custkey LEFT JOIN s ON s.domain_id = c_custkey AND k = 1"),
        "completed_first": (completed_first, f"SELECT domain_id, scan_id, status FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY status = 'completed' DESC, created_at DESC, scan_id DESC) AS k FROM {S}) WHERE k = 1"),
        "offset_page": (offset_page, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 40"),
        "cursor_page": (cursor_page, "SELECT o_orderkey, o_totalprice, (SELECT count(*) > 20 FROM orders WHERE o_totalprice <= 200000) AS has_more FROM orders WHERE o_totalprice <= 200000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20"),
        "semi_anti_backfill": (backfill, "WITH k AS (SELECT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS has FROM documents d) SELECT count(*) AS total, count(*) FILTER (WHERE has) AS with_label, count(*) FILTER (WHERE NOT has) AS without_label, CAST(coalesce(floor(100.0 * count(*) FILTER (WHERE has) / nullif(count(*), 0) + 0.5), 100) AS INTEGER) AS percent FROM k"),
        "polymorphic_lookup": (polymorphic, "SELECT event_id AS id, coalesce(o.c_name, c.c_name) AS name FROM events LEFT JOIN (SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey) o ON o_orderkey = event_id LEFT JOIN customer c ON c.c_custkey = event_id"),
        "dashboard_stats": (dashboard, f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status IN ('pending', 'processing')) AS in_progress, count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS) AS last_day, count(*) FILTER (WHERE status IN ('pending', 'processing') AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTES) AS stale FROM {S}"),
        "fetch_log_totals": (fetch_totals, f"SELECT domain_id, count(*) AS total, count(*) FILTER (WHERE status_code >= 200 AND status_code < 400) AS success, count(*) FILTER (WHERE status_code IS NULL OR status_code >= 400) AS failed, min(status_code) AS lowest FROM {L} GROUP BY 1"),
        "mode_first_seen": (mode_first_seen, f"WITH c AS (SELECT order_id, currency, count(*) AS n, min(pos) AS f FROM {O} GROUP BY 1, 2) SELECT order_id, currency, n FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY n DESC, f, currency DESC) AS k FROM c) WHERE k = 1"),
        "discount_summary": (discount_summary, f"SELECT currency, count(*) AS n, round(avg(amount), 4) AS average, round(avg(CASE WHEN on_sale AND original > 0 THEN (original - amount) / original * 100 END), 4) AS discount, count(*) FILTER (WHERE on_sale) AS sales, CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE amount > 1000) / count(*) + 0.5) AS INTEGER) AS dear_percent FROM {O} GROUP BY 1"),
        "text_search_ci": (text_search, "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an')"),
        "range_filters": (range_filters, "SELECT event_id, user_id, value FROM events WHERE user_id BETWEEN 1 AND 39 AND event_type IS NOT NULL AND (value >= 20 AND value < 40 OR value IS NULL)"),
        "pair_lookup": (pair_lookup, "SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"),
        "set_operations": (set_operations, "WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'purchase') AS p FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2) SELECT day, CAST(count(*) FILTER (WHERE v OR p) AS INTEGER) AS either, CAST(count(*) FILTER (WHERE v AND p) AS INTEGER) AS both, CAST(count(*) FILTER (WHERE v AND NOT p) AS INTEGER) AS only_view FROM d GROUP BY 1"),
        "json_pick": (json_pick, "WITH j AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type, CAST(sum(k) AS BIGINT) AS total, count(*) FILTER (WHERE k IS NULL) AS missing FROM j GROUP BY 1"),
        "nested_history": (nested_history, f"SELECT domain_id, string_agg(scan_id || ':' || status, ',' ORDER BY k) AS history FROM ({STARS}) WHERE k <= 3 GROUP BY 1"),
        "state_pivot": (state_pivot, "WITH p AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1) SELECT *, CASE WHEN error > 0 AND purchase > 0 THEN 'completed' WHEN error > 0 THEN 'failed' ELSE 'pending' END AS effective FROM p"),
        "cascade_delete": (cascade_delete, "WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) SELECT 'customer' AS name, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) UNION ALL SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE conv_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
        "cascade_graph": (cascade_graph, CASCADE_GRAPH_SQL),
        "page_hash_dupes": (hash_dupes, "SELECT sha256(coalesce(text, '')) AS sha, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1"),
        "notes_split": (notes_split, "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS asked, count(*) FILTER (WHERE role <> 'user') AS answered, arg_max(length(text), turn) FILTER (WHERE role = 'assistant') AS last_length FROM conversations GROUP BY 1"),
        "stream_latest": (stream_latest, LATEST),
        "stream_dedupe": (stream_dedupe, "SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events"),
        "stream_hourly": (stream_hourly, "SELECT * FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS"),
    }
