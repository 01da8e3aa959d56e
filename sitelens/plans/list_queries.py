"""Lists by every order that may be chosen, notes under requests, links in full and bodies as fetched, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses
from ..functions import values as V
from ..operators import notes
from ..operators import relational as R
from . import dom_queries
from .record_queries import BODY
from .relational_queries import t

#: Orders of the table of domains and of the history of comparisons; any other choice is the default, the newest first.
DOMAIN_ORDERS = {"normalizedUrl": "name", "isActive": "active", "lastCheckedAt": "checked", "createdAt": "created"}
HISTORY_ORDERS = {"score": "score", "createdAt": "created"}
ROWS = 25


def ordered(field: str | None, descending: bool, orders: dict[str, str], default: str) -> list:
    """The order of a choice; what is null counts as least, and the id settles ties."""
    column = F.col(orders.get(field or "", default))
    return [column.desc_nulls_last() if descending else column.asc_nulls_first(), F.asc("id")]


def placed(df: DataFrame, choice: str, order: list, page: int = 1) -> DataFrame:
    """A page of rows with the choice and their places on it."""
    rows = R.offset_page(df, order, page, ROWS)
    return rows.withColumn("place", F.row_number().over(R.W.orderBy(*order))).select(F.lit(choice).alias("choice"), "place", "id")


def sorted_lists(spark, sf):
    """The second page of domains under each of their four orders both ways, and of comparisons under each of theirs and an unknown one."""
    orders = t(spark, sf, "orders")
    seen = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("checked"), F.min("o_orderdate").alias("created"))
    domains = t(spark, sf, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("active"), "checked", "created")
    history = orders.select(F.col("o_orderkey").alias("id"), F.pmod(F.floor("o_totalprice"), F.lit(101)).alias("score"), F.col("o_orderdate").alias("created"))
    rows = [placed(domains, f"{field} {way}", ordered(field, way == "desc", DOMAIN_ORDERS, "checked"), 2) for field in DOMAIN_ORDERS for way in ("asc", "desc")]
    rows += [placed(history, f"history {field}", ordered(field, True, HISTORY_ORDERS, "created"), 2) for field in (*HISTORY_ORDERS, "other")]
    return reduce(DataFrame.unionAll, rows)


def sorted_lists_sql() -> str:
    one = lambda source, choice, column, way: f"SELECT '{choice}' AS choice, CAST(k - {ROWS} AS INTEGER) AS place, id FROM (SELECT id, row_number() OVER (ORDER BY {column} {'DESC NULLS LAST' if way == 'desc' else 'ASC NULLS FIRST'}, id) AS k FROM {source}) WHERE k BETWEEN {ROWS + 1} AND {2 * ROWS}"
    parts = [one("d", f"{field} {way}", column, way) for field, column in DOMAIN_ORDERS.items() for way in ("asc", "desc")]
    parts += [one("h", f"history {field}", HISTORY_ORDERS.get(field, "created"), "desc") for field in (*HISTORY_ORDERS, "other")]
    return f"WITH d AS (SELECT c_custkey AS id, any_value(c_name) AS name, any_value(c_acctbal > 0) AS active, max(o_orderdate) AS checked, min(o_orderdate) AS created FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), h AS (SELECT o_orderkey AS id, floor(o_totalprice) % 101 AS score, o_orderdate AS created FROM orders) {' UNION ALL '.join(parts)}"


def note_outcome(spark, sf) -> notes.Outcome:
    """Turns of conversations as notes, and events as requests about them."""
    held = t(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.max_by("text", "role").alias("text"), F.max("role").alias("role"))
    held = held.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("note_id"), F.col("conv_id").alias("domain_id"), F.col("text").alias("content"), F.when(F.col("role") == "user", "note").otherwise("review").alias("type"), F.lit(None).cast("string").alias("decision"))
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", notes.EDIT).when(F.col("event_type") == "click", notes.DELETE).otherwise(notes.CREATE)
    review = F.col("event_type") == "signup"
    body = F.to_json(F.struct(F.when(k % 3 > 0, F.concat(F.lit("text "), k.cast("string"))).alias("content"), F.when(review, "review").alias("type"), F.when(review & (k % 4 > 0), F.when(k % 2 == 0, "risky").otherwise("not_risky")).alias("riskDecision")))
    asked = t(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("ts").alias("at"), kind.alias("kind"), F.col("user_id").alias("domain_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.pmod(k, F.lit(6)).cast("string")).alias("note_id"), body.alias("body"))
    domains = t(spark, sf, "customer").select(F.col("c_custkey").alias("domain_id")).filter("domain_id % 10 > 0")
    return notes.answered(held, domains, asked)


def note_answers(spark, sf):
    """The answer to each request."""
    return note_outcome(spark, sf).answers


def notes_after(spark, sf):
    """Notes after all requests, and the flags that reviews have set."""
    out = note_outcome(spark, sf)
    rows = out.notes.select("note_id", "domain_id", F.md5(F.coalesce("content", F.lit(""))).alias("content"), "type", "decision")
    flags = out.flags.select(F.concat(F.lit("flag-"), "domain_id").alias("note_id"), "domain_id", F.lit("").alias("content"), F.lit("flag").alias("type"), F.when(F.col("risky"), "risky").otherwise("not_risky").alias("decision"))
    return rows.unionAll(flags)


NOTES_SQL = """
WITH n AS (SELECT conv_id || '-' || turn AS note_id, conv_id AS domain_id, arg_max(text, role) AS content, CASE max(role) WHEN 'user' THEN 'note' ELSE 'review' END AS type FROM conversations GROUP BY conv_id, turn),
q AS (SELECT event_id AS id, ts, user_id AS domain_id, CASE event_type WHEN 'view' THEN 'edit' WHEN 'click' THEN 'delete' ELSE 'create' END AS kind, event_type = 'signup' AS review, CAST(props ->> '$.k' AS INTEGER) AS k FROM events),
r AS (SELECT q.*, q.domain_id || '-' || (k % 6) AS note_id, k % 3 > 0 AS has_text, k % 4 > 0 AS decides FROM q),
c AS (SELECT *, CASE WHEN NOT CASE WHEN review THEN decides ELSE has_text END THEN 400 WHEN domain_id % 10 > 0 AND domain_id IN (SELECT c_custkey FROM customer) THEN 201 ELSE 404 END AS status FROM r WHERE kind = 'create'),
o AS (SELECT r.*, n.note_id IS NOT NULL AS there FROM r LEFT JOIN n ON n.note_id = r.note_id WHERE kind <> 'create'),
g AS (SELECT *, coalesce(bool_or(there AND kind = 'delete') OVER (PARTITION BY note_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM o),
a AS (SELECT *, CASE WHEN kind = 'edit' AND NOT has_text THEN 400 WHEN there AND NOT gone THEN 200 ELSE 404 END AS status FROM g)
"""
NOTE_ANSWERS_SQL = NOTES_SQL + " SELECT id AS request_id, CAST(status AS INTEGER) AS status FROM c UNION ALL SELECT id, CAST(status AS INTEGER) FROM a"
NOTES_AFTER_SQL = NOTES_SQL + """, d AS (SELECT note_id, bool_or(kind = 'delete') AS deleted, arg_max('text ' || k, (ts, id)) FILTER (WHERE kind = 'edit') AS edited FROM a WHERE status = 200 GROUP BY 1)
SELECT n.note_id, domain_id, md5(coalesce(edited, content, '')) AS content, type, CAST(NULL AS VARCHAR) AS decision FROM n LEFT JOIN d ON d.note_id = n.note_id WHERE NOT coalesce(deleted, false)
UNION ALL SELECT 'new-' || id, domain_id, md5(CASE WHEN has_text THEN 'text ' || k ELSE '' END), CASE WHEN review THEN 'review' ELSE 'note' END, CASE WHEN review THEN CASE WHEN k % 2 = 0 THEN 'risky' ELSE 'not_risky' END END FROM c WHERE status = 201
UNION ALL SELECT 'flag-' || domain_id, domain_id, '', 'flag', arg_max(CASE WHEN k % 2 = 0 THEN 'risky' ELSE 'not_risky' END, (ts, id)) FROM c WHERE status = 201 AND review GROUP BY domain_id
"""


def resolved_links(spark, sf):
    """Every link of a page in full, by expressions alone."""
    df = t(spark, sf, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(V.LINK_HREF), F.lit(1))).alias("pos", "href"))
    return df.select("page_id", "pos", "href", addresses.resolved(F.col("href"), F.col("url")).alias("address"))


def fetched_bodies(spark, sf):
    """Bodies of pages as a fetch keeps them: bytes in all, bytes kept, whether it was cut, and the hash of what is kept."""
    df = t(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("b"))
    kept = F.substring("b", 1, BODY)
    return df.select("page_id", F.octet_length("b").cast("long").alias("bytes"), F.octet_length(kept).cast("long").alias("kept"), (F.octet_length("b") > BODY).alias("was_cut"), F.sha2(kept, 256).alias("sha256"))


FETCHED_BODIES_SQL = f"SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, CAST(CASE WHEN strlen(html) > {BODY} THEN {BODY} ELSE strlen(html) END AS BIGINT) AS kept, strlen(html) > {BODY} AS was_cut, CASE WHEN strlen(html) <= {BODY} THEN sha256(html) END AS sha256 FROM pages"


def catalogue() -> dict:
    """name -> (query, SQL)."""
    return {
        "sorted_lists": (sorted_lists, sorted_lists_sql()),
        "note_answers": (note_answers, NOTE_ANSWERS_SQL),
        "notes_after": (notes_after, NOTES_AFTER_SQL),
        "resolved_links": (resolved_links, f"SELECT page_id, pos, href, address FROM ({dom_queries.plain_links_sql()})"),
        "fetched_bodies": (fetched_bodies, FETCHED_BODIES_SQL),
    }
