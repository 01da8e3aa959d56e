"""Bounded expansion of sitemaps: level by level, in the order of fetching, within a budget of fetches.

The first addresses of a site are fetched; those that answer with an index name children, which are fetched next, as
far as the budget goes. A level is one join of the frontier (a site, a place in the order, an address) with the answers. Answers
are reduced to the addresses that they name before they meet the frontier, and the children of an index are cut to the
budget as an array, before they become rows: a frontier never holds more rows of a site than its budget.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import robots


@dataclass(frozen=True)
class Policy:
    """first: addresses fetched of the first list; children: fetched of all indexes together, None for what `first` leaves of
    itself; of_index: taken of one index; listed: addresses kept of a sitemap; index: whether a file with these addresses is one;
    trees: how many levels of children are followed."""

    first: int
    children: int | None
    of_index: int | None
    listed: int | None
    index: Callable[[Column, Column], Column]
    levels: int = 1


#: The fetch layer: five fetches in all, an index by its element, a hundred addresses kept of a file.
LAYERED = Policy(5, None, None, 100, lambda content, locs: content.contains("<sitemapindex"))
#: Discovery: three files, two children of an index and five in all; an index names a file of sitemaps.
DISCOVERY = Policy(3, 5, 2, None, lambda content, locs: F.exists(locs, lambda x: x.contains("sitemap") & x.endswith(".xml")))


def answered(answers: DataFrame, policy: Policy) -> DataFrame:
    """answers (page_id, pos, url, status_code, content) -> one row an address, the first by pos: whether it answered, whether it is an index,
    its addresses, and the count of its entries."""
    first = answers.groupBy("page_id", "url").agg(F.min_by(F.struct("status_code", "content"), "pos").alias("x")).select("page_id", "url", "x.*")
    content = F.when(F.coalesce(F.col("status_code").between(200, 399), F.lit(False)), F.col("content"))
    locs = F.filter(robots.locations(content), lambda x: x != "")
    rows = first.select("page_id", "url", "status_code", content.isNotNull().alias("ok"), locs.alias("locs"), F.coalesce(policy.index(content, locs), F.lit(False)).alias("is_index"),
                        F.coalesce(F.regexp_count(content, F.lit("(?i)<url>")), F.lit(0)).cast("int").alias("entries"))
    return rows.withColumn("url_count", F.when(F.col("is_index"), 0).otherwise(F.col("entries"))).drop("entries")


def expanded(seeds: DataFrame, answers: DataFrame, policy: Policy, may: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """seeds (page_id, urls in order, and what `may` needs as a column `rule`) -> a row for each fetch: page_id, level, place, url,
    status_code, is_index, url_count, locs. may(url, rule): whether an address may be fetched; one that may not spends
    the budget without an answer."""
    files = answered(answers, policy)
    rules = seeds.select("page_id", *(["rule"] if may else []))
    front = seeds.select("page_id", F.posexplode(F.slice("urls", 1, policy.first)).alias("place", "url"))
    spent = F.least(F.lit(policy.first), F.size("urls"))
    left = F.lit(policy.children) if policy.children is not None else F.lit(policy.first) - spent
    budgets = seeds.select("page_id", F.greatest(left, F.lit(0)).alias("left"))
    out = None
    for level in range(policy.levels + 1):
        if may:
            front = front.join(rules, "page_id").withColumn("allowed", may(F.col("url"), F.col("rule"))).drop("rule")
        else:
            front = front.withColumn("allowed", F.lit(True))
        rows = front.join(files, ["page_id", "url"], "left")
        hidden = {c: F.when(F.col("allowed"), F.col(c)) for c in ("status_code", "ok", "is_index", "url_count", "locs")}
        rows = rows.withColumns(hidden).select("page_id", F.lit(level).alias("level"), (F.col("place") + 1).cast("int").alias("place"), "url", "status_code", F.coalesce("ok", F.lit(False)).alias("ok"),
                                               F.coalesce("is_index", F.lit(False)).alias("is_index"), F.coalesce("url_count", F.lit(0)).alias("url_count"), F.coalesce("locs", F.array().cast("array<string>")).alias("locs"))
        out = rows if out is None else out.unionByName(rows)
        if level < policy.levels:
            named = rows.filter("is_index").join(budgets, "page_id").filter("left > 0")
            most = F.least(F.lit(policy.of_index), F.col("left")) if policy.of_index is not None else F.col("left")
            named = named.select("page_id", "left", F.col("place").alias("parent"), F.posexplode(F.slice("locs", F.lit(1), most)).alias("at", "url"))
            order = W.partitionBy("page_id").orderBy("parent", "at")
            children = named.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < F.col("left"))
            front = children.select("page_id", "place", "url")
            taken = children.groupBy("page_id").agg(F.count("*").cast("int").alias("taken"))
            budgets = budgets.join(taken, "page_id", "left").select("page_id", (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"))
    kept = F.slice("locs", 1, policy.listed) if policy.listed is not None else F.col("locs")
    return out.withColumn("locs", kept)


def discovered(tree: DataFrame) -> DataFrame:
    """The addresses of all sitemaps that are no index, each once, in the order of fetching: page_id, loc, at."""
    rows = tree.filter("NOT is_index OR level > 0").select("page_id", "level", "place", F.posexplode("locs").alias("k", "loc"))
    return rows.groupBy("page_id", "loc").agg(F.min(F.struct("level", "place", "k")).alias("at"))
