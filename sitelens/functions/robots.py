"""Rules of robots.txt and addresses of sitemaps, as expressions over arrays of lines.

Files are read in four ways: for discovery, for comparison, for the fetch layer, and as a count of rules.
The last agent line governs the lines after it; a comment is a line of its own, so a path keeps what follows it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


@dataclass(frozen=True)
class Reader:
    """agent: a name, besides `*`, whose sections count; fold: paths in lower case; whole: crawl delays as
    whole seconds; once: each sitemap once; empty: rules without a path count."""

    agent: str | None = None
    fold: bool = False
    whole: bool = False
    once: bool = False
    empty: bool = False


DISCOVERY = Reader(agent="sitelensbot", fold=True, whole=True)
COMPARISON = Reader(fold=True)
LAYERED = Reader(once=True)
COUNTER = Reader(once=True, empty=True)


def rules(content: Column, reader: Reader = LAYERED) -> Column:
    """struct(allow, disallow, sitemaps, delay_ms)."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("on"), none.alias("allow"), none.alias("disallow"), none.alias("sitemaps"), F.lit(None).cast("double").alias("delay"))
    number = r"^([+-]?\d+)" if reader.whole else r"^([+-]?(?:\d+\.?\d*|\.\d+))"

    def step(a: Column, line: Column) -> Column:
        name = F.lower(F.substring_index(line, ":", 1))
        value = F.trim(F.regexp_replace(line, "^[^:]*:?", ""))
        agent = F.lower(value)
        ours = (agent == "*") | (agent.contains(reader.agent) if reader.agent else F.lit(False))
        path = F.lower(value) if reader.fold else value
        rule = a["on"] & line.contains(":") & (F.lit(reader.empty) | (value != ""))
        delay = F.nullif(F.regexp_extract(value, number, 1), F.lit("")).cast("double")
        return F.struct(
            F.when(name == "user-agent", ours).otherwise(a["on"]).alias("on"),
            F.when(rule & (name == "allow"), F.array_append(a["allow"], path)).otherwise(a["allow"]).alias("allow"),
            F.when(rule & (name == "disallow"), F.array_append(a["disallow"], path)).otherwise(a["disallow"]).alias("disallow"),
            F.when((name == "sitemap") & (value != ""), F.array_append(a["sitemaps"], value)).otherwise(a["sitemaps"]).alias("sitemaps"),
            F.when(a["on"] & (name == "crawl-delay") & delay.isNotNull(), delay).otherwise(a["delay"]).alias("delay"),
        )

    sitemaps = (lambda a: F.array_distinct(a["sitemaps"])) if reader.once else (lambda a: a["sitemaps"])
    return F.aggregate(lines, start, step, lambda a: F.struct(a["allow"].alias("allow"), a["disallow"].alias("disallow"), sitemaps(a).alias("sitemaps"), (a["delay"] * 1000).cast("int").alias("delay_ms")))


def allowed(path: Column, rule: Column, fold: bool = False) -> Column:
    """An allowed prefix wins over a disallowed one; without either, or without rules, the path is allowed."""
    path = F.lower(path) if fold else path
    return F.coalesce(F.exists(rule["allow"], lambda p: path.startswith(p)) | ~F.exists(rule["disallow"], lambda p: path.startswith(p)), F.lit(True))


def is_robots(content: Column) -> Column:
    """Whether a file is one of rules, not a page that stands in for a missing file."""
    return F.coalesce(content.rlike("(?i)User-agent|Sitemap|Disallow|Allow"), F.lit(False))


def is_sitemap(content: Column) -> Column:
    return F.coalesce(content.rlike("(?i)<urlset|<sitemapindex|<url>|<loc>"), F.lit(False))


def locations(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), lambda x: F.trim(x))


def contact_locations(xml: Column) -> Column:
    """Contact pages that a sitemap names; an index names none."""
    found = F.filter(locations(xml), lambda x: x.rlike(V.CONTACT_ADDRESS))
    return F.when(xml.contains("<sitemapindex"), F.array().cast("array<string>")).otherwise(found)
