"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source has a training target, in words, and a weight schedule over training time 0..1.
The schedule is linear, so its integral (the cumulative token demand) is a quadratic that is
inverted in closed form: the word that is the k-th of its source's target is trained on at the
time at which the source's cumulative demand reaches k. Every copy of a document gets the time of its
middle word, and a range sort on that time gives the training order.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source
of its own, ordered last; rows that repeat an id are rows of their own, and rows without an id stand by their
text; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, cut, fresh, keyed, parts, table

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: The weight schedule (start, end) that goes with each weight: large sources early, small ones late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MAX_REPEATS = 3
#: Hexadecimal digits of the shuffled order that split a source, so that no source is one task.
SPLIT_DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> the same with weight, kind and target.

    Resharing the excess of the capped sources until none is above its cap is filling to one
    level: with sources in order of cap / weight, a prefix of them is capped and the others get
    level * weight. The table has a row per source, so its windows need no partitioning.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.select("source", "source_size", kind.alias("kind"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    by_level = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy()
    s = s.withColumns({
        "n": F.row_number().over(by_level),
        "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    })
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("n"))).over(every))
    return s.select("source", "source_size", "kind", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: size, its source's size and target, words taken, and the training times of its copies
    (position: of the first), with the columns of keep.

    Documents of a source stand in the order of the md5 of their ids. Every document is taken
    floor(target / source size) times; the rest of the target is taken from the front of that
    order, the last document of it in part. Running totals go through sums of small ranges of
    the order, so a source with a third of all rows is spread over 4096 window groups.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), key.alias("order"), *keep)
    sized = sized.withColumns({
        "skey": F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")),
        "range": F.conv(F.substring("order", 1, SPLIT_DIGITS), 16, 10).cast("int"),
    })
    sized = cut(sized)
    ranges = sized.groupBy("skey", "source", "range").agg(F.sum("size").alias("words"))
    plan = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    plan = plan.withColumn("skey", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))).drop("source")
    earlier = W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("skey", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")).join(plan, "skey")
    inside = W.partitionBy("skey", "range").orderBy("order", F.col("doc_id").asc_nulls_first(), "size")
    docs = sized.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    docs = docs.join(ranges, ["skey", "range"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    docs = docs.withColumn("whole", whole)
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long")
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("start")))
    docs = docs.withColumn("taken", (F.col("whole") * F.col("size") + part).cast("long"))
    a = F.element_at(F.array(*(F.lit(float(x)) for x, _ in schedules)), F.col("kind") + 1)
    b = F.element_at(F.array(*(F.lit(float(x)) for _, x in schedules)), F.col("kind") + 1)

    def time(copy: Column) -> Column:
        # The middle of a copy, as a share of its source's target.
        middle = (F.col("start") + copy * F.col("source_size") + F.col("size") / 2) / F.col("target")
        demand = F.when(F.col("target") > 0, F.least(F.lit(1.0), middle)).otherwise(1.0) * (a + b) / 2
        # (b - a) / 2 * t * t + a * t = demand, in the form that also holds for b = a
        return F.round(2 * demand / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) * demand))), 9)

    last = F.col("whole") - F.when(part > 0, 0).otherwise(1)
    copies = F.when(last >= 0, F.transform(F.sequence(F.lit(0).cast("long"), last), time)).otherwise(F.array().cast("array<double>"))
    return docs.select(*keep, "doc_id", "source", "size", "source_size", "target", "taken", time(F.lit(0)).alias("position"), copies.alias("positions"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, range-sorted by training position."""
    out = mix(table(spark, sf_dir, "documents"))
    last = F.coalesce(F.try_element_at("positions", F.lit(-1)), "position")
    return out.select("doc_id", "size", "source_size", "target", "taken", "position", last.alias("last_position")).orderBy("position", "doc_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as many times as it takes it, to the nearest whole copy, in
    training order: partitions hold successive spans of training time, each sorted.

    A text without words is never taken; rows that repeat an id, or have none, are mixed row by row; equal times
    stand by id; an empty table gives an empty result; other columns stay, whatever their names."""
    row, at = fresh(docs.columns, 2)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    docs = keyed(docs, row)
    copies = F.slice("positions", 1, F.greatest(F.lit(0), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")))
    times = mix(docs.select("doc_id", "source", "text", row), keep=(row,)).filter("taken > 0").select(row, F.explode(copies).alias(at))
    n = parts(docs)
    out = docs.join(times, row).repartitionById(n, F.least(F.lit(n - 1), F.floor(F.col(at) * n)).cast("int"))
    return out.sortWithinPartitions(at, "doc_id").select(*columns)


#: The same in DuckDB's SQL.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS o FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS kind FROM s
), w AS (
  SELECT *, CAST(CASE kind WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM k
), l AS (
  SELECT *, row_number() OVER by_level AS n,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (by_level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW by_level AS (ORDER BY cap / weight, source ASC NULLS LAST)
), f AS (
  SELECT (SELECT level FROM l WHERE level * weight <= cap ORDER BY n LIMIT 1) AS level
), t AS (
  SELECT l.source, l.source_size, l.kind, least(cap, coalesce(f.level * weight, cap)) AS target FROM l, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.kind,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, CASE kind WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a, CASE kind WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS b,
         greatest(0, least(size, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) - start)) AS part FROM p
), c AS (
  SELECT *, CASE WHEN target > 0 THEN least(1.0::DOUBLE, (start + CAST(size AS DOUBLE) / 2) / target) ELSE 1.0::DOUBLE END * (a + b) / 2 AS demand,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, (start + greatest(0, whole - CASE WHEN part > 0 THEN 0 ELSE 1 END) * source_size + CAST(size AS DOUBLE) / 2) / target) ELSE 1.0::DOUBLE END * (a + b) / 2 AS last_demand FROM x
)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken,
       round(2 * demand / (a + sqrt(greatest(0.0, a * a + 2 * (b - a) * demand))), 9) AS position,
       round(2 * last_demand / (a + sqrt(greatest(0.0, a * a + 2 * (b - a) * last_demand))), 9) AS last_position
FROM c
"""
