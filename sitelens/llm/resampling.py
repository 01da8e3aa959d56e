"""Importance resampling towards a target distribution, scored without exploding a document.

A document's features (runs of words) are hashed to buckets; higher-order functions make the array of its buckets. The
corpus's and the target's count of each bucket give the bucket's gain, a log ratio of their smoothed shares; the
gains are one literal array of BUCKETS entries, and a document's weight is the floored mean of its buckets'
gains, an aggregate over element_at. Only totals by bucket are shuffled for it: at most BUCKETS rows of each task.

A score is the weight plus Gumbel noise from a hash of the id, so that the highest scores are a sample without replacement.
Scores are whole numbers of a bounded range, so a count of each score (some 100 000 rows at most, whatever the
corpus) gives the score that is reached by the sample; only rows from that score on are range-sorted, and their
ranks are places in the sorted partitions.

Defined results: a null text has no words and weight 0; a null id counts as the empty text in the noise and comes last in
ties; rows of one id and score are ranked in an order of their own; rows with fewer than MIN_WORDS words are never
drawn; an empty table gives an empty result; an empty target gives gains from smoothing alone; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keyed, parts, stored, table

#: Buckets of features, words of a feature at most, scale of logarithms, words that a document needs, share that is drawn in per cent.
BUCKETS, LENGTH, SCALE, MIN_WORDS, PERCENT, SEED = 10_000, 1, 1000, 20, 10, 2024
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "".join(map(chr, range(65, 91)))


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def buckets(tokens: Column, length: int = LENGTH) -> Column:
    """The bucket of every run of 1 to length words, as an array."""
    code = lambda run: (F.crc32(run.cast("binary")) % BUCKETS).cast("int")
    runs, out = tokens, F.transform(tokens, code)
    for n in range(2, length + 1):
        # A run of n words is one of n - 1 and the word after it; the array of later words is shorter, which leaves nulls at the end.
        later = F.when(F.size(tokens) >= n, F.slice(tokens, n, F.size(tokens))).otherwise(F.array().cast("array<string>"))
        runs = F.filter(F.zip_with(runs, later, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
        out = F.concat(out, F.transform(runs, code))
    return out


def totals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Features in each bucket that has any: bucket, n. Tasks count their own before the shuffle."""
    return docs.select(F.explode(buckets(words(F.col("text")), length)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, length: int = LENGTH) -> list[int]:
    """The gain of every bucket: BUCKETS numbers, whatever the size of either side."""
    spark = docs.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    for name, df in (("s", docs), ("t", target)):
        both = both.join(totals(df, length).withColumnRenamed("n", name), "bucket", "left")
    both = both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"))
    # BUCKETS rows, so one task sums them.
    both = both.withColumns({f"all_{c}": F.sum(c).over(W.partitionBy()) for c in "st"})
    ratio = (F.col("t") + 1) * (F.col("all_s") + BUCKETS) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    rows = both.select("bucket", F.floor(SCALE * F.log(ratio)).cast("long").alias("gain")).collect()
    return [r.gain for r in sorted(rows)]


def weight(codes: Column, gain: list[int]) -> Column:
    """The floored mean of the buckets' gains; 0 for no bucket."""
    table_ = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to a literal array
    total, n = F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: a + F.element_at(table_, b + 1)), F.size(codes).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(((total - F.pmod(total, n)) / n).cast("long"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise by the id's hash, as a whole number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_features, weight, score."""
    gain = gains(docs, target, length)
    rows = docs.select("doc_id", words(F.col("text")).alias("tokens"))
    rows = rows.select("doc_id", F.size("tokens").cast("long").alias("n_words"), buckets(F.col("tokens"), length).alias("codes"))
    rows = rows.select("doc_id", "n_words", F.size("codes").cast("long").alias("n_features"), weight(F.col("codes"), gain).alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def drawn(spark: SparkSession, docs: DataFrame, target: DataFrame, length: int = LENGTH, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn."""
    rows = keyed(stored(scored(docs, target, length, seed)), "row")
    may = F.col("n_words") >= MIN_WORDS
    # A row for each score: whole numbers between bounds that the hash and the doubles set.
    counts = rows.filter(may).groupBy("score").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow))
    reached = counts.select("score", (upto - F.col("n")).alias("above"), F.expr(f"{percent} * sum(n) OVER () div 100").alias("quota"))
    edge = reached.filter(F.col("above") < F.col("quota")).agg(F.min("score").alias("score"), F.max("quota").alias("quota")).first()
    out = ["doc_id", "n_features", "weight", "score"]
    if edge.score is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    may = may & (F.col("score") >= edge.score)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    places = rows.filter(may).repartitionByRange(parts(rows), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    places = stored(places.select(*out, F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at")))
    # A row for each partition.
    sizes = places.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at") + 1
    ranked = places.join(F.broadcast(before), "part").select(*out, F.when(rank <= edge.quota, rank).alias("rank"))
    return rows.filter(~may).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked)


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return drawn(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same in DuckDB's SQL; crc32 by its table of 256 remainders, made by its rule, and a word's bytes one after another.
OP11_SQL = f"""
WITH RECURSIVE step(b, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8
), d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SEPARATORS}'), lambda w: w <> '') AS w FROM documents
), g AS (
  SELECT list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{SEPARATORS}'), lambda w: w <> '') AS w FROM benchmark
), dw AS (SELECT row, w, count(*) AS n FROM (SELECT row, unnest(w) AS w FROM d) GROUP BY 1, 2
), gw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM g) GROUP BY 1
), names AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM gw)
), bytes AS (SELECT w, list_transform(range(1, 2 * strlen(w), 2), lambda k: CAST('0x' || substr(hex(encode(w)), k, 2) AS BIGINT)) AS b FROM names
), coded AS (
  SELECT w, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM bytes, crc
), s AS (SELECT bucket, sum(n) AS n FROM dw JOIN coded USING (w) GROUP BY 1
), t AS (SELECT bucket, sum(n) AS n FROM gw JOIN coded USING (w) GROUP BY 1
), gain AS (
  SELECT bucket, CAST(floor({SCALE} * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(n) FROM s), 0) + {BUCKETS}::DOUBLE) / ((s.n + 1.0::DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS}::DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), m AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM dw JOIN coded USING (w) JOIN gain USING (bucket) GROUP BY 1
), x AS (
  SELECT d.row, doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % m.n) + m.n) % m.n) // m.n, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (row)
), y AS (
  SELECT *, weight + CAST(floor(-{SCALE} * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x
), r AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= {MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (row)
"""
