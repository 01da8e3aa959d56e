"""Quality classifier: a regularised quadratic discriminant over document statistics.

Counts of a text become about a dozen transformed statistics. Each class has a Gaussian over them,
whose covariance is shrunk towards the pooled one and towards a multiple of the identity; a score is
the difference of the two log densities (Mahalanobis distances by cached Cholesky factors) and the
classes' log shares, through the logistic function. Means and covariances come from sums over all
labelled rows, a row per task, so nothing that grows with the corpus reaches the driver; the sums are of whole
multiples of 1 / GRID, so that they are the same in whatever order the rows come.

Defined results: a null text counts as empty, and empty texts get a score like others; without labels
of both classes the score is the share of label 1 (1 without any label); ids may repeat or be null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, forget, fresh, small_batches, table

#: Weight of the pooled covariance and of the identity's multiple in a class's covariance.
POOLED, ROUND = 0.05, 0.02
#: Scores from here on predict label 1.
THRESHOLD = 0.3
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS, _STOPS, _COMMAS = b"#*$%&|<>{}[]=+~^_\\/@", b".?", b",;:"
STATISTICS = 14
#: Parts of one that statistics are summed in.
GRID = 1 << 14
USUAL = 20


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; ratios are to words or bytes, smoothed so that short texts stay near the middle."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    n, size = len(words), len(data)
    less = lambda drop: size - len(data.translate(None, drop))
    # A usual share stands in for the first USUAL units of each ratio.
    rate = lambda k, of, usual: float(np.log((k + USUAL * usual) / (of + USUAL)))
    distinct = len(set(words))
    letters = sum(map(len, words))
    return [
        float(np.log(n + USUAL)),
        float(np.log((letters + 5 * USUAL) / (n + USUAL))),
        float(np.log(distinct + USUAL) - 0.8 * np.log(n + USUAL)),
        rate(sum(map(operator.eq, words, words[1:])), n, 0.01),
        rate(sum(map(operator.eq, words, words[2:])), n, 0.01),
        rate(len(lines) - len(set(lines)), len(lines), 0.02),
        rate(less(_UPPER), size, 0.03),
        rate(less(_DIGITS), size, 0.005),
        rate(less(_SYMBOLS), n, 0.005),
        rate(data.count(b"!"), n, 0.005),
        rate(less(_STOPS), n, 0.1),
        rate(less(_COMMAS), n, 0.05),
        rate(size - letters, size, 0.17),
        float(np.log1p(max(map(len, words), default=0) + 10)),
    ]


class Model:
    """share: of label 1; by class: mean and the inverse of the covariance's Cholesky factor, and half its log determinant."""

    def __init__(self, share: float, classes: list[tuple[np.ndarray, np.ndarray, float]]):
        self.share, self.classes = share, classes

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.share)
        logs = []
        for mean, inverse, half_log in self.classes:
            z = (x - mean) @ inverse.T
            logs.append(-0.5 * np.einsum("ij,ij->i", z, z) - half_log)
        odds = np.log(self.share / (1 - self.share)) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def solve(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """sums: by class the rows, the sum of their statistics and of their outer products."""
    sums = {k: v for k, v in sums.items() if v[0] > 0}
    n = sum(v[0] for v in sums.values())
    if len(sums) < 2:
        return Model(float(1 in sums or not sums), [])
    means = {k: s / m for k, (m, s, _) in sums.items()}
    scatter = {k: q - m * np.outer(means[k], means[k]) for k, (m, _, q) in sums.items()}
    pooled = sum(scatter.values()) / n
    classes = []
    for k in (0, 1):
        m = sums[k][0]
        # A class of few rows leans on the pooled covariance more.
        lean = max(POOLED, STATISTICS / (m + STATISTICS))
        cov = (1 - lean) * scatter[k] / m + lean * pooled
        cov = (1 - ROUND) * cov + ROUND * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-6 * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        classes.append((means[k], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return Model(sums[1][0] / n, classes)


def matrix(x: pa.Array) -> np.ndarray:
    """A row of statistics for each of an array's lists."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every row of docs."""
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    small_batches(docs.sparkSession)
    return docs.select("doc_id", run("text").alias("x"))


def fit(spark: SparkSession, rows: DataFrame, labels: DataFrame, may_learn: Column | None = None) -> Model:
    """rows: measured(); labels: doc_id, quality. Learns from every labelled row, or those that may_learn (over doc_id) picks."""
    labels = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    labels = labels.filter(may_learn) if may_learn is not None else labels
    known = rows.join(labels, "doc_id").select("quality", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            quality, every = batch.column(0).to_numpy(), matrix(batch.column(1))
            for k in np.unique(quality).tolist():
                x = np.rint(every[quality == k] * GRID).astype(np.int64)
                new = (len(x), x.sum(0), x.T @ x)
                totals[k] = [a + b for a, b in zip(totals[k], new)] if k in totals else list(new)
        rows = [(k, n, s, q.ravel()) for k, (n, s, q) in totals.items()]
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["k", "n", "s", "q"])

    each = known.select(F.col("quality").cast("int").alias("quality"), "x").mapInArrow(run, "k int, n long, s array<long>, q array<long>")
    sums = {}
    by = each.select("k", "n", F.posexplode(F.concat("s", "q")).alias("i", "v")).groupBy("k", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"))
    d, found = STATISTICS, by.collect()
    for k in (0, 1):
        own = {r["i"]: r for r in found if r["k"] == k}
        if own:
            s, q = ([float(own[i]["v"]) / unit for i in range(*at)] for unit, at in ((GRID, (0, d)), (GRID * GRID, (d, d + d * d))))
            sums[k] = (float(own[0]["n"]), np.array(s), np.array(q).reshape(d, d))
    return solve(sums)


def scorer(spark: SparkSession, model: Model):
    """A column function: statistics -> score."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(matrix(x)))

    return run


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    rows = cut(measured(docs))
    model = fit(spark, rows, table(spark, sf_dir, "labels"), ~held_out)
    out = rows.select("doc_id", held_out.alias("held_out"), scorer(spark, model)("x").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts label 1 for; all, where no labels of both classes are known and
    there is one of label 1 or none. Rows are judged alone, whatever their ids; a null text counts as empty; other
    columns stay, whatever their names."""
    found = fresh(docs.columns, 1)[0]
    # A task that measures and sums at once needs two Python workers, and those live on through all later stages.
    rows = cut(measured(docs))
    model = fit(spark, rows, table(spark, sf_dir, "labels"))
    forget(rows)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(np.array([statistics(t.as_py()) for t in texts]).reshape(-1, STATISTICS)))

    return docs.withColumn(found, run("text")).filter(F.col(found) >= THRESHOLD).drop(found)
