"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of 2, 3 and 4 letters (as UTF-8 bytes, lower case, a space at either
end of a word); each is hashed to a row of an embedding table, the rows are averaged and a softmax
over the languages reads the average. Table and softmax are trained by stochastic gradient descent
in numpy on a sample of the labelled rows of every language, SAMPLE of each at most, in one task
that keeps the sample's bags on its disk; a temperature and a rejection threshold are fitted on a part
of the sample that training doesn't see. A prediction is rejected when its
calibrated probability is under the threshold.

As the softmax is linear, table and weights are multiplied out before they are sent to the executors
where there are DIM languages at most: a row of DIM numbers per bucket, the same size whatever the corpus.

Defined results: a text that is null or has no letter is `und` with score 0 and rejected; without
any labelled row all texts are; ids may repeat or be null; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_mod, fresh, small_batches, table

#: Labelled rows that are learned from, of a language at most and in all; all rows where there are fewer.
SAMPLE, MOST = 1000, 200_000
#: Languages up to which their counts are broadcast (a name and a number each); more are joined.
SENT = 10_000
#: Rows of the sample that are calibrated on at a time.
CALIBRATED = 1024
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 15, 16, 6, 0.3, 7
#: Share of correctly predicted calibration rows that may be rejected, and the highest threshold.
LOST, HIGHEST = 0.002, 0.5
#: Bytes of a text that are hashed at a time.
SLICE = 1 << 20
_SPACES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all subwords of a text, some at a time."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split()) + b" "
    for start in range(0, len(data), SLICE):
        a = np.frombuffer(data, np.uint8, min(SLICE + 3, len(data) - start), start).astype(np.uint64)
        blank = a == 32
        code = a
        for n in (2, 3, 4):
            if len(a) < n:
                break
            code = (code[:-1] << np.uint64(8)) | a[n - 1 :]
            # Slices overlap by three bytes; a run that starts in the overlap belongs to the next one.
            whole = code[:SLICE] if len(a) > SLICE else code
            inner = np.zeros(len(code), bool)
            for k in range(1, n - 1):
                inner |= blank[k : k + len(code)]
            hashed = ((whole + np.uint64(n << 40)) * _MULTIPLIER >> np.uint64(49)).astype(np.int64) % BUCKETS
            yield hashed[~inner[: len(whole)]]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, and how often each occurs."""
    counts = sum((np.bincount(b, minlength=BUCKETS) for b in buckets(text)), np.zeros(BUCKETS, np.int64))
    at = np.flatnonzero(counts)
    return at, counts[at]


class Model:
    """classes; scores: a row per bucket, with the softmax's weights multiplied in unless these are in out; bias; temperature; threshold."""

    def __init__(self, classes, scores, bias, temperature=1.0, threshold=0.0, out=None):
        self.classes, self.scores, self.bias, self.temperature, self.threshold, self.out = classes, scores, bias, temperature, threshold, out

    def weighed(self, mean: np.ndarray) -> np.ndarray:
        return (mean if self.out is None else mean @ self.out) + self.bias

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.scores.shape[1]), 0
        for b in buckets(text):
            total += self.scores[b].sum(0, dtype=np.float64)
            n += len(b)
        return self.weighed(total / max(n, 1))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is rejected."""
        if not self.classes or not has_letter(text):
            return "und", 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Spool(Sequence):
    """Rows of language, buckets and counts, in an order of their content; the numbers are in a file of the task."""

    def __init__(self, rows: Iterator[tuple[str, np.ndarray, np.ndarray]]):
        self.file, self.rows, end = tempfile.TemporaryFile(), [], 0
        for lang, at, counts in rows:
            data = at.astype(np.int32).tobytes() + counts.astype(np.int32).tobytes()
            self.file.write(data)
            self.rows.append((lang, len(at), xxhash.xxh3_128_digest(data), end))
            end += 2 * len(at)
        self.file.flush()
        self.rows.sort()
        self.numbers = np.memmap(self.file, np.int32, "r") if end else np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[str, np.ndarray, np.ndarray]:
        lang, n, _, start = self.rows[k]
        return lang, self.numbers[start : start + n], self.numbers[start + n : start + 2 * n]


def train(rows: Sequence[tuple[str, np.ndarray, np.ndarray]], languages: Sequence[str]) -> Model:
    """rows: language, buckets and counts; languages: those of the rows. Every fifth row is held back for calibration."""
    classes = sorted(set(languages))
    if not classes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    place = {x: k for k, x in enumerate(classes)}
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    held, used = (order[::5], [k for n, k in enumerate(order) if n % 5]) if len(rows) >= 50 else (order, order)
    table_, out, bias = rng.normal(0, 1, (BUCKETS, DIM)), np.zeros((DIM, len(classes))), np.zeros(len(classes))
    steps, step = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(used)):
            lang, at, counts = rows[used[k]]
            if not len(at):
                continue
            rate = RATE * (1 - step / steps)
            step += 1
            share = counts / counts.sum()
            hidden = share @ table_[at]
            error = softmax(hidden @ out + bias)
            error[place[lang]] -= 1
            to_hidden = out @ error
            out -= rate * np.outer(hidden, error) / max(hidden @ hidden, 0.1)
            bias -= 0.1 * rate * error
            # So scaled that the average itself moves by the step, however many subwords share it.
            table_[at] -= np.outer(share / (share @ share), 0.1 * rate * to_hidden)
    if len(classes) <= DIM:
        model = Model(classes, (table_ @ out).astype(np.float32), bias)
    else:
        model = Model(classes, table_.astype(np.float32), bias, out=out)

    def known() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the held rows' languages, and their logits, some rows at a time."""
        for start in range(0, len(held), CALIBRATED):
            part = [rows[k] for k in held[start : start + CALIBRATED]]
            yield np.array([place[x] for x, _, _ in part]), np.array([model.weighed((model.scores[at].T @ counts) / max(counts.sum(), 1)) for _, at, counts in part])

    temperatures = (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)
    loss = sum(np.array([-np.log(np.maximum(softmax(x / t)[np.arange(len(y)), y], 1e-12)).sum() for t in temperatures]) for y, x in known())
    model.temperature = temperatures[int(np.argmin(loss))]
    right = np.concatenate([p.max(1)[p.argmax(1) == y] for y, x in known() for p in [softmax(x / model.temperature)]])
    model.threshold = min(HIGHEST, float(np.quantile(right, LOST))) if len(right) else 0.0
    return model


def sample(spark: SparkSession, docs: DataFrame, may_learn: Column | None = None) -> DataFrame:
    """(lang, at, counts): the bags of SAMPLE rows at most of every language, and of MOST rows in all where languages are many.

    Rows are drawn by a number that is each row's own, whatever its id and text: somewhat more than are needed first, row by row, so that
    little is shuffled, then the first ones of each language.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(F.col("text").rlike(r"\p{L}"))
    known = known.filter(may_learn) if may_learn is not None else known
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    each = max(1, min(SAMPLE, MOST // max(languages, 1)))
    counts = counts.select("lang", F.least(F.lit(1.0), (1.5 * each + 50) / F.col("n")).alias("chance"))
    known = known.join(F.broadcast(counts) if languages <= SENT else counts, "lang")
    own = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id(), F.lit(SEED)), F.lit(1 << 40))
    known = known.select("lang", own.alias("draw"), "text", "chance").filter(F.col("draw") < F.col("chance") * (1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, *bag(text)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in (1, 2))],
                names=["lang", "draw", "at", "counts"],
            )

    bags_ = known.select("lang", "draw", "text").mapInArrow(run, "lang string, draw long, at array<int>, counts array<int>")
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    return bags_.withColumn("place", place).filter(F.col("place") <= each).select("lang", "at", "counts")


def fit(spark: SparkSession, docs: DataFrame, may_learn: Column | None = None) -> Model:
    """Learns from text and lang of a sample of docs (doc_id, text, lang); see sample()."""
    small_batches(spark)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Spool(r for batch in batches if len(batch) for r in bags(batch))
        if len(rows):
            model = train(rows, [r[0] for r in rows.rows])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, 5)], pa.binary())], names=["model"])

    found = sample(spark, docs, may_learn).repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], [])


def bags(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The rows of a batch (lang, at, counts) as views of its numbers."""
    at, counts = batch.column(1), batch.column(2)
    ends, flat_at, flat_counts = at.offsets.to_numpy(), at.values.to_numpy(), counts.values.to_numpy()
    shift = counts.offsets[0].as_py() - int(ends[0])
    for k, lang in enumerate(batch.column(0).to_pylist()):
        yield lang, flat_at[ends[k] : ends[k + 1]], flat_counts[ends[k] + shift : ends[k + 1] + shift]


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct(lang, score, rejected)."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, rejected boolean")
    def run(texts: pa.Array) -> pa.Array:
        found = [sent.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))], names=["lang", "score", "rejected"])

    return run


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(spark, docs, ~held_out)
    out = docs.select("doc_id", held_out.alias("held_out"), predictor(spark, model)("text").alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is not rejected; a text that is null or has no letter is, and without any labelled
    row all are. Rows are judged alone, whatever their ids; other columns stay, whatever their names."""
    found = fresh(docs.columns, 1)[0]
    model = fit(spark, docs)
    return docs.withColumn(found, predictor(spark, model)("text")).filter(~F.col(found)["rejected"]).drop(found)
