"""Exact top-k inner products by norm-bucketed retrieval.

Queries go in blocks of bounded size, each broadcast once; the candidates never move. Where there are several
blocks they run one after the other, and a block's answers are written before the next is fetched, so that the
driver holds one block at a time. Every task sorts its candidates by length into buckets. A query's k-th best
score so far, over its own length and the bucket's greatest, is the local cosine that a vector of the bucket
must reach: above 1 the bucket and all after it are skipped; where it is low, the bucket is cut at the length that
the score needs (length pruning); where it is high, a list of the bucket sorted by the query's largest coordinate bounds the
angle (coordinate pruning). What is left is verified by exact products. Thresholds begin with the
scores among the block's own vectors, so a task passes on few rows beyond the answers.

Components x count as floor(256 * x), x as a double. Products are exact: in doubles while every sum
is below 2 ** 53, else in Python's integers.

Defined results: vectors that are null, empty, or hold null or non-finite components (256 * x included), and rows
without an id, take no part; scores beyond 2 ** 62 - 1 either way count as that; vectors of different lengths are not compared; a query never gets
candidates of its own id; equal scores rank by the smaller id; rows that repeat an id are candidates
of their own, and queries of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, parts, table

K, EVERY, SCALE = 5, 50, 256
#: Query vectors in a block: it takes 8 bytes a component in the driver and in every worker.
BLOCK = 1 << 15
#: Candidates that a task holds at once, and vectors in a bucket.
CHUNK, BUCKET = 8192, 1024
#: Local cosine from which coordinates prune rather than lengths.
COORDINATES_FROM = 0.6
#: Rows of the block that first thresholds are taken from.
SEEDS = 2048
EXACT = float(1 << 53)
#: The score of what is no candidate; its negative is an integer too.
NONE = -(1 << 62)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as integers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        plain = np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT
    if plain:
        return (a @ b.T).astype(np.int64)
    exact = lambda x: np.array([[int(v) for v in r] for r in x], object)
    return np.clip(exact(a) @ exact(b).T, NONE + 1, -NONE - 1).astype(np.int64)


class Best:
    """The k best (score, id) of every query: first by score, then by the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor  # no score below floor is among the k best
        self.scores = np.full((n, k), NONE)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def least(self, q) -> np.ndarray:
        return np.maximum(self.scores[q, -1], self.floor[q])

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: queries by candidates, with candidates to be left out at NONE."""
        if scores.shape[1] > 4 * self.k:
            # A cut at the k-th score keeps all ties with it.
            cut = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            some = np.flatnonzero(cut >= self.least(q)) if len(q) > 1 else np.arange(len(q))
            least = self.least(q)
            for r in some:
                at = np.flatnonzero(scores[r] >= max(cut[r], least[r]))
                self._merge(q[r], scores[r, at], ids[at])
            rest = np.setdiff1d(np.arange(len(q)), some, assume_unique=True)
            for r in rest[scores[rest].max(1) >= least[rest]] if len(rest) else ():
                at = np.flatnonzero(scores[r] >= least[r])
                self._merge(q[r], scores[r, at], ids[at])
        else:
            for r in range(len(q)):
                self._merge(q[r], scores[r], ids)

    def _merge(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]


def search(best: Best, queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
    """Adds the candidates of one chunk to best."""
    q_len = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    v_len = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    order = np.argsort(-v_len, kind="stable")
    vectors, ids, v_len = vectors[order], ids[order], v_len[order]
    alive = np.arange(len(queries))
    for start in range(0, len(vectors), BUCKET):
        own, own_ids, own_len = vectors[start : start + BUCKET], ids[start : start + BUCKET], v_len[start : start + BUCKET]
        if own_len[0] > 0:
            cosine = best.least(alive) / np.maximum(q_len[alive] * own_len[0], 1e-300)
            # Buckets come in order of length, so what a bucket can't reach the later ones can't either.
            keep = (cosine <= 1 + 1e-9) | (q_len[alive] == 0)
        else:
            keep, cosine = np.ones(len(alive), bool), np.zeros(len(alive))
        alive, cosine = alive[keep], cosine[keep]
        if not len(alive):
            return
        by_coordinate = (cosine >= COORDINATES_FROM) & (q_len[alive] > 0)
        # Queries that need like lengths go together, and see the vectors of the bucket that are as long.
        by_length = ~by_coordinate
        needed = cosine[by_length] * own_len[0]
        order = np.argsort(-needed, kind="stable")
        for at in np.split(order, range(256, len(order), 256)):
            q = alive[by_length][at]
            long_enough = slice(0, np.searchsorted(-own_len, -needed[at].min() * (1 - 1e-9), "right") if len(q) and needed[at].min() > 0 else None)
            if len(q):
                scores = products(queries[q], own[long_enough])
                scores[query_ids[q][:, None] == own_ids[None, long_enough]] = NONE
                best.add(q, scores, own_ids[long_enough])
        if by_coordinate.any():
            unit = own / np.maximum(own_len, 1e-300)[:, None]
            lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for q, least in zip(alive[by_coordinate], cosine[by_coordinate]):
                f = int(np.abs(queries[q]).argmax())
                if f not in lists:
                    rank = np.argsort(unit[:, f], kind="stable")
                    lists[f] = rank, unit[rank, f]
                rank, sorted_ = lists[f]
                angle, width = np.arccos(np.clip(queries[q, f] / q_len[q], -1, 1)), np.arccos(min(1.0, least)) + 1e-6
                low, high = np.cos(min(np.pi, angle + width)) - 1e-9, np.cos(max(0.0, angle - width)) + 1e-9
                at = rank[np.searchsorted(sorted_, low, "left") : np.searchsorted(sorted_, high, "right")]
                at = at[own_ids[at] != query_ids[q]]
                if len(at):
                    scores = products(queries[q : q + 1], own[at])
                    best.add(np.array([q]), scores, own_ids[at])


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and the integer components of the vectors that take part, as doubles."""
    scaled = lambda v: F.lit(float(SCALE)) * v.cast("double")
    # A double of 2 ** 53 or more is whole, and may be too great for floor()'s integer.
    x = F.transform("embedding", lambda v: F.when(F.abs(scaled(v)) >= EXACT, scaled(v)).otherwise(F.floor(scaled(v)).cast("double")))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(scaled(v)) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(sound, F.lit(False))
    return vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def by_length(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of each vector length in a batch (vec_id, x)."""
    ids, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    sizes = x.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield ids[at].astype(np.int64), flat[starts[at][:, None] + np.arange(d)]


def searched(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """Exact top k of every query: query_id, rank, vec_id, score. Both: quantised()."""
    q = queries.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)))
    blocks = -(-q.count() // BLOCK)
    found = spark.createDataFrame([], "query long, query_id long, vec_id long, score long")
    # One pass over the candidates for each block of queries; a block's rows are picked by hash.
    for b in range(blocks):
        low, high = (1 << 30) * b // blocks, (1 << 30) * (b + 1) // blocks
        own, sent = found_in(spark, q.filter((F.col("h") >= low) & (F.col("h") < high)).select("vec_id", "x").toArrow(), candidates, k, b)
        if blocks > 1:
            own = cut(own)
            sent.destroy()
        found = found.unionByName(own) if b else own
    ranked = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def found_in(spark: SparkSession, block, candidates: DataFrame, k: int, number: int) -> tuple[DataFrame, Broadcast]:
    """The k best of each task for each query of a block (vec_id, x), and the block as sent to the tasks."""
    groups = {}
    for ids, x in by_length(block) if block.num_rows else ():
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        # Each query's k-th best among the block's own first vectors is a floor for its answers.
        seeds = x[:SEEDS], ids[:SEEDS]
        floor = np.full(len(ids), NONE)
        if len(seeds[1]) > k:
            for at in range(0, len(ids), 1024):
                s = products(x[at : at + 1024], seeds[0])
                s[ids[at : at + 1024, None] == seeds[1][None]] = NONE
                floor[at : at + 1024] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        groups[x.shape[1]] = (ids, x, floor)
    sent = spark.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sent.value
        best = {d: Best(len(ids), k, floor) for d, (ids, _, floor) in groups.items()}
        held: dict[int, list] = {}

        def flush(d: int) -> None:
            ids, x = (np.concatenate(v) for v in zip(*held.pop(d)))
            search(best[d], groups[d][1], groups[d][0], x, ids)

        for batch in batches:
            for ids, x in by_length(batch):
                if (d := x.shape[1]) in groups:
                    held.setdefault(d, []).append((ids, x))
                    if sum(len(v[0]) for v in held[d]) >= CHUNK:
                        flush(d)
        for d in list(held):
            flush(d)
        for d, b in best.items():
            r, c = np.nonzero((b.scores >= b.floor[:, None]) & (b.scores > NONE))
            key = (np.int64(number) << 40) + (np.int64(d) << 20) + r
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key, groups[d][0][r], b.ids[r, c], b.scores[r, c])], names=["query", "query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query long, query_id long, vec_id long, score long"), sent


def op7_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return searched(spark, vectors.filter(F.col("vec_id") % EVERY == 0), vectors.repartition(parts(vectors)))


#: The same in DuckDB's SQL.
OP7_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % {EVERY} = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
