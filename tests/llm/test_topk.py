"""Exact top k in several blocks, with pruned buckets, great values and odd rows."""

import collections
import math

import numpy as np
import pytest

from sitelens.llm import topk


def best(rows, queries, k=5):
    sound = [(i, [math.floor(256 * c) if abs(256 * c) < 2**53 else int(256 * c) for c in x]) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(256 * c) for c in x)]
    limit = 2**62 - 1
    score = lambda a, b: max(-limit, min(limit, sum(p * q for p, q in zip(a, b))))
    return {q: sorted((-score(x, y), i) for i, y in sound if i != q and len(x) == len(y))[:k] for q, x in sound if queries(q)}


@pytest.mark.parametrize("block, bucket, chunk, coordinates", [(1 << 15, 1024, 8192, 0.6), (7, 16, 64, 0.6), (50, 8, 100, 2.0), (50, 8, 100, 0.0)])
def test_whole_answers(spark, monkeypatch, block, bucket, chunk, coordinates):
    for name, value in {"BLOCK": block, "BUCKET": bucket, "CHUNK": chunk, "COORDINATES_FROM": coordinates}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    rows = [(k, [float(v) for v in rng.normal(0, 0.1 + k % 7, 6)]) for k in range(400)]
    rows += [(401, None), (402, []), (403, [float("nan")] * 6), (404, [1.0, None] * 3), (None, [1.0] * 6), (405, [1e307] * 6), (406, [0.0] * 6), (500, [0.0] * 6), (407, [1.0] * 4), (550, [2.0] * 4)]
    rows += [(410, [1e18] * 6), (411, [-1e18] * 6), (412, [1e17, 0.0] * 3), (600, [1e18] * 6), (650, [1e290] * 6), (700, [3.0] * 6), (413, [3.0] * 6), (414, [3.0] * 6)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(3)
    got = collections.defaultdict(list)
    for r in topk.searched(spark, vectors.filter("vec_id % 50 = 0"), vectors).collect():
        got[r.query_id].append((r.rank, -r.score, r.vec_id))
    want = best(rows, lambda i: i % 50 == 0)
    assert {q: [(s, i) for _, s, i in sorted(x)] for q, x in got.items()} == {q: x for q, x in want.items() if x}


def test_empty_tables_and_repeated_queries(spark):
    rows = spark.createDataFrame([(50, [1.0, 2.0]), (50, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    v = topk.quantised(rows)
    got = sorted(tuple(r) for r in topk.searched(spark, v.filter("vec_id = 50"), v).collect())
    assert got == [(50, 1, 3, 3 * 65536), (50, 1, 3, 3 * 65536)]
    none = topk.quantised(rows.limit(0))
    assert topk.searched(spark, none, v).count() == topk.searched(spark, v, none).count() == 0
