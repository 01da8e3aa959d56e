"""Ranked search against a version written out by the definition: odd rows, ties, tiny shards, blocks of queries, single trees."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import lexical

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    mine = [(i, Counter(terms(text))) for i, text in docs if terms(text)]
    n_docs, n_terms, df = len(mine), sum(sum(c.values()) for _, c in mine), Counter(t for _, c in mine for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, c in mine:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_whole_tables(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert Counter(map(tuple, lexical.op12_lexical(spark, SF).collect())) == brute(docs, items)


ODD = [
    (1, None), (2, ""), (3, "The cat sat"), (3, "The cat sat"), (None, "the cat"), (None, "the cat"), (4, " \n.-"), (5, "word " * 30_000 + "cat"), (6, "ÉTÉ été ſ 15 a_b"),
    (7, "CAT cat Cat"), (9, "the"), (8, "the"), (-4, "the"), (2**62, "the cat sat on the mat"),
] + [(k, f"w{k % 7} w{k % 5} the x{k}") for k in range(20, 120)]
ITEMS = [(1, "the cat"), (1, "the cat"), (2, None), (3, ""), (4, "unknown words"), (None, "w1 w2 w3 x30 x30 the"), (5, "cat " * 500), (6, "été É 15 b"), (7, " ".join(f"x{k}" for k in range(200)))]


@pytest.mark.parametrize("shard_docs, postings, block, k", [(4096, 1 << 19, 1 << 19, 20), (1, 1 << 19, 3, 5), (7, 30, 10, 3), (64, 50, 1, 500)])
def test_odd_rows(spark, monkeypatch, shard_docs, postings, block, k):
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("terms", F.lit("x")).withColumn("query", F.lit(1)).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("query", F.lit("x")).withColumn("score", F.lit(0))
    got = lexical.searched(lexical.index(docs, shard_docs, postings), items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute(ODD, ITEMS, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(ODD, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.searched(lexical.index(docs.limit(0)), items).count() == 0
    assert lexical.searched(lexical.index(docs), items.limit(0)).count() == 0
    assert lexical.searched(lexical.index(docs.filter("doc_id IN (1, 2)")), items).count() == 0


@pytest.mark.parametrize("opened, k", [(1, 3), (4, 1), (128, 10)])
def test_a_tree_opens_few_nodes_and_is_exact(monkeypatch, opened, k):
    """Bounds keep the search from most documents, and what it returns is what all scores give."""
    monkeypatch.setattr(lexical, "OPENED", opened)
    rng = np.random.default_rng(opened)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 300) for _ in range(1000)]
    shard = lexical.Builder(1000, sum(len(t.split()) for t in texts))
    for i, text in enumerate(texts):
        shard.add(3 * i, text)
    tree, names = next(lexical.trees(iter([shard.finish()])))
    counts, place = [Counter(t.split()) for t in texts], {t: n for n, t in enumerate(names.to_pylist())}
    for _ in range(20):
        asked = rng.choice(list(place), 8, replace=False)
        weights = rng.integers(1, 9000, 8)
        scores = []
        for i, c in enumerate(counts):
            m = 75 + 25 * len(texts[i].split()) * 1000 // shard.n_terms
            scores.append((-sum(int(w) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, w in zip(asked, weights) if c[t]), False, 3 * i))
        want = [s for s in sorted(scores)[:k] if s[0] < 0]
        assert tree.search(np.array([place[t] for t in asked]), weights, k, []) == want
