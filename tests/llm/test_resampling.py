"""Importance resampling against a version written out by the definition: odd rows, ties, longer features, hot rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelens.llm import resampling

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def codes(text, length):
    words = WORDS.findall((text or "").translate(LOWER))
    runs = [" ".join(words[k : k + n]) for n in range(1, length + 1) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(docs, target, length=1, percent=10):
    mine = [(i, *codes(text, length)) for i, text in docs]
    s, t = Counter(c for *_, x in mine for c in x), Counter(c for text in target for c in codes(text, length)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000) / ((s[b] + 1.0) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for i, n, x in mine:
        w = sum(gain[c] for c in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    may = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = may[: percent * len(may) // 100]
    return Counter((*r[:4], k + 1) for k, r in enumerate(drawn)) + Counter((*r[:4], None) for r in rows if r[4] < 20) + Counter((*r[:4], None) for r in may[len(drawn) :])


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(map(tuple, resampling.op11_resampling(spark, SF).collect())) == brute(docs, target)


@pytest.mark.parametrize("length, percent", [(1, 50), (3, 30), (2, 100), (1, 0)])
def test_odd_rows(spark, length, percent):
    text = "One two three four five six seven eight nine ten eleven twelve Thirteen fourteen 15 sixteen ÉTÉ été ſ eighteen nineteen twenty"
    docs = [(1, None), (2, ""), (3, text), (3, text), (None, text), (None, text + " x"), (4, "a b"), (5, "word " * 30_000), (6, " \n.;"), (7, text.upper()), (8, text[:110])]
    docs += [(9, text)] * 40 + [(k, text + f" w{k}") for k in range(10, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).withColumn("tokens", F.lit(None).cast("int"))
    target = ["two three", None, "", "ÉTÉ word"]
    got = resampling.drawn(spark, df, spark.createDataFrame([(x,) for x in target], "text string"), length, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(docs, target, length, percent)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 25)], "doc_id long, text string")
    assert resampling.drawn(spark, docs.limit(0), docs).count() == 0
    assert Counter(map(tuple, resampling.drawn(spark, docs, docs.limit(0), percent=100).collect())) == brute([(1, "a " * 25)], [], percent=100)


def test_only_totals_and_drawn_rows_move(spark):
    """Weights come from expressions on the row: no join, no generator and no exchange stands over the scan."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = resampling.scored(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Generate", "Join"))
