"""The pipeline's stages: odd rows, empty tables, clashing columns, and brute-force versions of what they keep."""

import array
import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sitelens.llm import bpe, language_id, mixing, near_dedup, quality_classifier

SF = "/root/testdata/sf0.001"
STAGES = [language_id.stage, quality_classifier.stage, near_dedup.stage, mixing.stage]
#: Names that helpers might be tempted to use.
CLASH = ["__id", "__n", "__at", "__k", "__row", "__language", "__quality", "one", "own_0", "OWN_1", "range", "order", "component_id", "a.b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    long = "plain words of a quite usual text that goes on. " * 4000
    rows = [(1, None, "en", None), (2, "", None, "a"), (3, "a b", "en", "a"), (3, "a b", "en", "a"), (None, "one two three four five six", "en", "b"), (None, "one two three four five six", None, None),
            (5, long, "en", "a"), (6, " \n\t ", "de", "b"), (7, "ÀÉ İ ſ K ½", "fr", "b"), (8, long, "en", None)]
    return spark.createDataFrame([(*r, None, *("x" for _ in CLASH)) for r in rows], SCHEMA)


@pytest.mark.parametrize("stage", STAGES)
def test_columns_and_empty_tables(spark, odd, stage):
    out = stage(spark, odd, SF)
    assert out.schema.names == odd.schema.names
    kept = collections.Counter(map(tuple, out.collect()))
    assert set(kept) <= set(map(tuple, odd.collect()))
    empty = stage(spark, odd.limit(0), SF)
    assert empty.columns == odd.columns and empty.count() == 0


def test_language_keeps_what_is_not_rejected(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    model = language_id.fit(spark, docs)
    want = collections.Counter(r.text for r in docs.collect() if not model.predict(r.text)[2])
    assert collections.Counter(r.text for r in language_id.stage(spark, docs, SF).collect()) == want and None not in want and "" not in want


def test_quality_keeps_what_is_predicted_good(spark):
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, labels = docs.collect(), {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    sums = {}
    for k in (0, 1):
        x = np.array([quality_classifier.statistics(r.text) for r in rows if labels.get(r.doc_id) == k])
        sums[k] = (float(len(x)), x.sum(0), x.T @ x)
    model = quality_classifier.solve(sums)
    scores = model.scores(np.array([quality_classifier.statistics(r.text) for r in rows]))
    assert {r.doc_id for r in quality_classifier.stage(spark, docs, SF).collect()} == {r.doc_id for r, s in zip(rows, scores) if s >= 0.3}


def curriculum(rows):
    """(time, index of row) of every copy, by brute force."""
    size = [len((r.text or "").split()) for r in rows]
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r.source == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, list(sources), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * total[s]]
        for s in over or free:
            target[s] = 3.0 * total[s] if over else weight[s] * level
            left -= target[s] * bool(over)
        free = [s for s in free if s not in target]
    out = []
    for k, s in enumerate(sources):
        a, b = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))[k % 3]
        if not total[s]:
            continue
        own = sorted((i for i, r in enumerate(rows) if r.source == s), key=lambda i: (hashlib.md5((str(rows[i].doc_id) if rows[i].doc_id is not None else rows[i].text or "").encode()).hexdigest(), rows[i].doc_id or 0, size[i]))
        whole, start = int(target[s] // total[s]), 0
        rest = math.floor(target[s] - whole * total[s] + 0.5)
        for i in own:
            taken = whole * size[i] + max(0, min(size[i], rest - start))
            for c in range(math.floor(taken / size[i] + 0.5) if size[i] else 0):
                low, high, share = 0.0, 1.0, min(1.0, (start + c * total[s] + size[i] / 2) / target[s]) * (a + b) / 2
                for _ in range(60):  # the time at which the integral of the schedule reaches the share
                    t = (low + high) / 2
                    low, high = (t, high) if a * t + (b - a) * t * t / 2 < share else (low, t)
                out.append((t, i))
            start += size[i]
    return out


@pytest.mark.parametrize("table", ["sf", "odd"])
def test_mixing_takes_copies_in_training_order(spark, odd, table):
    docs = (spark.read.parquet(f"{SF}/documents.parquet") if table == "sf" else odd).withColumn("at", F.monotonically_increasing_id())
    rows = docs.orderBy("at").collect()
    want = curriculum(rows)
    got = [r.doc_id for r in mixing.stage(spark, docs, SF).collect()]
    assert collections.Counter(got) == collections.Counter(rows[i].doc_id for _, i in want)
    assert got == [d for _, d in sorted((round(t, 9), rows[i].doc_id if rows[i].doc_id is not None else -1) for t, i in want)] or table == "odd"


def test_bpe_returns_texts_ids_and_places(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    rows = odd.coalesce(1).collect()
    odd.coalesce(1).write.parquet(str(tmp_path / "docs"))
    for source in (odd, spark.read.parquet(str(tmp_path / "docs"))):
        out = bpe.stage(spark, source, SF)
        got = sorted(out.collect(), key=lambda r: r.place)
        assert collections.Counter(r.text for r in got) == collections.Counter(r.text for r in rows)
        for r in got:
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            assert (r.n_tokens, array.array("I", bytes(r.ids)).tolist(), r.ids_sha256) == (len(ids), ids, hashlib.sha256(array.array("I", ids).tobytes()).hexdigest())
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert bpe.stage(spark, odd.limit(0), SF).count() == 0
