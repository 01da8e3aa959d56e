"""Labels and scores of the licence scan by brute force: templates aligned at all offsets."""

import re

from sitelens.llm import licences

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def labels_of(text):
    lower = {k: k + 32 for k in range(65, 91)}
    w = WORDS.findall((text or "").translate(lower))
    known, found, best = set(licences.vocabulary()), set(), 0.0
    joined = f" {' '.join(w)} "
    for label, key, template in licences.TEMPLATES:
        t = template.split()
        offsets = {}
        for p, x in enumerate(w):
            for q, y in enumerate(t):
                if x == y and x in known:
                    offsets[p - q] = offsets.get(p - q, 0) + 1
        n, most = max(offsets.values(), default=0), sum(y in known for y in t)
        if n >= licences.MIN_ALIGNED and f" {key} " in joined:
            found.add(label)
            best = max(best, min(1.0, n / most))
    base = {v for p, v in licences.BASE.items() if f" {p} " in joined}
    return ",".join(sorted(found | base)), max(best, 0.5 if base else 0.0)


def test_labels_and_scores(spark):
    every = " and then ".join(t for _, _, t in licences.TEMPLATES)
    rows = [(k, t) for k, (_, _, t) in enumerate(licences.TEMPLATES)] + [(50, every), (51, every.upper()), (52, None), (53, ""), (54, "the MIT licence"), (55, "gnu general word public license"), (56, ("filler " * 3000) + every)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(docs).collect()}
    for k, text in texts.items():
        assert got[k] == labels_of(text), k
    assert set(got[50][0].split(",")) == {label for label, _, _ in licences.TEMPLATES}
