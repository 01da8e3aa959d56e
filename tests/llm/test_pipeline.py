"""The whole pipeline against its stages by brute force, and its folders."""

import collections
import os

import corpus_pipeline
from sitelens.llm import common, language_id, quality_classifier

SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    """Clean documents stay, junk goes, one of each group of copies stays, and the order of training is kept."""
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "ids", "n_tokens", "place"} <= set(out.columns)
    rows = out.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = quality_classifier.stage(spark, language_id.stage(spark, docs, SF), SF).collect()
    from test_near_dedup import components

    component = components([(r.doc_id, r.text) for r in left])
    first = {min(i for i in component if component[i] == c) for c in set(component.values())}
    copies = collections.Counter(r.doc_id for r in rows)
    assert set(copies) <= first and max(copies.values()) <= 3
    from test_stages import curriculum

    kept = [r for r in left if r.doc_id in first]
    want = curriculum(kept)
    assert copies == collections.Counter(kept[i].doc_id for _, i in want)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.place)] == [d for _, d in sorted((round(t, 9), kept[i].doc_id) for t, i in want)]
    assert not common._stored


def test_files_of_earlier_stages_are_deleted(spark):
    folder = corpus_pipeline.shared_folder(spark)
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
    left = [x for x in set(os.listdir(folder)) - before if x.startswith("pipeline-")]
    assert [os.listdir(f"{folder}/{x}") for x in left] == [["mixing"]]
