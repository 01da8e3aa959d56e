"""Weak supervision on planted votes, verdicts by brute force, and the classifier's sums in any order."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import quality_classifier, quality_rules


def planted(share, rules, n, seed=4):
    """Votes of n documents, of which a share is good; rules: by rule the chances of (good, bad) votes on good and on bad ones."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < share
    votes = np.zeros((n, len(rules)), int)
    for k, (on_good, on_bad) in enumerate(rules):
        for kind, (yes, no) in ((True, on_good), (False, on_bad)):
            at = np.flatnonzero(good == kind)
            draw = rng.random(len(at))
            votes[at, k] = np.where(draw < yes, 1, np.where(draw < yes + no, -1, 0))
    return good, votes


@pytest.mark.parametrize("share", [0.5, 0.8, 0.9])
def test_accuracies_of_planted_rules_are_found(share):
    # Good rules, one that condemns seldom but rightly, one that only commends, and one that says nothing.
    rules = [((0.8, 0.05), (0.1, 0.7)), ((0.0, 0.01), (0.0, 0.5)), ((0.7, 0.1), (0.2, 0.6)), ((0.2, 0.2), (0.2, 0.2)), ((0.6, 0.0), (0.1, 0.0)), ((0.6, 0.1), (0.1, 0.5))]
    good, votes = planted(share, rules, 20_000)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found, ratios = quality_rules.maximise([(tuple(map(int, p)), int(n)) for p, n in zip(patterns, counts)])
    assert found == pytest.approx(share, abs=0.06)
    for (on_good, on_bad), r in zip(rules[:1], ratios):
        assert r[1] == pytest.approx(math.log(on_good[0] / on_bad[0]), abs=0.6) and r[-1] == pytest.approx(math.log(on_good[1] / on_bad[1]), abs=0.9)
    assert abs(ratios[3][1]) < 0.3 and ratios[1][-1] < -2
    kept = np.array([quality_rules.posterior(tuple(v), found, ratios) >= 0.5 for v in votes.tolist()])
    best = np.mean(kept == good)
    assert best > max(share, 0.85)


def test_verdicts_equal_brute_force(spark):
    rows = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    names = [c for c in rows[0].asDict() if c.startswith("vote_")]
    patterns = {}
    for r in rows:
        v = tuple(r[c] for c in names)
        patterns[v] = patterns.get(v, 0) + 1
    share, ratios = quality_rules.maximise(sorted(patterns.items()))
    for r in rows:
        p = quality_rules.posterior(tuple(r[c] for c in names), share, ratios)
        assert r.quality == pytest.approx(p, abs=1e-9)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and p >= 0.5)
    labels = {x.doc_id: x.quality for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    known = [r for r in rows if r.doc_id in labels]
    assert np.mean([r.kept == bool(labels[r.doc_id]) for r in known]) > 0.9


def test_fits_agree_whatever_the_order(spark):
    docs = quality_classifier.measured(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).persist()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a = quality_classifier.fit(spark, docs.repartition(3, "doc_id"), labels)
    b = quality_classifier.fit(spark, docs.orderBy(F.desc("doc_id")).repartition(7), labels)
    for (m, i, d), (n, j, e) in zip(a.classes, b.classes):
        assert (m == n).all() and (i == j).all() and d == e
    assert a.share == b.share
    docs.unpersist()


def test_no_task_of_the_stage_runs_two_python_steps(spark, monkeypatch):
    plans, fit = [], quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda spark, rows, labels: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or fit(spark, rows, labels))
    out = quality_classifier.stage(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01")
    assert out.count() > 100
    assert len(plans) == 1 and "Python" not in plans[0]
