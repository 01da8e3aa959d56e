"""Queries that need signals, likelihood and contacts of a page strip its text once."""

import pytest

from sitelens.plans import compare_queries, record_queries, site_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [site_queries.signal_paths, site_queries.risk_scores, record_queries.scores_shown])
def test_text_is_read_once(spark, monkeypatch, query):
    calls, texts = [], site_queries.texts
    monkeypatch.setattr(site_queries, "texts", lambda *args: calls.append(1) or texts(*args))
    query(spark, SF)
    assert len(calls) == 1


@pytest.mark.parametrize("query", [compare_queries.compare_full, compare_queries.compare_diff, record_queries.comparison_readback])
def test_compared_pages_are_stripped_once(spark, query):
    """What sides, vectors and pairs read is written: no branch of the plan goes back to html."""
    assert "html#" not in query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
