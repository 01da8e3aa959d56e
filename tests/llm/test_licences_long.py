"""A licence's words never push another's out of the scan."""

from sitelens.llm import licences


def test_notice_beside_a_full_text(spark):
    mit, bsd = licences.TEMPLATES[1][2], "released under the bsd license"
    # The words of the notice are frequent, so those of the full text are rarer.
    rows = [(1, f"{mit} and {bsd}"), (2, bsd), (3, mit)] + [(k, "released under a license") for k in range(4, 30)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].labels for k in (1, 2, 3, 4)] == ["bsd,mit", "bsd", "mit", ""]
    assert [got[k].score for k in (1, 2, 3, 4)] == [1.0, 1.0, 1.0, 0.0]
