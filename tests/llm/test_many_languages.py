"""Every language that has labelled rows is learned."""

import numpy as np

from sitelens.llm import language_id


def test_all_languages_are_learned(spark):
    rng = np.random.default_rng(2)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 130 * 6)]
    rows = []
    for k in range(130):
        for n in range(16):
            rows.append((len(rows), " ".join("".join(rng.choice(letters[6 * k : 6 * k + 6], 3)) for _ in range(30)), f"l{k:03}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(spark, docs)
    assert model.classes == [f"l{k:03}" for k in range(130)]
    assert np.mean([model.predict(text)[0] == lang for _, text, lang in rows]) > 0.9
    assert model.scores.shape[1] <= language_id.DIM
