"""The pipeline's near_dedup stage against brute force, where ids repeat or are null."""

import collections

from sitelens.llm import near_dedup


def test_one_row_of_each_group_stays(spark):
    base = [f"w{k}" for k in range(60)]
    near = [*base[:-1], "other"]
    texts = [(None, " ".join(base)), (None, " ".join(f"u{k}" for k in range(20))), (7, "a b c"), (7, " ".join(base)), (7, "A  b c"), (7, "d e f g h"),
             (3, " ".join(near)), (None, "a b c"), (None, None), (None, ""), (8, "only here"), (8, "only here"), (None, "x y z"), (None, "x y z")]
    words = [(t or "").lower().split() for _, t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    members = collections.defaultdict(list)
    for (doc_id, text), g in zip(texts, group):
        members[g].append((doc_id is None, doc_id or 0, text))
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, lang string")
    out = near_dedup.stage(spark, rows, "").collect()
    left = collections.Counter((r.doc_id, " ".join((r.text or "").lower().split())) for r in out)
    assert left == collections.Counter((None if none else i, " ".join((t or "").lower().split())) for none, i, t in (min(m, key=lambda x: x[:2]) for m in members.values()))
    assert out[0].asDict().keys() == {"doc_id", "text", "lang"}
