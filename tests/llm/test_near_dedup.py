"""Near-duplicate groups against brute force: repeated ids, large and mixed nodes, and all 10 000 rows of a table."""

import collections

import numpy as np
import pytest

from sitelens.llm import near_dedup


def components(docs):
    """id -> the least id that it reaches, by an inverted index over full sets."""
    rows = [(i, near_dedup.shingles(t)) for i, t in docs]
    sets = [s for _, s in rows]
    held = collections.defaultdict(list)
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, s) in enumerate(rows):
        common = collections.Counter(j for x in s.tolist() for j in held[x])
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                low, high = sorted((root(i), root(rows[j][0])))
                up[high] = low
        for x in s.tolist():
            held[x].append(k)
    return {i: root(i) for i, _ in rows}


def found(spark, docs):
    rows = near_dedup.grouped(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {r.doc_id: r.component_id for r in rows}


def test_an_id_has_the_links_of_all_its_rows(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    docs = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "other words"), (4, None)]
    assert found(spark, docs) == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("leaf, few", [(3, 0), (8, 0), (8, 1 << 20), (2000, 0)])
def test_large_and_mixed_nodes(spark, monkeypatch, leaf, few):
    """A large group of near copies, a chain whose ends are not alike, and texts that share a passage only."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 9000, n)]
    base, passage, chain, texts = words(120), words(80), words(100), []
    for n in range(40):
        copy = list(base)
        for at in rng.integers(0, 120, 2):
            copy[at] = f"x{n}"
        texts.append(copy)
    texts += [passage + words(60 + n) for n in range(40)]
    for n in range(25):
        chain = [*chain[3:], *words(3)]
        texts.append(chain)
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "FEW_LINKS", few)
    monkeypatch.setattr(near_dedup, "LEAF_SHINGLES", 40 * leaf)
    assert found(spark, docs) == components(docs)


def test_recall_over_a_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in near_dedup.op9_near_dedup(spark, "/root/testdata/sf0.1").collect()}
    want = components(docs)
    linked = [i for i in want if want[i] != i]
    assert len(got) == 10_000 and len(linked) > 500
    assert np.mean([got[i] == want[i] for i in linked]) >= 0.95 and all(got[i] >= want[i] for i in got)


def test_an_id_meets_its_component_once(spark, monkeypatch):
    """A left join by id gets a row for each class, not one for each node that holds it."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(90))
    docs = [(k, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 9000, 20 + k % 3))) for k in range(60)]
    docs += [(60 + k, f"{docs[k][1]} end") for k in range(30)]
    seen, join = [], type(spark.range(1)).join

    def spy(self, other, on=None, how=None):
        if how == "left" and on == "id":
            seen.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(type(spark.range(1)), "join", spy)
    assert found(spark, docs) == components(docs)
    assert len(seen) > 2 and max(seen) <= len(docs)
