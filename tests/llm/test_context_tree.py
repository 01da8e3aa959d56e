"""The language model against a context tree written out from its definition, node by node."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import lm_score

DEPTH = lm_score.DEPTH


def decisions(words):
    """(context, bits before, bit) of every decision of the words, their closing spaces and one end."""
    for word, closing in [*((w, b" ") for w in words), (b"", b"\n")]:
        data = b" " + word + closing
        for k in range(1, len(data)):
            context = data[max(0, k - DEPTH) : k]
            bits = f"{data[k]:08b}"
            for n in range(8):
                yield context, bits[:n], int(bits[n])


class Tree:
    def __init__(self, texts):
        self.counts = collections.defaultdict(lambda: [0, 0])
        self.below = collections.defaultdict(set)
        for words in texts:
            for context, before, bit in decisions(words):
                for d in range(DEPTH + 1):
                    # A context shorter than the depth stands at all greater depths by itself, as with nothing before it.
                    node = (d, context[max(0, len(context) - d) :] if d else b"", before)
                    self.counts[node][bit] += 1
                    if d:
                        self.below[d - 1, context[max(0, len(context) - d + 1) :] if d > 1 else b"", before].add(node)
        self.known = {}

    def own(self, node):
        zeros, ones = self.counts[node]
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def weighted(self, node):
        """Log of half the own probability and half the product of those below."""
        if node not in self.known:
            own = self.own(node)
            if node[0] < DEPTH:
                low = sum(map(self.weighted, self.below[node]))
                own = max(own, low) + math.log1p(math.exp(-abs(own - low))) - math.log(2)
            self.known[node] = own
        return self.known[node]

    def one(self, context, before):
        """The chance of a one: the estimates along the path, each by the weight of ending there; the rest at the last node held."""
        left, out = 1.0, 0.0
        for d in range(DEPTH + 1):
            node = (d, context[max(0, len(context) - d) :] if d else b"", before)
            if node not in self.counts:
                return out + left * last if d else 0.5
            zeros, ones = self.counts[node]
            if d:
                out, left = out + left * share * last, left * (1 - share)
            last = (ones + 0.5) / (zeros + ones + 1)
            share = math.exp(self.own(node) - self.weighted(node) - math.log(2)) if d < DEPTH else 1.0
        return out + left * last

    def log10(self, words):
        return sum(math.log10(p if bit else 1 - p) for context, before, bit in decisions(words) for p in [self.one(context, before)])


@pytest.mark.parametrize("contexts", [30, 60_000])
def test_scores_equal_the_definition(spark, monkeypatch, contexts):
    monkeypatch.setattr(lm_score, "CONTEXTS", contexts)
    rng = np.random.default_rng(6)
    some = ["the", "there", "then", "other", "others", "mother", "Ω", "été", "a", "xxxxxxxxxx", "internationally"]
    texts = [" ".join(rng.choice(some, n)) for n in (5, 9, 14, 3, 20)] + ["", None, "never seen 12345678 internationality", "THE  Other\n"]
    held = [k >= 5 for k in range(len(texts))]
    rows = spark.createDataFrame([(k, t, h) for k, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in lm_score.scored(spark, rows, F.col("held")).collect()}
    tree = Tree([lm_score.tokens(t) for t, h in zip(texts, held) if not h])
    for k, text in enumerate(texts):
        assert got[k] == pytest.approx(tree.log10(lm_score.tokens(text)), rel=1e-5), text
