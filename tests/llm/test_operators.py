"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, extra columns."""

import array
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import bpe, html_text, language_id, licences, lm_score, mixing, near_dedup, quality_classifier, quality_rules, topk

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "en", None, "x"), (2, "", None, "a", "x"), (3, "a b", "en", "a", None), (3, "a b", "en", "a", None), (None, "one two three four five six", "en", "b", "x"),
    (5, "Released under the MIT License. " + "word " * 5000, "en", "a", "x"), (6, " \n\t ", "de", "b", "x"), (7, "ÀÉ <|endoftext|> İ ſ K ½", "fr", "b", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, words string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


LABELS = "doc_id long, quality int"


@pytest.mark.parametrize("run", [
    licences.scan, quality_rules.judge, mixing.mix, near_dedup.grouped,
    lambda d: bpe.encoded(d.sparkSession, d), lambda d: lm_score.scored(d.sparkSession, d, F.lit(False)),
    lambda d: d.select("doc_id", language_id.predictor(d.sparkSession, language_id.fit(d.sparkSession, d))("text")),
    lambda d: d.join(quality_classifier.measured(d).select("doc_id", quality_classifier.scorer(d.sparkSession, quality_classifier.fit(d.sparkSession, quality_classifier.measured(d), d.sparkSession.createDataFrame([(3, 1)], LABELS)))("x")).limit(0).select("doc_id"), "doc_id", "left"),
])
def test_odd_rows_and_empty_tables(run, odd, none):
    assert run(odd).count() == len(ODD)
    assert run(none).count() == 0


def test_licences(spark, docs):
    words = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {k: k + 32 for k in range(65, 91)}
    for r in licences.op1_licences(spark, SF).collect():
        w = words.findall((docs[r.doc_id].text or "").translate(lower))
        at = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in licences.BASE}
        every = sorted(i for x in at.values() for i in x)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(every), every[0] if every else None, every[-1] if every else None)
        assert r.base_labels == ",".join(sorted(licences.BASE[p] for p, x in at.items() if x))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_bpe(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    for r in bpe.op2_bpe(spark, SF).collect():
        e = t.encode(docs[r.doc_id].text or "", add_special_tokens=False)
        assert r.n_tokens == len(e.ids)
        assert r.ids_sha256 == hashlib.sha256(array.array("I", e.ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    own = bpe.Bpe(open(bpe.default_path(), encoding="utf-8").read())
    for _, text, *_ in ODD:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_long_fragments():
    import random

    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(bpe.default_path()), bpe.Bpe(open(bpe.default_path(), encoding="utf-8").read())
    t.no_truncation()
    draw = random.Random(5)
    for n in (2, 3, 20, bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3000):
        for _ in range(20):
            word = "".join(draw.choice("abcdetaoinsr") for _ in range(n))
            symbols = (*word[:-1], word[-1] + bpe.END)
            assert own.merged(symbols) == own.merged_long(symbols)
            assert own.encode(word) == np.array(t.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    made = []
    words = bpe._Words(lambda w: made.append(w) or w)
    assert [words[w] for w in "abcabcdabef"] == list("abcabcdabef") and made == list("abcdef")
    assert len(words) <= 3 and len(words.older) <= 3


def test_language_model(spark, docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    tokens = {i: [*lm_score.tokens(r.text), b"\n"] for i, r in docs.items()}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in lm_score.op3_lm_score(spark, SF).collect():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0


def test_bytes_of_a_context_sum_to_one():
    words = [b"the", b"then", b"there", b"other"]
    c, _ = lm_score.codes(words)
    known, n = np.unique(c, return_counts=True)
    model = lm_score.Model(known, n, np.zeros(0), np.zeros(0))
    for context in (b" ", b" th", b"zzzzz", b" oth"):
        at = int.from_bytes(context, "big") << 8
        assert (10 ** model.byte_log(np.array([at | b for b in range(256)], np.uint64))).sum() == pytest.approx(1, abs=1e-5)


def test_language(spark, docs):
    rows = language_id.op4_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out and docs[r.doc_id].text]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.9
    assert language_id.Model([], None, None).predict("text") == ("und", 0.0, True) and not language_id.has_letter("1 2 !")


def test_long_texts_hash_as_a_whole(monkeypatch):
    text = "some words of a text that is cut into slices " * 50
    whole = np.sort(np.concatenate(list(language_id.buckets(text))))
    monkeypatch.setattr(language_id, "SLICE", 64)
    assert (np.sort(np.concatenate(list(language_id.buckets(text)))) == whole).all()


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality_classifier.op5_quality_classifier(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<nav>a</nav><article><h1>T</h1><p>x&amp;y<br>z</p><form>f</form><p>w</article><footer>f</footer>", "T\n\nx&y z\n\nw"),
    ("<body><div class='sidebar'><p>" + "s " * 50 + "</div><div class=content><p>" + "a " * 60 + "<p>b c</div><div id=comments><p>" + "n " * 80 + "</div>", ("a " * 60).strip() + "\n\nb c"),
])
def test_pages(page, text):
    assert html_text.extract(page) == text


def test_topk(spark):
    rng = np.random.default_rng(1)
    x = [(k, [float(v) for v in rng.normal(0, 1 + k % 3, 6)]) for k in range(300)] + [(301, None), (302, [float("nan")] * 6), (None, [1.0] * 6), (100, [3.0] * 6), (303, [1e9] * 6)]
    v = topk.quantised(spark.createDataFrame(x, "vec_id long, embedding array<double>"))
    got = collections.defaultdict(list)
    for r in topk.searched(spark, v.filter("vec_id % 50 = 0 and vec_id <> 100"), v).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    sound = [(k, [math.floor(256 * c) for c in e]) for k, e in x if k is not None and e and all(map(math.isfinite, e))]
    for q, e in sound:
        if q % 50 == 0 and q != 100:
            best = sorted((-sum(a * b for a, b in zip(e, c)), k) for k, c in sound if k != q)[:5]
            assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]


def test_mixing_reaches_targets(spark):
    rows = mixing.op8_mixing(spark, SF).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.target, r.source_size].append(r)
        assert r.taken <= 3 * r.size
    for (target, _), own in by.items():
        assert sum(r.taken for r in own) == pytest.approx(target * len({r.source_size for r in own}), rel=0.01, abs=2) or len(own) > 1
    assert [r.position for r in rows] == sorted(r.position for r in rows)


def test_near_duplicates(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(40)]
    for n in range(60):
        copy = list(base)
        for at in rng.integers(0, 400, 1 + n % 12):
            copy[at] = f"x{n}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "a b", "a b", "", None]
    monkeypatch.setattr(near_dedup, "LEAF", 20)  # makes nodes branch
    got = {r.doc_id: r for r in near_dedup.grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    assert [got[k].component_id for k in range(len(texts))] == group
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]


def test_quality_rules(spark, docs):
    for r in quality_rules.op10_quality_rules(spark, SF).collect():
        text = docs[r.doc_id].text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        counts = collections.Counter(windows)
        covered = {i for k, x in enumerate(windows) if counts[x] > 1 for i in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)



def test_language_model_keeps_every_context(spark, monkeypatch):
    """The distributed tree in many buckets scores as one tree of all contexts does, however many there are."""
    monkeypatch.setattr(lm_score, "MAX_CONTEXTS", 50, raising=False)
    monkeypatch.setattr(lm_score, "CONTEXTS", 40, raising=False)
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcdéz"), 1 + k % 9)) for k in rng.integers(0, 99, 30)) for _ in range(20)] + ["", None, "unseen Ω words"]
    held = [k % 5 == 0 for k in range(len(texts))]
    df = spark.createDataFrame([(k, t, h) for k, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in lm_score.scored(spark, df, F.col("held")).collect()}
    of = lambda ws: np.concatenate([lm_score.codes(ws)[0] if ws else np.zeros(0, np.uint64), np.array([lm_score.END_CODE], np.uint64)])
    c, n = np.unique(np.concatenate([of(lm_score.tokens(t)) for t, h in zip(texts, held) if not h]), return_counts=True)
    model = lm_score.Model(c, n, np.zeros(0), np.zeros(0))
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(model.byte_log(of(lm_score.tokens(t))).sum(), rel=1e-5)
