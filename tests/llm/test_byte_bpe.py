"""Byte-level BPE against the tiktoken library: whole documents, odd texts, every kind of character."""

import base64
import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from sitelens.llm import bpe, byte_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return byte_bpe.tokenizer(f.read(), public_tokenizers.PATTERN)


def test_documents(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = byte_bpe.op13_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_texts(own, library):
    rng = random.Random(4)
    alphabet = "aeioubcdnrst '\n\t .,0123456789éñçß你好世界мир🎉  ‍\x1c\x1f\x85▁﻿"
    texts = ["", " ", "  \n ", "a" * 5000, "é" * 999, "x y" * 300, "\x00\x01\x7f", "I'll we've it's 'S", "<|endoftext|>", "▁▁unknown▁", "Ġ Ċ Ā", " 　a　 b"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x3000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(30)) for _ in range(300)]
    for text in texts:
        text = "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000)
        ids = own.listed(own.encode(text))
        assert ids == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_forgotten_words_are_encoded_again(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    for text in ["one two three four five six seven eight nine ten eleven twelve"] * 3:
        assert own.listed(own.encode(text)) == library.encode_ordinary(text)


def test_rows_alone_and_back(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "one two", None), (2, "one two", "z"), (3, "long " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.encoded(spark, docs)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect())[:4] == [(0, 2), (1, 0), (1, 0), (2, 2)]
    back = {(r.doc_id, r.text) for r in byte_bpe.decoded(spark, got).collect()}
    assert back == {(k, text or "") for k, text, _ in rows}
    assert byte_bpe.encoded(spark, docs.limit(0)).count() == 0


def test_a_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe({b"a": 0}, public_tokenizers.PATTERN)
