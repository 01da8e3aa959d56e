"""Byte-level BPE encoding and decoding by a sentencepiece model made of the vocabulary.

A rank file's tokens are byte strings. Each byte becomes a printable character, so that a token is a piece of text;
the pieces, scored by their negative rank, are written as a sentencepiece model of the BPE kind with an
identity normaliser, without training. Its merges take the best-scored pair, leftmost first, which is the pair of
lowest rank. A text is split by the pre-token pattern; pre-tokens are encoded each (once, then from a bounded cache), and
ids are decoded by the inverse mapping of pieces to bytes.

Defined results: a null text counts as empty and has no tokens; ids may repeat or be null, every row is encoded
alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _Words, byte_symbols
from .common import small_batches, table

#: Kinds of pieces and of models in sentencepiece's format; the separator that no piece holds.
UNKNOWN, NORMAL, BPE_MODEL, UNKNOWN_PIECE = 2, 1, 2, "▁unknown▁"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's tokens: lines of a token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer: text or message, integer, or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a sentencepiece model; piece k is the token of the k-th lowest rank, and the last one is unknown."""
    symbols = byte_symbols()
    pieces = [("".join(symbols[b] for b in token), -float(rank), NORMAL) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append((UNKNOWN_PIECE, 0.0, UNKNOWN))
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, score) + _field(3, kind)) for p, score, kind in pieces)
    trainer = _field(3, BPE_MODEL) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + _field(45, UNKNOWN_PIECE.encode())
    # No bos, eos and pad; negative numbers take ten bytes.
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """A tokenizer of ranks and a pre-token pattern. The pattern's white space is Unicode's, whatever the regex library takes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.decimals = {rank: str(rank) for rank in self.tokens}
        self.by_piece = np.array([*sorted(self.tokens), 0], "<u4")  # the unknown piece never occurs: every byte is a piece
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.symbols = byte_symbols()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model(ranks))
        self.remembered = _Words(self.encode_word)

    def encode_word(self, word: str) -> bytes:
        data = word.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return struct.pack("<I", whole)
        mapped = "".join(map(self.symbols.__getitem__, data))
        return self.by_piece[self.pieces.encode(mapped)].tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.remembered.__getitem__, self.words.findall(text))) if text else b""

    def listed(self, ids: bytes) -> list[int]:
        return np.frombuffer(ids, "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ready: dict[str, ByteBpe] = {}


def tokenizer(data: bytes, pattern: str) -> ByteBpe:
    """One tokenizer per worker, vocabulary and pattern."""
    key = hashlib.sha256(data + b"\0" + pattern.encode()).hexdigest()
    if key not in _ready:
        _ready[key] = ByteBpe(read_ranks(data), pattern)
    return _ready[key]


def defaults() -> tuple[str, str]:
    """Path of the rank file and its pattern."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def encoded(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, digests of the ids (decimal, joined by commas) and of the decoded bytes, and the ids
    themselves (as little-endian unsigned 32-bit integers)."""
    small_batches(spark)
    with open(path or defaults()[0], "rb") as f:
        sent = spark.sparkContext.broadcast((f.read(), pattern or defaults()[1]))  # as long as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(*sent.value)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                packed = bpe.encode(text.as_py())
                ids = bpe.listed(packed)
                digest = hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest()
                rows.append((len(ids), digest, hashlib.sha256(bpe.decode(ids)).hexdigest(), packed if with_ids else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: 3 + with_ids]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decoded(spark: SparkSession, rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids as of encoded) -> doc_id and the text of the ids; null ids give an empty text, bytes that are no
    UTF-8 become replacement characters."""
    small_batches(spark)
    with open(path or defaults()[0], "rb") as f:
        sent = spark.sparkContext.broadcast((f.read(), defaults()[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(*sent.value)
        for batch in batches:
            texts = [bpe.decode(bpe.listed(x.as_py() or b"")).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"), with_ids=False)
