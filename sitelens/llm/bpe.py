"""BPE encoding and decoding with forced boundaries.

A vocabulary of a word-end BPE (lower case, white space dropped) is read from a tokenizer file.
Two neighbouring byte symbols that stand side by side inside no token of the vocabulary can never
be merged across, so a cut between them is certain: a word is cut at all such places, its fragments
are encoded independently (each once, then from a bounded cache) and their ids concatenated.
Decoding looks the ids up and joins the tokens by spaces, as a tokenizer without a decoder does.

Defined results: a null text counts as empty and has no tokens; ids may repeat or be null, every
row is encoded alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

END = "</w>"
#: Words and fragments that a worker remembers at once.
REMEMBERED = 100_000
#: Symbols from which a fragment is merged by a heap, and a word is not remembered.
LONG = 200
NONE = 1 << 60
#: How the tokenizer of the file splits normalised text, with its white space spelled out.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class _Words(dict):
    """Word -> its ids as little-endian bytes.

    Holds up to twice REMEMBERED words: when REMEMBERED new ones have come, those that were not met
    again since the last time are dropped, so that frequent words stay. Words over LONG are not held.
    """

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, word):
        if len(word) > LONG:
            return self.encode(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        self[word] = ids = self.encode(word) if ids is None else ids
        return ids


class Bpe:
    def __init__(self, spec: str):
        model = json.loads(spec)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.ids = model["model"]["vocab"]
        self.ranks = {(a, b): n for n, (a, b) in enumerate(merges)}
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.special = {k: struct.pack("<I", v) for k, v in special.items()}
        self.at_special = regex.compile("(" + "|".join(regex.escape(k) for k in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.tokens = {i: t.encode() for t, i in (self.ids | special).items()}
        self.symbols = byte_symbols()
        self.inside = {pair for t in self.ids for s in [self.split_symbols(t)] for pair in zip(s, s[1:])}
        self.fragments = _Words(self.encode_fragment)
        self.words = _Words(self.encode_word)

    @staticmethod
    def split_symbols(token: str) -> list[str]:
        body = token.removesuffix(END)
        return [*body[:-1], body[-1:] + END] if body != token and body else list(token)

    def encode_word(self, word: str) -> bytes:
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += END
        inside, start, out = self.inside, 0, []
        for k in range(1, len(symbols)):
            if (symbols[k - 1], symbols[k]) not in inside:
                out.append(self.fragments[tuple(symbols[start:k])])
                start = k
        if not start:  # an uncut word is remembered as a word only
            return self.encode_fragment(tuple(symbols))
        out.append(self.fragments[tuple(symbols[start:])])
        return b"".join(out)

    def encode_fragment(self, symbols: tuple[str, ...]) -> bytes:
        """Merges the pair of lowest rank, leftmost first, until none can be merged."""
        parts = self.merged_long(symbols) if len(symbols) > LONG else self.merged(symbols)
        return struct.pack(f"<{len(parts)}I", *(self.ids[p] for p in parts))

    def merged(self, symbols: tuple[str, ...]) -> list[str]:
        parts, rank = list(symbols), self.ranks.get
        found = [rank(pair, NONE) for pair in zip(parts, parts[1:])]
        while found and (best := min(found)) < NONE:
            at = found.index(best)
            parts[at : at + 2] = [new] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = rank((parts[at - 1], new), NONE)
            if at < len(found):
                found[at] = rank((new, parts[at + 1]), NONE)
        return parts

    def merged_long(self, symbols: tuple[str, ...]) -> list[str]:
        """The same by a heap over a linked list, so that a fragment of any length takes n log n steps."""
        parts, ranks, n = list(symbols), self.ranks, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[pair], k, *pair) for k, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            nxt = after[k]
            if nxt >= n or parts[k] != x or parts[nxt] != y:
                continue
            parts[k], parts[nxt], after[k] = x + y, "", after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (parts[left], parts[right]) in ranks:
                    heapq.heappush(heap, (ranks[parts[left], parts[right]], left, parts[left], parts[right]))
        return [p for p in parts if p]

    def encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            # Lower-casing goes letter by letter there: a sigma at a word's end is like any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.at_special is None or "<|" not in text:
            return self.encode_plain(text)
        return b"".join(self.special[p] if p in self.special else self.encode_plain(p) for p in self.at_special.split(text) if p)

    def decode(self, ids: bytes) -> bytes:
        """The tokens of ids, special ones included, as UTF-8."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ready: dict[str, Bpe] = {}


def tokenizer(spec: str) -> Bpe:
    """One tokenizer per worker and vocabulary; its tables take longer to build than a batch."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ready:
        _ready[key] = Bpe(spec)
    return _ready[key]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encoded(spark: SparkSession, docs: DataFrame, path: str | None = None, with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, digests of the ids and of the decoded text, the ids themselves (as little-endian
    unsigned 32-bit integers), and the columns of keep."""
    small_batches(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # as long as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            ids = [bpe.encode(t.as_py()) for t in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=[*names, *keep])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    schema += "".join(f", {c} {dict(docs.dtypes)[c]}" for c in keep)
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"kept_{c}") for c in keep)).mapInArrow(run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"), with_ids=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, its ids (see encoded), their number and digests, and place: the row's order in the files that docs was read
    from (their number, then the row's), so that a training order is kept. A null text has no tokens; rows are
    encoded alone, whatever their ids; other columns are left out."""
    try:
        number = F.try_to_number(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1), F.lit("9" * 9)).cast("long")
        docs = docs.select("doc_id", "text", (F.coalesce(number, F.lit(0)) * (1 << 40) + F.col("_metadata.row_index")).alias("place"))
    except AnalysisException:  # not read from files
        docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    return encoded(spark, docs, keep=("place", "text"))
