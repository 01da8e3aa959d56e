"""Language-model scores of texts by context-tree weighting over bytes.

Tokens are words between ASCII white space (A-Z lower-cased) and one end after the last. The model
codes a word as its bytes and a closing space, the end as a line feed, each byte as eight binary
decisions. The context of a byte is the bytes before it in its word, with the space before the word,
DEPTH at most. For every decision a context tree mixes Krichevsky-Trofimov estimates of all depths:
a node's weighted probability is half its own estimate and half the product of its children's, and
the prediction is the average, so weighted, of the estimates along the path. Code lengths add up to
the log10 probability of a text.

Counts are gathered from all training texts, and every context of them is kept. Words are counted by
a shuffle, bytes by context from the distinct words. The tree stays distributed: a context's two last
bytes name its subtree, and subtrees are dealt to buckets of about CONTEXTS codes. A first pass sends the
weights of depth 2, summed by their parents, to the driver, which weighs depths 0 and 1 (65 536 nodes at
most, whatever the corpus); with these a second pass finishes each subtree and answers the codes that
chunks of distinct words ask of its bucket, so that every word of the corpus gets its log probability.
Words' counts and logs stay distributed: words that make up a share HOT of all tokens (at most 1 / HOT of
them) go to every task; of the others each batch of texts sends what it holds to one of the buckets of
the vocabulary, and gets sums back.

Defined results: a null or empty text is the end alone; without training texts all counts are 0 and
every bit has probability 1/2; ids may repeat or be null, every row is scored alone; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, small_batches, table

DEPTH = 7
#: Byte counts by context, and distinct words, for each bucket of the tree; words that ask at a time.
CONTEXTS, WORDS, ASKING = 60_000, 1_000_000, 20_000
#: Share of all tokens from which a word's count is sent to every task.
HOT = 1e-4
#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000
#: Tokens of the corpus for each bucket of the vocabulary.
PER_BUCKET = 6_000_000
END, SPACE = 0x0A, 0x20
_U = np.uint64
END_CODE = (SPACE << 8) | END
#: Nodes of depth 1 by key, and the depth that subtrees begin at.
TOP, FIRST = 1 << 16, 2


def word_hash(word: bytes) -> int:
    """A signed 64-bit hash that stands for the word."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


#: No word holds white space, so no word has the end's hash but by chance.
END_WORD = b"\n"
END_HASH = word_hash(END_WORD)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (context, byte) codes of all bytes of words and their closing spaces, and where each word's begin."""
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(_U)
    n = len(a) - 1
    out, open_ = a[1:].copy(), np.ones(n, bool)
    for k in range(1, DEPTH + 1):
        before = np.zeros(n, _U)
        before[k - 1 :] = a[: n - k + 1]
        out |= np.where(open_, before, _U(0)) << _U(8 * k)
        open_ &= before != SPACE
        open_[: k - 1] = False
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]]).astype(np.int64)
    return out, starts


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Model:
    """The tree of some codes: by depth the nodes (context, bits so far) and the probability that the
    next bit is one where the path ends there. ends and state are those of the depth above a subtree, by
    key (top()); where they are empty the codes are the whole tree."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, ends: np.ndarray, state: np.ndarray):
        self.ends, self.first = ends, FIRST if len(ends) else 0
        self.keys, zeros, ones, up, share, _ = weighed(known.astype(_U), counts.astype(np.float64), self.first)
        self.ones = {}
        for d in range(self.first, DEPTH + 1):
            estimate = (ones[d] + 0.5) / (zeros[d] + ones[d] + 1)
            if d > self.first:
                gathered_, left = (gathered_ + left * share[d - 1] * last)[up[d]], (left * (1 - share[d - 1]))[up[d]]
            elif d:
                gathered_, left = state[:, self._shorter(self.keys[d], d - 1)]
            else:
                gathered_, left = np.zeros(len(estimate)), np.ones(len(estimate))
            last = estimate
            self.ones[d] = (gathered_ + left * estimate).astype(np.float32)

    @staticmethod
    def _nodes(c: np.ndarray, depth: int) -> np.ndarray:
        """Keys of the eight decisions of each code at a depth."""
        context = (c >> _U(8)) & _U((1 << 8 * depth) - 1)
        bits = (_U(256) | (c & _U(255)))[:, None] >> np.arange(8, 0, -1, dtype=_U)
        return (context << _U(8))[:, None] | bits

    @staticmethod
    def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
        return ((keys >> _U(8)) & _U((1 << 8 * depth) - 1)) << _U(8) | (keys & _U(255))

    def _path_logs(self, c: np.ndarray) -> np.ndarray:
        """log10 probabilities of the bytes of codes, each decision from its deepest node."""
        if not len(c):
            return np.zeros(0)
        one = self.ends[self._nodes(c, self.first - 1)] if self.first else np.full((len(c), 8), 0.5)
        for d in range(self.first, DEPTH + 1):
            if len(self.keys[d]):
                key = self._nodes(c, d)
                at = np.minimum(np.searchsorted(self.keys[d], key), len(self.keys[d]) - 1)
                one = np.where(self.keys[d][at] == key, self.ones[d][at], one)
        bit = ((c[:, None] >> np.arange(7, -1, -1, dtype=_U)) & _U(1)).astype(bool)
        one = np.clip(one, 1e-9, 1 - 1e-9)
        return np.log10(np.where(bit, one, 1 - one)).sum(1)

    def byte_log(self, c: np.ndarray) -> np.ndarray:
        unique, back = np.unique(c, return_inverse=True)
        logs = [self._path_logs(unique[start : start + 20_000]) for start in range(0, len(unique), 20_000)]
        return np.concatenate([*logs, np.zeros(0)])[back]


def weighed(c: np.ndarray, n: np.ndarray, first: int):
    """By depth from first on: nodes, zeros, ones, places of the nodes above, and shares of the own
    estimates; and the log weighted probabilities of the nodes of the first depth."""
    keys, zeros, ones, up, share = {}, {}, {}, {}, {}
    bit = (c[:, None] >> np.arange(7, -1, -1, dtype=_U)) & _U(1)
    for d in range(first, DEPTH + 1):
        keys[d], at = np.unique(Model._nodes(c, d), return_inverse=True)
        total = np.bincount(at.ravel(), np.repeat(n, 8), len(keys[d]))
        ones[d] = np.bincount(at.ravel(), (n[:, None] * bit).ravel(), len(keys[d]))
        zeros[d] = total - ones[d]
        if d > first:
            up[d] = np.searchsorted(keys[d - 1], Model._shorter(keys[d], d - 1))
    weighted = log_estimate(zeros[DEPTH], ones[DEPTH])
    for d in range(DEPTH - 1, first - 1, -1):
        own = log_estimate(zeros[d], ones[d])
        both = np.logaddexp(own, np.bincount(up[d + 1], weighted, len(keys[d])))
        share[d], weighted = np.exp(own - both), both - np.log(2)
    return keys, zeros, ones, up, share, weighted


def top(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of depth 1, with the summed log weights below them, to arrays by key: the probability of a
    one where the path ends there (or, for a node that is not held, at depth 0), and what goes down."""
    z, o, b, held = np.zeros(TOP), np.zeros(TOP), np.zeros(TOP), np.zeros(TOP, bool)
    z[key], o[key], b[key], held[key] = zeros, ones, below, True

    def weigh(z, o, b):
        own = log_estimate(z, o)
        both = np.logaddexp(own, b)
        return (o + 0.5) / (z + o + 1), np.exp(own - both), both - np.log(2)

    estimate, share, weighted = weigh(z, o, b)
    root, root_share, _ = weigh(*(np.where(held, x, 0).reshape(256, 256).sum(0) for x in (z, o, weighted)))
    root, root_share = np.tile(root, 256), np.tile(root_share, 256)
    gathered_, left = root_share * root, 1 - root_share
    ends = np.where(held, gathered_ + left * estimate, root)
    return ends, np.stack([gathered_ + left * share * estimate, left * (1 - share)])


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """codes() of words, of which one may be the end: a code alone, without a closing space."""
    c, starts = codes(words)
    if END_WORD in words:
        k = words.index(END_WORD)
        c = np.delete(c, starts[k] + 1)
        starts[k + 1 :] -= 1
    return c, starts


def gathered(docs: DataFrame) -> DataFrame:
    """(text, held_out) -> key, word, n: each word with its hash, and how often texts that are not held out have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            own, n = list(words), np.fromiter(words.values(), np.int64, len(words))
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(map(word_hash, own), pa.int64()), pa.array(own, pa.binary()), pa.array(n)], names=["key", "word", "n"])

        for batch in batches:
            for text, held_out in zip(batch.column(0), batch.column(1).to_pylist()):
                own = [*tokens(text.as_py()), END_WORD]
                words.update(dict.fromkeys(own, 0) if held_out else own)
            if len(words) >= COUNTED:
                yield flush()
        if words:
            yield flush()

    return docs.select("text", "held_out").mapInArrow(run, "key long, word binary, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= ASKING or sum(b.nbytes for b in held) >= 1 << 20:
            yield pa.Table.from_batches(held)
            held = []
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held)


def contexts(words: DataFrame) -> DataFrame:
    """(word, n) -> code, n: byte counts by context over all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            c, starts = word_codes(part.column("word").to_pylist())
            unique, at = np.unique(c, return_inverse=True)
            n = np.bincount(at, np.repeat(part.column("n").to_numpy(), np.diff([*starts, len(c)])), len(unique))
            yield pa.RecordBatch.from_arrays([pa.array(unique.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    return words.filter("n > 0").select("word", "n").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def dealt(counts: DataFrame, vocabulary: int) -> tuple[np.ndarray, int]:
    """The bucket of each subtree, by its two bytes, so that buckets hold about as many codes each; and how many buckets."""
    subtree = F.shiftright("code", 8).bitwiseAND(0xFFFF).alias("subtree")
    sizes = sorted(((r["count"], r["subtree"]) for r in counts.groupBy(subtree).count().collect()), reverse=True)
    buckets = max(12, -(-sum(n for n, _ in sizes) // CONTEXTS), -(-vocabulary // WORDS))
    where = (np.arange(TOP) % buckets).astype(np.int32)
    room = [(0, b) for b in range(buckets)]
    for n, s in sizes:
        full, b = heapq.heappop(room)
        where[s] = b
        heapq.heappush(room, (full + n, b))
    return where, buckets


def with_logs(spark: SparkSession, words: DataFrame, vocabulary: int) -> DataFrame:
    """(key, word, n) -> key, n, log: the log10 probability of each word under the tree of all words' counts."""
    counts = cut(contexts(words))
    where, buckets = dealt(counts, vocabulary)

    def place(c: np.ndarray) -> np.ndarray:
        return where[((c >> _U(8)) & _U(0xFFFF)).astype(np.int64)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch.column(0).to_numpy().astype(_U))), *batch.columns], names=["bucket", "code", "n"])

    placed = counts.select("code", "n").mapInArrow(deal, "bucket int, code long, n long")

    def upward(group: pa.Table) -> pa.Table:
        keys, zeros, ones, _, _, weighted = weighed(group.column("code").to_numpy().astype(_U), group.column("n").to_numpy().astype(np.float64), FIRST)
        parents, at = np.unique(Model._shorter(keys[FIRST], FIRST - 1), return_inverse=True)
        sums = [np.bincount(at, x, len(parents)) for x in (zeros[FIRST], ones[FIRST], weighted)]
        return pa.Table.from_arrays([pa.array(parents.astype(np.int64)), *map(pa.array, sums)], names=["key", "zeros", "ones", "below"])

    nodes = placed.groupBy("bucket").applyInArrow(upward, "key long, zeros double, ones double, below double")
    nodes = nodes.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
    sent = spark.sparkContext.broadcast(top(*(nodes.column(c).to_numpy() for c in ("key", "zeros", "ones", "below"))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, part in enumerate(chunks(batches)):
            c, starts = word_codes(part.column("word").to_pylist())
            unique, at = np.unique(c, return_inverse=True)
            mine = part.column("key").to_numpy(), part.column("n").to_numpy(), starts.astype(np.uint32), at.astype(np.uint32), len(unique)
            out = [(base + number, number % buckets, True, pickle.dumps(mine, 5))]
            bucket = place(unique)
            for b in np.unique(bucket):
                own = np.flatnonzero(bucket == b)
                out.append((base + number, int(b), False, pickle.dumps((own.astype(np.uint32), unique[own]), 5)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], names=["chunk", "bucket", "words", "blob"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = [(chunk.as_py(), own.as_py(), blob.as_py()) for chunk, own, blob in zip(*(left.column(c) for c in ("chunk", "words", "blob")))]
        out = [x for x in asked if x[1]]
        asked = [(chunk, *pickle.loads(blob)) for chunk, own, blob in asked if not own]
        if asked:
            model = Model(right.column("code").to_numpy(), right.column("n").to_numpy(), *sent.value)
            logs = np.split(model.byte_log(np.concatenate([c for _, _, c in asked])), np.cumsum([len(c) for _, _, c in asked])[:-1])
            out += [(chunk, False, pickle.dumps((at, x), 5)) for (chunk, at, _), x in zip(asked, logs)]
        columns = zip(*out) if out else [[]] * 3
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary()))], names=["chunk", "words", "blob"])

    def summed(group: pa.Table) -> pa.Table:
        parts = [(own.as_py(), pickle.loads(blob.as_py())) for own, blob in zip(group.column("words"), group.column("blob"))]
        key, n, starts, at, size = next(x for own, x in parts if own)
        logs = np.zeros(size)
        for own, x in parts:
            if not own:
                logs[x[0]] = x[1]
        return pa.Table.from_arrays([pa.array(key), pa.array(n), pa.array(np.add.reduceat(logs[at], starts.astype(np.int64)))], names=["key", "n", "log"])

    asked = words.select("key", "word", "n").mapInArrow(ask, "chunk long, bucket int, words boolean, blob binary")
    answers = asked.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(answer, "chunk long, words boolean, blob binary")
    return answers.groupBy("chunk").applyInArrow(summed, "key long, n long, log double")


def scored(spark: SparkSession, docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, text) -> one row per row; learns from the rows that are not held out."""
    small_batches(spark, 1000)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    words_ = cut(gathered(docs))
    whole = words_.agg(F.count("*").alias("every"), F.count_if(F.col("n") > 0).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]
    n, v = whole["n"], whole["v"]
    counts = cut(with_logs(spark, words_, whole["every"]))
    frequent = counts.filter(F.col("n") >= max(1.0, HOT * n)).orderBy("key").toArrow()
    sent = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("key", "n", "log")))
    found_end = counts.filter(F.col("key") == END_HASH).collect()
    ends, end_log = (found_end[0]["n"], found_end[0]["log"]) if found_end else (0, 0.0)
    buckets = max(12, -(-(n + 1) * 7 // 6 // PER_BUCKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_counts, hot_scores = sent.value
        base = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            ids: dict[bytes, int] = {}
            per_doc = []
            for text in batch.column(1):
                per_doc.append(np.array([ids.setdefault(w, len(ids)) for w in tokens(text.as_py())], np.int64))
            words, rows = list(ids), len(per_doc)
            sizes = np.fromiter(map(len, per_doc), np.int64, rows)
            pairs = np.concatenate([*per_doc, np.zeros(0, np.int64)]) + np.repeat(np.arange(rows), sizes) * max(1, len(words))
            pairs, tf = np.unique(pairs, return_counts=True)
            doc, word = pairs // max(1, len(words)), pairs % max(1, len(words))
            keys = np.fromiter(map(word_hash, words), np.int64, len(words))
            at = np.minimum(np.searchsorted(hot_keys, keys), max(0, len(hot_keys) - 1))
            is_hot = hot_keys[at] == keys if len(hot_keys) else np.zeros(len(keys), bool)
            hot_log = np.where(is_hot, np.log10(hot_counts[at] + 1.0), 0.0) if len(hot_keys) else np.zeros(len(keys))
            hot_score = np.where(is_hot, hot_scores[at], 0.0) if len(hot_keys) else np.zeros(len(keys))
            own = is_hot[word]
            mine = {
                "doc_id": batch.column(0).to_pylist(), "held_out": batch.column(2).to_pylist(), "words": sizes, "score": np.bincount(doc, tf * hot_score[word], rows),
                "sum": np.bincount(doc, tf * hot_log[word], rows), "known": np.bincount(doc, tf * own, rows),
            }
            doc, word, tf = doc[~own], word[~own], tf[~own]
            bucket = (keys % buckets)[word]
            order = np.lexsort((word, bucket))
            doc, word, tf, bucket = doc[order], word[order], tf[order], bucket[order]
            out = [(base + number, number % buckets, True, pickle.dumps(mine, 5))]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                part = slice(edges[b], edges[b + 1])
                if edges[b] < edges[b + 1]:
                    unique, inverse = np.unique(word[part], return_inverse=True)
                    small = np.uint16 if tf[part].max() < 65536 else np.int64
                    blob = keys[unique], np.bincount(inverse).astype(np.uint32), doc[part].astype(np.uint16 if rows < 65536 else np.uint32), tf[part].astype(small), rows
                    out.append((base + number, b, False, pickle.dumps(blob, 5)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], names=["batch", "bucket", "docs", "blob"])

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """The sums over a bucket's words, for each batch."""
        keys, ns = right.column("key").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(keys)
        keys, ns, scores = keys[order], ns[order], right.column("log").to_numpy()[order]
        logs = np.log10(ns + 1.0)
        out = []
        for batch, docs, blob in zip(*(left.column(c) for c in ("batch", "docs", "blob"))):
            if docs.as_py():
                out.append((batch.as_py(), True, blob.as_py()))
                continue
            own, times, doc, tf, rows = pickle.loads(blob.as_py())
            at = np.searchsorted(keys, own)  # every word of the texts is there
            of = lambda x: np.bincount(doc, tf * np.repeat(x[at], times), rows)
            sums = of(logs), of(ns > 0).astype(np.uint32), of(scores)
            out.append((batch.as_py(), False, pickle.dumps(sums, 5)))
        columns = zip(*out) if out else [[]] * 3
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary()))], names=["batch", "docs", "blob"])

    whole_log, end_count = float(np.log10(n + v + 1)), ends

    def assemble(group: pa.Table) -> pa.Table:
        sums = known = score = 0
        mine = None
        for docs, blob in zip(group.column("docs"), group.column("blob")):
            x = pickle.loads(blob.as_py())
            if docs.as_py():
                mine = x
                sums, known, score = sums + x["sum"], known + x["known"], score + x["score"]
            else:
                sums, known, score = sums + x[0], known + x[1], score + x[2]
        tokens_ = mine["words"] + 1
        columns = [
            pa.array(mine["doc_id"], pa.int64()), pa.array(mine["held_out"], pa.bool_()), pa.array(tokens_),
            pa.array((known + (end_count > 0)).astype(np.int64)), pa.array(np.full(len(tokens_), n, np.int64)),
            pa.array(sums + np.log10(end_count + 1.0) - tokens_ * whole_log), pa.array(score + end_log),
        ]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sums = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, "batch long, bucket int, docs boolean, blob binary")
    cold = counts.filter(F.col("n") < max(1.0, HOT * n)).select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key", "n", "log")
    found = sums.groupBy("bucket").cogroup(cold.groupBy("bucket")).applyInArrow(look_up, "batch long, docs boolean, blob binary")
    return found.groupBy("batch").applyInArrow(assemble, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    return scored(spark, table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)
