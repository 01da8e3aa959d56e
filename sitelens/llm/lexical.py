"""Ranked lexical search over dual-sorted wavelet trees, one tree a shard of documents.

A shard holds the postings of some documents. Each term's list is ordered by impact, highest first, and all lists, one after
another, are one sequence of document numbers, kept as a wavelet matrix: a bit of the number at each
level, high bits first, after a stable partition by the bits before. So the postings of a term in any dyadic range of document
numbers are a contiguous range at that range's level, still in order of impact: the first one bounds the
impact of the term in the whole range, and a range of one document has its exact impact. Numbers follow
the ids, so a node is a range of ids.

A query starts at the root with the ranges of its terms. Nodes are opened best bound first, some at a time;
a node's bound is the sum of weight times first impact over the terms that it holds. What can't reach the k-th best
score so far is never opened; the k-th best is carried from shard to shard within a task. Only ranges that hold
postings are kept, so a search never holds more ranges than the shard has postings of its terms. The result is exact.

The index is a table: a row a shard, with the terms and their sizes beside the bits, so that document frequencies are read without
the trees. Shards are cut from each task's rows as they come: nothing is shuffled to build it. Impacts depend on
the number of documents and terms, so these are counted first. Queries go in blocks of bounded size, each broadcast once.

Defined results: a null text has no terms; documents without terms are not found; rows that repeat an id are documents of
their own, and so are queries that repeat an item's id; null ids come last in ties; queries without a known term have no
rows; weights that are not above 0 count nothing; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keyed, parts, small_batches, stored, table

K = 20
#: Documents, and postings before the last document, of a shard.
SHARD_DOCS, POSTINGS = 1 << 12, 1 << 19
#: Nodes that are opened at a time.
OPENED = 128
#: Pairs of query and term in a block of queries.
BLOCK = 1 << 19
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same over UTF-8 in lower case.
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER = "".join(map(chr, range(65, 91)))
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Scale of impacts, of term frequencies, weight of the length norm, and the norm's fixed and variable share in per cent.
IMPACT, TF, LENGTH, VARIABLE = 1_000_000_000, 1000, 12, 25
SHARD = "doc_ids array<long>, norms array<long>, terms array<string>, sizes array<int>, tf binary, bits binary"


@dataclass(frozen=True)
class Index:
    """shards: a row each (see SHARD); documents with a term, and all their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def impacts(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return IMPACT * tf // (TF * tf + LENGTH * norms)


def level_count(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


class Builder:
    """Gathers documents until a shard is full."""

    def __init__(self, n_docs: int, n_terms: int, shard_docs: int = SHARD_DOCS, most: int = POSTINGS):
        self.n_docs, self.n_terms, self.shard_docs, self.most = n_docs, n_terms, shard_docs, most
        self.start()

    def start(self) -> None:
        self.vocabulary, self.docs, self.postings = {}, [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = TERM_BYTES.findall((text or "").encode("utf-8", "replace").translate(LOWER_BYTES))
        if words:
            known = self.vocabulary
            terms, tf = np.unique(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)), return_counts=True)
            self.docs.append((doc_id is None, doc_id or 0, len(words), terms, tf))
            self.postings += len(terms)

    def full(self) -> bool:
        return len(self.docs) >= self.shard_docs or self.postings >= self.most

    def finish(self) -> pa.RecordBatch:
        docs = sorted(self.docs, key=lambda d: d[:2])
        norms = np.array([100 - VARIABLE + VARIABLE * n * self.n_docs // self.n_terms for _, _, n, _, _ in docs], np.int64)
        at = np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs])
        terms, tf = np.concatenate([d[3] for d in docs]), np.concatenate([d[4] for d in docs])
        order = np.argsort(terms << 32 | ((1 << 20) - 1 - impacts(tf, norms[at])) << 12 | at)
        sequence, levels, bits = at[order], level_count(len(docs)), []
        for level in range(levels):
            bit = (sequence >> (levels - 1 - level) & 1).astype(bool)
            bits.append(np.packbits(bit))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        ids = pa.array([None if null else doc_id for null, doc_id, *_ in docs], pa.int64())
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        names = pa.array([w.decode("utf-8", "replace") for w in self.vocabulary], pa.string())
        sizes = pa.array(np.bincount(terms, minlength=len(self.vocabulary)).astype(np.int32))
        columns = [one(ids), one(pa.array(norms)), one(names), one(sizes), pa.array([tf[order].astype("<u4").tobytes()]), pa.array([np.concatenate(bits).tobytes()])]
        self.start()
        return pa.RecordBatch.from_arrays(columns, names=["doc_ids", "norms", "terms", "sizes", "tf", "bits"])


class Tree:
    """A shard's wavelet matrix with counts of ones before each place, and the impacts at every level."""

    def __init__(self, doc_ids: list[int | None], norms: np.ndarray, sizes: np.ndarray, tf: np.ndarray, bits: np.ndarray):
        self.doc_ids, n = doc_ids, len(tf)
        self.levels = level_count(len(doc_ids))
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes
        packed = bits.reshape(self.levels, -1)
        self.ones = np.zeros((self.levels, n + 1), np.int32)
        place, docs, places = np.arange(n), np.zeros(n, np.int64), []
        for level in range(self.levels):
            bit = np.unpackbits(packed[level], count=n)
            np.cumsum(bit, out=self.ones[level, 1:])
            own, before = bit[place], self.ones[level][place]
            docs = docs << 1 | own
            place = np.where(own == 1, n - self.ones[level, n] + before, place - before)
            places.append(place)
        self.zeros = (n - self.ones[:, n]).astype(np.int64)
        self.impacts = np.zeros((self.levels + 1, n + 1), np.int32)
        self.impacts[0, :n] = own = impacts(tf, norms[docs])
        for level, place in enumerate(places):
            self.impacts[level + 1, place] = own

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list) -> list:
        """best: (-score, id is null, id), the k best so far in order; returns it with those of this shard."""
        least = -best[-1][0] if len(best) >= k else 1
        level, code = np.zeros(1, np.int64), np.zeros(1, np.int64)
        node, weight, low, high = np.zeros(len(terms), np.int64), weights, self.starts[terms], self.ends[terms]
        bound = np.array([(weight * self.impacts[0, low].astype(np.int64)).sum()])
        while len(bound):
            picked = np.ones(len(bound), bool)
            if len(bound) > OPENED:
                picked[np.argpartition(bound, -OPENED)[:-OPENED]] = False
            # Children of the picked nodes, zeros first; ranges without postings go.
            own = picked[node]
            at, a, b = node[own], low[own], high[own]
            depth = level[at]
            ones_a, ones_b = self.ones[depth, a].astype(np.int64), self.ones[depth, b].astype(np.int64)
            zeros, child = self.zeros[depth], 2 * (np.cumsum(picked) - 1)[at]
            child_low, child_high = np.concatenate([a - ones_a, zeros + ones_a]), np.concatenate([b - ones_b, zeros + ones_b])
            some = child_high > child_low
            child = np.concatenate([child, child + 1])[some]
            child_low, child_high, child_weight = child_low[some], child_high[some], np.concatenate([weight[own]] * 2)[some]
            depth = np.concatenate([depth, depth])[some] + 1
            child_bound = np.zeros(2 * int(picked.sum()), np.int64)
            np.add.at(child_bound, child, child_weight * self.impacts[depth, child_low].astype(np.int64))
            child_level = np.repeat(level[picked] + 1, 2)
            child_code = np.repeat(code[picked] << 1, 2)
            child_code[1::2] += 1
            # A node of the last level is a document, and its bound the score.
            found = (child_level == self.levels) & (child_bound >= least)
            if found.any():
                ids = [(-int(s), (i := self.doc_ids[c]) is None, i or 0) for s, c in zip(child_bound[found], child_code[found])]
                best = sorted(best + ids)[:k]
                least = -best[-1][0] if len(best) >= k else least
            # What stays: nodes not opened, and children, that can still reach the k-th best.
            stay, child_stay = ~picked & (bound >= least), (child_level < self.levels) & (child_bound >= least)
            number, child_number = np.cumsum(stay) - 1, np.cumsum(child_stay) - 1 + int(stay.sum())
            own, some = stay[node], child_stay[child]
            node = np.concatenate([number[node[own]], child_number[child[some]]])
            weight, low, high = (np.concatenate([x[own], y[some]]) for x, y in ((weight, child_weight), (low, child_low), (high, child_high)))
            level, code, bound = (np.concatenate([x[stay], y[child_stay]]) for x, y in ((level, child_level), (code, child_code), (bound, child_bound)))
        return best


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tree, pa.Array]]:
    """The tree of each shard, and its terms."""
    for batch in batches:
        for k in range(batch.num_rows):
            doc_ids, norms, terms, sizes = (batch.column(c)[k].values for c in range(4))
            tf, bits = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((4, "<u4"), (5, np.uint8)))
            yield Tree(doc_ids.to_pylist(), norms.to_numpy(), sizes.to_numpy(), tf, bits), terms


def count_terms(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(TERM))


def index(docs: DataFrame, shard_docs: int = SHARD_DOCS, postings: int = POSTINGS) -> Index:
    """docs (doc_id, text); the index is written to the shared folder."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = count_terms(F.col("text")).cast("long")
    n_docs, n_terms = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Builder(n_docs, n_terms, shard_docs, postings)
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                shard.add(doc_id.as_py(), text.as_py())
                if shard.full():
                    yield shard.finish()
        if shard.docs:
            yield shard.finish()

    return Index(stored(docs.mapInArrow(run, SHARD)), n_docs, n_terms)


def weighed(at: Index, queries: DataFrame) -> DataFrame:
    """queries (item_id, text) -> query (a number for each row), item_id, and its terms with weight times repeats."""
    items = keyed(queries.select("item_id", F.col("text").cast("string").alias("text")), "query")
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    terms = items.select("query", "item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), 0)).alias("term"))
    terms = terms.groupBy("query", "item_id", "term").agg(F.count("*").alias("n"))
    held = at.shards.select(F.inline(F.arrays_zip("terms", "sizes"))).select(F.col("terms").alias("term"), "sizes")
    df = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("sizes").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * at.n_docs + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("n")
    terms = terms.join(df, "term").withColumn("weight", weight).filter("weight > 0")
    return terms.groupBy("query", "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))


def blocks(queries: DataFrame) -> Iterator[tuple[list, bool]]:
    """Rows of weighed() until they have BLOCK terms, and whether more follow; the driver holds one block and the next's first row."""
    block, size = [], 0
    for row in queries.toLocalIterator():
        if block and size + len(row.terms) > BLOCK:
            yield block, True
            block, size = [], 0
        block.append(row)
        size += len(row.terms)
    yield block, False


def searched(at: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of every query (item_id, text): item_id, rank, doc_id, score."""
    spark = queries.sparkSession
    small_batches(spark)
    shards = at.shards
    if len(shards.inputFiles()) < parts(shards):  # a small index: more tasks than files
        shards = shards.repartition(parts(shards))
    kind = dict(queries.dtypes)["item_id"]
    found = None
    for block, more in blocks(weighed(at, queries)):
        own = found_in(spark, shards, block, k, kind)
        own = stored(own) if more or found is not None else own
        found = own if found is None else found.unionByName(own)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def found_in(spark: SparkSession, shards: DataFrame, block: list, k: int, kind: str) -> DataFrame:
    """The k best of each task for each query of a block: query, item_id, doc_id, score."""
    vocabulary: dict[str, int] = {}
    asked = [(np.array([vocabulary.setdefault(t.term, len(vocabulary)) for t in row.terms], np.int64), np.array([t.weight for t in row.terms], np.int64)) for row in block]
    sent = spark.sparkContext.broadcast((list(vocabulary), asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = sent.value
        names, best = pa.array(names, pa.string()), [[] for _ in asked]
        for tree, terms in trees(batches):
            place = pc.fill_null(pc.index_in(names, value_set=terms), -1).to_numpy()
            for q, (own, weights) in enumerate(asked):
                held = place[own] >= 0
                if held.any():
                    best[q] = tree.search(place[own][held].astype(np.int64), weights[held], k, best[q])
        rows = [(q, None if null else doc_id, -score) for q, x in enumerate(best) for score, null, doc_id in x]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["at", "doc_id", "score"])

    rows = shards.mapInArrow(run, "at long, doc_id long, score long")
    names = spark.createDataFrame([(n, row.query, row.item_id) for n, row in enumerate(block)], f"at long, query long, item_id {kind}")
    return rows.join(F.broadcast(names), "at").select("query", "item_id", "doc_id", "score")  # a row for each query of the block


def op12_lexical(spark, sf_dir: str) -> DataFrame:
    return searched(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


#: The same in DuckDB's SQL.
OP12_SQL = f"""
WITH d AS (
  SELECT row, doc_id, unnest(w) AS term, len(w) AS n FROM (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}') AS w FROM documents)
), p AS (SELECT row, doc_id, term, n, count(*) AS tf FROM d GROUP BY ALL
), totals AS (SELECT count(DISTINCT row) AS n_docs, count(*) AS n_terms FROM d
), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1
), q AS (
  SELECT query, item_id, term, count(*) AS repeats FROM (
    SELECT row_number() OVER () AS query, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM benchmark)
  GROUP BY ALL
), w AS (
  SELECT query, item_id, term, CAST(repeats * floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS weight
  FROM q JOIN f USING (term), totals
), s AS (
  SELECT query, item_id, row, doc_id, CAST(sum(weight * (({IMPACT} * tf) // ({TF} * tf + {LENGTH} * ({100 - VARIABLE} + ({VARIABLE} * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM w JOIN p USING (term), totals GROUP BY ALL HAVING score > 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""
