"""Near-duplicate groups by a chosen-path set similarity join over minwise tokens.

A document's set is its distinct five-word shingles, as 64-bit hashes. Documents of one set are a
class and take part once. Every class has MINHASHES minwise tokens. A tree branches the classes by
one token at its root and, where a node holds more than LEAF classes, by PATHS further paths of STEP
tokens that the node chooses, for DEPTH levels; every class follows its own paths from its tokens alone, so
a level is one grouping by path. Nodes of two to LEAF classes are compared exhaustively, by the share of
equal tokens; of nodes with the same members, as near copies have in most trees, one is compared. TREES
independent trees reach the target recall: a pair at similarity 0.75 misses all roots with chance
0.25 ** 8, under 2 in 100 000, and all paths of all levels with chance 4 in 100 000.

A large node first links its members to its least one (its pivot), on full sets; nodes whose members are of
one component by then are done, so that a large group of near copies does not branch. Nodes that are
large and of several components on the last level too are compared in blocks, pair by pair of parts. Each node
gives a maximum spanning forest of the pairs that may be links, never all pairs of a group of copies. Links are
confirmed on full sets; nodes with further possible pairs, whose members the confirmed links leave in
different components, then get their members' full sets and count all pairs, so that no link between
components is lost, and again only those that join components leave the task. Components come from alternating
large and small stars, after each task has contracted its own links; up to FEW_LINKS links are contracted by one task.

Defined results: a document without words or with a null text has no shingles, links with nothing and
is its own component; fewer than five words are one shingle; a row with a null id has a null component
and is not kept; rows that repeat an id are one document, that has all their links and one component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, fresh, keyed, small_batches, table

SHINGLE = 5
#: Similarity of a link, in per cent.
PERCENT = 75
MINHASHES, TREES, PATHS, STEP, DEPTH = 128, 8, 4, 2, 2
#: Classes that a node compares at once, and their shingles.
LEAF, LEAF_SHINGLES = 2000, 2_000_000
#: Estimated similarity from which a pair is confirmed: four standard errors under the link's.
MAYBE = 0.6
#: Ids that may be broadcast to pick the documents of possible links (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Links that one task may contract (some 100 bytes each); more go by stars.
FEW_LINKS = 500_000
#: Words that a worker remembers hashes of.
REMEMBERED = 100_000
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINHASHES, dtype=np.uint64)
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingles of a whole text, as hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    mixed = h[: len(h) - width + 1] + np.uint64(width)
    for k in range(1, width):
        mixed = mixed * _P + h[k : len(h) - width + 1 + k]
        mixed ^= mixed >> _SHIFT
    for m in (_M1, _M2):
        mixed = (mixed ^ (mixed >> _SHIFT)) * m
    return np.unique(mixed ^ (mixed >> _SHIFT))


def tokens(own: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set."""
    out = np.full(MINHASHES, 0xFFFFFFFF, np.uint64)
    for start in range(0, len(own), 2048):
        out = np.minimum(out, ((_A[:, None] * own[None, start : start + 2048] + _B[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """row, doc_id, h (of the text), n shingles, the set's 128-bit hash (k1, k2) and its tokens: their last
    bytes (the sketch), then three bytes more of each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            hashes = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]
            bytes_ = [tokens(s).view(np.uint8).reshape(MINHASHES, 4) for s in sets]
            columns = [
                *batch.columns[:2],
                pa.array(map(len, sets), pa.int64()),
                pa.array([int(h[0]) for h in hashes], pa.int64()),
                pa.array([int(h[1]) for h in hashes], pa.int64()),
                pa.array([b[:, 0].tobytes() + b[:, 1:].tobytes() for b in bytes_], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "k1", "k2", "tokens"])

    rows = texts(docs).mapInArrow(run, "doc_id long, h long, n long, k1 long, k2 long, tokens binary")
    return rows.withColumn("row", F.monotonically_increasing_id())


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def token(j: int | Column) -> list[Column]:
    """The bytes of token j."""
    j = F.lit(j) if isinstance(j, int) else j
    return [F.substring("tokens", j + 1, F.lit(1)), F.substring("tokens", j * 3 + (MINHASHES + 1), F.lit(3))]


def placed(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """(id, nodes) -> node, id, component: an id meets its component once, whatever the number of its nodes."""
    component = F.col("id")
    if found is not None:
        rows = rows.join(found, "id", "left")
        component = F.coalesce("component", "id")
    return rows.select(F.explode("nodes").alias("node"), "id", component.alias("component"))


def dealt(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """(id, nodes) -> node, id, size, pivot: the rows of one of the nodes of each set of members, where these
    are two or more, of several components as found so far."""
    rows = placed(rows, found)
    if found is not None:
        rows = cut(rows)
    nodes = rows.groupBy("node").agg(
        F.count("*").alias("size"), F.min("id").alias("pivot"), F.bit_xor(F.xxhash64("id")).alias("members"), F.min("component").alias("x"), F.max("component").alias("y")
    )
    one = nodes.filter("x < y").groupBy("size", "pivot", "members").agg(F.min("node").alias("node"))
    out = cut(rows.select("node", "id").join(one.select("node", "size", "pivot").hint("merge"), "node"))
    if found is not None:
        forget(rows)
    return out


def in_parts(rows: DataFrame, parts: Column, node: str) -> DataFrame:
    """Rows of nodes split into parts by hash of the id: every pair of parts is a node, so that all pairs of members meet."""
    rows = rows.withColumn("parts", parts.cast("int"))
    split = rows.filter("parts > 1").withColumns({"part": F.pmod(F.xxhash64("id"), "parts"), "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    split = split.withColumn(node, F.xxhash64(node, F.least("part", "other"), F.greatest("part", "other")))
    return rows.filter("parts <= 1").drop("parts").unionByName(split.drop("parts", "part", "other"))


def by_id(rows: DataFrame, node: str = "node") -> DataFrame:
    """(node, id) -> id, nodes."""
    return rows.groupBy("id").agg(F.collect_list(node).alias("nodes"))


def children(node: Column) -> Column:
    """Where a node's paths lead a class."""
    paths = [[F.pmod(F.xxhash64(node, F.lit(p), F.lit(s)), F.lit(MINHASHES)).cast("int") for s in range(STEP)] for p in range(PATHS)]
    return F.array(*(F.xxhash64(node, F.lit(p), *(b for j in path for b in token(j))) for p, path in enumerate(paths)))


def leaves(classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(leaf, id): the nodes of all trees that are compared exhaustively; and the links of pivots."""
    roots = F.array(*(F.xxhash64(F.lit(t), *token(t)) for t in range(TREES)))
    rows = dealt(classes.select("id", roots.alias("nodes")), None)
    out = [rows.filter(F.col("size") <= LEAF)]
    links, found, large = None, None, rows.filter(F.col("size") > LEAF)
    if large.isEmpty():
        return out[0].select(F.col("node").alias("leaf"), "id"), None
    own = cut(classes.join(large.select("id").distinct().hint("merge"), "id", "left_semi"))
    for level in range(DEPTH + 1):
        new = confirmed(possible(large.filter("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), own), own, docs)
        new = cut(new)
        if not new.isEmpty():
            links = new if links is None else cut(links.union(new))
            found = components(links)
        large = dealt(by_id(large), found)
        if level == DEPTH or large.isEmpty():
            break
        below = by_id(large).join(own.select("id", "tokens"), "id").select("id", F.flatten(F.transform("nodes", children)).alias("nodes"))
        below = dealt(below, found)
        out.append(below.filter(F.col("size") <= LEAF))
        large = below.filter(F.col("size") > LEAF)
    out.append(in_parts(large, F.ceil(2 * F.col("size") / LEAF), "node"))
    return reduce(DataFrame.unionByName, out).select(F.col("node").alias("leaf"), "id"), links


def estimate(same: np.ndarray) -> np.ndarray:
    """Similarity of sets by how many bytes of their sketches are the same."""
    return (same / MINHASHES - 1 / 256) / (1 - 1 / 256)


def alike(sketches: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
    """Estimated similarity of member i to all; 0 where the sizes rule a link out, and to itself."""
    out = estimate((sketches == sketches[i]).sum(1))
    out[np.minimum(sizes, sizes[i]) * 100 < PERCENT * np.maximum(sizes, sizes[i])] = 0
    out[i] = 0
    return out


def forest(sketches: np.ndarray, sizes: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A maximum spanning forest of the possible links, and the members of any where there are others beside it."""
    n, edges, possible = len(sizes), [], np.zeros(len(sizes), int)
    open_, best, via = np.ones(n, bool), np.zeros(n), np.zeros(n, int)
    for _ in range(n):
        at = int(np.where(open_, best, -1).argmax())
        if best[at] >= MAYBE:
            edges.append((at, int(via[at])))
        open_[at] = False
        own = alike(sketches, sizes, at)
        possible[at] = (own >= MAYBE).sum()
        nearer = open_ & (own > best)
        best[nearer], via[nearer] = own[nearer], at
    more = possible.sum() > 2 * len(edges)
    return edges, np.flatnonzero(possible) if more else np.zeros(0, int)


def compared(members: DataFrame) -> DataFrame:
    """(leaf, members: [id, n, sketch]) -> leaf, a, b: a spanning forest of the possible links (a < b),
    and the members of any (a = b) in nodes where there are others beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for leaf, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = own.values
                ids, sizes = (own.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
                edges, more = forest(np.frombuffer(b"".join(own.field("sketch").to_pylist()), np.uint8).reshape(len(ids), MINHASHES), sizes)
                out += [(leaf, *sorted((int(ids[i]), int(ids[j])))) for i, j in edges]
                out += [(leaf, int(ids[i]), int(ids[i])) for i in more]
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["leaf", "a", "b"])

    return members.select("leaf", "members").mapInArrow(run, "leaf long, a long, b long")


def joined(members: DataFrame) -> DataFrame:
    """(members: [id, component, set]) -> a, b: links on full sets that join different components.

    All pairs of a node are counted, a member against all at a time: its shingles are marked and
    the marks summed over the others' sets. Pairs within one component are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for own in batch.column(0):
                own = own.values
                ids, component = (own.field(c).to_numpy(zero_copy_only=False) for c in ("id", "component"))
                sets = [np.frombuffer(x, np.uint64) for x in own.field("set").to_pylist()]
                sizes = np.array([len(x) for x in sets])
                _, flat = np.unique(np.concatenate(sets), return_inverse=True)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                marks = np.zeros(flat.max() + 1, np.int32)
                component = component.copy()
                for i in range(len(ids)):
                    if (component[i + 1 :] == component[i]).all():
                        continue
                    part = flat[starts[i] : starts[i] + sizes[i]]
                    marks[part] = 1
                    common = np.add.reduceat(marks[flat], starts)
                    marks[part] = 0
                    linked = 100 * common >= PERCENT * (sizes + sizes[i] - common)
                    for j in np.flatnonzero(linked & (component != component[i])):
                        if component[j] != component[i]:
                            out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
                            component[component == component[j]] = component[i]
            columns = zip(*out) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return members.select("members").mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be links by their sketches."""
    sketch = F.substring("tokens", 1, MINHASHES)
    for x in "ba":
        pairs = pairs.join(classes.select(F.col("id").alias(x), F.col("n").alias("n" + x), sketch.alias("s" + x)), x)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (c.to_numpy() for c in batch.columns[2:4])
            sa, sb = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, MINHASHES) for c in batch.columns[4:])
            near = estimate((sa == sb).sum(1)) >= MAYBE
            near &= np.minimum(na, nb) * 100 >= PERCENT * np.maximum(na, nb)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(test, "a long, b long")


def full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id) -> (id, set): the shingles of the classes with these distinct ids, from the text of their least row."""
    ids = cut(ids.join(classes.select("id", "doc_id", "h"), "id"))
    few = ids.count() <= BROADCAST_IDS
    picked = texts(docs).join(F.broadcast(ids) if few else ids.hint("merge"), ["doc_id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "set"])

    return picked.select("id", "text").mapInArrow(run, "id long, set binary").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""
    pairs = cut(pairs)
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, docs)
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def contracted(edges: DataFrame) -> DataFrame:
    """The links (u, v) of every task as stars: each id with the least that the task's own links reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = sorted((root(x), root(y)))
                up[y] = x
        yield pa.RecordBatch.from_arrays([pa.array(up, pa.int64()), pa.array(map(root, up), pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): every id of a link, with the smallest id that it reaches."""
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    if edges.count() <= FEW_LINKS:
        return cut(contracted(edges.coalesce(1)).toDF("id", "component"))
    links, edges, before = edges, cut(contracted(edges).filter("u > v").distinct()), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if tuple(state) == before:
            return cut(edges.toDF("id", "component").union(edges.select("v", "v").distinct()))
        before = tuple(state)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, edges = edges, cut(small.distinct())
        forget(old)


def of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes of rows that repeat an id."""
    several = rows.groupBy("doc_id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).filter("x < y").select("doc_id")
    own = rows.join(several, "doc_id").join(classes.select("k1", "k2", "id"), ["k1", "k2"])
    first = own.groupBy("doc_id").agg(F.min("id").alias("a"))
    return own.select("doc_id", F.col("id").alias("b")).distinct().join(first, "doc_id").filter("a < b").select("a", "b")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = cut(signatures(docs))
    own = rows.filter("n > 0 and doc_id is not null")
    one = F.min(F.struct("doc_id", "row", "h")).alias("one")
    classes = own.groupBy("k1", "k2").agg(one, F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = cut(classes.select("k1", "k2", F.col("one.row").alias("id"), "one.doc_id", "one.h", "n", "tokens"))
    rows = rows.select("doc_id", "n", "k1", "k2")
    nodes, links = leaves(classes, docs)
    members = nodes.join(classes.select("id", "n", F.substring("tokens", 1, MINHASHES).alias("sketch")).hint("merge"), "id")
    first = cut(compared(members.groupBy("leaf").agg(F.collect_list(F.struct("id", "n", "sketch")).alias("members"))))
    new = confirmed(first.filter("a < b").select("a", "b").distinct(), classes, docs).union(of_one_id(rows.filter("n > 0 and doc_id is not null"), classes))
    links = cut(new if links is None else links.union(new))
    found = components(links)
    # Nodes with possible links beside their forest, where these may join different components.
    every = by_id(first.filter("a = b").select("leaf", F.col("a").alias("id")), "leaf")
    every = cut(placed(every, found).withColumnRenamed("node", "leaf"))
    open_ = every.groupBy("leaf").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("leaf")
    more = cut(every.join(open_, "leaf", "left_semi"))
    forget(every)
    if not more.isEmpty():
        sets = full_sets(more.select("id").distinct(), classes, docs)
        sized = more.join(classes.select("id", "n"), "id")
        sized = sized.join(sized.groupBy("leaf").agg(F.ceil(2 * F.sum("n") / LEAF_SHINGLES).alias("many")), "leaf")
        sized = in_parts(sized, F.when(F.col("many") > 2, F.col("many")).otherwise(1), "leaf")
        one = F.struct("id", "component", "set")
        new = joined(sized.join(sets, "id").groupBy("leaf").agg(F.collect_list(one).alias("members")))
        found = components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).union(new))
    # A component is named by the least id of its documents.
    own = found.join(classes.select("id", "doc_id"), "id")
    least = own.groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = own.select("id", "component").join(least, "component").select("id", "least")
    by_class = cut(classes.select("k1", "k2", "id", "doc_id").join(linked, "id", "left").select("k1", "k2", F.coalesce("least", "doc_id").alias("component")))
    for done in (classes, first, links, found, more):
        forget(done)
    out = rows.join(by_class, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")))
    out = out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the least id (a null id is the last, equal ids by row); ids may repeat or be
    null, and texts without words are groups of their own; other columns stay, whatever their names."""
    row, one = fresh(docs.columns, 2)
    docs = keyed(docs, row)
    groups = grouped(docs.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    own = docs.select(row, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias(one))
    first = own.join(groups, row).groupBy("component_id").agg(F.min(one).alias(one)).select(F.col(one)["row"].alias(row))
    return docs.join(first, row, "left_semi").drop(row)
