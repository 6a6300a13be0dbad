"""N-gram Jaccard join with R-trees over count vectors.

A document's tokens are its distinct four-word shingles. Each token falls into one of GROUPS groups by its hash, and a
document is the point of its group counts. The overlap of two documents is at most the sum of their coordinates' minima, and
of two R-tree nodes at most the sum of the minima of their upper corners; what can't reach the required overlap is pruned
and what is left is verified by the exact shingles of both texts.

In so many dimensions one tree over a corpus prunes little near its root, as unrelated documents of one length have much the same
counts. So points are dealt to many trees first: two documents that link share one of each other's 15 % rarest tokens (in an order
by how often the corpus has a token's hash bucket), and points meet in the trees of those tokens.

1. Equal texts become one point; counts of hash buckets are taken over all documents.
2. First links: every point meets the others of a few of its rare tokens, takes the nearest of its R-tree leaf by the
   bound that is of another component, and the pair is verified. That joins most copies, however large their group, with a few rows per document.
3. All others: the trees of all rare tokens that still hold points of different components are joined with themselves, node
   pair by node pair; nodes and points of one component are pruned, as their link is known. Surviving pairs are verified.
   A token with very many points is dealt in blocks that meet pairwise.

Components of all verified links are the classes; copies and cliques are never expanded into all pairs.

Defined cases: null, empty and blank texts have no shingles, n_shingles 0 and their own doc_id as class, equal or not; texts
of under four words have one shingle, all their words; equal texts share a class; rows of one doc_id with different texts are
judged each by its text; null ids are judged like others, and a class is named by its smallest id that is not null; empty tables
give no rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import text_table, written
from weftline.llm.components import components
from weftline.llm.words import shingle_set, shingles_of

WIDTH = 4
#: Shared shingles that a link needs, in percent of all of both.
PERCENT = 85
#: Groups that tokens are hashed into, the dimensions of the trees. Hash buckets whose counts order the tokens.
GROUPS, BUCKETS = 256, 1 << 16
#: Points of a leaf. Points of one token that one task takes; beyond, they are dealt in blocks.
LEAF, DIRECT = 32, 4096
#: Rare tokens of a document that the first links use, those of the least hashes: near copies mostly have the same.
FIRST = 4
#: Rounds of first links; a further one joins components that the one before has left apart (few on the tables here).
ROUNDS = 1
#: Documents up to which those in candidate pairs are sent to every task to pick their texts; beyond, they are joined.
SENT = 300_000


def _key() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


# --- points ---------------------------------------------------------------------------------------------------------


def _distinct(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[fresh], r[fresh]


def _counted(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for h, r in shingles_of(batch.column(0), width):
                h, _ = _distinct(h, r)
                seen += np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """How many (document, shingle) pairs of the whole table fall into each hash bucket; as many numbers as buckets come to the driver."""
    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(_counted(width, buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Counts in one byte each if they fit, else in four."""
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else counts.astype("<u4").tobytes()


def _vectors(column: pa.Array, groups: int) -> np.ndarray:
    """The counts of packed points, a row each."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    narrow = np.diff(at) == groups
    if narrow.all():
        return raw[at[0] : at[-1]].reshape(-1, groups)
    out = np.zeros((len(column), groups), np.uint32)
    out[narrow] = raw[at[:-1][narrow][:, None] + np.arange(groups)]
    wide = np.flatnonzero(~narrow)
    out[wide] = np.ascontiguousarray(raw[at[wide][:, None] + np.arange(4 * groups)]).view("<u4")
    return out


def _pointed(order, width: int, percent: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mask = order.value, np.uint64(len(order.value) - 1)
        for batch in batches:
            keys = batch.column(0)
            for h, r in shingles_of(batch.column(1), width):
                h, r = _distinct(h, r)
                rows, first = np.unique(r, return_index=True)
                sizes = np.diff(np.r_[first, len(r)])
                group = (h >> np.uint64(44)).astype(np.int64) * groups >> 20
                vectors = np.bincount(np.repeat(np.arange(len(rows)), sizes) * groups + group, minlength=len(rows) * groups).reshape(-1, groups)
                rank = np.lexsort((h, counts[(h & mask).astype(np.int64)], r))
                rare = sizes - (sizes * percent + 99) // 100 + 1
                place = np.arange(len(h)) - np.repeat(first, sizes)
                taken = h[rank][place < np.repeat(rare, sizes)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rare)], pa.int32()), pa.array(taken))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(sizes, pa.int64()), pa.array([_packed(v) for v in vectors], pa.binary()), lists], names=["key", "size", "point", "rare"])

    return run


def points(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, groups: int = GROUPS, buckets: int = BUCKETS) -> DataFrame:
    """(d, key, size, point, rare) of every distinct text that has words: its number, hash, shingles, packed counts and rare tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, width, buckets))
    rows = docs.select(_key().alias("key"), "text").mapInArrow(_pointed(sent, width, percent, groups), "key binary, size bigint, point binary, rare array<bigint>")
    return written(written(rows, "rows").dropDuplicates(["key"]).withColumn("d", F.monotonically_increasing_id()), "points")


# --- trees ----------------------------------------------------------------------------------------------------------


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most tokens that points can share: the sum of their coordinates' minima."""
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def _may_link(shared: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return shared * (100 + percent) >= percent * both


class RTree:
    """A bulk-loaded tree: nodes are halved at the median of their widest coordinate until they are leaves.

    order: the points' places by leaf; first, last: each node's range there; low, high: its corners; least: its smallest size;
    only: the component of all its points, or -1 if there are several; left, right: its children, or -1.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, kinds: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.first, self.last, self.low, self.high, self.least, self.only, self.left, self.right = [], [], [], [], [], [], [], []
        self._vectors, self._sizes, self._kinds, self._leaf = vectors, sizes, kinds, leaf
        stack = [self._node(0, len(vectors))]
        while stack:
            n = stack.pop()
            f, t = self.first[n], self.last[n]
            if t - f > leaf:
                part = self.order[f:t]
                spread = self.high[n].astype(np.int64) - self.low[n]
                widest = int(spread.argmax())
                by = vectors[part, widest] if spread[widest] else np.arange(len(part))
                self.order[f:t] = part[np.argsort(by, kind="stable")]
                half = (f + t) // 2
                self.left[n], self.right[n] = self._node(f, half), self._node(half, t)
                stack += [self.left[n], self.right[n]]

    def _node(self, f: int, t: int) -> int:
        part = self.order[f:t]
        v, kinds = self._vectors[part], self._kinds[part]
        self.first.append(f)
        self.last.append(t)
        self.low.append(v.min(axis=0))
        self.high.append(v.max(axis=0))
        self.least.append(int(self._sizes[part].min()))
        self.only.append(int(kinds[0]) if (kinds == kinds[0]).all() else -1)
        self.left.append(-1)
        self.right.append(-1)
        return len(self.first) - 1

    def leaves(self) -> Iterator[np.ndarray]:
        """The places of each leaf's points."""
        for n, left in enumerate(self.left):
            if left < 0:
                yield self.order[self.first[n] : self.last[n]]

    def pairs(self, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the point pairs that may link and are not of one component, each pair once."""
        v, sizes, kinds = self._vectors, self._sizes, self._kinds
        stack = [(0, 0)]
        while stack:
            x, y = stack.pop()
            if self.only[x] >= 0 and self.only[x] == self.only[y]:
                continue
            if x != y and not _may_link(overlap_bound(self.high[x], self.high[y]), self.least[x] + self.least[y], percent):
                continue
            if self.left[x] < 0 and self.left[y] < 0:
                p, q = self.order[self.first[x] : self.last[x]], self.order[self.first[y] : self.last[y]]
                close = _may_link(overlap_bound(v[p][:, None, :], v[q][None, :, :]), sizes[p][:, None] + sizes[q][None, :], percent) & (kinds[p][:, None] != kinds[q][None, :])
                i, j = np.nonzero(np.triu(close, 1) if x == y else close)
                if len(i):
                    yield p[i], q[j]
            elif x == y:
                stack += [(self.left[x], self.left[x]), (self.left[x], self.right[x]), (self.right[x], self.right[x])]
            elif self.left[y] < 0 or (self.left[x] >= 0 and self.last[x] - self.first[x] >= self.last[y] - self.first[y]):
                stack += [(self.left[x], y), (self.right[x], y)]
            else:
                stack += [(x, self.left[y]), (x, self.right[y])]


def nearest(d: np.ndarray, sizes: np.ndarray, kinds: np.ndarray, vectors: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point of a leaf the one of another component that it may share most tokens with for their sizes, if that may be a link."""
    both = sizes[:, None] + sizes[None, :]
    shared = overlap_bound(vectors[:, None, :], vectors[None, :, :])
    share = np.where(kinds[:, None] == kinds[None, :], -1.0, shared / both)
    best = share.argmax(axis=1)
    at = np.arange(len(d))
    good = _may_link(shared[at, best], both[at, best], percent) & (share[at, best] >= 0)
    return d[good], d[best[good]]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where equal keys begin, and the end."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.r_[np.flatnonzero(fresh), len(fresh)]


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Batches sorted by their first columns, cut so that rows of equal keys stay together."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        differs = np.zeros(batch.num_rows, bool)
        for c in cols:
            differs |= c != c[-1]
        last = np.flatnonzero(differs)
        if rest:
            before = [x.column(i)[-1].as_py() for x in rest[-1:] for i in range(keys)]
            if not len(last) and before == [c[0] for c in cols]:
                rest.append(batch)
                continue
        cut = int(last[-1]) + 1 if len(last) else 0
        if rest or cut:
            yield pa.Table.from_batches([*rest, *([batch.slice(0, cut)] if cut else [])])
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def _pair_batch(x: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x, y))
    a, b = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _first_links(percent: int, groups: int, leaf: int):
    """Rows (h, block, d, size, kind, point) to candidate pairs of leaf neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches, 2):
            rows = rows.combine_chunks()
            h, block, d, sizes, kinds = (rows.column(i).to_numpy() for i in range(5))
            vectors, x, y = _vectors(rows.column(5).combine_chunks(), groups), [], []
            at = _runs(h, block)
            for f, t in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if t - f > 1:
                    v, s, k = vectors[f:t], sizes[f:t], kinds[f:t]
                    for part in [np.arange(t - f)] if t - f <= leaf else RTree(v, s, k, leaf).leaves():
                        p, q = nearest(d[f:t][part], s[part], k[part], v[part], percent)
                        x.append(p)
                        y.append(q)
            yield _pair_batch(x, y)

    return run


def _joined(percent: int, groups: int, leaf: int):
    """Rows (h, tile, d, size, kind, block, point) to candidate pairs of different kinds; a tile of 0 or more pairs its two blocks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches, 2):
            rows = rows.combine_chunks()
            h, tile, d, sizes, kinds, blocks = (rows.column(i).to_numpy() for i in range(6))
            vectors, x, y = _vectors(rows.column(6).combine_chunks(), groups), [], []
            at = _runs(h, tile)
            counts = np.diff(at)
            few = np.repeat(counts <= leaf, counts)
            place = np.flatnonzero(few)  # runs of one leaf at most, all at once
            own = np.repeat(np.arange(len(counts)), counts)[place]
            for step in range(1, leaf):
                i = np.flatnonzero(own[:-step] == own[step:]) if step < len(own) else ()
                if not len(i):
                    break
                p, q = place[i], place[i + step]
                apart = (kinds[p] != kinds[q]) & ((tile[p] < 0) | (blocks[p] != blocks[q]))
                p, q = p[apart], q[apart]
                for k in range(0, len(p), 1 << 16):
                    a, b = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                    close = _may_link(overlap_bound(vectors[a], vectors[b]), sizes[a] + sizes[b], percent)
                    x.append(d[a[close]])
                    y.append(d[b[close]])
            for f, t in zip(at[:-1][counts > leaf].tolist(), at[1:][counts > leaf].tolist(), strict=True):
                held = 0
                for p, q in RTree(vectors[f:t], sizes[f:t], kinds[f:t], leaf).pairs(percent):
                    if tile[f] >= 0:
                        across = blocks[f + p] != blocks[f + q]
                        p, q = p[across], q[across]
                    x.append(d[f + p])
                    y.append(d[f + q])
                    held += len(p)
                    if held > 1 << 20:
                        yield _pair_batch(x, y)
                        x, y, held = [], [], 0
            yield _pair_batch(x, y)

    return run


# --- links ----------------------------------------------------------------------------------------------------------


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                if a[i] != last:
                    last, own = a[i], shingle_set(batch.column(2)[i].as_py(), width)
                other = shingle_set(batch.column(3)[i].as_py(), width)
                shared = len(own & other)
                good[i] = shared * 100 >= percent * (len(own) + len(other) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(pa.array(good)), pa.array(b, pa.int64()).filter(pa.array(good))], names=["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, where: DataFrame, width: int, percent: int, sent: int = SENT) -> DataFrame:
    """The pairs (a, b) whose texts link, by their exact shingles. where: (d, key). Only texts of documents in pairs are moved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct()
    named = written(where.select("d", "key").join(ids.hint("merge"), "d", "left_semi"), "named")
    wanted = F.broadcast(named) if named.count() <= sent else named.hint("merge")
    copies = docs.select(_key().alias("key"), "text").join(wanted, "key").select("d", "text")
    texts = written(copies.groupBy("d").agg(F.min("text").alias("text")), "texts")
    both = pairs.join(texts.select(F.col("d").alias("a"), F.col("text").alias("x")).hint("merge"), "a").join(texts.select(F.col("d").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(_verify(width, percent), "a bigint, b bigint"), "links")


def _kinds(at: DataFrame, roots: DataFrame | None, tokens: Column) -> DataFrame:
    """(d, kind, h): the tokens of each point with its component, itself where it has no link yet."""
    if roots is None:
        return at.select("d", F.col("d").alias("kind"), F.explode(tokens).alias("h"))
    kinds = at.select("d", tokens.alias("tokens")).join(roots.select(F.col("node").alias("d"), "root").hint("merge"), "d", "left")
    return written(kinds.select("d", F.coalesce("root", "d").alias("kind"), "tokens"), "kinds").select("d", "kind", F.explode("tokens").alias("h"))


def first_pairs(at: DataFrame, roots: DataFrame | None, percent: int, groups: int, leaf: int, direct: int, first: int = FIRST) -> DataFrame:
    """Candidate pairs of each point's nearest neighbours of other components in the trees of its rare tokens of the least hashes."""
    keys = _kinds(at, roots, F.slice(F.array_sort("rare"), 1, first))
    shared = written(keys.groupBy("h").agg(F.count("*").alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high")).where("low < high").select("h", "n"), "shared")
    block = F.pmod(F.xxhash64("d", "h"), F.ceil(F.col("n") / direct)).alias("block")
    rows = keys.join(shared.hint("merge"), "h").select("h", block, "d", "kind").join(at.select("d", "size", "point").hint("merge"), "d")
    rows = rows.select("h", "block", "d", "size", "kind", "point").repartition("h", "block").sortWithinPartitions("h", "block", "d")
    return written(rows.mapInArrow(_first_links(percent, groups, leaf), "a bigint, b bigint").distinct(), "pairs")


def other_pairs(at: DataFrame, roots: DataFrame, percent: int, groups: int, leaf: int, direct: int) -> DataFrame:
    """Candidate pairs of different components, from the trees of all rare tokens that more than one component holds.

    Tokens of the very same points (by their number and two 64-bit hashes of the set) would give one tree again and again; it is built once.
    """
    keys = _kinds(at, roots, F.col("rare"))
    mark = [F.bit_xor(F.xxhash64("d", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    mixed = keys.groupBy("h").agg(F.count("*").alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high"), *mark).where("low < high")
    mixed = mixed.groupBy("n", "m1", "m2").agg(F.min("h").alias("h")).select("h", "n")
    rows = keys.join(written(mixed, "mixed").hint("merge"), "h").withColumn("blocks", F.ceil(F.col("n") / direct).cast("bigint"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("d", "h"), F.col("blocks")))
    # a block is paired with itself (below 0) and with each other one
    own, n = F.col("block"), F.col("blocks")
    tiles = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda j: F.when(j == own, -1 - own).otherwise(F.least(j, own) * n + F.greatest(j, own)))
    rows = rows.select("h", F.explode(tiles).alias("tile"), "d", "kind", "block").join(at.select("d", "size", "point").hint("merge"), "d")
    rows = rows.select("h", "tile", "d", "size", "kind", "block", "point").repartition("h", "tile").sortWithinPartitions("h", "tile", "d")
    return written(rows.mapInArrow(_joined(percent, groups, leaf), "a bigint, b bigint").distinct(), "pairs")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, groups: int = GROUPS, buckets: int = BUCKETS, leaf: int = LEAF, direct: int = DIRECT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    at = points(docs, width, percent, groups, buckets)
    links, roots = [], None
    for _ in range(ROUNDS):
        links.append(verified(first_pairs(at, roots, percent, groups, leaf, direct), docs, at, width, percent))
        roots = components(reduce(DataFrame.union, links))
    links.append(verified(other_pairs(at, roots, percent, groups, leaf, direct), docs, at, width, percent))
    roots = components(reduce(DataFrame.union, links)).withColumnRenamed("node", "d")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key().alias("key"))
    least = own.groupBy("key").agg(F.min("doc_id").alias("least"))
    rooted = at.select("d", "key", "size").join(roots.hint("merge"), "d", "left").select("key", "size", F.coalesce("root", "d").alias("root"))
    rooted = written(rooted.join(least.hint("merge"), "key"), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(named.hint("merge"), "root").select("key", "size", "component_id"), "classes")
    return own.join(named.hint("merge"), "key", "left").select("doc_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(text_table(spark, sf_dir))
