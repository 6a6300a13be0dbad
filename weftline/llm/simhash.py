"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint of four-word shingles per document; fingerprints link at 4 or fewer differing bits and the
components of the links are the groups. The search runs over distinct fingerprints:

1. Bits that correlate (in a bounded sample of fingerprints) go to the same partition, so that the partitions
   are as independent of each other as can be.
2. Dynamic programming gives each partition its own threshold, or none, at the least estimated cost (key rows to
   shuffle and candidate pairs, from the sample's distances scaled to all fingerprints), with the thresholds plus
   one summing to the allowed distance plus one. So a pair within the distance is within the threshold of at
   least one partition, and no pair is lost whatever the sample says.
3. Probing: a partition of b bits and threshold t has a key for each choice of t masked bits; fingerprints that
   differ in at most t bits there share one of them. Keys are shuffled, and tasks compare what shares a key.
4. A key with very many fingerprints is dealt again by parts of all 64 bits, of which two within the distance
   share at least one, and what is still large again by other parts.

Tasks verify the distances and give links of a spanning forest, never all pairs of a group.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other; texts under four words
have one shingle, all their words; equal texts share a fingerprint and so a group; rows of one doc_id are one document
if they have the same text, and several if not, so representatives keeps one text of a group whatever ids its rows share; null
ids come before others; empty tables give no rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, text_table, written
from weftline.llm.components import components

BITS, DISTANCE, WIDTH, SEED = 64, 4, 4, 42
#: Fingerprints that the plan is estimated on; what it finds changes the cost only, not the result.
SAMPLE = 2000
#: Relative costs of a key row that is shuffled and of a pair that is compared.
ROW_COST, PAIR_COST = 1e-6, 4e-9
#: Fingerprints of one key that are compared directly; beyond, the key is dealt again.
DIRECT = 2048
#: How often a key is dealt again at most; what is larger then is compared all the same.
LEVELS = 6


def fingerprint_of(words: list[bytes], width: int = WIDTH) -> int:
    """The bits that are set in over half of the shingles' hashes."""
    import xxhash

    if not words:
        return 0
    n = len(words) - width + 1
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends, strict=False)), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        votes += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint_of((t.as_py() or "").encode().lower().split()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp holds the 64 bits as a signed long; text_hash tells rows of one doc_id apart."""
    return docs.select("doc_id", "text", _text_hash().alias("text_hash")).mapInArrow(_fingerprints, "doc_id bigint, text_hash bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def correlated_parts(sample: np.ndarray, m: int) -> list[int]:
    """m masks of near-equal size that part the bits, correlated bits together."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(axis=0) if len(bits) else np.zeros(BITS)
    like = np.zeros((BITS, BITS))
    if len(bits) > 1:
        z = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
        like = np.abs(z.T @ z) / len(bits)
    like[spread == 0] = like[:, spread == 0] = 1  # constant bits tell nothing; they go together
    np.fill_diagonal(like, 0)
    left, masks = list(range(BITS)), []
    for i in range(m):
        part = [max(left, key=lambda b: like[b, left].sum())]
        left.remove(part[0])
        while len(part) < BITS // m + (i < BITS % m):
            nxt = max(left, key=lambda b: like[b, part].sum())
            part.append(nxt)
            left.remove(nxt)
        masks.append(sum(1 << b for b in part))
    return masks


def plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold) of each probed partition, at the least estimated cost over the numbers of partitions."""
    total = max(total, 100_000)  # few fingerprints must not make many keys look free
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    pairs = np.triu_indices(len(sample), 1)
    apart = sample[pairs[0]] ^ sample[pairs[1]]
    scale = (total * total / 2) / max(1, len(apart))
    for m in range(1, distance + 2):
        masks = correlated_parts(sample, m)
        cost = []
        for mask in masks:
            b = mask.bit_count()
            seen = np.bincount(np.bitwise_count(apart & np.uint64(mask)), minlength=BITS + 1) * scale
            even = np.array([comb(b, k) / 2.0**b for k in range(distance + 1)]) * total * total / 2
            near = np.maximum(seen[: distance + 1], even)
            cost.append([0.0] + [total * comb(b, t) * ROW_COST + sum(near[k] * comb(b - k, t - k) for k in range(t + 1)) * PAIR_COST for t in range(distance + 1)])
        # state: pigeons (threshold + 1) dealt so far -> least cost, thresholds plus one
        state = {0: (0.0, [])}
        for c in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (x, t) in state.items():
                for more in range(distance + 2 - used):
                    y = (x + c[more], [*t, more])
                    if used + more not in nxt or y[0] < nxt[used + more][0]:
                        nxt[used + more] = y
            state = nxt
        x, dealt = state[distance + 1]
        if x < best[0]:
            best = (x, [(mask, p - 1) for mask, p in zip(masks, dealt, strict=True) if p])
    return best[1]


def key_masks(parts: list[tuple[int, int]]) -> list[int]:
    """The masks of all probing keys: each partition less each choice of threshold bits."""
    out = []
    for mask, t in parts:
        bits = [b for b in range(BITS) if mask >> b & 1]
        out += [mask - sum(1 << b for b in gone) for gone in combinations(bits, t)]
    return out


def _keys(fp: Column, masks: list[int]) -> Column:
    """(kind, part) for each mask; the masks are one folded array, so hundreds of them don't grow the plan."""
    folded = F.expr("array(" + ", ".join(f"bigint('{_signed(m)}')" for m in masks) + ")")
    return F.transform(folded, lambda m, i: F.struct(i.alias("kind"), fp.bitwiseAND(m).alias("part")))


class _Forest:
    """Union-find over fingerprints, giving each node's smallest known root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, r = self.up, x
        while up.get(r, r) != r:
            r = up[r]
        while up.get(x, x) != r:
            up[x], x = r, up[x]
        return r

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.up.setdefault(min(x, y), min(x, y))

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def _compare(group: np.ndarray, fps: np.ndarray, forest: _Forest, distance: int, small: int = 32) -> None:
    """Links fingerprints of equal group numbers (sorted) within the distance."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(group)])
    keep = np.repeat(sizes <= small, sizes)
    g, v = group[keep], fps[keep]
    for d in range(1, small):
        same = g[:-d] == g[d:] if d < len(g) else np.zeros(0, bool)
        if not same.any():
            break
        x, y = v[:-d][same], v[d:][same]
        close = np.bitwise_count(x ^ y) <= distance
        for p, q in zip(x[close].tolist(), y[close].tolist(), strict=True):
            forest.link(p, q)
    for f, n in zip(first[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        left = fps[f : f + n]
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                x = front.pop()
                close = np.bitwise_count(left ^ x) <= distance
                if close.any():
                    new, left = left[close], left[~close]
                    for y in new.tolist():
                        forest.link(int(x), y)
                    front += list(new)


def _linker(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        forest = _Forest()

        def emit() -> pa.RecordBatch:
            rows = np.array(forest.stars(), np.uint64).reshape(-1, 2)
            forest.up.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy().view(np.int64)), pa.array(rows[:, 1].copy().view(np.int64))], names=["a", "b"])

        def compare(kind: np.ndarray, part: np.ndarray, fps: np.ndarray) -> None:
            if len(fps):
                fresh = np.r_[False, (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])]
                _compare(np.cumsum(fresh), fps, forest, distance)

        for batch in batches:
            cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cols = (cols[0], cols[1], cols[2].view(np.uint64))
            if rest is not None:
                cols = tuple(np.r_[a, b] for a, b in zip(rest, cols, strict=True))
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            compare(*(c[:cut] for c in cols))
            rest = tuple(c[cut:] for c in cols)
            if len(forest.up) > 200_000:
                yield emit()
        if rest is not None:
            compare(*rest)
        yield emit()

    return run


def _finer(level: int, distance: int) -> list[int]:
    """Masks that part all bits, in another way for each level."""
    order = np.random.default_rng(level).permutation(BITS) if level else np.arange(BITS)
    return [sum(1 << int(b) for b in x) for x in np.array_split(order, distance + 1)]


def _dealt(keys: DataFrame, distance: int, direct: int) -> DataFrame:
    """keys (kind, part, fp) with the rows of keys of more than direct rows dealt again, until there are none or LEVELS is reached."""
    for level in range(LEVELS):
        hot = written(keys.groupBy("kind", "part").count().where(F.col("count") > direct).select("kind", "part"), "hot")
        if hot.isEmpty():
            break
        marked = keys.join(hot.withColumn("hot", F.lit(True)).hint("merge"), ["kind", "part"], "left")
        plain = F.array(F.struct("kind", "part"))
        # the parts of all bits are exact pigeonholes on their own; the first key stays in the hash of the second
        split = F.array(*[F.struct(F.xxhash64("kind", "part", F.lit(i)).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("part")) for i, m in enumerate(_finer(level, distance))])
        dealt = marked.select("fp", F.explode(F.when(F.col("hot"), split).otherwise(plain)).alias("k")).select(F.col("k.kind").alias("kind"), F.col("k.part").alias("part"), "fp")
        keys = written(dealt, "keys")
    return keys


def links(fps: DataFrame, distance: int = DISTANCE, direct: int = DIRECT, parts: list[tuple[int, int]] | None = None) -> DataFrame:
    """(a, b): forest links that join all fingerprints (distinct, column fp) within the distance, and no others."""
    if parts is None:
        sample = [r["fp"] for r in bounded_sample(fps.select("fp"), ["fp"], SAMPLE).collect()]
        parts = plan(np.array(sample, np.int64).view(np.uint64), fps.count(), distance)
    masks = key_masks(parts)
    keys = fps.select("fp", F.explode(_keys(F.col("fp"), masks)).alias("k")).select(F.col("k.kind").alias("kind"), F.col("k.part").alias("part"), "fp")
    keys = _dealt(keys.withColumn("kind", F.col("kind").cast("bigint")), distance, direct)
    return keys.repartition("kind", "part").sortWithinPartitions("kind", "part", "fp").mapInArrow(_linker(distance), "a bigint, b bigint")


def grouped(docs: DataFrame, distance: int = DISTANCE, **options) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): root is a fingerprint per group, component_id the smallest doc_id that links reach."""
    own = written(fingerprints(docs), "fingerprints")
    fps = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps, distance, **options))
    rooted = fps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(least.hint("merge"), "root").select("fp", "root", "component_id"), "named")
    return own.join(named.hint("merge"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group: the one of the smallest doc_id, then text hash."""
    first = grouped(docs, **options).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    kept = first.select(F.col("r.doc_id").alias("_doc"), F.col("r.text_hash").alias("_mark"))
    own = docs.select(F.struct(*docs.columns).alias("_own"), F.col("doc_id").alias("_id"), _text_hash().alias("_text_hash"))
    return own.join(kept.hint("merge"), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_mark")), "left_semi").select("_own.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = grouped(text_table(spark, sf_dir))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
