"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the power of two of their number of distinct five-word shingles. An item's
signature is a bottom-k MinHash: its k smallest shingle hashes, with k set for its size partition so that a
document holding the required share of the item's shingles must hold at least one of the k (k exceeds what
may be missing of the partition's largest item). Documents of any length are probed with their shingles
against the signatures, so a short item in a very long text is found with certainty, and every candidate
is verified by the exact shingles of both texts.

A benchmark of up to MAX_SHINGLES words (counted first, so an upper bound of its shingles) and MAX_BYTES bytes is sent to every task as packed
arrays, and documents are read once without a shuffle; a task spells out an item's shingles when a document meets its
signature. A larger one is joined: signatures with document shingles on the hash, the candidates' shared hashes are
counted, and pairs that have enough of them meet both texts. Both ways give the same rows.

Defined cases: null or empty texts and items have no shingles and match nothing; a text of fewer than five
words has one shingle, all its words; items are judged row by row, so rows of equal item_id but other texts, and repeated
documents and items, give a row for each pair of rows that match; rows with a null id are judged like others; empty tables
give no rows; other input columns are ignored. In cleaned a row goes if its own text holds an item, whatever other rows
have its doc_id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import WHITE, table, text_table, written
from weftline.llm.words import shingle_set, shingles_of

WIDTH = 5
SHARE = 0.8
#: Words and bytes of a benchmark that may be sent to every task; beyond either the search is a shuffled join.
MAX_SHINGLES, MAX_BYTES = 2_000_000, 32 << 20
PAIRS = "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint, containment double"
#: Pairs with the hash of the document's text.
_FOUND = "doc_id bigint, _text_hash bigint, item_id bigint, n_shingles bigint, n_shared bigint"


def _hashes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for h, r in shingles_of(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array(h.view(np.int64))], names=["id", "h"])

    return run


def signatures(items: DataFrame, width: int, share: float) -> DataFrame:
    """(h, n): the bottom-k hashes of each item (columns _n and text), k by its size partition."""
    hashes = items.select("_n", "text").mapInArrow(_hashes(width), "id bigint, h bigint").distinct()
    sized = hashes.withColumn("size", F.count("*").over(Window.partitionBy("id"))).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("h")))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("size")) + 1) - 1
    return sized.where(F.col("place") <= F.floor((1 - share) * largest + 1e-9) + 1).select("h", F.col("id").alias("_n"))


def _shared(item: set[bytes], doc: set[bytes], share: float) -> tuple[int, int] | None:
    both = len(item & doc)
    return (len(item), both) if item and both >= share * len(item) - 1e-9 else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in _FOUND.split(", ")])


def _search(sent, width: int, share: float):
    """Probes the documents of a task with the signatures sent to it, and verifies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, names, texts = sent.value  # hashes in order, the item's place of each, and the items' ids and texts
        items: dict[int, set[bytes]] = {}
        some = np.zeros(1 << 20, bool)
        some[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            ids, marks, out = batch.column(0), batch.column(2), []
            for h, r in shingles_of(batch.column(1), width):
                near = np.flatnonzero(some[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                h, r = h[near], r[near]
                lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                wanted = defaultdict(set)
                for a, b, row in zip(lo.tolist(), hi.tolist(), r.tolist(), strict=True):
                    if b > a:
                        wanted[row].update(owners[a:b].tolist())
                for row, found in wanted.items():
                    doc = shingle_set(batch.column(1)[row].as_py(), width)
                    for n in sorted(found):
                        if n not in items:
                            items[n] = shingle_set(texts[n].as_py(), width)
                        if got := _shared(items[n], doc, share):
                            out.append((ids[row].as_py(), marks[row].as_py(), names[n].as_py(), *got))
            if out:
                yield _batch(out)

    return run


def _verify(width: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, mark, item, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if got := _shared(shingle_set(wanted, width), shingle_set(text, width), share):
                    out.append((doc, mark, item, *got))
            if out:
                yield _batch(out)

    return run


def n_words(text: str) -> Column:
    return F.size(F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, " " * len(WHITE)), " "), lambda w: w != ""))


def _numbered(items: DataFrame) -> DataFrame:
    """The items with a number each, written so that it never changes."""
    return written(items.select("item_id", "text").withColumn("_n", F.monotonically_increasing_id()), "items")


def _matches(docs: DataFrame, items: DataFrame, width: int, share: float, max_shingles: int) -> DataFrame:
    """Rows of _FOUND; items: item_id, text and the number _n."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"))
    size = items.agg(F.coalesce(F.sum(n_words("text")), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    keys = signatures(items, width, share)
    if size["words"] <= max_shingles and size["bytes"] <= MAX_BYTES:
        # no more hashes than the benchmark has words, and its texts: bounded by max_shingles and MAX_BYTES
        found = keys.toArrow().combine_chunks()
        h, own = found["h"].to_numpy().view(np.uint64), items.toArrow().sort_by("_n").combine_chunks()
        order = np.argsort(h, kind="stable")
        owners = np.searchsorted(own["_n"].to_numpy(), found["_n"].to_numpy()[order])
        sent = docs.sparkSession.sparkContext.broadcast((h[order], owners, own["item_id"].combine_chunks(), own["text"].combine_chunks()))
        return docs.mapInArrow(_search(sent, width, share), _FOUND)
    # a row's own number ties its shingles to it; the table is written so that the number stays
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
    hashes = written(rows.select("_row", "text").mapInArrow(_hashes(width), "id bigint, h bigint").distinct(), "hashes")
    pairs = hashes.join(keys.hint("merge"), "h").select("id", "_n").distinct()
    all_hashes = written(items.select("_n", "text").mapInArrow(_hashes(width), "id bigint, h bigint").distinct().select(F.col("id").alias("_n"), "h"), "item_hashes")
    sizes = all_hashes.groupBy("_n").agg(F.count("*").alias("size"))
    wanted = pairs.join(all_hashes.hint("merge"), "_n").join(hashes.hint("merge"), ["id", "h"]).groupBy("id", "_n").agg(F.count("*").alias("shared"))
    near = wanted.join(sizes.hint("merge"), "_n").where(F.col("shared") >= share * F.col("size") - 1e-9).select(F.col("id").alias("_row"), "_n")
    both = near.join(rows.hint("merge"), "_row").join(items.select("_n", "item_id", F.col("text").alias("wanted")).hint("merge"), "_n")
    return both.select("doc_id", "_text_hash", "item_id", "text", "wanted").mapInArrow(_verify(width, share), _FOUND)


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds at least share of the item's shingles."""
    found = _matches(docs, _numbered(items), width, share, max_shingles)
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def cleaned(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """docs without the rows whose text holds a benchmark item."""
    found = _matches(docs, _numbered(items), width, share, max_shingles).select(F.col("doc_id").alias("_doc"), F.col("_text_hash").alias("_mark")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("_own"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    return own.join(found.hint("merge"), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_mark")), "left_anti").select("_own.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(text_table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
items AS (SELECT item_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM benchmark),
ds AS (SELECT DISTINCT id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 3, 2)::BIGINT)) AS i FROM docs WHERE len(ws) > 0)),
bs AS (SELECT DISTINCT id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 3, 2)::BIGINT)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
shared AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n FROM ds JOIN bs ON ds.s = bs.s GROUP BY ALL)
SELECT doc_id, item_id, sizes.n AS n_shingles, shared.n AS n_shared, shared.n / sizes.n AS containment
FROM shared JOIN sizes ON shared.item_id = sizes.id WHERE shared.n >= 0.8 * sizes.n - 1e-9
"""
