"""Packing: documents cut into token pieces, pieces packed into near-equal windows by multiway differencing.

One pass over the documents without a shuffle. Each task tokenises its rows, cuts every document into whole windows and a
remainder, the remainder into pieces of at most PIECE ids, and packs the pieces in lots of a bounded number: the
Karmarkar-Karp heap merges the two partial partitions of largest imbalance with opposing order. It begins with the fewest
windows that could hold a lot, and the number of windows rises by one while the fullest exceeds the capacity.

Ids come from the byte-level BPE vocabulary. tiktoken reads the same ranks and gives the same ids as the
tokenizers file at about six times its speed; the tests hold one against the other. That file's added tokens
(<|endoftext|>) are matched inside a text, as the tokenizers library does.

Defined cases: a null or empty text gives the closing id only; a null doc_id stays null and its pieces are packed like others; very long texts give many whole windows;
repeated rows are packed one by one; no rows give no rows. Sequence ids hold the task's number in the high
bits, so they are unique, and the same after a task is run again. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import text_table

CAPACITY = 1024
#: Ids of a piece of a remainder, at most: of pieces of up to a quarter of a window, near-equal windows fit with little to spare.
PIECE = 256
#: Pieces that are differenced together.
LOT = 1024
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def added_tokens(json_path: str) -> dict[str, int]:
    """The ids of a tokenizers file's added tokens. Only tokens taken as they are spelled are known here."""
    with open(json_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t[flag] for t in found for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("an added token takes white space or whole words only")
    return {t["content"]: t["id"] for t in found}


def encoder(ranks_path: str, pattern: str, added: dict[str, int] | None = None):
    """The vocabulary's encoder; encode with allowed_special="all" gives the added tokens in a text their ids."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})


def differenced(sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[int], dict[int, tuple[int, int]]]:
    """k-way Karmarkar-Karp: the k loads, the node of each, and the tree of merged nodes (leaves: positions in sizes).

    A partial partition keeps its non-zero loads in falling order; its imbalance is the largest less the
    smallest of the k. Two are merged by adding the one's largest to the other's smallest loads.
    """
    tree: dict[int, tuple[int, int]] = {}
    heap = [(-int(s), i, np.array([s], np.int64), [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)  # slots where loads of the two meet
        free, taken = len(a) - both, len(b) - both
        loads = np.concatenate([a[:free], a[free:] + b[taken:][::-1], b[:taken]])
        nodes = x[:free]
        for p, q in zip(x[free:], y[taken:][::-1], strict=True):
            tree[fresh] = (p, q)
            nodes.append(fresh)
            fresh += 1
        nodes += y[:taken]
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        least = int(loads[-1]) if len(loads) == k else 0
        heapq.heappush(heap, (least - int(loads[0]), fresh, loads, [nodes[i] for i in order]))
        fresh += 1
    return heap[0][2], heap[0][3], tree


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The positions in sizes of each window's pieces: windows near-equal in load, none over the capacity, as few as differencing fits."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece is larger than a window")
    items = np.asarray(sizes, np.int64)
    k = -(-int(items.sum()) // capacity)
    while (tried := differenced(items, k))[0][0] > capacity:  # ends: with a window for each piece all fit
        k += 1
    _, nodes, tree = tried
    out = []
    for node in nodes:
        leaves, stack = [], [node]
        while stack:
            n = stack.pop()
            if n in tree:
                stack += tree[n]
            else:
                leaves.append(n)
        out.append(leaves)
    return out


def _task(ranks_path: str, pattern: str, end_id: int, added: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern, added)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        sequence = TaskContext.get().partitionId() << 36
        lot: list[tuple[int | None, int, np.ndarray, int]] = []  # document, start, ids of the piece, tokens of the document
        done: list[tuple[int | None, int, int, int, int, int, int]] = []

        def emit() -> pa.RecordBatch:
            docs = pa.array([r[0] for r in done], pa.int64())
            rows = np.array([r[1:] for r in done], np.int64).reshape(-1, len(names) - 1)
            done.clear()
            return pa.RecordBatch.from_arrays([docs, *(pa.array(rows[:, i]) for i in range(len(names) - 1))], names=names)

        def pack() -> None:
            nonlocal sequence
            for members in windows([len(p[2]) for p in lot]):
                offset = 0
                for m in members:
                    doc, start, ids, n = lot[m]
                    done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset))
                    offset += len(ids)
                sequence += 1
            lot.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(enc.encode_to_numpy(text, allowed_special="all"), np.uint32(end_id)).astype("<u4") if text else np.array([end_id], "<u4")
                n = len(ids)
                whole = n // CAPACITY * CAPACITY
                for start in range(0, whole, CAPACITY):
                    done.append((doc, start, CAPACITY, zlib.crc32(ids[start : start + CAPACITY].tobytes()), n, sequence, 0))
                    sequence += 1
                for start in range(whole, n, PIECE):
                    lot.append((doc, start, ids[start : start + PIECE].copy(), n))
                    if len(lot) == LOT:
                        pack()
                if len(done) >= 20_000:
                    yield emit()
        pack()
        if done:
            yield emit()

    return run


def packed(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 0, added: dict[str, int] | None = None) -> DataFrame:
    """A row per piece of docs (doc_id, text), with its sequence and its place there. Ranks of one's own come with their added tokens."""
    if ranks_path is None or pattern is None:
        import public_tokenizers

        if ranks_path is None and added is None:
            added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return docs.select("doc_id", "text").mapInArrow(_task(ranks_path, pattern, end_id, added or {}), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(text_table(spark, sf_dir))
