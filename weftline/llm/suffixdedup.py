"""Suffix-array dedup: removes every byte covered by a 50-byte string that also starts in an earlier document.

Documents are written in chunks of a megabyte or more. Each 50-byte window has a minimiser (the leftmost least hash of
its 16-byte grams), which depends on the window's content only, so all copies of a string meet at one minimiser:

1. A window that begins REACH bytes or more before its minimiser holds the REACH bytes before it, any other one REACH + 1
   bytes after it. Every chunk sends the distinct hashes of its minimisers with those bytes (33 or 34 in all), packed, to the
   shard of the minimiser's hash; a shard answers which of them occur in more than one document. Only windows with
   such a hash go on. (16 bytes alone repeat by chance, and the more so the more text there is.)
2. Chunks send the segments around those minimisers, equal ones once, with the smallest and the largest document that has
   them in the chunk. Where they occur stays the chunk's: its places travel in one row that goes back to it unread.
3. A shard joins equal segments, orders their windows by Larsson-Sadakane refinement (ranks of h bytes give ranks of
   2h, and what is alone in its group is not sorted again), takes common prefixes of neighbours in that order with
   Kasai's carry-over, and so has the groups of equal 50-byte strings with the smallest document of each. It works in
   parts of bounded size; the parts' sorted windows are merged by binary search.
4. For each segment that a chunk sent it learns the smallest documents of the windows that an earlier document has too, and drops
   those windows at all its places.

Shards are as many as the text needs, each is a task of its own, equal segments and hashes of a chunk travel once, and rows are packed arrays.
A string in a third of all documents costs its shard one segment for each chunk, however often it occurs there.

Defined cases: null and empty texts have 0 bytes and the hash of nothing; texts under 50 bytes are kept; strings are
judged on the input; repeats inside one document stay; rows with a null doc_id, which no id is smaller than, keep all and remove nothing; rows of equal doc_id are equal in rank, so neither removes
the other's bytes; empty tables give no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import tasks, text_table, written
from weftline.llm.words import mixed, text_bytes

LENGTH, GRAM = 50, 16
#: Windows that begin so many bytes or more before their minimiser are known by the bytes before it, others by those after it.
REACH = (LENGTH - GRAM) // 2
#: Bytes of text in a chunk (a longer document is one chunk), and for each of which there is a shard, at least.
CHUNK, SHARD = 4 << 20, 16 << 20
#: The most bytes of a chunk, and the keys that a chunk should have for each shard: both grow with the text so that rows of
#: a chunk and a shard, of which there are chunks times shards, hold many keys (a key stands for about 17 bytes of text).
LARGEST_CHUNK, KEYS, KEY_BYTES = 64 << 20, 16, 17
#: Segment bytes that a shard orders at once; parts are merged by binary search.
PART = 8 << 20
#: Window starts and ranges that are worked on at once.
_BLOCK, _ROWS = 1 << 20, 1 << 14
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(kinds), 8)
    out, at = [], 8 * (len(kinds) + 1)
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """32-bit numbers as their first bytes, their second bytes and so on, which pack better; _numbers undoes it."""
    return np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4).T).ravel()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def sizes_for(total: int) -> tuple[int, int]:
    """Bytes of a chunk and of a shard for so many bytes of text: the least ones, until chunks times shards get too many."""
    both = KEYS * KEY_BYTES * total  # chunk times shard
    chunk = max(CHUNK, min(LARGEST_CHUNK, math.isqrt(both)))
    return chunk, max(SHARD, both // chunk)


def _chunks(chunk: int):
    """Rows (chunk_id, size, body): body has doc ids, byte lengths and bytes of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, sizes, parts, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal number, held
            body = _pack(np.array(ids, "<i8"), np.array(sizes, "<i8"), np.concatenate(parts))
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held], pa.int64()), pa.array([body], pa.binary())], names=["chunk_id", "size", "body"])
            number, held = number + 1, 0
            ids.clear(), sizes.clear(), parts.clear()
            return out

        for batch in batches:
            data, at = text_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for doc, s, e in zip(names, at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids.append(doc)
                sizes.append(e - s)
                parts.append(data[s:e].copy())
                held += e - s
                if held >= chunk or len(ids) >= 1 << 16:
                    yield row()
        if ids:
            yield row()

    return run


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    h = data.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < GRAM:
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ h[width:]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        width *= 2
    return h


def segments(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: first and last window start, row, and the minimiser's hash."""
    return _marked(data, sizes)[:4]


def _marked(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments, the first window start of each that is known by the bytes after its minimiser, and hashes of the minimiser
    with REACH bytes before it and with REACH + 1 after it (without meaning where no window of the segment holds them)."""
    span = LENGTH - GRAM + 1
    ends = np.cumsum(sizes)
    rows = np.flatnonzero(sizes >= LENGTH)
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(data) - LENGTH + 1, _BLOCK):
        hi = min(lo + _BLOCK, len(data) - LENGTH + 1)  # window starts
        h = _grams(data[lo : hi + LENGTH - 1])
        packed = (h >> np.uint64(23) << np.uint64(23)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            packed = np.minimum(packed[:-width], packed[width:])
            width *= 2
        if width < span:
            packed = np.minimum(packed[: width - span], packed[span - width :])
        spot = (packed & np.uint64((1 << 23) - 1)).astype(np.int64)  # of the minimiser of each window
        valid = np.zeros(hi - lo + 1, np.int32)
        first, last = ends[rows] - sizes[rows], ends[rows] - LENGTH
        some = (last >= lo) & (first < hi)
        np.add.at(valid, np.maximum(first[some], lo) - lo, 1)
        np.add.at(valid, np.minimum(last[some] + 1, hi) - lo, -1)
        valid = np.cumsum(valid)[:-1] > 0
        begin = valid.copy()
        begin[1:] &= (spot[1:] != spot[:-1]) | ~valid[:-1]
        begin[np.maximum(first[some], lo) - lo] = True
        stop = valid.copy()
        stop[:-1] &= begin[1:] | ~valid[1:]
        a, b = np.flatnonzero(begin), np.flatnonzero(stop)
        at = spot[a]
        own, odd = h[at], np.uint64(0x9E3779B97F4A7C15)
        before = (h[np.maximum(at - REACH, 0)] * odd ^ h[np.maximum(at - REACH + GRAM, 0)]) * odd ^ own
        after = (own * odd ^ h[np.minimum(at + GRAM, len(h) - 1)]) * odd ^ h[np.minimum(at + REACH + 1, len(h) - 1)]
        out.append((a + lo, b + lo, own, at - REACH + 1 + lo, before, after))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64)) + (np.zeros(0, np.uint64),) * 2
    a, b, h, turn, before, after = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b, np.searchsorted(ends, a, side="right"), h, turn, before, after


def _keys(data: np.ndarray, sizes: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """First and last window start, row and turn (see _marked) of segments, their shards, and the keys of their halves that have
    windows, first those before the turn, then the others, with the segment of each key: shard << 31, 30 bits of the hash, and
    which half it is. A chance meeting only makes a candidate."""
    a, b, row, h, turn, before, after = _marked(data, sizes)
    shard = ((mixed(h) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    left, right = np.flatnonzero(a < turn), np.flatnonzero(b >= turn)
    bits = np.uint64((1 << 31) - 2)
    keys = np.r_[shard[left] << np.uint64(31) | mixed(before[left]) & bits, shard[right] << np.uint64(31) | mixed(after[right]) & bits | np.uint64(1)]
    return a, b, row, turn, shard.astype(np.int64), keys, np.r_[left, right]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a rising array and where each one's run begins; the array's length ends the last one."""
    begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[begin].astype(np.int64), np.r_[begin, len(x)]


def _sent_hashes(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, sizes, data = _unpack(body, "<i8", "<i8", "u1")
                _, _, row, _, _, keys, of = _keys(data, sizes, shards)
                order = np.argsort(keys, kind="stable")  # rows rise within a key
                keys, row = keys[order], row[of[order]]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
                last = np.r_[first[1:], len(keys)] - 1
                many = row[first] != row[last] if len(keys) else np.zeros(0, bool)
                own = keys[first]
                values = (own & np.uint64((1 << 31) - 1)).astype("<u4")
                full, cuts = _runs(own >> np.uint64(31))
                blobs = [_pack(_planes(np.diff(values[a:b], prepend=np.uint32(0))), np.packbits(many[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), number), pa.int64()), pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk_id", "shard", "keys"])

    return run


def _repeated(group: pa.Table) -> pa.Table:
    """Of a shard's hashes, the bits of those that more than one document has, for each chunk."""
    parts = [_unpack(x, "u1", "u1") for x in group["keys"].to_pylist()]
    steps = [_numbers(p) for p, _ in parts]
    sizes = [len(p) for p in steps]
    many = np.concatenate([np.unpackbits(m, count=n) for (_, m), n in zip(parts, sizes, strict=True)]).astype(bool)
    _, inverse, counts = np.unique(np.concatenate([np.cumsum(p, dtype=np.uint32) for p in steps]), return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[inverse[many]] = True
    bits = np.split(twice[inverse], np.cumsum(sizes)[:-1])
    return pa.table({"chunk_id": group["chunk_id"], "shard": group["shard"], "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one after another; places are made for a block of ranges at a time."""
    out = np.empty(int(size.sum()), np.uint8)
    done = 0
    for i in range(0, len(start), _ROWS):
        n = size[i : i + _ROWS]
        ends = np.cumsum(n)
        total = int(ends[-1])
        out[done : done + total] = data[np.arange(total) + np.repeat(start[i : i + _ROWS] - (ends - n), n)]
        done += total
    return out


def _lanes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranges as rows of 64-bit numbers, filled up with zeros."""
    column = np.arange(2 * LENGTH - GRAM + 12)  # a range has at most 2 * LENGTH - GRAM bytes; a multiple of 8
    rows = data[np.minimum(start[:, None] + column, len(data) - 1)]
    rows[column >= size[:, None]] = 0
    return rows.view(np.uint64)


def distinct_ranges(data: np.ndarray, start: np.ndarray, size: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """For each range the place of a range with the same mark and the same bytes that stands for it (or itself)."""
    n = len(start)
    h = mixed(mark.astype(np.uint64) * np.uint64(256) + size.astype(np.uint64))
    for i in range(0, n, _ROWS):
        part = h[i : i + _ROWS]
        lanes = _lanes(data, start[i : i + _ROWS], size[i : i + _ROWS])
        for j in range(lanes.shape[1]):
            part = (part ^ lanes[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            part ^= part >> np.uint64(29)
        h[i : i + _ROWS] = part
    order = np.argsort(h, kind="stable")
    head = np.r_[True, h[order][1:] != h[order][:-1]][:n]
    of = np.empty(n, np.int64)
    of[order] = order[np.maximum.accumulate(np.where(head, np.arange(n), 0))]
    same = (size == size[of]) & (mark == mark[of])
    for i in range(0, n, _ROWS):
        o = of[i : i + _ROWS]
        same[i : i + _ROWS] &= (_lanes(data, start[i : i + _ROWS], size[i : i + _ROWS]) == _lanes(data, start[o], size[o])).all(axis=1)
    return np.where(same, of, np.arange(n))


def _sent_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk_id, shard, places, body): distinct segments of windows with a repeated hash for each shard, and one row of their
    places, which any shard may pass on."""
    for batch in batches:
        for body, number, answers, shards in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            ids, sizes, data = _unpack(body, "<i8", "<i8", "u1")
            if not answers:
                continue
            a, b, row, turn, shard, keys, owner = _keys(data, sizes, shards)
            kinds, inverse = np.unique(keys, return_inverse=True)
            full, cuts = _runs(kinds >> np.uint64(31))
            asked = dict(zip(full.tolist(), zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), strict=True))
            some = np.zeros(len(kinds), bool)
            for x in answers:
                i, j = asked[x["shard"]]
                some[i:j] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=j - i).astype(bool)
            left, right = np.zeros(len(a), bool), np.zeros(len(a), bool)
            known, after = some[inverse], (keys & np.uint64(1)).astype(bool)
            left[owner[known & ~after]], right[owner[known & after]] = True, True
            pick = np.flatnonzero(left | right)
            if not len(pick):
                continue
            a, b = np.where(left, a, np.maximum(a, turn)), np.where(right, b, np.minimum(b, turn - 1))
            a, size, row, shard = a[pick], (b - a + LENGTH)[pick], row[pick], shard[pick]
            order = np.argsort(shard, kind="stable")
            a, size, row, shard = a[order], size[order], row[order], shard[order]
            of = distinct_ranges(data, a, size, shard)
            mine = np.flatnonzero(of == np.arange(len(of)))
            nth = np.zeros(len(of), np.int64)
            nth[mine] = np.arange(len(mine))
            of, docs = nth[of], ids[row]
            by = np.argsort(of, kind="stable")
            begin = np.searchsorted(of[by], np.arange(len(mine)))
            low, high = np.minimum.reduceat(docs[by], begin), np.maximum.reduceat(docs[by], begin)
            full, cuts = _runs(shard[mine])
            bodies = [
                _pack(size[mine[i:j]].astype("u1"), _gathered(data, a[mine[i:j]], size[mine[i:j]]), np.diff(low[i:j], prepend=0).astype("<i8"), (high[i:j] - low[i:j]).astype("<i8"))
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
            ]
            order = np.argsort(a)
            places = _pack(full.astype("<i8"), cuts[:-1].astype("<i8"), _planes(np.diff(a[order], prepend=0)), _planes(of[order]))
            kinds = pa.array([False] * len(full) + [True])
            shard_ids = pa.array([*full.tolist(), number % shards], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(kinds), pa.int64()), shard_ids, kinds, pa.array([*bodies, places], pa.binary())], names=["chunk_id", "shard", "places", "body"])


def refined(data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement: the places with LENGTH bytes before their limit, in order of those bytes, and a label
    of each place (equal for equal bytes, rising in order). limit: where each place's segment ends."""
    n = len(data)
    left = (limit - np.arange(n)).astype(np.int32)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key |= wide[i : n + i]
    live = np.flatnonzero(left >= 8).astype(np.int32)
    key = key[live]
    order = np.argsort(key)
    live, key = live[order], key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    label = np.zeros(n, np.int32)
    label[live] = np.maximum.accumulate(np.where(head, np.arange(len(live), dtype=np.int32), 0))
    single = np.zeros(n, bool)
    single[live[head & np.r_[head[1:], True]]] = True
    del key, order, head
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        depth += step
        live = np.flatnonzero((left >= depth) & ~single).astype(np.int32)
        if not len(live):
            continue
        pair = label[live].astype(np.uint64) << np.uint64(32) | label[live + step].astype(np.uint64)
        order = np.argsort(pair)
        live, pair = live[order], pair[order]
        old = (pair >> np.uint64(32)).astype(np.int32)
        group = np.r_[True, old[1:] != old[:-1]]
        head = np.r_[True, pair[1:] != pair[:-1]]
        at = np.arange(len(live), dtype=np.int32)
        label = label.copy()
        label[live] = old + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        single[live[head & np.r_[head[1:], True]]] = True
    starts = np.flatnonzero(left >= LENGTH)
    return starts[np.argsort(label[starts], kind="stable")], label


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each ordered place with the one before it, up to LENGTH bytes.

    Kasai's carry-over: where a place and its neighbour are both one further than the place before and its neighbour, their
    prefix is one shorter than that pair's, and only the byte that comes in at the end is compared.
    """
    n = len(order)
    before = np.full(len(data) + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    place = np.sort(order)
    prior = before[place]
    follows = np.r_[False, (place[1:] == place[:-1] + 1) & (prior[1:] == prior[:-1] + 1)] & (prior >= 0)
    found = np.zeros(n, np.int64)
    fresh = np.flatnonzero(~follows & (prior >= 0))
    for i in range(0, len(fresh), 1 << 15):
        f = fresh[i : i + (1 << 15)]
        same = data[place[f][:, None] + np.arange(LENGTH)] == data[prior[f][:, None] + np.arange(LENGTH)]
        found[f] = np.where(same.all(axis=1), LENGTH, np.argmin(same, axis=1))
    run = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    gone = np.arange(n) - run
    f = np.flatnonzero(follows)
    comes = np.zeros(n, bool)
    comes[f] = data[place[f] + LENGTH - 1] == data[prior[f] + LENGTH - 1]
    for i in range(1, int(gone.max(initial=0)) + 1):
        todo = f[gone[f] == i]
        last = found[todo - 1]
        found[todo] = np.where(last == LENGTH, np.where(comes[todo], LENGTH, LENGTH - 1), last - 1)
        new = todo[last == 0]  # the byte that differed is gone: compared anew
        same = data[place[new][:, None] + np.arange(LENGTH)] == data[prior[new][:, None] + np.arange(LENGTH)]
        found[new] = np.where(same.all(axis=1), LENGTH, np.argmin(same, axis=1))
    out = np.zeros(len(data) + 1, np.int64)
    out[place] = found
    return out[order]


def least_documents(data: np.ndarray, size: np.ndarray, doc: np.ndarray, part: int = PART) -> np.ndarray:
    """For each window of the segments (of bytes size, smallest document doc), in order: the smallest document of all equal windows."""
    ends = np.cumsum(size)
    known, least = np.zeros(0, f"S{LENGTH}"), np.zeros(0, np.int64)
    own = []  # of each part: its sorted windows' strings, and which of them each window is
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + part, side="right")))
        base = ends[i] - size[i]
        text = data[base : ends[j - 1]]
        limit = np.repeat(ends[i:j] - base, size[i:j])
        order, _ = refined(text, limit)
        head = common_prefixes(text, order) < LENGTH
        seg_doc = np.repeat(doc[i:j], size[i:j])
        mine = np.minimum.reduceat(seg_doc[order], np.flatnonzero(head))
        group = np.empty(len(text), np.int64)
        group[order] = np.cumsum(head) - 1
        group = group[np.sort(order)]
        if i == 0 and j == len(size):
            return mine[group]
        strings = np.ascontiguousarray(text[order[head][:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel()
        own.append((strings, group))
        # the sorted windows of this part meet the others' by binary search
        at = np.searchsorted(known, strings)
        met = at < len(known)
        met[met] = known[at[met]] == strings[met]
        least[at[met]] = np.minimum(least[at[met]], mine[met])
        known, least = np.insert(known, at[~met], strings[~met]), np.insert(least, at[~met], mine[~met])
        i = j
    return np.concatenate([least[np.searchsorted(known, strings)][group] for strings, group in own]) if own else np.zeros(0, np.int64)


def _earlier(group: pa.Table) -> pa.Table:
    """Of a shard's segments, for each chunk, the runs of windows that a document before the chunk's last one has too, with the
    smallest such document."""
    cols = [_unpack(x, "u1", "u1", "<i8", "<i8") for x in group["body"].to_pylist()]
    sizes, data, low, more = (np.concatenate(x) for x in zip(*((n, text, np.cumsum(steps), up) for n, text, steps, up in cols), strict=True))
    sizes, high = sizes.astype(np.int64), low + more
    sent = np.array([len(c[0]) for c in cols])
    chunk, first_of = np.repeat(np.arange(len(cols)), sent), np.cumsum(sent) - sent
    starts = np.cumsum(sizes) - sizes
    same = distinct_ranges(data, starts, sizes, np.zeros(len(sizes), np.int64))
    own = np.flatnonzero(same == np.arange(len(same)))
    number = np.zeros(len(same), np.int64)
    number[own] = np.arange(len(own))
    of = number[same]
    by = np.argsort(of, kind="stable")
    smallest = np.minimum.reduceat(low[by], np.searchsorted(of[by], np.arange(len(own))))
    least = least_documents(_gathered(data, starts[own], sizes[own]), sizes[own], smallest)
    windows = sizes[own] - LENGTH + 1
    base = np.cumsum(windows) - windows
    out: list[tuple[np.ndarray, ...]] = []
    step = 1 << 16
    for i in range(0, len(of), step):
        o, n = of[i : i + step], windows[of[i : i + step]]
        shift = np.cumsum(n) - n
        offset = np.arange(int(n.sum())) - np.repeat(shift, n)
        best = least[np.repeat(base[o], n) + offset]
        gone = best < np.repeat(high[i : i + step], n)
        begin, stop = gone.copy(), gone.copy()
        begin[1:] &= ~gone[:-1] | (offset[1:] == 0) | (best[1:] != best[:-1])
        stop[:-1] &= ~gone[1:] | (offset[1:] == 0) | (best[1:] != best[:-1])
        out.append((i + np.repeat(np.arange(len(o)), n)[begin], offset[begin], offset[stop], best[begin]))
    segment, first, last, best = (np.concatenate(x) for x in zip(*out, strict=True))
    at = chunk[segment]
    segment -= first_of[at]
    cuts = np.searchsorted(at, np.arange(len(cols) + 1))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    blobs = [_pack(*(x[cuts[c] : cuts[c + 1]].astype(kind) for x, kind in ((segment, "<u4"), (first, "u1"), (last, "u1"), (best, "<i8")))) for c in full]
    return pa.table({"chunk_id": group["chunk_id"].take(pa.array(full, pa.int64())), "shard": group["shard"].take(pa.array(full, pa.int64())), "body": pa.array(blobs, pa.binary())})


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's answers; rows of places pass, with shard -1."""
    names, rows = ["chunk_id", "shard", "body"], []
    for batch in batches:
        places = batch.column("places")
        passed = batch.filter(places)
        yield pa.RecordBatch.from_arrays([passed.column("chunk_id"), pa.array(np.full(passed.num_rows, -1), pa.int64()), passed.column("body")], names=names)
        rows.append(batch.filter(pc.invert(places)).select(names))
    group = pa.Table.from_batches(rows) if rows else None
    if group is not None and group.num_rows:
        yield from _earlier(group).to_batches()


def _gone(ids: np.ndarray, sizes: np.ndarray, answers: list) -> np.ndarray:
    """Of a chunk's bytes, which are covered by a string that an earlier document has; answers as (shard, body)."""
    depth = np.zeros(int(sizes.sum()) + 1, np.int32)
    shards, base, steps, of = next((_unpack(x["body"], "<i8", "<i8", "u1", "u1") for x in answers if x["shard"] < 0), [np.zeros(0, np.int64)] * 4)
    base = dict(zip(shards.tolist(), base.tolist(), strict=True))
    parts = [(base[x["shard"]] + cols[0], *cols[1:]) for x in answers if x["shard"] >= 0 for cols in [_unpack(x["body"], "<u4", "u1", "u1", "<i8")]]
    if not parts:
        return depth[:-1] > 0
    segment, first, last, best = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
    order = np.argsort(segment, kind="stable")
    segment, first, last, best = segment[order], first[order], last[order], best[order]
    start, of = np.cumsum(_numbers(steps), dtype=np.int64), _numbers(of).astype(np.int64)
    runs, at = np.searchsorted(segment, of, side="right") - np.searchsorted(segment, of), np.searchsorted(segment, of)
    doc = ids[np.searchsorted(np.cumsum(sizes), start, side="right")]
    for i in range(0, len(of), _ROWS):
        n = runs[i : i + _ROWS]
        ends = np.cumsum(n)
        run = np.arange(int(ends[-1])) + np.repeat(at[i : i + _ROWS] - (ends - n), n)
        early = best[run] < np.repeat(doc[i : i + _ROWS], n)
        run, place = run[early], np.repeat(start[i : i + _ROWS], n)[early]
        np.add.at(depth, place + first[run], 1)
        np.add.at(depth, place + last[run] + LENGTH, -1)
    return np.cumsum(depth, dtype=np.int32)[:-1] > 0


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, sizes, data = _unpack(body, "<i8", "<i8", "u1")
                gone = _gone(ids, sizes, answers or [])
                ends = np.cumsum(sizes)
                fresh = gone.copy()
                fresh[1:] &= ~gone[:-1]
                inner = (ends - sizes)[sizes > 0]
                fresh[inner] = gone[inner]  # a run ends with its document
                removed, spans = (np.r_[np.int32(0), np.cumsum(x, dtype=np.int32)] for x in (gone, fresh))
                left = data[~gone].tobytes()
                cut = np.r_[0, ends] - removed[np.r_[0, ends]]
                texts = [left[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                cols = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed[ends] - removed[ends - sizes], pa.int64()), pa.array(spans[ends] - spans[ends - sizes], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                names = [x.split()[0] for x in RESULT.split(", ")]
                if with_text:
                    cols, names = [*cols, pa.array(texts, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _of_shard(work):
    """work on all rows of a task, which are those of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from work(pa.Table.from_batches(rows)).to_batches()

    return run


def _untouched(docs: DataFrame, with_text: bool) -> DataFrame:
    """The results of rows that keep all their bytes."""
    text, none = F.coalesce("text", F.lit("")), F.lit(0).cast("bigint")
    result = (F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return docs.select(*result, *([F.encode(text, "UTF-8").alias("kept")] if with_text else []))


def deduped(docs: DataFrame, with_text: bool = False, shards: int | None = None) -> DataFrame:
    """Per document its bytes, removed bytes, maximal removed runs and the hash of what is kept (and with_text, the bytes kept)."""
    nameless, docs = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    return _deduped(docs, with_text, shards).unionByName(_untouched(nameless, with_text))


def _deduped(docs: DataFrame, with_text: bool, shards: int | None) -> DataFrame:
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunk, shard = sizes_for(total)
    chunks = written(docs.select("doc_id", "text").mapInArrow(_chunks(chunk), "chunk_id bigint, size bigint, body binary"), "chunks")
    shards = shards or max(2 * tasks(spark), -(-total // shard))
    hashes = chunks.select("chunk_id", "body").mapInArrow(_sent_hashes(shards), "chunk_id bigint, shard bigint, keys binary")
    bits = hashes.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(_of_shard(_repeated), "chunk_id bigint, shard bigint, bits binary")
    answers = bits.groupBy("chunk_id").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))
    # both joins are left ones: so both read one exchange of the chunks, which an inner join's filter would make two
    asked = chunks.select("chunk_id", "body").join(answers.hint("merge"), "chunk_id", "left").select("body", "chunk_id", "answers", F.lit(shards).alias("shards"))
    parts = asked.mapInArrow(_sent_segments, "chunk_id bigint, shard bigint, places boolean, body binary")
    earlier = parts.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(_answered, "chunk_id bigint, shard bigint, body binary")
    gone = earlier.groupBy("chunk_id").agg(F.collect_list(F.struct("shard", "body")).alias("answers"))
    back = chunks.select("chunk_id", "body").join(gone.hint("merge"), "chunk_id", "left").select("body", "answers")
    return back.mapInArrow(_kept(with_text), RESULT + (", kept binary" if with_text else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(text_table(spark, sf_dir))
