"""Word and shingle hashes of whole Arrow columns of text in numpy, without a Python loop over words.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r; A-Z are lower-cased. A word's hash is a
polynomial of its bytes, read off prefix sums modulo 2**64. Hashes only find candidates: callers verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of text that are hashed at once; a longer text is taken alone.
CHUNK = 2 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows there (nulls are empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_ODD, -1, 1 << 64)
            for name, base in (("up", _ODD), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the rows data[at[i]:at[i + 1]], and the row of each."""
    base = at[0]
    data = data[base : at[-1]]
    at = at - base
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers.to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[e] - sums[s]) * down[s]), np.searchsorted(at, s, side="right") - 1


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of width-word shingles with their rows; a row of fewer words has one shingle, all its words."""
    if not len(words):
        return words, rows
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    sizes = np.diff(np.r_[first, len(rows)])
    n = len(words) - width + 1
    if n > 0:
        h = words[:n].copy()
        for i in range(1, width):
            h = h * np.uint64(_ODD) + words[i : i + n]
        whole = rows[:n] == rows[width - 1 :]
        h, r = mixed(h[whole]), rows[:n][whole]
    else:
        h, r = np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    short = np.flatnonzero(sizes < width)
    if len(short):
        more = []
        for f, k in zip(first[short].tolist(), sizes[short].tolist(), strict=True):
            x = int(k)
            for v in words[f : f + k].tolist():
                x = (x * _ODD + v) & 0xFFFFFFFFFFFFFFFF
            more.append(x)
        h, r = np.r_[h, mixed(np.array(more, np.uint64))], np.r_[r, rows[first[short]]]
    return h, r


def shingles_of(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingle hashes and row numbers of a text column, in chunks of whole rows."""
    data, at = text_bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        w, r = word_hashes(data, at[i : j + 1])
        h, r = shingle_hashes(w, r, width)
        yield h, r + i
        i = j


def shingle_set(text: str | None, width: int) -> set[bytes]:
    """The exact shingles of a text, as the hashes have them."""
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
