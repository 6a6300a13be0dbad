"""Fill-in-the-middle transformation: a wavelet matrix over character classes finds both cuts of a text.

Units are runs of ASCII letters and single other characters (`[A-Za-z]+|[^A-Za-z]`). A batch of texts becomes one string of
byte classes: OTHER (first byte of a character that is no letter), START (letter that begins a run), INSIDE (further letter)
and TAIL (further byte of a character). A wavelet matrix of two levels answers how often a class occurs before a place:

* units before a place: rank of OTHER plus rank of START;
* code points before a place: its distance less the rank of TAIL.

A cut after u units is the place where unit u begins: all texts of a batch bisect on the unit rank together. How many units
stand before each cut, the order of the parts and whether a text is transformed at all come from a hash of its id.

Defined cases: null and empty texts have no units and stay plain; a text that contains a marker stays plain; a null id hashes
as no digits; rows with equal ids are cut at equal draws, each in its own text; very long texts are taken alone; an empty
table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import text_table
from weftline.llm.words import text_bytes

#: The markers of prefix, suffix and middle, and the shares of transformed and of suffix-first texts in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20

OTHER, START, INSIDE, TAIL = range(4)
#: Bytes of text whose classes are indexed at once; a longer text is taken alone.
CHUNK = 4 << 20
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Bits:
    """A bit string with the number of ones before any place: packed bits and a count for every 512 of them."""

    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 512) * 512
        padded = np.zeros(n, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        per_word = np.bitwise_count(self.words).astype(np.int64).reshape(-1, 8)
        self.before = np.r_[0, np.cumsum(per_word.sum(axis=1))]
        self.inside = (np.cumsum(per_word, axis=1) - per_word).astype(np.int16)  # ones before each word of its block

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        rest = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at >> 9] + self.inside.reshape(-1)[word] + np.bitwise_count(rest)


class WaveletMatrix:
    """Symbols below 2**levels: each level keeps one bit of every symbol, high bit first, and sorts by it stably."""

    def __init__(self, symbols: np.ndarray, levels: int = 2):
        self.n, self.levels, self.zeros = len(symbols), [], []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(bits))
            self.zeros.append(int(len(bits) - np.count_nonzero(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first at symbols are this one."""
        low, high = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            if symbol >> (len(self.levels) - 1 - k) & 1:
                low, high = zeros + bits.ones(low), zeros + bits.ones(high)
            else:
                low, high = low - bits.ones(low), high - bits.ones(high)
        return high - low


_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x80:0xC0] = TAIL
_CLASS[65:91] = _CLASS[97:123] = START


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte; a run of letters also begins where a text does."""
    out = _CLASS[data]
    letter = out == START
    further = letter.copy()
    further[1:] &= letter[:-1]
    further[:1] = False
    further[starts[starts < len(data)]] = False
    out[further] = INSIDE
    return out


class Units:
    """Unit and code point counts of the texts data[at[i]:at[i + 1]], and the places where units begin."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.at = at
        self.matrix = WaveletMatrix(classes(data, at[:-1]))
        self.first = self.units(at[:-1])
        self.n = self.units(at[1:]) - self.first

    def units(self, place: np.ndarray) -> np.ndarray:
        return self.matrix.rank(OTHER, place) + self.matrix.rank(START, place)

    def chars(self, place: np.ndarray) -> np.ndarray:
        return place - self.matrix.rank(TAIL, place)

    def cut(self, after: np.ndarray) -> np.ndarray:
        """The place behind the first `after` units of each text: the last place with so many units before it and none begun there."""
        low, high = self.at[:-1].copy(), self.at[1:].copy()
        target = self.first + after
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.units(middle) <= target
            low = np.where(open_ & fits, middle, low)
            high = np.where(open_ & ~fits, middle - 1, high)
        return low


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from a document's id."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "psm":
        return p + prefix + s + suffix + m + middle
    return s + suffix + p + prefix + m + middle


def _task(transformed_percent: int, suffix_first_percent: int):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    markers = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def rows(data: np.ndarray, at: np.ndarray, ids: list) -> pa.RecordBatch:
        base = at[0]
        data, at = data[base : at[-1]], at - base
        units, drawn = Units(data, at), [draws(i) for i in ids]
        h = np.array(drawn, np.int64).reshape(-1, 4)
        x, y = h[:, 0] % (units.n + 1), h[:, 1] % (units.n + 1)
        one, two = units.cut(np.minimum(x, y)), units.cut(np.maximum(x, y))
        before = units.chars(one) - units.chars(at[:-1])
        between = units.chars(two) - units.chars(one)
        forms, outputs, view = [], [], data.tobytes()
        for i in range(len(ids)):
            text = view[at[i] : at[i + 1]]
            if not text or h[i, 2] % 100 >= transformed_percent or any(m in text for m in markers):
                forms.append("plain")
                outputs.append(text)
            else:
                forms.append("spm" if h[i, 3] % 100 < suffix_first_percent else "psm")
                outputs.append(arranged(view[at[i] : one[i]], view[one[i] : two[i]], view[two[i] : at[i + 1]], forms[-1]))
        plain = np.array([f == "plain" for f in forms], bool)
        columns = [pa.array(ids, pa.int64()), pa.array(units.n, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64(), mask=plain), pa.array(between, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, at = text_bytes(batch.column(1))
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
                yield rows(data, at[i : j + 1], ids[i:j])
                i = j

    return run


def transformed(docs: DataFrame, transformed_percent: int = TRANSFORMED, suffix_first_percent: int = SUFFIX_FIRST) -> DataFrame:
    """A row per row of docs (doc_id, text): units, form, code points of prefix and middle (null if plain), and the output text."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_task(transformed_percent, suffix_first_percent), SCHEMA)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text before the transformation; markers can't stand in its parts, so the output splits at them."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col(output))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transformed(text_table(spark, sf_dir))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') END AS u
  FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
cut AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, least(x, y)), '') AS p, array_to_string(list_slice(u, least(x, y) + 1, greatest(x, y)), '') AS m,
    array_to_string(list_slice(u, greatest(x, y) + 1, n), '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM cut
"""
