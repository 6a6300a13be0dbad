"""Embedding whitening by shifted CholeskyQR: principal components without ever forming a covariance's square of the condition.

The rows of A are the centred vectors. Each pass over the vectors solves them through the triangular factors found so far
(Q = A R1^-1 R2^-1 ..., one factor after the other), sums the Gram matrix of Q where the rows are, and factors it: the first
passes shift the diagonal, so that the factor exists however ill-conditioned A is. When Q is orthonormal to rounding, the
factors are composed, R = Rk ... R2 R1, and the singular values and right singular vectors of R are those of A.

Only matrices of the dimension meet: a task sends the triangle of its Gram matrix, and Spark adds the triangles up.

Defined cases: rows whose vector is null, empty or holds a null or an entry that is no number, is infinite or too large for an
exact integer (1024 times it reaches 2**53) are dropped; vectors of another length than most have (ties: the longest) are
dropped; ids may be null or repeat, each row has its result; a component without variance has whitened null and explained
0 (null if nothing varies); deviation is null where it exceeds a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

COMPONENTS = 8
#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Passes at most; each brings directions of little variance about seven digits nearer to the others.
PASSES = 6
#: Singular values of at most so much of the largest are rounding, not variance.
RANK = 1e-12
_U = np.finfo(float).eps
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _integers(batch: pa.RecordBatch, d: int, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a batch as integers, and which rows they are."""
    lists = batch.column(column)
    lists = lists.cast(pa.large_list(pa.float64()))
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.values.slice(lists.offsets[0].as_py(), int(lengths.sum()))
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    whole = (lengths == d) & np.asarray(lists.is_valid())
    starts = np.cumsum(lengths) - lengths
    at = np.flatnonzero(whole)
    rows = values[starts[at][:, None] + np.arange(d)] if len(at) and d else np.zeros((0, d))
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(rows * SCALE)
        good = (np.abs(scaled) < 2.0**53).all(axis=1)
    return scaled[good].astype(np.int64) + OFFSET, at[good]


def _sums(d: int, column: int):
    """Rows (dim, high, low, n) of a task: the sums of x split in two halves, which cannot overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            x, _ = _integers(batch, d, column)
            high += (x >> 26).sum(axis=0)
            low += (x & ((1 << 26) - 1)).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int64()), pa.array(high), pa.array(low), pa.array(np.full(d, n))], names=["dim", "high", "low", "n"])

    return run


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, by forward substitution over its columns."""
    out = np.empty_like(rows)
    for j in range(factor.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def cholesky(gram: np.ndarray) -> np.ndarray | None:
    """The upper triangular factor of gram, or None if it has none."""
    try:
        return np.linalg.cholesky(gram).T
    except np.linalg.LinAlgError:
        return None


@dataclass(frozen=True)
class Center:
    """The exact sums of the fit list's integers and their number."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less its mean: the whole part exactly, then the fraction."""
        if not self.n:
            return x.astype(float)
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        return (x - np.array(whole, np.int64)).astype(float) - np.array([r / self.n for r in rest])

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sums of (n x - S)^2, exact: modulo 2**64, which is the value itself wherever a long can hold it."""
        wrap = (1 << 64) - 1
        s = np.array([v & wrap for v in self.sums], np.uint64)
        away = x.astype(np.uint64) * np.uint64(self.n & wrap) - s
        value = (away * away).sum(axis=1, dtype=np.uint64)
        size = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        return pa.array(value.view(np.int64), mask=size > 9.2e18)


def _grams(center: Center, factors: list[np.ndarray], column: int, turned: np.ndarray | None = None):
    """The upper triangle (i, j, v) of a task's Gram matrix of the rows, solved through the factors and turned; with column sums as i = -1."""
    d = len(center.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = d if turned is None else turned.shape[1]
        gram, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            x, _ = _integers(batch, d, column)
            q = center.centred(x)
            for f in factors:
                q = solved(q, f)
            if turned is not None:
                q = q @ turned
            gram += q.T @ q
            total += q.sum(axis=0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, np.full(k, -1)]), pa.array(np.r_[j, np.arange(k)]), pa.array(np.r_[gram[i, j], total])], names=["i", "j", "v"])

    return run


def _gram(vectors: DataFrame, center: Center, factors: list[np.ndarray], turned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The Gram matrix and the column sums over all vectors; dimension squared numbers come to the driver."""
    k = len(center.sums) if turned is None else turned.shape[1]
    parts = vectors.mapInArrow(_grams(center, factors, 0, turned), "i bigint, j bigint, v double")
    gram, total = np.zeros((k, k)), np.zeros(k)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r["i"] < 0:
            total[r["j"]] = r["v"]
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["v"]
    return gram, total


def triangular_factors(vectors: DataFrame, center: Center) -> list[np.ndarray]:
    """R1, R2, ... of shifted CholeskyQR: vectors (a column of arrays) solved through all of them are orthonormal."""
    d, factors = len(center.sums), []
    for _ in range(PASSES):
        gram, _ = _gram(vectors, center, factors)
        if factors and np.abs(gram - np.eye(d)).max() < 64 * d * _U:
            break
        size = np.linalg.norm(gram, 2)
        if size == 0:  # nothing varies
            factors.append(np.zeros((d, d)))
            break
        factor = cholesky(gram) if factors else None
        if factor is None:  # the first pass always, later ones where a direction still has no variance to speak of
            shift = 11 * (center.n * d + d * (d + 1)) * _U * size if not factors else 11 * (d + d * (d + 1)) * _U * size
            factor = cholesky(gram + min(shift, size / 100) * np.eye(d))
        factors.append(factor)
    return factors


@dataclass(frozen=True)
class Model:
    """The centre, unit components (columns) by falling eigenvalue, and the eigenvalues of all of them."""

    center: Center
    components: np.ndarray
    eigenvalues: np.ndarray

    def whitener(self, k: int) -> np.ndarray:
        """What turns centred rows into k whitened components; 0 for those without variance."""
        scale = np.sqrt(self.eigenvalues[:k])
        return self.components[:, :k] * np.divide(1, scale, out=np.zeros(len(scale)), where=scale > 0)


def fitted(vectors: DataFrame, embedding: str = "embedding") -> Model | None:
    """The model of all usable vectors, or None if there are none."""
    column = vectors.select(F.col(embedding).cast("array<double>").alias("v"))
    lengths = column.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c"))
    most = lengths.orderBy(F.desc("c"), F.desc("d")).first()
    if most is None:
        return None
    sums = column.mapInArrow(_sums(most["d"], 0), "dim bigint, high bigint, low bigint, n bigint").groupBy("dim")
    wide = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")}
    rows = sorted(sums.agg(*wide.values()).collect(), key=lambda r: r["dim"])
    if not int(rows[0]["n"]):
        return None
    center = Center(int(rows[0]["n"]), tuple((int(r["high"]) << 26) + int(r["low"]) for r in rows))
    composed = np.eye(most["d"])
    for f in triangular_factors(column, center):
        composed = f @ composed
    _, sizes, turned = np.linalg.svd(composed)
    sizes = np.where(sizes > RANK * sizes[0], sizes, 0) if sizes[0] > 0 else sizes * 0
    return Model(center, turned.T, sizes**2 / center.n)


def identity_error(vectors: DataFrame, model: Model, k: int = COMPONENTS, embedding: str = "embedding") -> float:
    """The largest entry of the whitened components' covariance less the identity, over components with variance."""
    k = min(k, int((model.eigenvalues > 0).sum()))
    if not k:
        return 0.0
    gram, total = _gram(vectors.select(F.col(embedding).cast("array<double>").alias("v")), model.center, [], model.whitener(k))
    n = model.center.n
    return float(np.abs(gram / n - np.outer(total / n, total / n) - np.eye(k)).max())


def whitened(vectors: DataFrame, model: Model, k: int = COMPONENTS, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, deviation, whitened: an array of k values, null for components without variance) of each usable vector."""
    k = min(k, len(model.eigenvalues))
    d, turn, flat = len(model.center.sums), model.whitener(k), model.eigenvalues[:k] == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _integers(batch, d, 1)
            w = model.center.centred(x) @ turn
            values = pa.array(w.reshape(-1), mask=np.tile(flat, len(x)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), model.center.deviation(x), lists], names=["key", "deviation", "whitened"])

    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "key bigint, deviation bigint, whitened array<double>").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = fitted(vectors)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    trace, k = float(model.eigenvalues.sum()), min(COMPONENTS, len(model.eigenvalues))
    explained = F.array(*[F.lit(float(e) / trace if trace else None).cast("double") for e in model.eigenvalues[:k]])
    df = whitened(vectors, model).withColumn("n", F.lit(model.center.n).cast("bigint")).withColumn("identity_error", F.lit(identity_error(vectors, model)))
    df = df.select("vec_id", "n", "deviation", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return df.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), "identity_error")
