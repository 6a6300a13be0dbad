"""Nearest vectors by an inverted-file index over normalised vectors, with an approximate and an exact search.

The index has centroids (spherical k-means on a bounded sample of rows, taken by hash); every row goes to the cell of its nearest
centroid. A query meets the rows of its nearest cells only, by an equi-join on (group, cell), so the rows of a group are never
paired with all queries of it. How many cells are probed is measured on the sample: the fewest that find the nearest row
for the wanted share of its queries. Cells hold about the square root of the rows, so a search of few cells reads few rows.

The exact search goes on from there: a cell can hold a better row than the best one so far only if the query's angle to its
centroid less the cell's radius is smaller than the angle to that row; those cells, and no others, are read too.

Rows whose vector is null, empty, of another length than the sample's or of norm zero have no direction: they match nothing, and
as queries they are missing. Rows with a column value count only if it holds data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.vectors import dot, is_meaningful, norm
from weftline.sources.tables import stored

#: Rows that centroids and probes are fitted on, cells, and sampled queries for the probes, at most.
SAMPLE, CELLS, TRIALS = 20_000, 4096, 500
ROUNDS = 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of a list column, and the rows that have one."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    at = np.flatnonzero((np.diff(offsets) == d) & np.asarray(lists.is_valid()))
    x = flat[offsets[at][:, None] + np.arange(d)] if len(at) else np.zeros((0, d))
    size = np.linalg.norm(x, axis=1)
    good = np.isfinite(size) & (size > 0)
    return x[good] / size[good][:, None], at[good]


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; an empty cell keeps its centroid."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        cell = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        some = np.linalg.norm(sums, axis=1) > 0
        c[some] = _unit(sums[some])
    return c


def _needed_probes(x: np.ndarray, groups: np.ndarray, c: np.ndarray, recall: float, rng: np.random.Generator) -> int:
    """The fewest probed cells that find the nearest other row of the group for so many of the sample's queries."""
    cell = (x @ c.T).argmax(axis=1)
    places = []
    for i in rng.choice(len(x), min(TRIALS, len(x)), replace=False):
        score = np.where(groups == groups[i], x @ x[i], -2)
        score[i] = -2
        best = int(score.argmax())
        if score[best] > -2:
            near = c @ x[i]
            places.append(int((near > near[cell[best]]).sum()) + 1)
    return int(np.quantile(places, recall, method="higher")) if places else 1


@dataclass(frozen=True)
class VectorIndex:
    """rows: group, key, vec, norm, cell of every indexed row; radius: the largest angle of a row to its centroid, by cell."""

    rows: DataFrame
    group: str
    centroids: np.ndarray
    probes: int
    radius: np.ndarray = field(repr=False)

    def _probed(self, first: bool):
        """(group, field, vec) to a row per probed cell: the nearest ones, or (with column best) all others that can hold a better row."""
        c, probes, radius = self.centroids, self.probes, self.radius

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, at = _matrix(batch.column(2), c.shape[1])
                for i in range(0, len(x), 256):
                    near = x[i : i + 256] @ c.T
                    order = np.argsort(-near, axis=1, kind="stable")
                    wanted = np.zeros(near.shape, bool)
                    np.put_along_axis(wanted, order[:, :probes], True, axis=1)
                    if not first:
                        best = np.clip(batch.column(3).to_numpy(zero_copy_only=False)[at[i : i + 256]], -1, 1)
                        reach = np.arccos(np.clip(near, -1, 1)) - radius <= np.arccos(np.where(np.isnan(best), -1, best))[:, None] + 1e-6
                        wanted = ~wanted & reach & (radius >= 0)
                    row, cell = np.nonzero(wanted)
                    took = pa.array(at[i : i + 256][row])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), batch.column(2).take(took), pa.array(cell, pa.int64())], names=["g", "field", "fv", "cell"])

        return run

    def _best(self, cells: DataFrame) -> DataFrame:
        """(g, field, r: score and key) of the best row in the probed cells."""
        both = cells.join(self.rows.hint("merge"), ["g", "cell"]).where("not (key <=> field)")
        scored = both.select("g", "field", "key", (dot(F.col("fv"), F.col("vec")) / (norm(F.col("fv")) * F.col("norm"))).alias("score"))
        return scored.groupBy("g", "field").agg(F.max(F.struct("score", "key")).alias("r"))

    def search(self, fields: DataFrame, least: float = 0.65, exact: bool = False) -> DataFrame:
        """(group, field, key, score, missing) of each row of fields (group, field, vec): its most similar indexed row, missing under the threshold or if none was found.

        A row whose key equals the field doesn't count. Not exact: the best of the probed cells.
        """
        kinds = {c: t for c, t in fields.dtypes}
        schema = f"g {kinds[self.group]}, field {kinds['field']}, fv array<double>, cell bigint"
        asked = stored(fields.select(F.col(self.group).alias("g"), "field", F.col("vec").cast("array<double>").alias("vec")), "asked")
        found = stored(self._best(asked.mapInArrow(self._probed(True), schema)), "found")
        if exact:
            rest = asked.join(found.hint("merge"), ["g", "field"], "left").select("g", "field", "vec", F.col("r.score").alias("best"))
            more = self._best(rest.mapInArrow(self._probed(False), schema))
            found = found.unionByName(more).groupBy("g", "field").agg(F.max("r").alias("r"))
        df = asked.select("g", "field").join(found.hint("merge"), ["g", "field"], "left")
        return df.select(F.col("g").alias(self.group), "field", "r.key", F.round("r.score", 6).alias("score"), F.coalesce(F.col("r.score") < least, F.lit(True)).alias("missing"))


def vector_index(keys: DataFrame, group: str, recall: float = 0.95, sample: int = SAMPLE, cells: int = CELLS, seed: int = 7) -> VectorIndex:
    """The index of keys (group, key, vec, and value if only rows that hold data count). The sample is at most sample rows, by hash of their vectors."""
    if "value" in keys.columns:
        keys = keys.where(is_meaningful(F.col("value")))
    keys = keys.select(F.col(group).alias("g"), "key", F.col("vec").cast("array<double>").alias("vec"))
    usable = keys.where((F.size("vec") > 0) & (norm(F.col("vec")) > 0))
    total = usable.count()
    some = usable if total <= 4 * sample else usable.where(F.pmod(F.xxhash64("key", "vec"), F.lit(1 << 40)) < (4 * sample << 40) // total)
    drawn = some.orderBy(F.xxhash64("key", "vec")).limit(sample).select("g", "vec").collect()
    lengths = [len(r["vec"]) for r in drawn]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if drawn else 1
    drawn = [r for r in drawn if len(r["vec"]) == d]
    rng = np.random.default_rng(seed)
    x = _unit(np.array([r["vec"] for r in drawn], float)) if drawn else np.zeros((0, d))
    k = max(1, min(cells, math.isqrt(total), len(x) // 8))
    c = _centroids(x, k, rng) if len(x) else np.eye(1, d)
    names = {g: i for i, g in enumerate(dict.fromkeys(r["g"] for r in drawn))}
    probes = _needed_probes(x, np.array([names[r["g"]] for r in drawn]), c, recall, rng) if len(x) else 1

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, at = _matrix(batch.column(2), d)
            near = v @ c.T
            cell = near.argmax(axis=1) if len(v) else np.zeros(0, np.int64)
            took = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(took) for i in range(3)), pa.array(cell, pa.int64()), pa.array(near[np.arange(len(v)), cell])], names=["g", "key", "vec", "cell", "near"])

    kinds = dict(keys.dtypes)
    rows = keys.mapInArrow(assigned, f"g {kinds['g']}, key {kinds['key']}, vec array<double>, cell bigint, near double")
    rows = stored(rows.withColumn("norm", norm(F.col("vec"))), "index")
    radius = np.full(len(c), -1.0)
    for r in rows.groupBy("cell").agg(F.min("near").alias("near")).collect():  # a row per cell: bounded by cells
        radius[r["cell"]] = math.acos(min(1.0, max(-1.0, r["near"])))
    return VectorIndex(rows.drop("near"), group, c, probes, radius)
