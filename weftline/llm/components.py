"""Connected components of a table of links by alternating star steps, with every step in shared storage.

Each round is two groupings with map-side minima and two plain joins. The minima are written first: a join that took
over the grouping's partitions could not be split where a node has very many links. Labels fall to the smallest reachable node; the rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    far = both.where("b > a").join(least.hint("merge"), "a")
    return far.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    near = edges.join(least.hint("merge"), "a")
    return near.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b: bigint), root the smallest node of its component; no row for others."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = written(_small(_large(edges)), "links")
        state, before = _state(edges), state
        if state == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
