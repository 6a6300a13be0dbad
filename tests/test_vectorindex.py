"""The vector index against comparing all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import vectorindex, vectors


@pytest.fixture(scope="module")
def tables(spark):
    """Clustered vectors of two groups, with copies, and the query set of ids divisible by 100."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    rows = [(int(i % 2), i, [float(v) for v in centres[i % 40] + 0.4 * rng.normal(size=16)]) for i in range(4000)]
    rows += [(0, 5000 + i, rows[100][2]) for i in range(50)]
    keys = spark.createDataFrame(rows, "g long, key long, vec array<double>")
    return keys.where("key % 100 = 0").select("g", F.col("key").alias("field"), "vec"), keys


def found(df):
    return {r.field: (r.key, r.score, r.missing) for r in df.collect()}


def test_exact_search_is_all_pairs(spark, tables):
    fields, keys = tables
    index = vectorindex.vector_index(keys, "g")
    assert found(index.search(fields, exact=True)) == found(vectors.best_matches(fields, keys, "g"))


def test_recall_of_probed_cells(spark, tables, data):
    """At least nine tenths of the nearest rows, from a part of the index where vectors have clusters."""
    fields, keys = tables
    index = vectorindex.vector_index(keys, "g")
    got, want = found(index.search(fields)), found(vectors.best_matches(fields, keys, "g"))
    assert np.mean([got[f][1] == want[f][1] for f in want]) >= 0.9
    assert index.probes <= len(index.centroids) // 3
    e = spark.read.parquet(f"{data}/embeddings.parquet").select("label", F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    few = e.where("key % 10 = 0").select("label", F.col("key").alias("field"), "vec")  # the table has few ids divisible by 100
    got, want = found(vectorindex.vector_index(e, "label").search(few)), found(vectors.best_matches(few, e, "label"))
    assert np.mean([got[f][1] == want[f][1] for f in want]) >= 0.9


def test_exact_search_skips_cells_out_of_reach(spark, tables):
    fields, keys = tables
    index = vectorindex.vector_index(keys, "g")
    best = fields.withColumn("best", F.lit(0.95))
    more = best.select("g", "field", F.col("vec").cast("array<double>"), "best").mapInArrow(index._probed(False), "g long, field long, fv array<double>, cell bigint")
    assert more.count() < 0.5 * fields.count() * (len(index.centroids) - index.probes)


def test_unusable_rows(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, None), (1, 3, []), (1, 4, [0.0, 0.0]), (1, 5, [1.0, 0.0, 0.0]), (1, 6, [float("nan"), 1.0]), (None, 7, [1.0, 0.0]), (1, 8, [0.9, 0.1])]
    keys = spark.createDataFrame(rows, "g long, key long, vec array<double>")
    index = vectorindex.vector_index(keys, "g")
    got = found(index.search(keys.withColumnRenamed("key", "field"), exact=True))
    assert {f: r[0] for f, r in got.items()} == {1: 8, 8: 1, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert all(got[f][2] for f in (2, 3, 4, 5, 6, 7)) and not got[1][2]
    nothing = vectorindex.vector_index(keys.limit(0), "g").search(keys.withColumnRenamed("key", "field"), exact=True)
    assert nothing.where("missing").count() == len(rows)


def test_values_without_data_don_t_count(spark):
    keys = spark.createDataFrame([(1, 1, [1.0, 0.0], "short"), (1, 2, [0.8, 0.6], "a value of some length")], "g long, key long, vec array<double>, value string")
    fields = spark.createDataFrame([(1, 9, [1.0, 0.0])], "g long, field long, vec array<double>")
    assert found(vectorindex.vector_index(keys, "g").search(fields, exact=True)) == found(vectors.best_matches(fields, keys, "g")) == {9: (2, 0.8, False)}
