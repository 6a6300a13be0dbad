"""Every registered query against its SQL."""

import pytest
from tests.conftest import rows_of

from weftline.plans import registry
from weftline.sources import tables


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    got, want = df.toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want) and len(got) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_merged_fields_are_all_of_a_page(spark, data):
    """The merge has every key of a page: as many rows as page_result counts fields, and the keys of discover_fields."""
    rows = registry.QUERIES["merge_engines"](spark, data).collect()
    fields = {r.page_id: r.n_fields for r in registry.QUERIES["page_result"](spark, data).collect()}
    keys = {r.page_id: r["keys"].split(",") for r in registry.QUERIES["discover_fields"](spark, data).collect()}
    merged = {}
    for r in rows:
        merged.setdefault(r.page_id, []).append(r["key"])
    assert {p: len(k) for p, k in merged.items()} == fields
    assert {p: sorted(k) for p, k in merged.items()} == {p: sorted(k) for p, k in keys.items()}


def test_rows_of_a_task_stay_bounded(spark, data, tmp_path):
    """A table is dealt over the more partitions the larger it is, and what groups by its key keeps them."""
    spark.range(1000).selectExpr("id % 300 AS k", "id AS v").write.parquet(str(tmp_path / "t"))
    df = tables.dealt(spark.read.parquet(str(tmp_path / "t")), "k", rows=50).groupBy("k", "v").count().groupBy("k").count()
    assert df.rdd.getNumPartitions() == 20 and df.count() == 300
    for name in ("unify_fields", "conflict_report", "keep_better", "fill_gaps", "filtered_items", "intent_order"):
        plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name
