"""URL candidates: pooling, ranks, attempts and the choice, all per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool_urls(results: DataFrame) -> DataFrame:
    """The first place of each URL in a request's pooled results (request_id, url, query_no, pos)."""
    return results.groupBy("request_id", "url").agg(F.min(F.struct("query_no", "pos")).alias("at")).select("request_id", "url", "at.query_no", "at.pos")


def rank_decay(df: DataFrame, keys: list[str], order: list, step: float, floor: float) -> DataFrame:
    """df with a confidence that falls by step a rank down to floor, to 2 places."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("confidence", F.round(F.greatest(F.lit(floor), 1 - F.lit(step) * i), 2))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


def with_position(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def attempts_until(df: DataFrame, keys: list[str], order: list, stop: float = 90, cap: int = 5) -> DataFrame:
    """The attempts that are made: at most cap, none after the first score of stop or more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    tried = df.withColumns({"attempt": F.row_number().over(w), "_done": F.max(F.when(F.col("score") >= stop, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return tried.where((F.col("attempt") <= cap) & (F.coalesce("_done", F.lit(0)) == 0)).drop("_done")


def best_url(df: DataFrame, keys: list[str], least: float = 50, top: int = 5) -> DataFrame:
    """The top candidates per key of at least the score, best first; the earlier ord wins a tie."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))
    return df.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= top)


def ordered_candidates(cached: DataFrame, found: DataFrame) -> DataFrame:
    """Cached candidates before found ones, each in their order, with one running place per request."""
    both = cached.withColumn("source", F.lit(0)).unionByName(found.withColumn("source", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("source", "ord")))


def limit_per_request(items: DataFrame, intents: DataFrame) -> DataFrame:
    """The first items of each request up to its own limit (null: all)."""
    ranked = items.join(intents.select("request_id", "item_limit").hint("merge"), "request_id", "left").withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy("position")))
    return ranked.where(F.col("item_limit").isNull() | (F.col("_n") <= F.col("item_limit"))).drop("_n", "item_limit")


def order_by_intent(items: DataFrame, intents: DataFrame) -> DataFrame:
    """items with place: per request by the field that its intent names (sort_by, sort_order), numbers before texts; nulls last."""
    df = items.join(intents.select("request_id", "sort_by", "sort_order").hint("merge"), "request_id")
    value = F.col("fields")[F.col("sort_by")]
    number, down = value.try_cast("double"), F.col("sort_order") == "desc"
    w = Window.partitionBy("request_id").orderBy(F.when(down, number).desc_nulls_last(), F.when(~down, number).asc_nulls_last(), F.when(down, value).desc_nulls_last(), F.when(~down, value).asc_nulls_last(), "position")
    return df.withColumn("place", F.row_number().over(w))


def apply_filters(items: DataFrame, filters: DataFrame) -> DataFrame:
    """Items that pass all filters of their request. filters: request_id, field, op (=, >, <, >=, <=, between), value, upper."""
    df = items.join(filters.hint("merge"), "request_id", "left")
    have, want = F.col("fields")[F.col("field")], F.col("value")
    x, y, z = have.try_cast("double"), want.try_cast("double"), F.col("upper").try_cast("double")
    ok = (
        F.when(F.col("op").isNull(), True).when(F.col("op") == "=", F.coalesce(x == y, F.lower(have) == F.lower(want)))
        .when(F.col("op") == ">", x > y).when(F.col("op") == "<", x < y).when(F.col("op") == ">=", x >= y).when(F.col("op") == "<=", x <= y).when(F.col("op") == "between", x.between(y, z))
    )
    return df.groupBy(*[c for c in items.columns if c != "fields"]).agg(F.min(F.coalesce(ok, F.lit(False)).cast("int")).alias("ok"), F.first("fields").alias("fields")).where("ok = 1").drop("ok")


def attach_selected(candidates: DataFrame, least: float = 50) -> DataFrame:
    """The whole candidate row of each request that is selected: the best score of at least least; the earlier ord wins a tie."""
    cols = [c for c in candidates.columns if c != "request_id"]
    best = candidates.where(F.col("score") >= least).groupBy("request_id").agg(F.max_by(F.struct(*cols), F.struct("score", -F.col("ord"))).alias("r"))
    return best.select("request_id", "r.*")


def order_by_conf_created(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """df with place: per key by falling confidence, then the newest first."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("confidence").desc_nulls_last(), F.col("created_at").desc_nulls_last(), tie)))


def order_nulls_last(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """df in rising order of a column, rows without a value last."""
    return df.orderBy(F.col(column).asc_nulls_last(), *ties)
