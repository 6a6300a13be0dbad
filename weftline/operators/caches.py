"""Cache reuse: exact, latest, semantic, fuzzy and two-tier lookups, for a whole batch of requests at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.intents import url_matches_intent
from weftline.sources.tables import stored


def fresh(df: DataFrame, as_of: str) -> DataFrame:
    """Rows that are valid and not expired at as_of."""
    return df.where((F.col("status") == "valid") & (F.col("expires_at") > F.lit(as_of).cast("timestamp")))


def cache_exact(requests: DataFrame, cache: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """requests with hit: whether a fresh cache row has the same keys."""
    live = fresh(cache, as_of).select(*keys).distinct().withColumn("hit", F.lit(True))
    return requests.join(live.hint("merge"), keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The newest row per key (the greater tie column wins), as one aggregate that combines before the shuffle."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("r")).select(*keys, "r.*")


def cache_result(results: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """The newest result per key whose request is COMPLETED."""
    done = requests.where("state = 'COMPLETED'").select("request_id")
    return latest_per_key(results.join(done.hint("merge"), "request_id", "left_semi"), keys, "created_at", "request_id")


def cache_semantic(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Per request the best result of equal canonical filters and goal: greatest confidence, then newest.

    requests: request_id, filters (canonical text), goal; results: result_id, filters, goal, confidence, created_at.
    """
    best = results.groupBy("filters", "goal").agg(F.max_by(F.struct("result_id", "confidence"), F.struct("confidence", "created_at", "result_id")).alias("r"))
    best = stored(best, "best_results")  # a plain join, split where many requests ask the same
    return requests.join(best.hint("merge"), ["filters", "goal"], "left").select("request_id", "r.result_id", "r.confidence")


def trigrams(key: Column) -> Column:
    """The distinct trigrams of a key, word by word with two blanks before and one after, as trigram indexes have them."""
    words = F.filter(F.split(F.lower(key), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3)))))


def similar_keys(left: DataFrame, right: DataFrame, least: float = 0.65, strict: bool = True) -> DataFrame:
    """(lkey, rkey, similarity) of the distinct keys of left and right with trigram similarity over least.

    Prefix filter: trigrams are put in a global order by rarity; keys of similarity t share one of the first
    n - ceil(t * n) + 1, so only these rare ones are joined, with the sizes in reach, and the exact similarity is checked.
    Frequent trigrams never meet.
    """
    lk, rk = left.select("key").distinct(), right.select("key").distinct()
    all_keys = lk.union(rk).distinct().withColumn("grams", trigrams(F.col("key"))).where(F.size("grams") > 0)
    # written first, so that the join is a plain one, which Spark splits where a trigram is frequent
    freq = stored(all_keys.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")), "trigrams")
    ranked = all_keys.select("key", F.explode("grams").alias("gram")).join(freq.hint("merge"), "gram").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    ranked = stored(ranked.select("key", F.transform("g", lambda x: x["gram"]).alias("grams"), F.size("g").alias("n")), "ranked")  # four readers
    first = ranked.withColumn("prefix", F.slice("grams", 1, F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1))
    probes = first.select("key", "grams", "n", F.explode("prefix").alias("gram"))
    a = probes.join(lk.hint("merge"), "key", "left_semi").select("gram", F.col("key").alias("lkey"), F.col("n").alias("ln"))
    b = probes.join(rk.hint("merge"), "key", "left_semi").select("gram", F.col("key").alias("rkey"), F.col("n").alias("rn"))
    pairs = a.join(b.hint("merge"), "gram").where((F.col("ln") >= F.col("rn") * least - 1e-9) & (F.col("rn") >= F.col("ln") * least - 1e-9)).select("lkey", "rkey").distinct()
    grams = ranked.select("key", "grams", "n")
    both = pairs.join(grams.select(F.col("key").alias("lkey"), F.col("grams").alias("lg")).hint("merge"), "lkey").join(grams.select(F.col("key").alias("rkey"), F.col("grams").alias("rg")).hint("merge"), "rkey")
    shared = F.size(F.array_intersect("lg", "rg"))
    scored = both.withColumn("similarity", shared / (F.size("lg") + F.size("rg") - shared))
    return scored.where(F.col("similarity") > least if strict else F.col("similarity") >= least).select("lkey", "rkey", "similarity")


def fuzzy_join(left: DataFrame, right: DataFrame, least: float = 0.65, strict: bool = True) -> DataFrame:
    """(left_id, right_id, similarity) of keys with trigram similarity over least. left, right: id, key.

    Distinct keys are compared, not rows, and copies are joined back.
    """
    scored = similar_keys(left, right, least, strict)
    out = left.select(F.col("id").alias("left_id"), F.col("key").alias("lkey")).join(scored.hint("merge"), "lkey").join(right.select(F.col("id").alias("right_id"), F.col("key").alias("rkey")).hint("merge"), "rkey")
    return out.select("left_id", "right_id", "similarity")


def top_similar(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The n most similar per left id, the more confident and then the smaller right id first."""
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("similarity"), F.desc("confidence"), "right_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def fuzzy_top(left: DataFrame, right: DataFrame, n: int = 5, least: float = 0.65, digits: int | None = None) -> DataFrame:
    """(left_id, right_id, similarity, confidence, rank): top_similar of fuzzy_join, without its pairs. left: id, key; right: id, key, confidence.

    Rows of one key have one similarity, so no key gives more than its first n rows, and all left rows of a key have the same answer: keys
    are ranked, not rows, and what is sorted grows with the keys that meet, however many copies they have. digits: similarities are rounded first.
    """
    place = F.row_number().over(Window.partitionBy("rkey").orderBy(F.desc("confidence"), "right_id"))
    best = right.select(F.col("id").alias("right_id"), F.col("key").alias("rkey"), "confidence").withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
    scored = similar_keys(left, right, least)
    scored = scored if digits is None else scored.withColumn("similarity", F.round("similarity", digits))
    # the keys of a pair stand for rows: top_similar ranks them by left key
    ranked = top_similar(scored.join(best.hint("merge"), "rkey").withColumnRenamed("lkey", "left_id"), n).withColumnRenamed("left_id", "lkey")
    ranked = stored(ranked.select("lkey", "right_id", "similarity", "confidence", "rank"), "ranked_keys")  # a plain join, split where a key has many left rows
    return left.select(F.col("id").alias("left_id"), F.col("key").alias("lkey")).join(ranked.hint("merge"), "lkey").drop("lkey")


def site_cache(requests: DataFrame, scores: DataFrame, memory: DataFrame, as_of: str, least: float = 0.3) -> DataFrame:
    """Two-tier site lookup: a fresh score of the same intent, else site memory with two queries or more, else uncached."""
    best = fresh(scores, as_of).where(F.col("score") >= least).groupBy("domain", "intent_hash", "site").agg(F.max("score").alias("tier1"))
    known = memory.where("is_valid and query_count >= 2").select("domain", "site", F.col("avg_score").alias("tier2"))
    df = requests.join(best.hint("merge"), ["domain", "intent_hash", "site"], "left").join(known.hint("merge"), ["domain", "site"], "left")
    tier = F.when(F.col("tier1").isNotNull(), "tier1").when(F.col("tier2").isNotNull(), "tier2").otherwise("uncached")
    return df.select("request_id", "domain", "site", tier.alias("tier"), F.coalesce("tier1", "tier2").alias("score"))


def idempotent_action(requests: DataFrame, existing: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """none, return, retry or attach, by the state of the newest request with the same key."""
    last = latest_per_key(existing.select(key, "state", "created_at", "request_id"), [key], "created_at", "request_id").select(key, F.col("state").alias("last_state"), F.col("request_id").alias("existing_id"))
    df = requests.join(last.hint("merge"), key, "left")
    action = F.when(F.col("last_state").isNull(), "none").when(F.col("last_state") == "COMPLETED", "return").when(F.col("last_state") == "FAILED", "retry").otherwise("attach")
    return df.withColumn("action", action)


def url_cache(requests: DataFrame, patterns: DataFrame, least: float = 0.5, top: int = 5) -> DataFrame:
    """The first of the top patterns per request by confidence that passes: same domain, site, version and entity title, not
    blocked, and a URL that matches the request's intent (JSON text).
    """
    keys = ["domain", "site", "version", "entity_title"]
    # the rank doesn't depend on the request: each key's top patterns, cut in the tasks before the shuffle, then meet its requests
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "pattern"))
    best = stored(patterns.where(F.col("confidence") > least).withColumn("rank", rank).where(F.col("rank") <= top), "top_patterns")
    hits = requests.join(best.hint("merge"), keys)
    passes = ~F.coalesce("blocked", F.lit(False)) & url_matches_intent(F.col("pattern"), F.col("intent"), F.col("entity_title"))
    return hits.where(passes).groupBy("request_id").agg(F.min_by(F.struct("pattern", "confidence"), "rank").alias("r")).select("request_id", "r.pattern", "r.confidence")


def union_hits(*tiers: DataFrame) -> DataFrame:
    """The hits of all cache tiers (request_id, site, score), with the number of the tier from 1."""
    return reduce(DataFrame.unionByName, [t.select("request_id", "site", "score").withColumn("tier", F.lit(i)) for i, t in enumerate(tiers, 1)])


def same_version(df: DataFrame, version: str) -> DataFrame:
    """The rows of a schema version."""
    return df.where(F.col("schema_version") == version)
