"""Queries over events, orders and lineitem as the operational log, requests and site runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import candidates, oplog
from weftline.sources import tables
from weftline.streaming import jobs, keyed

AS_OF = "2024-01-16 00:00:00"
STATES = ("INIT", "INTENT_DONE", "VALIDATED", "CACHE_HIT", "RELEVANCE_DONE", "PIPELINES_RUNNING", "EXTRACTION_DONE", "UNIFIED", "COMPLETED", "FAILED")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """orders as requests."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("INIT")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as site runs."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("request_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("run_id"), F.col("l_suppkey").alias("site_id"), F.when(F.col("l_linenumber") != 3, F.col("l_shipdate").cast("timestamp")).alias("started_at"), F.when(F.col("l_linestatus") == "F", "COMPLETED").otherwise("RUNNING").alias("run_state"))


def _stamp(*names: str) -> list:
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names]


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    ms = _events(spark, d).withColumn("ms", F.col("value") * 100)
    return oplog.histogram(ms, "ms", oplog.STAGE_MS, ["event_type"])


def tool_counters(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return oplog.counters(_events(spark, d).select(day, "event_type"), ["day", "event_type"])


def health_counters(spark: SparkSession, d: str) -> DataFrame:
    log = _events(spark, d).withColumns({"site": F.col("user_id"), "failure_class": F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.col("event_id") % 4).cast("string")))})
    return oplog.health(log, ["site"]).select("site", "failures", "last_class", "status", *_stamp("last_failure", "cooldown_until"))


def sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    df = oplog.sliding_rate(_events(spark, d), "user_id", "ts", 3600, 2)
    return df.select("event_id", "in_window", "over", F.coalesce("retry_after", F.lit(0)).cast("bigint").alias("retry_after"))


def rate_usage(spark: SparkSession, d: str) -> DataFrame:
    return oplog.rate_usage(_events(spark, d), "user_id", "ts", AS_OF, 86_400, 5)


def step_elapsed(spark: SparkSession, d: str) -> DataFrame:
    return oplog.with_elapsed(_events(spark, d), ["user_id"], "ts", "event_id").select("event_id", "since_start", "since_previous")


def replay(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events numbered in order of time."""
    return candidates.with_position(_events(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "position", "event_id")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("event_type").alias("domain"), F.col("user_id").alias("site"), (F.col("value") / 100).alias("score"), F.col("ts").alias("created_at"), F.col("event_id").alias("tie"))


def site_memory(spark: SparkSession, d: str) -> DataFrame:
    df = oplog.site_memory(_scores(spark, d), ["domain", "site"])
    return df.select("domain", "site", F.round(F.col("avg_score") * F.col("query_count"), 4).alias("total_score"), "query_count", "success_count", F.round("last_score", 6).alias("last_score"))


def site_memory_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The first half of the log as memory, the second as a batch: the same as all at once."""
    s = _scores(spark, d)
    half = F.lit(AS_OF).cast("timestamp")
    memory = oplog.site_memory(s.where(F.col("created_at") < half), ["domain", "site"])
    df = oplog.site_memory_update(memory, s.where(F.col("created_at") >= half), ["domain", "site"])
    return df.select("domain", "site", F.round(F.col("avg_score") * F.col("query_count"), 4).alias("total_score"), "query_count", "success_count", F.round("last_score", 6).alias("last_score"))


def relevance_split(spark: SparkSession, d: str) -> DataFrame:
    df = oplog.split_by_relevance(_scores(spark, d))
    return df.groupBy("domain", "status").agg(F.count("*").alias("n"), F.min("reason").alias("first_reason"))


def stale_requests(spark: SparkSession, d: str) -> DataFrame:
    df = oplog.stale(_requests(spark, d), "1998-01-01 00:00:00")
    return df.select("request_id", "state", "previous_state", *_stamp("updated_at"))


def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    return oplog.cascade(oplog.stale(_requests(spark, d), "1998-01-01 00:00:00"), _runs(spark, d)).select("run_id", "request_id", "run_state")


def stuck_band(spark: SparkSession, d: str) -> DataFrame:
    points = _runs(spark, d).where("started_at is not null").select("request_id", F.col("run_id").alias("checkpoint_id"), (F.col("started_at") - F.expr("interval 10 days")).alias("checkpoint_at"))
    return oplog.stuck_with_checkpoint(_requests(spark, d), points, minutes=60 * 24 * 5, top=10).select("request_id", "checkpoint_id", *_stamp("checkpoint_at"))


def request_status(spark: SparkSession, d: str) -> DataFrame:
    return oplog.request_status(_requests(spark, d), _runs(spark, d)).select("request_id", "state", "run_id", "run_state", "place")


def api_states(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).groupBy(oplog.api_status().alias("status")).agg(F.count("*").alias("n"))


def _moves(events: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(s) for s in STATES])
    at = lambda c: F.get(names, (c % 10).cast("int"))
    return events.select(F.col("user_id").alias("request_id"), "event_id", "ts", at(F.col("event_id")).alias("from_state"), at(F.col("event_id") + 1).alias("to_state"))


def transition_legality(spark: SparkSession, d: str) -> DataFrame:
    return _moves(_events(spark, d)).groupBy("from_state", "to_state", oplog.valid_transition().alias("valid")).agg(F.count("*").alias("n"))


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    fetch = oplog.classify_fetch(F.when(F.col("event_id") % 7 == 0, 403).when(F.col("event_id") % 7 == 1, 503).when(F.col("event_id") % 7 == 2, 404).otherwise(200), F.when(F.col("event_type") == "error", "Timeout while loading"), (F.col("value") * 10).cast("int"))
    failure = oplog.classify_error(F.when(F.col("event_id") % 3 == 0, "SchemaError").when(F.col("event_id") % 3 == 1, "DOMError").otherwise("ValueError"), F.concat(F.col("event_type"), F.when(F.col("event_id") % 5 == 0, " 403").otherwise("")))
    return e.groupBy(fetch.alias("fetch"), failure.alias("failure")).agg(F.count("*").alias("n"))


def _tries(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("user_id").alias("request_id"), F.col("event_id").alias("ord"), (F.col("value") % 100).alias("score"), F.concat(F.lit("https://a.example/"), "event_type", F.lit("/"), (F.col("event_id") % 20).cast("string")).alias("url"))


def attempts_until_90(spark: SparkSession, d: str) -> DataFrame:
    return candidates.attempts_until(_tries(spark, d), ["request_id"], ["ord"]).select("request_id", "ord", "attempt")


def best_url(spark: SparkSession, d: str) -> DataFrame:
    return candidates.best_url(_tries(spark, d), ["request_id"]).select("request_id", "ord", "rank")


def rank_decay(spark: SparkSession, d: str) -> DataFrame:
    return candidates.rank_decay(_tries(spark, d), ["request_id"], ["ord"], 0.08, 0.3).select("ord", "confidence")


def pool_urls(spark: SparkSession, d: str) -> DataFrame:
    t = _tries(spark, d).select("request_id", "url", (F.col("ord") % 3).alias("query_no"), F.col("ord").alias("pos"))
    return candidates.pool_urls(t)


def ordered_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = _tries(spark, d).select("request_id", "url", "ord")
    return candidates.ordered_candidates(t.where("ord % 4 = 0"), t.where("ord % 4 <> 0")).select("request_id", "ord", "source", "place")


def penalty_patterns(spark: SparkSession, d: str) -> DataFrame:
    t = _tries(spark, d).withColumn("source", F.when(F.col("ord") % 4 == 0, "cache").otherwise("serp"))
    return tables.penalty_patterns(t).groupBy("request_id", "status").agg(F.count("*").alias("n"), F.round(F.min("confidence"), 6).alias("lowest"))


def limit_per_request(spark: SparkSession, d: str) -> DataFrame:
    items = _tries(spark, d).select("request_id", F.col("ord").alias("position"))
    limits = items.select("request_id").distinct().withColumn("item_limit", F.when(F.col("request_id") % 3 != 0, F.col("request_id") % 5))
    return candidates.limit_per_request(items, limits)


def request_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Requests with changed state after a keyed update by newer runs, and new ones inserted."""
    base = _requests(spark, d).select("request_id", "state").where("state <> 'INIT'")
    delta = _requests(spark, d).where("updated_at >= '1998-01-01'").select("request_id", F.lit("DONE").alias("state"))
    return tables.upsert(base, delta, ["request_id"], {"state": F.concat_ws(">", "old_state", "new_state")})


def request_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    base = _requests(spark, d).select("request_id", "state").where("state <> 'INIT'")
    delta = _requests(spark, d).where("updated_at >= '1998-01-01'").select("request_id", F.lit("NEW").alias("state"))
    return tables.insert_ignore(base, delta, ["request_id"])


def request_updates(spark: SparkSession, d: str) -> DataFrame:
    base = _requests(spark, d).select("request_id", "state")
    changes = base.where("state = 'FAILED'").select("request_id", F.when(F.col("request_id") % 10 == 0, "CLOSED").alias("state"))
    return tables.update_rows(base, changes, ["request_id"])


def windowed_metrics_stream(spark: SparkSession, d: str) -> DataFrame:
    """The log replayed as a stream into event-time windows of a day."""
    df = jobs.windowed_metrics(tables.read_log_stream(spark, d), "1 day", "1 day")
    out = jobs.run_all(df, tables.scratch(spark, "metrics"), tables.scratch(spark, "state"), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "errors", F.round("total", 2).alias("total"))


def rate_limiter_stream(spark: SparkSession, d: str) -> DataFrame:
    df = keyed.rate_limit(tables.read_log_stream(spark, d).withWatermark("ts", "10 minutes"), 2, 3600)
    out = jobs.run_all(df, tables.scratch(spark, "limited"), tables.scratch(spark, "state"))
    return out.select("user_id", "event_id", "accepted", F.round("retry_after", 3).alias("retry_after"))


def circuit_breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    stream = tables.read_log_stream(spark, d).where("event_type = 'error'").withColumn("site", F.col("user_id").cast("string"))
    out = jobs.run_all(keyed.circuit_breaker(stream.withWatermark("ts", "10 minutes")), tables.scratch(spark, "broken"), tables.scratch(spark, "state"))
    return out.where("event_id IS NOT NULL").select("site", "event_id", "failures", "status")


def transitions_stream(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_all(keyed.apply_transitions(_moves(tables.read_log_stream(spark, d)).withWatermark("ts", "10 minutes")), tables.scratch(spark, "moved"), tables.scratch(spark, "state"))


def dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type, with a watermark as long as the log."""
    stream = tables.read_log_stream(spark, d).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    out = jobs.run_all(jobs.dedup_requests(stream, "key", delay="60 days"), tables.scratch(spark, "first"), tables.scratch(spark, "state"))
    return out.select("key")


QUERIES = {
    f.__name__: f
    for f in (
        latency_histogram, tool_counters, health_counters, sliding_rate, rate_usage, step_elapsed, replay, site_memory, site_memory_incremental, relevance_split, stale_requests, stale_runs, stuck_band,
        request_status, api_states, transition_legality, error_classes, attempts_until_90, best_url, rank_decay, pool_urls, ordered_candidates, penalty_patterns, limit_per_request, request_upsert,
        request_insert_ignore, request_updates, windowed_metrics_stream, rate_limiter_stream, circuit_breaker_stream, transitions_stream, dedup_stream,
    )
}

_BUCKETS = " UNION ALL ".join(f"SELECT event_type, '{b:g}' AS le, count(*) FILTER (value * 100 <= {b}) AS n FROM events GROUP BY 1" for b in oplog.STAGE_MS)
_REQ = "(SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'INIT' END AS state, o_orderdate AS updated_at FROM orders)"
_RUN = "(SELECT l_orderkey AS request_id, l_orderkey || '-' || l_linenumber AS run_id, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS started_at, CASE l_linestatus WHEN 'F' THEN 'COMPLETED' ELSE 'RUNNING' END AS run_state FROM lineitem)"
_TRY = "(SELECT user_id AS request_id, event_id AS ord, value % 100 AS score, 'https://a.example/' || event_type || '/' || event_id % 20 AS url FROM events)"
_FMT = "'%Y-%m-%d %H:%M:%S'"
_MEMORY = """
SELECT event_type AS domain, user_id AS site, round(sum(value / 100), 4) AS total_score, count(*) AS query_count, count(*) FILTER (value / 100 >= 0.3) AS success_count,
  round(arg_max(value / 100, (ts, event_id)), 6) AS last_score FROM events GROUP BY ALL"""
_LIST = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"
_EDGES = ", ".join(f"'{a}>{b}'" for a, to in oplog.TRANSITIONS.items() for b in to)
ORACLES = {
    "latency_histogram": f"{_BUCKETS} UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY 1",
    "tool_counters": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "health_counters": f"""
SELECT user_id AS site, count(*) AS failures, arg_max('E' || event_id % 4, (ts, event_id)) AS last_class, CASE WHEN count(*) >= 10 THEN 'disabled' WHEN count(*) >= 5 THEN 'degraded' ELSE 'healthy' END AS status,
  strftime(max(ts), {_FMT}) AS last_failure, CASE WHEN count(*) >= 10 THEN strftime(max(ts) + INTERVAL 30 MINUTE, {_FMT}) END AS cooldown_until FROM events WHERE event_type = 'error' GROUP BY user_id""",
    "sliding_rate": """
WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events),
w AS (SELECT event_id, s, count(*) OVER o AS in_window, min(s) OVER o AS first_s FROM e WINDOW o AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
SELECT event_id, in_window, in_window > 2 AS over, CASE WHEN in_window > 2 THEN first_s + 3600 - s ELSE 0 END::BIGINT AS retry_after FROM w""",
    "rate_usage": f"""
WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, epoch(TIMESTAMP '{AS_OF}')::BIGINT AS now FROM events)
SELECT user_id, count(*) FILTER (s > now - 86400 AND s <= now) AS used, 5::BIGINT AS "limit", greatest(0, 5 - count(*) FILTER (s > now - 86400 AND s <= now))::BIGINT AS remaining FROM e GROUP BY user_id""",
    "step_elapsed": """
WITH e AS (SELECT event_id, user_id, ts, floor(epoch(ts))::BIGINT AS s FROM events)
SELECT event_id, s - first_value(s) OVER o AS since_start, coalesce(s - lag(s) OVER o, 0)::BIGINT AS since_previous FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "replay": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS position, event_id FROM events",
    "site_memory": _MEMORY,
    "site_memory_incremental": _MEMORY,
    "relevance_split": """
SELECT event_type AS domain, CASE WHEN value / 100 >= 0.3 THEN 'accepted' ELSE 'rejected' END AS status, count(*) AS n,
  min(CASE WHEN value / 100 < 0.3 THEN printf('score %.2f below threshold 0.30', value / 100) END) AS first_reason FROM events GROUP BY ALL""",
    "stale_requests": f"SELECT request_id, 'FAILED' AS state, state AS previous_state, strftime(updated_at, {_FMT}) AS updated_at FROM {_REQ} WHERE state = 'INIT' AND updated_at < TIMESTAMP '1998-01-01' - INTERVAL 10 MINUTE",
    "stale_runs": f"SELECT run_id, r.request_id, run_state FROM {_RUN} r JOIN {_REQ} q ON r.request_id = q.request_id WHERE run_state = 'RUNNING' AND state = 'INIT' AND updated_at < TIMESTAMP '1998-01-01' - INTERVAL 10 MINUTE",
    "stuck_band": f"""
SELECT r.request_id, run_id AS checkpoint_id, strftime(started_at - INTERVAL 10 DAY, {_FMT}) AS checkpoint_at FROM {_RUN} r JOIN {_REQ} q ON r.request_id = q.request_id
WHERE started_at IS NOT NULL AND abs(epoch(updated_at) - epoch(started_at - INTERVAL 10 DAY)) <= 432000 ORDER BY started_at DESC, r.request_id, run_id LIMIT 10""",
    "request_status": f"SELECT q.request_id, state, run_id, run_state, row_number() OVER (PARTITION BY q.request_id ORDER BY started_at NULLS LAST, run_id, run_state)::INT AS place FROM {_REQ} q LEFT JOIN {_RUN} r ON r.request_id = q.request_id",
    "api_states": f"SELECT CASE state WHEN 'COMPLETED' THEN 'completed' WHEN 'FAILED' THEN 'failed' ELSE 'processing' END AS status, count(*) AS n FROM {_REQ} GROUP BY 1",
    "transition_legality": f"""
WITH m AS (SELECT {_LIST}[event_id % 10 + 1] AS from_state, {_LIST}[(event_id + 1) % 10 + 1] AS to_state FROM events)
SELECT from_state, to_state, from_state || '>' || to_state IN ({_EDGES}) AS valid, count(*) AS n FROM m GROUP BY ALL""",
    "error_classes": """
WITH e AS (SELECT CASE event_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END AS st, event_type = 'error' AS err, trunc(value * 10)::INT AS size, event_id, event_type || CASE WHEN event_id % 5 = 0 THEN ' 403' ELSE '' END AS msg FROM events)
SELECT CASE WHEN st = 403 THEN 'BLOCKED_403' WHEN err THEN 'TIMEOUT' WHEN size < 500 AND size > 0 THEN 'EMPTY_PAGE' WHEN st = 404 THEN 'NOT_FOUND' WHEN st >= 500 THEN 'SERVER_ERROR' ELSE 'UNKNOWN' END AS fetch,
  CASE WHEN msg LIKE '%403%' THEN 'BOT_PROTECTION' WHEN event_id % 3 = 0 THEN 'EXTRACTION_SCHEMA_FAIL' WHEN event_id % 3 = 1 THEN 'DOM_STRUCTURE_CHANGED' ELSE 'NETWORK_TIMEOUT' END AS failure, count(*) AS n FROM e GROUP BY ALL""",
    "attempts_until_90": f"""
WITH t AS (SELECT *, row_number() OVER o AS attempt, max(CASE WHEN score >= 90 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM {_TRY} WINDOW o AS (PARTITION BY request_id ORDER BY ord))
SELECT request_id, ord, attempt::INT AS attempt FROM t WHERE attempt <= 5 AND coalesce(done, 0) = 0""",
    "best_url": f"SELECT request_id, ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ord)::INT AS rank FROM {_TRY} WHERE score >= 50) WHERE rank <= 5",
    "rank_decay": f"SELECT ord, round(greatest(0.3::DOUBLE, 1 - 0.08::DOUBLE * (row_number() OVER (PARTITION BY request_id ORDER BY ord) - 1)), 2) AS confidence FROM {_TRY}",
    "pool_urls": f"SELECT request_id, url, query_no, pos FROM (SELECT request_id, url, ord % 3 AS query_no, ord AS pos, row_number() OVER (PARTITION BY request_id, url ORDER BY ord % 3, ord) AS rn FROM {_TRY}) WHERE rn = 1",
    "ordered_candidates": f"SELECT request_id, ord, CASE WHEN ord % 4 = 0 THEN 0 ELSE 1 END AS source, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN ord % 4 = 0 THEN 0 ELSE 1 END, ord)::INT AS place FROM {_TRY}",
    "penalty_patterns": f"""
WITH t AS (SELECT *, max(score) OVER (PARTITION BY request_id) AS best FROM {_TRY})
SELECT request_id, 'failed' AS status, count(*) AS n, round(min(greatest(-1.0::DOUBLE, -score / 100)), 6) AS lowest FROM t WHERE (ord % 4 = 0 AND score < 50) OR best < 50 GROUP BY request_id""",
    "limit_per_request": f"SELECT request_id, position FROM (SELECT request_id, ord AS position, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS n FROM {_TRY}) WHERE request_id % 3 = 0 OR n <= request_id % 5",
    "request_upsert": f"SELECT request_id, CASE WHEN state <> 'INIT' AND updated_at >= '1998-01-01' THEN state || '>DONE' WHEN state <> 'INIT' THEN state ELSE 'DONE' END AS state FROM {_REQ} WHERE state <> 'INIT' OR updated_at >= '1998-01-01'",
    "request_insert_ignore": f"SELECT request_id, CASE WHEN state <> 'INIT' THEN state ELSE 'NEW' END AS state FROM {_REQ} WHERE state <> 'INIT' OR updated_at >= '1998-01-01'",
    "request_updates": f"SELECT request_id, CASE WHEN state = 'FAILED' AND request_id % 10 = 0 THEN 'CLOSED' ELSE state END AS state FROM {_REQ}",
    "windowed_metrics_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "rate_limiter_stream": """
WITH RECURSIVE e AS (SELECT *, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (
  SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, NULL::TIMESTAMP AS ts, []::DOUBLE[] AS held, true AS accepted, 0.0::DOUBLE AS retry_after FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT w.user_id, e.i, e.event_id, e.ts, CASE WHEN len(h) < 2 THEN list_append(h, e.s) ELSE h END, len(h) < 2, CASE WHEN len(h) < 2 THEN 0.0 ELSE h[1] + 3600 - e.s END
  FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1, LATERAL (SELECT list_filter(w.held, lambda x: x > e.s - 3600) AS h))
SELECT user_id, event_id, accepted, round(retry_after, 3) AS retry_after FROM w WHERE i > 0""",
    "circuit_breaker_stream": """
WITH RECURSIVE e AS (SELECT *, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
w AS (
  SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::BIGINT AS n, 0.0::DOUBLE AS last FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT w.user_id, e.i, e.event_id, CASE WHEN w.n >= 10 AND e.s - w.last >= 1800 THEN 1 ELSE w.n + 1 END, e.s FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id::VARCHAR AS site, event_id, n AS failures, CASE WHEN n >= 10 THEN 'disabled' WHEN n >= 5 THEN 'degraded' ELSE 'healthy' END AS status FROM w WHERE i > 0""",
    "transitions_stream": f"""
WITH RECURSIVE m AS (SELECT user_id AS request_id, event_id, {_LIST}[event_id % 10 + 1] AS from_state, {_LIST}[(event_id + 1) % 10 + 1] AS to_state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (
  SELECT request_id, 0::BIGINT AS i, 0::BIGINT AS event_id, '' AS from_state, '' AS to_state, '' AS verdict, 'INIT' AS now FROM (SELECT DISTINCT request_id FROM m)
  UNION ALL
  SELECT request_id, i, event_id, from_state, to_state, v, CASE WHEN v = 'applied' THEN to_state ELSE now END
  FROM (SELECT m.*, w.now, CASE WHEN m.from_state <> w.now THEN 'STALE' WHEN m.from_state || '>' || m.to_state NOT IN ({_EDGES}) THEN 'INVALID_TRANSITION' ELSE 'applied' END AS v FROM w JOIN m ON m.request_id = w.request_id AND m.i = w.i + 1))
SELECT request_id, event_id, from_state, to_state, verdict FROM w WHERE i > 0""",
    "dedup_stream": "SELECT DISTINCT user_id || ':' || event_type AS key FROM events",
}
