"""The operational log in batch: health, histograms, counters, rates, site memory, request states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Histogram bounds, state transitions, API statuses.
REQUEST_MS = (100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000)
STAGE_MS = (50, 100, 250, 500, 1000, 2500, 5000, 10000, 20000)
TOOL_S = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0)
CONFIDENCE = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
TRANSITIONS = {
    "INIT": ("INTENT_DONE", "FAILED"),
    "INTENT_DONE": ("VALIDATED", "FAILED"),
    "VALIDATED": ("CACHE_HIT", "RELEVANCE_DONE", "FAILED"),
    "CACHE_HIT": ("COMPLETED",),
    "RELEVANCE_DONE": ("PIPELINES_RUNNING", "FAILED"),
    "PIPELINES_RUNNING": ("EXTRACTION_DONE", "FAILED"),
    "EXTRACTION_DONE": ("UNIFIED", "FAILED"),
    "UNIFIED": ("COMPLETED", "FAILED"),
    "COMPLETED": (),
    "FAILED": (),
}
#: States that nothing follows.
FINISHED = ("COMPLETED", "FAILED")


def valid_transition(old: str = "from_state", new: str = "to_state"):
    """Whether a state may follow another."""
    edges = [f"{a}>{b}" for a, to in TRANSITIONS.items() for b in to]
    return F.concat(F.col(old), F.lit(">"), F.col(new)).isin(edges)


def api_status(state: str = "state"):
    c = F.col(state)
    return F.when(c == "COMPLETED", "completed").when(c == "FAILED", "failed").otherwise("processing")


def histogram(df: DataFrame, value: str, bounds: tuple, labels: list[str]) -> DataFrame:
    """Cumulative bucket counts per label set: (labels, le, n), le +Inf last; one aggregation whatever the number of buckets."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    per = df.groupBy(*labels).agg(*counts, F.count(value).alias("all"))
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return per.select(*labels, F.explode(F.array(*rows)).alias("r")).select(*labels, "r.le", "r.n")


def counters(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def health(log: DataFrame, keys: list[str], degraded: int = 5, disabled: int = 10, cooldown_minutes: int = 30) -> DataFrame:
    """Failures, last failure and its class per key, the state they lead to and the end of a cooldown.

    log: keys, ts, failure_class (null: no failure), event_id.
    """
    bad = log.where("failure_class is not null")
    per = bad.groupBy(*keys).agg(F.count("*").alias("failures"), F.max("ts").alias("last_failure"), F.max_by("failure_class", F.struct("ts", "event_id")).alias("last_class"))
    state = F.when(F.col("failures") >= disabled, "disabled").when(F.col("failures") >= degraded, "degraded").otherwise("healthy")
    until = F.when(F.col("failures") >= disabled, F.col("last_failure") + F.make_dt_interval(mins=F.lit(cooldown_minutes)))
    return per.withColumns({"status": state, "cooldown_until": until})


def health_report(health: DataFrame, keys: list[str]) -> DataFrame:
    """The health of all keys in their order, by range partitions."""
    return health.orderBy(*keys)


def sliding_rate(df: DataFrame, key: str, ts: str, seconds: int = 60, limit: int = 30) -> DataFrame:
    """df with the key's events in the window up to and including each, over (limit passed) and retry_after in seconds."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds(ts)).rangeBetween(-seconds, 0)
    df = df.withColumns({"in_window": F.count("*").over(w), "_first": F.min(F.unix_seconds(ts)).over(w)})
    return df.withColumns({"over": F.col("in_window") > limit, "retry_after": F.when(F.col("in_window") > limit, F.col("_first") + seconds - F.unix_seconds(ts))}).drop("_first")


def rate_usage(df: DataFrame, key: str, ts: str, as_of: str, seconds: int = 60, limit: int = 30) -> DataFrame:
    """Per key the events of the last seconds before as_of, the limit and what remains."""
    now = F.unix_seconds(F.lit(as_of).cast("timestamp"))
    recent = (F.unix_seconds(ts) > now - seconds) & (F.unix_seconds(ts) <= now)
    per = df.groupBy(key).agg(F.count_if(recent).alias("used"))
    return per.select(key, "used", F.lit(limit).cast("bigint").alias("limit"), F.greatest(F.lit(0).cast("bigint"), limit - F.col("used")).alias("remaining"))


def with_elapsed(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Seconds since the first and since the previous step of a key."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    s = F.unix_seconds(ts)
    return df.withColumns({"since_start": s - F.first(s).over(w), "since_previous": F.coalesce(s - F.lag(s).over(w), F.lit(0).cast("bigint"))})


def site_memory(scores: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """Mean, count, accepted count and last score per key. scores: keys, score, created_at, tie."""
    per = scores.groupBy(*keys).agg(F.avg("score").alias("avg_score"), F.count("*").alias("query_count"), F.count_if(F.col("score") >= least).alias("success_count"), F.max_by("score", F.struct("created_at", "tie")).alias("last_score"))
    return per.withColumn("is_valid", F.col("avg_score") >= least)


def site_memory_update(memory: DataFrame, batch: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """memory after a batch of scores: running means from counts and sums; the batch is aggregated first."""
    new = site_memory(batch, keys, least).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("avg_score", "query_count", "success_count", "last_score")])
    both = memory.join(new.hint("merge"), keys, "full_outer")
    old_n, n = F.coalesce("query_count", F.lit(0)), F.coalesce("_query_count", F.lit(0))
    mean = (F.coalesce("avg_score", F.lit(0.0)) * old_n + F.coalesce("_avg_score", F.lit(0.0)) * n) / (old_n + n)
    return both.select(*keys, mean.alias("avg_score"), (old_n + n).alias("query_count"), (F.coalesce("success_count", F.lit(0)) + F.coalesce("_success_count", F.lit(0))).alias("success_count"), F.coalesce("_last_score", "last_score").alias("last_score"), (mean >= least).alias("is_valid"))


def split_by_relevance(scores: DataFrame, least: float = 0.3) -> DataFrame:
    """scores with status accepted or rejected, and the reason of a rejection."""
    ok = F.col("score") >= least
    return scores.withColumns({"status": F.when(ok, "accepted").otherwise("rejected"), "reason": F.when(~ok, F.format_string("score %.2f below threshold %.2f", F.col("score"), F.lit(least)))})


def stale(requests: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    """Unfinished requests that have not changed for minutes: to be FAILED, with the old state for their checkpoint."""
    old = F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    gone = requests.where(~F.col("state").isin(*FINISHED) & old)
    return gone.withColumns({"previous_state": F.col("state"), "state": F.lit("FAILED")})


def cascade(stale_requests: DataFrame, runs: DataFrame) -> DataFrame:
    """The unfinished site runs of stale requests: to be FAILED too."""
    return runs.where(~F.col("run_state").isin(*FINISHED)).join(stale_requests.select("request_id").hint("merge"), "request_id", "left_semi")


def sweep_stale(requests: DataFrame, runs: DataFrame, as_of: str, minutes: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a sweep changes: the requests and site runs to be FAILED, and a checkpoint row of each such request."""
    gone = stale(requests, as_of, minutes)
    checkpoints = gone.select("request_id", "state", "previous_state", F.lit(as_of).cast("timestamp").alias("checkpoint_at"), F.to_json(F.struct(F.lit("stale").alias("reason"), F.lit(minutes).alias("minutes"))).alias("data"))
    return gone, cascade(gone, runs).withColumn("run_state", F.lit("FAILED")), checkpoints


def stuck_with_checkpoint(requests: DataFrame, checkpoints: DataFrame, minutes: int = 5, top: int = 10) -> DataFrame:
    """Requests with a checkpoint within minutes of their last change; the top newest."""
    near = F.abs(F.unix_seconds("updated_at") - F.unix_seconds("checkpoint_at")) <= minutes * 60
    return requests.join(checkpoints.hint("merge"), "request_id").where(near).orderBy(F.desc("checkpoint_at"), "request_id", "checkpoint_id").limit(top)


def request_status(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Each request with its site runs in order of start, those without one last."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("started_at").asc_nulls_last(), "run_id", "run_state"))
    return requests.join(runs.hint("merge"), "request_id", "left").withColumn("place", place)


def replay_log(log: DataFrame, request_id) -> DataFrame:
    return log.where(F.col("request_id") == request_id).orderBy("created_at", "event_id")


def classify_error(name, message):
    """The failure class of an exception's name and message."""
    low = F.lower(message)
    return (
        F.when(F.contains(message, F.lit("BOT_PROTECTION")) | F.contains(message, F.lit("403")), "BOT_PROTECTION")
        .when(F.contains(name, F.lit("Timeout")) | F.contains(low, F.lit("timeout")), "NETWORK_TIMEOUT")
        .when(F.contains(name, F.lit("Connection")) | F.contains(low, F.lit("connect")), "NETWORK_TIMEOUT")
        .when(F.contains(name, F.lit("Schema")) | F.contains(low, F.lit("schema")), "EXTRACTION_SCHEMA_FAIL")
        .when(F.contains(name, F.lit("DOM")) | F.contains(low, F.lit("selector")), "DOM_STRUCTURE_CHANGED")
        .otherwise("NETWORK_TIMEOUT")
    )


def classify_fetch(status, error, size):
    """Why a fetch failed, by status, error text and size."""
    low = F.lower(F.coalesce(error, F.lit("")))
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when((status == 403) | has("forbidden"), "BLOCKED_403").when((status == 429) | has("rate"), "RATE_LIMITED").when(has("captcha") | has("challenge"), "CAPTCHA_DETECTED")
        .when(has("timeout") | (status == 0), "TIMEOUT").when((size < 500) & (size > 0), "EMPTY_PAGE").when(status == 404, "NOT_FOUND").when(status >= 500, "SERVER_ERROR").otherwise("UNKNOWN")
    )
