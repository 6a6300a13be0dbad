"""Sources and sinks: state tables, page and result sources, keyed upserts and partitioned exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_state(spark: SparkSession, path: str, name: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A state table with projection and filter, both of which reach the parquet scan."""
    df = spark.read.parquet(f"{path}/{name}.parquet")
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def read_pages(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Pages with their HTML whole, or its first cap characters, as services that fetch pages cap it."""
    pages = read_state(spark, path, "pages")
    return pages if cap is None else pages.withColumn("html", F.substring("html", 1, cap))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files fill fewer: a small file of one row group is one task
    otherwise, however much work its rows are. Large tables, which fill more, are left as they are. df: a scan or little more.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()  # reads the row counts in the files' footers
    return df if filled >= cores else df.repartition(cores)


#: Rows of a dealt table in a task, about.
TASK_ROWS = 500_000


def parts(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """How many partitions hold about so many rows each, as many as there are cores at least. df: a scan, whose row counts are in the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys over parts(df) partitions, so that a task's rows, and with them the memory of its sorts and aggregates, don't grow
    with the table. What groups by these keys and more needs no other exchange. For keys that few rows share."""
    return df.repartition(parts(df, rows), *keys)


#: Bytes of a table, as JSON, up to which it may be sent to every task.
SMALL_BYTES = 4 << 20


def small(df: DataFrame) -> DataFrame:
    """A lookup table for a join: written once, then marked for broadcast if its measured size is within SMALL_BYTES, else for a merge join."""
    df = stored(df, "lookup")
    size = df.select(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= SMALL_BYTES else df.hint("merge")


#: Rows of numbers and tags up to which a table may be sent to every task.
FEW_ROWS = 50_000


def few(df: DataFrame, name: str = "few") -> DataFrame:
    """Short rows for a join with a large table: written once, then marked for broadcast if there are FEW_ROWS or fewer, else for a merge join."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= FEW_ROWS else df.hint("merge")  # the row counts are in the files' footers


def domain_config(domains: DataFrame, section: str = "field_map") -> DataFrame:
    """(name, alias, schema_field) of a section of each domain's JSON config; malformed JSON gives no rows."""
    entries = F.map_entries(F.from_json(F.get_json_object("config", f"$.{section}"), "map<string,string>"))
    return domains.select("name", F.explode(entries).alias("e")).select("name", F.col("e.key").alias("alias"), F.col("e.value").alias("schema_field"))


def active_domains(domains: DataFrame) -> DataFrame:
    """(name, site) of active domains and their allowed sites."""
    return domains.where("status = 'active'").select("name", F.explode_outer("allowed_sites").alias("site"))


def serp_source(results: DataFrame, n: int = 10) -> DataFrame:
    """(request_id, pos, url, title, snippet): the first n organic results that have a link, from a JSON column."""
    rows = results.select("request_id", F.posexplode(F.from_json(F.get_json_object("payload", "$.organic"), "array<struct<link:string,title:string,snippet:string>>")).alias("pos", "r"))
    linked = rows.where(F.coalesce(F.col("r.link"), F.lit("")) != "")
    return linked.where(F.col("pos") < n).select("request_id", "pos", F.col("r.link").alias("url"), "r.title", "r.snippet")


def read_stream(spark: SparkSession, path: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table as a stream of parquet files. The glob fits a file and a folder alike."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}/{name}.parque[t]")


def read_log_stream(spark: SparkSession, path: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """The log as a stream, with ts as an event-time timestamp."""
    return read_stream(spark, path, name, files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir). Only a local session (tests) may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/weftline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes what this application has stored on the way; for when its results are written, as they read it."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x")).getParent()
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back, for what several steps read: pages are parsed once, not once per engine."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ttl(df: DataFrame, as_of: str, seconds: int) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return df.withColumns({"created_at": now, "expires_at": now + F.make_dt_interval(secs=F.lit(seconds))})


def write_results(df: DataFrame, path: str, keys: list[str], as_of: str, seconds: int = 1800) -> None:
    """Appends results with their expiry, each key once and none that is there already."""
    spark = df.sparkSession
    new = with_ttl(df.dropDuplicates(keys), as_of, seconds)
    try:
        new = insert_ignore(None, new, keys, spark.read.parquet(path))
    except Exception as e:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], exprs: dict[str, Column] | None = None) -> DataFrame:
    """base with the rows of delta inserted or updated by key; exprs may use old_<c> and new_<c> of an updated row."""
    columns = [c for c in base.columns if c not in keys]
    old = base.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"old_{c}") for c in columns])
    new = delta.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"new_{c}") for c in columns])
    both = old.join(new.hint("merge"), keys, "full_outer")
    picked = []
    for c in columns:
        updated = (exprs or {}).get(c, F.col(f"new_{c}"))
        picked.append(F.when(F.col("_new").isNull(), F.col(f"old_{c}")).when(F.col("_old").isNull(), F.col(f"new_{c}")).otherwise(updated).alias(c))
    return both.select(*keys, *picked)


def insert_ignore(base: DataFrame | None, delta: DataFrame, keys: list[str], existing: DataFrame | None = None) -> DataFrame:
    """base with those rows of delta whose key it lacks; without base, only the rows to insert."""
    there = existing if base is None else base
    fresh = delta.dropDuplicates(keys).join(there.select(*keys).hint("merge"), keys, "left_anti")
    return fresh if base is None else base.unionByName(fresh)


def update_rows(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the non-null columns of changes in place of its own; keys that base lacks are ignored."""
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in changes.columns if c not in keys])
    both = base.join(new.hint("merge"), keys, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changes.columns and c not in keys else F.col(c) for c in base.columns])


def append_log(df: DataFrame, path: str, stages: Column | None = None) -> None:
    """Appends audit rows with their metadata as JSON, the cache stages hit merged in."""
    meta = F.map_concat(F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("cache_stages_hit"), F.array_join(stages, ","))) if stages is not None else F.col("metadata")
    df.withColumn("metadata", F.to_json(meta)).write.mode("append").parquet(path)


def semantic_fields(fields: DataFrame) -> DataFrame:
    """Rows for the semantic field table: relevance 0.5 and category other by default, values cut at 500 characters."""
    return fields.withColumns({"relevance": F.coalesce("relevance", F.lit(0.5)), "category": F.coalesce("category", F.lit("other")), "raw_value": F.substring("raw_value", 1, 500)})


def penalty_patterns(candidates: DataFrame, least: float = 50) -> DataFrame:
    """Failed patterns: cached URLs that scored under least, or every candidate of a request of which none was good enough."""
    best = candidates.groupBy("request_id").agg(F.max("score").alias("best"))
    df = candidates.join(best.hint("merge"), "request_id")
    bad = df.where(((F.col("source") == "cache") & (F.col("score") < least)) | (F.col("best") < least))
    return bad.select("request_id", F.col("url").alias("pattern"), F.greatest(F.lit(-1.0), -F.col("score") / 100).alias("confidence"), F.lit("failed").alias("status"))


def diagnostics(requests: DataFrame, eav: DataFrame, chosen: DataFrame, confidence: DataFrame, longest: int = 200) -> DataFrame:
    """A nested row per page for write_diagnostics: request_id, site, url, signals (number of keys, engines, score), field_discovery (the sorted key
    inventory), engine_results (name, confidence, fields_count, field_keys of each engine) and final_fields (key to value, cut at longest characters).

    requests: page_id, request_id, site, url, score; eav: page_id, engine, key, value; chosen: page_id, key, value, engine; confidence: page_id, engine, confidence.
    """
    held = eav.where("value is not null")
    per = held.groupBy("page_id", "engine").agg(F.array_sort(F.collect_set("key")).alias("field_keys")).join(confidence.select("page_id", "engine", "confidence").hint("merge"), ["page_id", "engine"], "left")
    result = F.struct(F.col("engine").alias("name"), "confidence", F.size("field_keys").alias("fields_count"), "field_keys")
    engines = per.groupBy("page_id").agg(F.array_sort(F.collect_list(result)).alias("engine_results"), F.array_distinct(F.flatten(F.collect_list("field_keys"))).alias("_keys"))
    short = F.when(F.length("value") > longest, F.concat(F.substring("value", 1, longest), F.lit("..."))).otherwise(F.col("value"))
    fields = chosen.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", short.alias("v"))))).alias("final_fields"))
    df = requests.join(engines.hint("merge"), "page_id", "left").join(fields.hint("merge"), "page_id", "left")
    used = F.transform(F.coalesce("engine_results", F.array().cast("array<struct<name:string,confidence:double,fields_count:int,field_keys:array<string>>>")), lambda e: e["name"])
    signals = F.struct(F.coalesce(F.size("_keys"), F.lit(0)).alias("n_keys"), used.alias("engines"), F.col("score").alias("relevance_score"))
    return df.select("request_id", "site", "url", signals.alias("signals"), F.array_sort(F.coalesce("_keys", F.array().cast("array<string>"))).alias("field_discovery"), "engine_results", "final_fields")


def write_diagnostics(df: DataFrame, path: str) -> None:
    """A JSON dataset per site; a column value is cut at 200 characters."""
    if "value" not in df.columns:
        df.write.mode("append").partitionBy("site").json(path)
        return
    df.withColumn("value", F.substring("value", 1, 200)).write.mode("append").partitionBy("site").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV per site with Field, Value, Category, Source; quotes are doubled."""
    df.select("site_domain", F.col("field").alias("Field"), F.col("value").alias("Value"), F.col("category").alias("Category"), F.col("source").alias("Source")).write.mode("overwrite").partitionBy("site_domain").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
