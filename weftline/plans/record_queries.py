"""Queries on sources and sinks, records, fields, policies and selections; orders are requests, part and lineitem hold their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import intents, registry, text, urls
from weftline.operators import caches, candidates, dom, engines, oplog, records, robots, unify, vectors
from weftline.plans.record_sql import ORACLES  # noqa: F401
from weftline.sources import tables
from weftline.streaming import jobs

AS_OF = "2024-01-10 00:00:00"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read_state(spark, d, name)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- sources and sinks


def state_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_state(spark, d, "orders", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F'")


def page_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pages whole and, as a service would cap them, cut."""
    cut = tables.read_pages(spark, d, 500).select("page_id", F.md5("html").alias("cut_md5"))
    return tables.read_pages(spark, d).select("page_id", F.length("html").alias("n_chars")).join(cut.hint("merge"), "page_id")


def domain_fields(spark: SparkSession, d: str) -> DataFrame:
    """A domain's config for each part, broken for every seventh."""
    good = F.to_json(F.struct(F.create_map(F.col("p_brand"), F.lit("brand"), F.lit("kind"), F.col("p_type")).alias("field_map"), F.lit(1).alias("version")))
    parts = _t(spark, d, "part").select(_text("d", F.col("p_partkey")).alias("name"), F.when(F.col("p_partkey") % 7 == 0, '{"field_map": {').otherwise(good).alias("config"))
    return tables.domain_config(parts)


def active_sites(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    domains = _t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, "active").otherwise("paused").alias("status"), F.when(k % 5 != 0, F.array(_text("a", k, ".com"), _text("b", k, ".com"))).alias("allowed_sites"))
    return tables.active_domains(domains)


def robots_texts(spark: SparkSession, d: str) -> DataFrame:
    """A cached file for each page's site, living up to two days, else the fetched one."""
    p = _t(spark, d, "pages").select(urls.netloc(F.col("url")).alias("site"), "page_id")
    made = F.lit("2024-01-09 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("page_id"))
    cache = p.select("site", _text("cached ", F.col("page_id")).alias("raw"), made.alias("created_at"), (made + F.make_dt_interval(days=F.col("page_id") % 3)).alias("expires_at"))
    return robots.robots_source(cache, p.select("site", F.lit("fetched").alias("raw")).distinct(), AS_OF)


def serp_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    row = lambda i: F.struct(F.when((k + i) % 3 != 0, _text("https://r.example/", k, f"/{i}")).alias("link"), _text(f"title {i} ", k).alias("title"), F.lit("s").alias("snippet"))
    results = _t(spark, d, "orders").select(k.alias("request_id"), F.to_json(F.struct(F.array(*[row(i) for i in range(4)]).alias("organic"))).alias("payload"))
    return tables.serp_source(results, 3)


def results_written(spark: SparkSession, d: str) -> DataFrame:
    """Results of finished requests, then of all requests: each is there once, with the expiry of its batch."""
    o, path = _t(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), "o_orderstatus", "o_totalprice"), tables.scratch(spark, "results")
    for rows, as_of in ((o.where("o_orderstatus = 'F'"), "2024-01-01 00:00:00"), (o, "2024-01-02 00:00:00")):
        tables.write_results(rows.drop("o_orderstatus"), path, ["request_id"], as_of, 3600)
    return spark.read.parquet(path).select("request_id", "o_totalprice", F.date_format("expires_at", "yyyy-MM-dd HH:mm").alias("expires"))


def log_written(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch(spark, "log")
    e = _t(spark, d, "events").select("event_id", F.create_map(F.lit("type"), F.col("event_type")).alias("metadata"), F.when(F.col("event_type") == "error", F.array(F.lit("L1"), F.lit("L2"))).otherwise(F.array().cast("array<string>")).alias("stages"))
    tables.append_log(e, path, F.col("stages"))
    return spark.read.parquet(path).select("event_id", "metadata")


def diagnostics_written(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch(spark, "diagnostics")
    tables.write_diagnostics(_t(spark, d, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("key"), F.col("text").alias("value")), path)
    return spark.read.schema("key long, value string, site string").json(path)


def diagnostics_nested(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pages with two engines' fields, written as nested diagnostics and read back."""
    path = tables.scratch(spark, "nested")
    p = _t(spark, d, "part").withColumn("page_id", F.col("p_partkey"))
    pair = lambda engine, key, value: F.struct(F.lit(engine).alias("engine"), F.lit(key).alias("key"), value.alias("value"))
    rows = F.array(pair("json_ld", "name", F.repeat("p_name", F.when(F.col("p_partkey") % 2 == 0, 20).otherwise(1))), pair("json_ld", "brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))), pair("heuristic", "text:Size", F.col("p_size").cast("string")), pair("heuristic", "name", F.col("p_type")))
    eav = p.where("p_partkey % 5 <> 0").select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")
    chosen = eav.where("value is not null").groupBy("page_id", "key").agg(F.max_by("value", "engine").alias("value"), F.max("engine").alias("engine"))
    confidence = eav.select("page_id", "engine").distinct().withColumn("confidence", F.when(F.col("engine") == "json_ld", 0.95).otherwise(0.5))
    requests = p.select("page_id", F.col("p_partkey").alias("request_id"), F.concat(F.lit("s"), (F.col("p_size") % 10).cast("string")).alias("site"), F.lit("u").alias("url"), (F.col("p_size") / 50).alias("score"))
    df = tables.diagnostics(requests, eav, chosen, confidence)
    tables.write_diagnostics(df, path)
    back = spark.read.schema(df.schema).json(path)
    names = F.array_join(F.transform("engine_results", lambda e: F.concat(e["name"], F.lit(":"), e["fields_count"].cast("string"), F.lit(":"), F.array_join(e["field_keys"], "+"))), " ")
    return back.select("request_id", "site", F.col("signals.n_keys").alias("n_keys"), F.array_join("field_discovery", ",").alias("keys"), F.coalesce(names, F.lit("")).alias("engines"), F.coalesce(F.col("final_fields")["name"], F.lit("")).alias("name"))


def csv_written(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch(spark, "csv")
    p = _t(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("site_domain"), _text('"', F.col("p_name"), '", ', F.col("p_partkey")).alias("field"), F.col("p_type").alias("value"), F.lit("a,b").alias("category"), F.col("p_brand").alias("source"))
    tables.export_csv(p, path)
    return spark.read.option("header", True).option("escape", '"').schema("Field string, Value string, Category string, Source string, site_domain string").csv(path)


def semantic_rows(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 0.9).alias("relevance"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("category"), F.col("text").alias("raw_value"))
    return tables.semantic_fields(df).select("doc_id", "relevance", "category", F.md5("raw_value").alias("value_md5"))


# ---- values and records


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """part as records: a map of text fields, some of them blank or missing."""
    k = F.col("p_partkey")
    fields = F.map_filter(
        F.create_map(
            F.lit("_heading"), F.when(k % 4 == 0, "  ").otherwise(F.lit("")), F.lit("name"), F.when(k % 3 != 0, F.concat(F.lit(" "), F.col("p_name"))), F.lit("title"), F.concat(F.col("p_name"), F.lit("  ")), F.lit("director"), F.concat(F.lit(" "), F.col("p_brand")),
            F.lit("genre"), F.when(k % 5 != 0, F.col("p_type")), F.lit("source_url"), F.lit("u"), F.lit("meta:size"), F.col("p_size").cast("string"), F.lit("query_answer"), F.when(k % 2 == 0, "an answer"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return _t(spark, d, "part").select(k.alias("id"), fields.alias("fields"))


def picked_titles(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("id", text.pick_title(F.col("fields")).alias("title"))


def trimmed_fields(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("id", F.explode(text.trim_fields(F.col("fields"))).alias("key", "value")).where("key in ('title', 'director', 'name')")


def signed_confidences(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12 - 0.1).alias("c"), (F.col("l_returnflag") == "R").alias("failed"))
    return li.groupBy("failed", F.round(urls.signed_confidence(F.col("c"), F.col("failed")), 4).alias("confidence")).agg(F.count("*").alias("n"))


def display_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    names = _text('["a", {"name": "', F.col("p_name"), '"}]')
    json = F.when(k % 5 == 0, _text('{"ratingValue": "', F.col("p_size"), '"}')).when(k % 5 == 1, _text('{"ratingValue": "', F.col("p_size"), '", "ratingCount": "', k, '"}')).when(k % 5 == 2, _text('{"name": "', F.col("p_name"), '", "x": 1}')).when(k % 5 == 3, names).otherwise(F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", text.display_value(json).alias("shown"))


def display_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, _text('{"ratingValue": "', F.col("p_size"), '"}')).when(k % 3 == 1, _text('{"ratingValue": "', F.col("p_size"), '", "bestRating": "50"}')).when(k % 11 != 0, F.col("p_name"))
    eav = _t(spark, d, "part").select("p_partkey", F.when(k % 7 == 0, "_hidden").when(k % 2 == 0, "meta:unit_price-net").otherwise("text:SIZE of it").alias("key"), value.alias("value"))
    return records.display_rows(eav).select("p_partkey", "label", "shown")


def previews(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", *[text.preview(F.col("text"), n).alias(f"p{n}") for n in (20, 120)])


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    words = F.when(k % 3 == 0, F.array(F.lit("cast"), F.lit("plot"), F.lit("year"), F.lit("more"))).otherwise(F.array().cast("array<string>"))
    title = F.when(k % 4 != 0, F.col("p_name")).otherwise(" ")
    return _t(spark, d, "part").select("p_partkey", text.build_search_query(title, F.when(k % 2 == 0, F.col("p_size")), words, F.col("p_type")).alias("query"))


def expanded_queries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    asked = F.array(_text(F.col("p_name"), " site:a.com"), F.col("p_name"), F.when(k % 2 == 0, F.col("p_type")).otherwise(" site:b.com "), F.when(k % 3 == 0, F.col("p_brand")).otherwise(""))
    return _t(spark, d, "part").select("p_partkey", F.array_join(text.clean_expanded(asked, F.lit("raw")), "|").alias("queries"))


def multi_items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    intent = F.to_json(F.struct(F.when(k % 3 != 0, "T").alias("title"), F.when(k % 4 == 0, k % 3).alias("limit"), (k % 5 == 0).alias("comparison")))
    df = _t(spark, d, "orders").select(k.alias("request_id"), intent.alias("intent"), F.when(k % 2 == 0, "list").otherwise("details").alias("query_type"), (k % 2 + 1).alias("n_sites"))
    df = df.withColumn("cap", intents.capabilities(F.col("intent"), F.col("n_sites"))).withColumn("plan", intents.strategy(F.col("cap"), F.col("n_sites")))
    return df.select("request_id", intents.is_multi_item(F.col("cap"), F.col("plan"), F.col("query_type")).alias("multi"))


def _eav(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as extracted fields of requests, a key per ship quarter and flag."""
    li = _t(spark, d, "lineitem")
    key = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "meta:").otherwise(""), F.lit("k"), F.quarter("l_shipdate").cast("string"), F.when(F.col("l_linestatus") == "F", ".sub").otherwise(""))
    return li.select(F.col("l_orderkey").alias("request_id"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("_"), key)).otherwise(key).alias("key"), F.col("l_linenumber").alias("ord"), F.round("l_tax", 2).cast("string").alias("value"))


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    """k1 to k3 by the quarters of orders; k4 has no field."""
    q = _t(spark, d, "orders").select(F.quarter("o_orderdate").alias("q")).distinct().where("q < 4")
    return q.select(_text("k", F.col("q")).alias("alias"), _text("field", F.col("q") % 2).alias("schema_field"))


def mapped_aliases(spark: SparkSession, d: str) -> DataFrame:
    return unify.map_aliases(_eav(spark, d), _aliases(spark, d)).groupBy("key", "schema_field").agg(F.count("*").alias("n"))


def semantic_completeness(spark: SparkSession, d: str) -> DataFrame:
    return unify.semantic_completeness(_eav(spark, d), _aliases(spark, d), 3, ["request_id"])


def field_completeness(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("title", "name", "genre", "year")])
    return _fields(spark, d).select("id", unify.completeness(F.map_keys("fields"), wanted).alias("completeness"))


def core_fields(spark: SparkSession, d: str) -> DataFrame:
    spec = _t(spark, d, "part").select(F.col("p_name").alias("field"), F.when(F.col("p_size") > 40, "core").otherwise("common").alias("tier"))
    return records.fields_by_tier(spec, "core").groupBy("field").agg(F.count("*").alias("n"))


def answer_records(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("id", F.explode(records.answer_record(F.col("fields"))).alias("key", "value"))


def cached_responses(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 9 != 0, _text('{"b": ', F.col("o_custkey"), ', "a": "x"}')).otherwise("{broken").alias("unified_data"), F.array(F.lit("a.com")).alias("source_sites"), F.lit(0.5).alias("confidence"), F.col("o_orderpriority").alias("raw_query"))
    return records.cache_response(o, "exact").select("request_id", "data", "original_query", "match_type")


def simple_confidences(spark: SparkSession, d: str) -> DataFrame:
    many = F.size(F.filter(F.map_keys("fields"), lambda k: k.startswith("meta:")))
    return _fields(spark, d).select("id", unify.simple_confidence(F.col("fields")).alias("confidence"), unify.list_confidence(many).alias("list_confidence"))


def found_fields(spark: SparkSession, d: str) -> DataFrame:
    missing = F.array(F.lit("size"), F.col("p_brand"), F.col("p_type"))
    still = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("size"), F.col("p_brand"))).otherwise(F.array(F.lit("size")))
    return _t(spark, d, "part").select("p_partkey", F.array_join(unify.fields_found(missing, still), ",").alias("found"))


# ---- policies and checks


def policy_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Orders under the standard rule and a rule of a user's own."""
    registry.RULES.pop("orders", None)
    registry.register_rule("orders", registry.domain_policy("5-LOW", 0.3, 4))
    registry.register_rule("orders", lambda: F.when(F.col("price") > 300_000, F.lit("too dear")))
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("domain"), (F.col("o_custkey") % 10 / 10).alias("confidence"), (F.col("o_orderkey") % 7).alias("n_sites"), F.col("o_totalprice").alias("price"))
    return registry.denied(o, "orders").groupBy("domain", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def rejected_sites(spark: SparkSession, d: str) -> DataFrame:
    sites = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("site")).distinct()
    signals = _t(spark, d, "supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").alias("site"), (F.col("s_acctbal") > 5000).alias("accessible"))
    return records.reject_inaccessible(sites, signals).select("site", "status")


def _intents(spark: SparkSession, d: str) -> DataFrame:
    """pages with an intent that names their host's first label as title, a digit as year and a language."""
    n, host = F.col("page_id"), urls.netloc(F.col("url"))
    title = F.initcap(F.regexp_extract(host, r"^([^.]*)", 1))
    language = F.get(F.array(F.lit("English"), F.lit("german"), F.lit("FRENCH"), F.lit(None).cast("string")), (n % 4).cast("int"))
    intent = F.to_json(F.struct(F.when(n % 5 != 0, title).alias("title"), F.when(n % 3 == 0, n % 10).alias("year"), F.when(n % 2 == 0, language).alias("language"), F.when(n % 2 == 1, F.struct(language.alias("language"))).alias("filters")))
    return _t(spark, d, "pages").select("page_id", "url", host.alias("site"), intent.alias("intent"), F.when(n % 7 != 0, title).otherwise("Another").alias("entity_title"))


def url_matches(spark: SparkSession, d: str) -> DataFrame:
    return _intents(spark, d).select("page_id", intents.url_matches_intent(F.col("url"), F.col("intent"), F.col("entity_title")).alias("matches"))


def url_cache(spark: SparkSession, d: str) -> DataFrame:
    """Requests for a page meet the cached URLs of its site; the best of five that is allowed and fits the intent."""
    p = _intents(spark, d).withColumns({"domain": F.lit("web"), "version": F.lit("1")})
    requests = p.select(F.col("page_id").alias("request_id"), "domain", "site", "version", F.lit("T").alias("entity_title"), F.regexp_replace("intent", '"title":"[^"]*"', '"title":"t"').alias("intent"))
    patterns = p.select("domain", "site", "version", F.lit("T").alias("entity_title"), F.col("url").alias("pattern"), (F.col("page_id") % 11 / 10).alias("confidence"), (F.col("page_id") % 5 == 0).alias("blocked"))
    return caches.url_cache(requests, patterns).select("request_id", "pattern", "confidence")


def cache_rows_ok(spark: SparkSession, d: str) -> DataFrame:
    """Each order's intent against that of the customer's cached row."""
    o, k, c = _t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    ask = F.to_json(F.struct(F.when(k % 3 == 0, k % 4 + 2000).alias("year"), F.when(k % 5 == 0, "English ").when(k % 5 == 1, "french").alias("language")))
    have = F.to_json(F.struct(F.when(c % 3 == 0, c % 4 + 2000).alias("year"), F.when(c % 2 == 0, "english").alias("language")))
    wanted = F.when(k % 2 == 0, F.array(_text("s", k % 3))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", intents.cache_row_ok(ask, have, wanted, F.array(_text("s", c % 3), F.lit("s0"))).alias("ok"))


def robots_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("status_code", F.get(F.array(*[F.lit(x) for x in (200, 404, 429, 503, 500)]), (F.col("event_id") % 5).cast("int")))
    return e.groupBy("event_type", robots.robots_outcome().alias("outcome")).agg(F.count("*").alias("n"))


def noise_dropped(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    key = F.when(k % 3 == 0, F.concat(F.lit("nav:"), "p_brand")).when(k % 3 == 1, F.concat(F.lit("text:"), "p_name")).otherwise(F.col("p_brand"))
    value = F.when(k % 4 == 0, "short").when(k % 4 == 1, "[]").when(k % 4 == 2, F.concat_ws(" ", "p_name", "p_type", "p_brand")).otherwise("a b c d e f g h i j k l m n")
    return vectors.drop_noise(_t(spark, d, "part").select("p_partkey", key.alias("key"), value.alias("value"))).select("p_partkey", "key")


def envelope_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    out = F.to_json(F.struct(F.when(k % 6 != 0, "extract").alias("task"), F.col("o_orderpriority").alias("domain"), F.when(k % 4 == 0, "2.0").otherwise("1.0").alias("schema_version"), F.when(k % 5 != 0, F.struct(F.when(k % 3 != 0, 1).alias("score"))).alias("result"), F.when(k % 7 != 0, "0.8").alias("confidence")))
    df = _t(spark, d, "orders").select("o_orderkey", out.alias("out"))
    return df.select("o_orderkey", F.array_join(records.envelope_errors(F.col("out"), F.lit("5-LOW"), F.lit("1.0"), "score"), "; ").alias("errors"), records.envelope_confidence(F.col("out")).alias("confidence"))


def type_checks(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderpriority", F.get(F.array(*[F.lit(x) for x in ("string", "integer", "number", "null", None)]), (F.col("o_orderkey") % 5).cast("int")).alias("vtype"), F.get(F.array(*[F.lit(x) for x in ("string", "number", "string|number", None)]), (F.col("o_custkey") % 4).cast("int")).alias("wanted"))
    return o.groupBy("vtype", "wanted", unify.type_ok(F.col("vtype"), F.col("wanted")).alias("ok")).agg(F.count("*").alias("n"))


def preselected(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), "l_linenumber", (F.col("l_discount") * 10).alias("relevance"))
    return records.preselect(rows).select("request_id", "l_linenumber")


def resumable_requests(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in records.STATE_ORDER], F.lit("FAILED"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.get(names, (F.col("o_orderkey") % 9).cast("int")).alias("state"))
    return records.resumable(o).groupBy("state").agg(F.count("*").alias("n"))


def next_steps(spark: SparkSession, d: str) -> DataFrame:
    """Which requests fall back to a model or try the next URL, by how complete their fields are."""
    per = _t(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count("*") / 7).alias("completeness"), (F.max("l_linenumber") > 2).alias("multi"), F.max("l_linenumber").alias("attempts"))
    fallback = records.needs_fallback(F.col("l_orderkey") % 2 == 0, F.col("multi"), F.col("completeness"))
    return per.select("l_orderkey", fallback.alias("fallback"), records.needs_next_url(F.col("multi"), F.col("completeness"), F.col("attempts")).alias("next_url"))


def versioned(spark: SparkSession, d: str) -> DataFrame:
    return caches.same_version(_t(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("schema_version")), "2")


def stale_types(spark: SparkSession, d: str) -> DataFrame:
    """What a sweep of stale requests changes: requests, site runs and checkpoints, by kind."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("UNIFIED").alias("state"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    runs = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.when(F.col("l_linestatus") == "F", "COMPLETED").otherwise("RUNNING").alias("run_state"))
    gone, failed, points = oplog.sweep_stale(o, runs, "1997-01-01 00:00:00")
    kinds = [gone.select(F.lit("request").alias("kind"), F.col("state").alias("what")), failed.select(F.lit("run"), "run_state"), points.select(F.lit("checkpoint"), "data")]
    return kinds[0].union(kinds[1]).union(kinds[2]).groupBy("kind", "what").agg(F.count("*").alias("n"))


# ---- selections, joins and orders


def longest_values(spark: SparkSession, d: str) -> DataFrame:
    first = _t(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.lit("k").alias("key"), F.col("p_name").alias("value"))
    again = _t(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.lit("k").alias("key"), F.col("p_type").alias("value"))
    return engines.extract_longest(first, again)


def _site_fields(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey", "l_linenumber").agg(F.min("l_discount").alias("disc"), F.min("l_tax").alias("tax"))
    return li.select(F.col("l_orderkey").alias("request_id"), _text("s", F.col("l_suppkey"), ".com").alias("site_domain"), _text("key", F.col("l_linenumber")).alias("raw_field_key"), F.round(F.col("disc") * 10, 2).alias("relevance"), F.round("tax", 2).cast("string").alias("raw_value"))


def selected_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields that a user selects: each request's keys of even lines."""
    f = _site_fields(spark, d)
    return unify.select_fields(f, f.where("raw_field_key in ('key2', 'key4', 'key6')").select("request_id", "site_domain", "raw_field_key").distinct()).select("request_id", "site_domain", "raw_field_key", "relevance")


def fields_by_site(spark: SparkSession, d: str) -> DataFrame:
    df = unify.fields_by_site(_site_fields(spark, d))
    return df.select("request_id", "site_domain", F.array_join(F.transform("fields", lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("fields"))


def owned_runs(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the requests of the customer with the most orders."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"))
    user = o.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    return records.owned(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), "l_linenumber"), o, user)


def _tries(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("k"), (F.col("l_quantity") * 2).alias("score"), _text("https://x/", F.col("l_partkey")).alias("url"), F.col("l_shipdate").cast("timestamp").alias("created_at"), F.round(F.col("l_discount") * 10, 2).alias("confidence"))


def attached_selection(spark: SparkSession, d: str) -> DataFrame:
    t = _tries(spark, d).withColumn("ord", F.col("k.l_linenumber") * 1_000_000 + F.col("k.l_partkey")).drop("k")
    return candidates.attach_selected(t).select("request_id", "url", "score")


def first_urls(spark: SparkSession, d: str) -> DataFrame:
    """The first request that tried each URL."""
    t = _tries(spark, d).select("url", "request_id", F.col("k.l_linenumber").alias("line"))
    return candidates.first_wins(t, ["url"], ["request_id", "line"])


def confidence_order(spark: SparkSession, d: str) -> DataFrame:
    t = _tries(spark, d).groupBy("request_id", "confidence", "created_at").agg(F.min("url").alias("url"))
    return candidates.order_by_conf_created(t, ["request_id"], "url").select("request_id", "url", "place")


def latest_starts(spark: SparkSession, d: str) -> DataFrame:
    """The ten requests of the least price, those without a price last: an ordered report."""
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"))
    return candidates.order_nulls_last(o, "price", "o_orderkey").limit(10)


def raw_keys(spark: SparkSession, d: str) -> DataFrame:
    """What a model calls a field, met with the keys that were extracted."""
    named = _t(spark, d, "part").select((F.col("p_partkey") % 100).alias("g"), F.lower(F.substring_index("p_name", " ", -1)).alias("field")).distinct()
    eav = _t(spark, d, "part").select((F.col("p_partkey") % 100).alias("g"), F.initcap("p_name").alias("key"), F.col("p_partkey").alias("ord"))
    return records.match_raw_key(named, eav, "g").select("g", "field", "raw_key")


def same_site_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages by whether a link to the bare domain of their host stays on the site."""
    u = F.col("url")
    parent = F.concat(F.lit("https://"), F.when(F.col("page_id") % 2 == 0, urls.registrable_domain(urls.netloc(u))).otherwise(F.lit("example.org")), F.lit("/"))
    return _t(spark, d, "pages").select("page_id", urls.same_site(u, parent).alias("same"))


def link_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The three best unvisited links of each request, scored where a score is known."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("target")).agg(F.max("l_quantity").alias("score"), F.min("l_returnflag").alias("flag"))
    visited = _t(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("target"))
    return records.rank_links(li.select("page_id", "target"), li.where("flag <> 'N'").select("page_id", "target", "score"), visited).select("page_id", "target", "rank")


def log_replay(spark: SparkSession, d: str) -> DataFrame:
    """The log of the user with the most events, in order."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("request_id"), "event_id", F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    user = e.groupBy("request_id").count().orderBy(F.desc("count"), "request_id").first()["request_id"]
    return oplog.replay_log(e, user).select("event_id", "event_type")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("position"), "l_quantity", "l_returnflag", "l_tax")
    li = tables.dealt(li, "request_id").groupBy("request_id", "position").agg(F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("flag"), F.min("l_tax").alias("tax"))
    return li.select("request_id", "position", F.create_map(F.lit("q"), F.col("q").cast("string"), F.lit("flag"), "flag", F.lit("tax"), F.when(F.col("tax") > 0.01, F.round("tax", 2).cast("string"))).alias("fields"))


def intent_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    wishes = _t(spark, d, "orders").select(k.alias("request_id"), F.get(F.array(F.lit("q"), F.lit("flag"), F.lit("tax")), (k % 3).cast("int")).alias("sort_by"), F.when(k % 2 == 0, "desc").otherwise("asc").alias("sort_order"))
    return candidates.order_by_intent(_listed(spark, d), wishes).select("request_id", "position", "place")


def filtered_items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rule = lambda field, op, value, upper=None: F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), value.cast("string").alias("value"), F.lit(upper).cast("string").alias("upper"))
    rules = F.when(k % 4 == 0, F.array(rule("q", ">=", k % 40))).when(k % 4 == 1, F.array(rule("flag", "=", F.lit("n")), rule("q", "<", F.lit(30)))).when(k % 4 == 2, F.array(rule("q", "between", F.lit(10), 20), rule("tax", ">", F.lit(0.02)))).otherwise(F.array(rule("tax", "<=", F.lit(0.05))))
    filters = _t(spark, d, "orders").where(k % 5 != 0).select(k.alias("request_id"), F.explode(rules).alias("r")).select("request_id", "r.*")
    return candidates.apply_filters(_listed(spark, d), filters).select("request_id", "position")


def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of the names of small and of dear parts."""
    p = _t(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("key"), "p_size", "p_retailprice")
    a, b = p.where("p_size < 10"), p.where("p_retailprice > 1000")
    kinds = [unify.key_union(a, b).withColumn("kind", F.lit("union")), unify.key_intersect(a, b).withColumn("kind", F.lit("intersect")), unify.key_except(a, b).withColumn("kind", F.lit("except"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def tier_hits(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 50).alias("site"), (F.col("o_orderkey") % 10 / 10).alias("score"), "o_orderstatus")
    return caches.union_hits(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"))


# ---- fragments, registries, fallbacks


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    """part as cards of a listing."""
    k, name = F.col("p_partkey"), F.col("p_name")
    head = F.when(k % 3 == 0, F.format_string("<h1>Top</h1><h2><b>%s</b></h2>", name)).when(k % 3 == 1, F.format_string('<a href="/x">%s</a>', name)).otherwise("<h3>no</h3>")
    named = F.when(k % 5 == 0, F.format_string('<span itemprop="name">%s</span>', name)).otherwise("")
    json = F.when(k % 2 == 0, F.format_string('<script type="application/ld+json">{"@type":"P","brand":"%s","Kind":"json"}</script>', "p_brand")).otherwise("")
    return _t(spark, d, "part").select(k.alias("page_id"), F.concat(F.lit("<div>"), head, named, F.format_string("<p>Kind: %s</p>", "p_type"), json, F.lit("</div>")).alias("html"))


def fragment_fields(spark: SparkSession, d: str) -> DataFrame:
    fragments = tables.stored(_fragments(spark, d), "fragments")
    return engines.fragment_fields(fragments, tables.stored(dom.dom_nodes(fragments), "nodes"))


def extra_engine(spark: SparkSession, d: str) -> DataFrame:
    """An engine of a user's own, after the others: the first heading of a card; and what it adds to their merge."""
    fragments = tables.stored(_fragments(spark, d), "fragments")
    nodes = tables.stored(dom.dom_nodes(fragments), "nodes")
    engines.register_engine("headings", 9, lambda pages, nodes: nodes.where("tag = 'h1'").select("page_id", F.lit("heading").alias("key"), F.col("node_id").alias("ord"), F.trim("own_text").alias("value")))
    try:
        return engines.merge_engines(engines.extract(fragments, nodes)).where("key in ('heading', 'name')").select("page_id", "key", "value", "engine")
    finally:
        del engines.EXTRA["headings"]


def registered_operator(spark: SparkSession, d: str) -> DataFrame:
    """An operator called by the name under which it is registered."""
    registry.register("latest", lambda df: caches.latest_per_key(df, ["o_custkey"], "o_orderdate", "o_orderkey"))
    return registry.OPERATORS["latest"](_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")).select("o_custkey", "o_orderkey")


def missing_by_vector(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of ids divisible by 100 that no other vector of their label is near to, at a high threshold."""
    e = _t(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("vec"))
    fields = e.where("vec_id % 100 = 0").select("label", F.col("vec_id").alias("field"), "vec")
    return vectors.missing_fields(fields, e.select("label", F.col("vec_id").alias("key"), "vec"), "label", 0.95).select("label", "field")


def silent_sessions_stream(spark: SparkSession, d: str) -> DataFrame:
    """Event-time sessions of users that ended with six silent hours."""
    stream = jobs.stale_sessions(tables.read_log_stream(spark, d), "user_id", "6 hours", "30 days")
    out = jobs.run_all(stream, tables.scratch(spark, "sessions"), tables.scratch(spark, "state"), "complete")
    return out.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        state_scan, page_scan, domain_fields, active_sites, robots_texts, serp_rows, results_written, log_written, diagnostics_written, diagnostics_nested, csv_written, semantic_rows, picked_titles, trimmed_fields, signed_confidences,
        display_values, display_records, previews, search_queries, expanded_queries, multi_items, mapped_aliases, semantic_completeness, field_completeness, core_fields, answer_records, cached_responses,
        simple_confidences, found_fields, policy_reasons, rejected_sites, url_matches, url_cache, cache_rows_ok, robots_outcomes, noise_dropped, envelope_errors, type_checks, preselected, resumable_requests,
        next_steps, versioned, stale_types, longest_values, selected_fields, fields_by_site, owned_runs, attached_selection, first_urls, confidence_order, latest_starts, raw_keys, same_site_links, link_ranks,
        log_replay, intent_order, filtered_items, key_sets, tier_hits, fragment_fields, extra_engine, registered_operator, missing_by_vector, silent_sessions_stream,
    )
}
