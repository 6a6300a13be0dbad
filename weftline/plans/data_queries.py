"""Queries on unification, caches, robots rules, intents, vectors and extraction engines (pages rendered from part and orders)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import intents, urls
from weftline.functions import text as texts
from weftline.operators import blocks, caches, dom, engines, records, robots, unify, vectorindex, vectors
from weftline.sources.tables import dealt, parts, spread, stored

AS_OF = "1996-01-01 00:00:00"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- unification


def _items(spark: SparkSession, d: str) -> DataFrame:
    """part as items of sites (brands): name and type are the title, every other size is known."""
    title = F.concat_ws(" ", "p_name", "p_type")
    odd = F.when(F.col("p_size") % 2 == 1, F.col("p_size").cast("string"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("site"), title.alias("title"), F.create_map(F.lit("name"), title, F.lit("kind"), F.col("p_type"), F.lit("size"), odd).alias("fields"))


def unify_items(spark: SparkSession, d: str) -> DataFrame:
    return unify.unify_items(_items(spark, d), texts.norm_title(F.col("title"), nfkd=False))


def unify_sources(spark: SparkSession, d: str) -> DataFrame:
    return unify.item_sources(_items(spark, d), texts.norm_title(F.col("title"), nfkd=False))


def unify_stats(spark: SparkSession, d: str) -> DataFrame:
    return unify.unify_stats(_items(spark, d), texts.norm_title(F.col("title"), nfkd=False))


def source_facets(spark: SparkSession, d: str) -> DataFrame:
    return unify.source_facets(_items(spark, d))


def _competing(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as competing field values of requests, one site per line, weights by site."""
    li = dealt(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_tax"), "l_orderkey")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag"), F.min("l_tax").alias("tax"))
    site = F.concat(F.lit("www.S"), F.col("s").cast("string"), F.lit(".com/"))
    flag = F.when(F.col("l_linenumber") % 2 == 0, F.lower("flag")).otherwise(F.col("flag"))
    rows = li.select(F.col("l_orderkey").alias("request_id"), site.alias("site"), F.col("l_linenumber").alias("ord"), F.explode(F.create_map(F.lit("flag"), flag, F.lit("tax"), F.round("tax", 2).cast("string"))).alias("field", "value"))
    weights = _t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("site"), ((F.col("s_suppkey") % 8) * 0.05 + 0.5).alias("weight"))
    return unify.with_trust_weight(rows, weights)


def unify_fields(spark: SparkSession, d: str) -> DataFrame:
    return unify.unify_fields(_competing(spark, d), ["request_id"]).select("request_id", "field", "value", "status", "n")


def conflict_report(spark: SparkSession, d: str) -> DataFrame:
    return unify.unify_fields(_competing(spark, d), ["request_id"]).groupBy("field", "status").agg(F.count("*").alias("n"))


def weight_gap(spark: SparkSession, d: str) -> DataFrame:
    df = unify.weight_gap(_competing(spark, d), ["request_id", "field"])
    return df.groupBy("field", F.coalesce("gap", F.lit(-1.0)).alias("gap")).agg(F.count("*").alias("n"))


def value_forms(spark: SparkSession, d: str) -> DataFrame:
    """Year and rating texts in their normal forms."""
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat((F.col("p_size") / 5).cast("string"), F.lit("/10"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit("%"))).otherwise(F.col("p_size").cast("string"))
    return _t(spark, d, "part").select("p_partkey", texts.norm_rating(raw).alias("rating"), texts.norm_year(F.concat(F.lit("0"), F.col("p_size").cast("string"))).alias("year"))


def fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    keys = ["request_id", "field", "ord"]
    # an anti-join needs its sides dealt by all its keys
    rows = _competing(spark, d).select(*keys, "value").repartition(parts(_t(spark, d, "lineitem")), *keys).select("request_id", "field", "value", "ord")
    return unify.fill_gaps(rows.where("field = 'flag'"), rows, keys)


def keep_better(spark: SparkSession, d: str) -> DataFrame:
    rows = _competing(spark, d).select("request_id", "field", F.col("ord").alias("attempt"), F.col("weight").alias("confidence"), "site")
    return unify.keep_better(rows, ["request_id", "field"]).select("request_id", "field", "attempt", F.round("confidence", 4).alias("confidence"))


def request_confidence(spark: SparkSession, d: str) -> DataFrame:
    sites = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_discount") * 10).alias("confidence"))
    answers = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("request_id"), F.lit(0.9).alias("answer_confidence"))
    return unify.request_confidence(sites, answers).select("request_id", F.round("confidence", 4).alias("confidence"))


# ---- caches


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("INIT")
    return o.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("domain"), (F.col("o_custkey") % 100).alias("intent_hash"), state.alias("state"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_totalprice").alias("price"),
    )


def _cache(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).where("state = 'COMPLETED'")
    return o.withColumns({"status": F.when(F.col("request_id") % 3 == 0, "invalidated").otherwise("valid"), "expires_at": F.col("created_at") + F.expr("interval 30 days")})


def cache_exact(spark: SparkSession, d: str) -> DataFrame:
    return caches.cache_exact(_orders(spark, d).select("request_id", "domain", "intent_hash"), _cache(spark, d), ["domain", "intent_hash"], AS_OF).select("request_id", "hit")


def cache_latest_completed(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    return caches.cache_result(o.select("request_id", "domain", "intent_hash", "created_at", "price"), o, ["domain", "intent_hash"]).select("domain", "intent_hash", "request_id", "price")


def cache_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Requests meet results of equal canonical filters, whatever the key order of their JSON."""
    o = _orders(spark, d)
    ask = F.to_json(F.try_parse_json(F.format_string('{"b": %d, "a": "%s"}', "intent_hash", "domain")))
    have = F.to_json(F.try_parse_json(F.format_string('{"a":"%s","b":%d}', "domain", "intent_hash")))
    results = o.where("state = 'COMPLETED'").select(F.col("request_id").alias("result_id"), have.alias("filters"), (F.col("user_id") % 2).alias("goal"), (F.col("request_id") % 10 / 10).alias("confidence"), "created_at")
    return caches.cache_semantic(o.select("request_id", ask.alias("filters"), (F.col("user_id") % 2).alias("goal")), results).select("request_id", F.coalesce("result_id", F.lit(-1)).alias("result_id"))


def cache_two_tier(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).select("request_id", "domain", "intent_hash", (F.col("user_id") % 50).alias("site"))
    scores = _cache(spark, d).select("domain", "intent_hash", (F.col("user_id") % 50).alias("site"), (F.col("request_id") % 10 / 10).alias("score"), "status", "expires_at")
    memory = _orders(spark, d).groupBy("domain", (F.col("user_id") % 50).alias("site")).agg((F.count("*") % 10 / 10).alias("avg_score"), F.count("*").alias("query_count")).withColumn("is_valid", F.col("avg_score") >= 0.3)
    return caches.site_cache(o, scores, memory, AS_OF).select("request_id", "tier", F.coalesce("score", F.lit(-1.0)).alias("score"))


def idempotent_action(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).withColumn("idempotency_key", F.concat_ws("|", "domain", "intent_hash"))
    new = F.col("created_at") >= F.lit(AS_OF).cast("timestamp")
    return caches.idempotent_action(o.where(new).select("request_id", "idempotency_key"), o.where(~new)).select("request_id", "action")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_name", "p_type").alias("key"))


def fuzzy_keys(spark: SparkSession, d: str) -> DataFrame:
    """Trigram-similar part names; the queries are the names of ids divisible by 100, against all names."""
    p = _names(spark, d)
    return caches.fuzzy_join(p.where("id % 100 = 0"), p).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


def top_similar(spark: SparkSession, d: str) -> DataFrame:
    """For the names of ids divisible by 100 the five most similar of all, by the similarity that fuzzy_keys gives."""
    p = _names(spark, d)
    return caches.fuzzy_top(p.where("id % 100 = 0"), p.withColumn("confidence", F.col("id") % 10 / 10), digits=6).select("left_id", "right_id", "rank")


# ---- robots


def _site_urls(spark: SparkSession, d: str) -> DataFrame:
    """pages with their site and, as a rule's path, the language and first digit of the URL's path."""
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", urls.netloc(u).alias("site"), "url", F.regexp_extract(urls.path(u), "^(/[^/]*/.)", 1).alias("start"))


def _files(spark: SparkSession, d: str, version: int) -> DataFrame:
    """A robots file for each site of pages: a third of its pages disallow their start, a third allow a path under it; version 1
    drops half of those and disallows all on some sites."""
    p = _site_urls(spark, d)
    allowed = (F.col("page_id") % 3 == 1) & ((F.col("page_id") % 2 == 1) | F.lit(version == 0))
    lines = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Disallow: "), "start")).when(allowed, F.concat(F.lit("Allow: "), "start", F.lit("/x")))
    per = p.groupBy("site").agg(F.array_sort(F.collect_set(lines)).alias("lines"), (F.min("page_id") % 5 == 0).alias("odd"))
    root = F.when(F.col("odd") & F.lit(version == 1), "\nDisallow: /").otherwise("")
    raw = F.concat(F.lit("# rules\nUser-agent: a\nUser-agent: *\nDisallow:\n"), F.array_join("lines", "\n"), root, F.lit("\nSitemap: https://"), "site", F.lit("/map.xml"))
    return stored(per.select("site", raw.alias("raw")), "robots")


def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    return robots.robots_rules(_files(spark, d, 0)).select("site", "ua", "kind", "path")


def robots_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    return robots.sitemaps(_files(spark, d, 0))


def robots_check(spark: SparkSession, d: str) -> DataFrame:
    pages = _site_urls(spark, d)
    checked = robots.robots_check(pages.select("site", "url").distinct(), robots.robots_rules(_files(spark, d, 0)))
    return pages.join(checked.hint("merge"), ["site", "url"]).select("page_id", "blocked", F.coalesce("blocking_path", F.lit("")).alias("blocking_path"))


def robots_longest(spark: SparkSession, d: str) -> DataFrame:
    """pages under robots files with patterns made of them: starts, anything with a digit at its end, queries, and longer allowed starts."""
    p = _site_urls(spark, d)
    k = F.col("page_id") % 6
    digit = F.substring("start", -1, 1)
    line = (
        F.when(k == 0, F.concat(F.lit("Disallow: "), "start")).when(k == 1, F.concat(F.lit("Disallow: /*"), digit, F.lit("$"))).when(k == 2, F.concat(F.lit("Allow: "), "start", F.lit("*/")))
        .when(k == 3, F.lit("Disallow: /*?*page=")).when(k == 4, F.concat(F.lit("Allow: "), F.regexp_extract("start", "^(/[^/]*/)", 1), F.lit("*"), digit))
    )
    per = p.groupBy("site").agg(F.array_sort(F.collect_set(line)).alias("lines"))
    raw = F.concat(F.lit("User-agent: bot\nUser-agent: *\nDisallow:\n"), F.array_join("lines", "\n"), F.lit("\nUser-agent: other\nDisallow: /"))
    rules = robots.robots_groups(stored(per.select("site", raw.alias("raw")), "robots"))
    checked = robots.robots_longest(p.select("site", "url").distinct(), rules, "Bot")
    return p.join(checked.hint("merge"), ["site", "url"]).select("page_id", "allowed", F.coalesce("rule", F.lit("")).alias("rule"))


def fully_blocked(spark: SparkSession, d: str) -> DataFrame:
    return robots.fully_blocked(robots.robots_rules(_files(spark, d, 1)))


def newly_disallowed(spark: SparkSession, d: str) -> DataFrame:
    return robots.newly_disallowed(robots.robots_rules(_files(spark, d, 0)), robots.robots_rules(_files(spark, d, 1)))


def invalidate_patterns(spark: SparkSession, d: str) -> DataFrame:
    patterns = _site_urls(spark, d).select("page_id", "site", F.col("url").alias("pattern"), F.when(F.col("page_id") % 4 == 0, "failed").otherwise("valid").alias("status"))
    return robots.invalidate_patterns(patterns, robots.robots_rules(_files(spark, d, 0)).where("kind = 'disallow'")).select("page_id")


# ---- intents


def _intents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("details", "list", "search", "compare", "unknown")])
    parsed = F.struct(
        F.get(kinds, (k % 5).cast("int")).alias("query_type"),
        F.when(k % 3 != 0, F.concat(F.lit("Part "), (k % 50).cast("string"))).alias("title"),
        F.when(k % 4 == 0, F.array(F.lit("A"), F.lit("B"))).alias("titles"),
        F.when(k % 7 == 1, "abc").when(k % 7 != 0, (1880 + k % 160).cast("string")).alias("year"),
        F.when(k % 6 == 0, " English").alias("language"),
        F.when(k % 5 != 1, k % 300).alias("limit"),
        (k % 8 == 0).alias("comparison"),
        F.when(k % 2 == 0, "Drama ").alias("genre"),
        F.when(k % 11 == 0, F.struct(F.struct((2000 + k % 20).alias("value")).alias("release_year"))).alias("filters"),
    )
    return _t(spark, d, "orders").select(k.alias("request_id"), F.to_json(parsed).alias("intent"), (0.5 + (k % 50) / 100).alias("confidence"), (k % 3 + 1).alias("num_sites"))


def intent_validate(spark: SparkSession, d: str) -> DataFrame:
    return _intents(spark, d).select("request_id", F.array_join(intents.intent_errors(F.col("intent")), "; ").alias("errors"))


def actionable(spark: SparkSession, d: str) -> DataFrame:
    reasons = intents.constraint_reasons(F.col("intent"), F.col("confidence"))
    return _intents(spark, d).select("request_id", F.size(reasons).cast("bigint").alias("n_reasons"), F.array_join(reasons, "; ").alias("reasons"))


def capability_strategy(spark: SparkSession, d: str) -> DataFrame:
    df = _intents(spark, d).withColumn("cap", intents.capabilities(F.col("intent"), F.col("num_sites"))).withColumn("plan", intents.strategy(F.col("cap"), F.col("num_sites")))
    return df.select("request_id", "cap.cardinality", "cap.needs_ranking", "cap.needs_filtering", "cap.needs_aggregation", "cap.single_entity_lookup", "plan.strategy", "plan.extraction_mode", "plan.unification_mode")


def semantic_key(spark: SparkSession, d: str) -> DataFrame:
    return _intents(spark, d).select("request_id", intents.semantic_key(F.col("intent"), F.lit("Movie")).alias("semantic_key"))


def intent_hash(spark: SparkSession, d: str) -> DataFrame:
    """Groups of requests whose intents differ in volatile keys only."""
    h = _intents(spark, d).select("request_id", intents.intent_hash(F.col("intent"), F.lit("movie"), F.lit("1.0")).alias("h"))
    return h.groupBy("h").agg(F.min("request_id").alias("first"), F.count("*").alias("n")).select("first", "n")


def idempotency_key(spark: SparkSession, d: str) -> DataFrame:
    key = intents.idempotency_key(F.col("o_custkey").cast("string"), F.lower("o_orderpriority"), F.lit("movie"), F.lit("1.0"), F.array(F.lit("b.com"), F.lit("a.com")))
    return _t(spark, d, "orders").select("o_orderkey", key.alias("key"))


# ---- vectors


def vector_match(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other vector of the same label for each vector of an id divisible by 100, among all."""
    e = _t(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("vec"))
    fields = e.where("vec_id % 100 = 0").select("label", F.col("vec_id").alias("field"), "vec")
    keys = e.select("label", F.col("vec_id").alias("key"), "vec")
    df = vectors.best_matches(fields, keys, "label")
    return df.select("field", "key", F.round("score", 3).alias("score"), "missing")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of ids divisible by 100 as fields, and all as keys of which every third has a value without data."""
    e = _t(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("vec"))
    value = F.when(F.col("vec_id") % 3 == 0, F.lit("short")).otherwise(F.format_string("a value of vector %d", "vec_id"))
    return e.where("vec_id % 100 = 0").select("label", F.col("vec_id").alias("field"), "vec"), e.select("label", F.col("vec_id").alias("key"), "vec", value.alias("value"))


def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vector of the same label whose value holds data, from the index in its exact mode."""
    fields, keys = _vectors(spark, d)
    df = vectorindex.vector_index(keys, "label").search(fields, 0.35, exact=True)
    return df.select("field", "key", F.round("score", 3).alias("score"), "missing")


def vector_index_copies(spark: SparkSession, d: str) -> DataFrame:
    """For vectors of ids divisible by 100, turned into near copies of all rows' vectors, the probed cells' best row: the row itself."""
    fields, keys = _vectors(spark, d)
    near = fields.select("label", (-F.col("field") - 1).alias("field"), F.transform("vec", lambda x, i: x * 2 + F.when(i == 0, 0.01).otherwise(0.0)).alias("vec"))
    df = vectorindex.vector_index(keys.drop("value"), "label").search(near, 0.9)
    return df.select("field", "key", F.round("score", 3).alias("score"), "missing")


def missing_fields_kw(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "part").select((F.col("p_partkey") % 50).alias("g"), F.col("p_name").alias("key"))
    fields = _t(spark, d, "part").select((F.col("p_partkey") % 50).alias("g"), F.lower(F.substring_index("p_type", " ", -1)).alias("field")).distinct()
    return vectors.missing_fields_kw(fields, names, "g").select("g", "field")


# ---- extraction engines on pages rendered from tables


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    """part as pages: JSON-LD, microdata, meta tags, label lines, a definition list, a section and a card list; every seventh page is bare."""
    k = F.col("p_partkey")
    name = F.col("p_name")
    full = F.concat(
        F.format_string('<html><head><title>%s</title><meta name="brand" content="%s"><meta content="%s" name="kind">', name, "p_brand", "p_type"),
        F.format_string('<meta property="og:title" content="%s"><meta property="og:type" content="%s">', name, "p_type"),
        F.format_string('<meta name="twitter:label1" content="Size"><meta name="twitter:data1" content="%d"><meta name="twitter:title" content="%s">', "p_size", name),
        F.when(k % 2 == 0, F.format_string('<script type="application/ld+json">{"@type":"Product","name":"%s","size":%d}</script>', name, "p_size")).otherwise(F.lit('<script type="application/ld+json">{bad</script>')),
        F.format_string('<script type="application/ld+json">[{"@type":"ItemList","itemListElement":[{"position":2,"item":{"name":"%s"}},{"item":{"name":"x"}}]}]</script></head><body>', name),
        F.format_string('<div itemscope itemtype="P"><span itemprop="name">%s</span><span itemprop="tag">a</span><b itemprop="tag">%s</b></div><div itemscope itemtype="P"><span itemprop="name">two</span></div>', name, "p_brand"),
        F.format_string("<p>Size: %d</p><p>size: other</p>", "p_size"),
        F.format_string("<dl><dt>Brand name</dt><dd>%s</dd><dt>None</dt></dl>", "p_brand"),
        F.format_string("<h3>Facts</h3><ul><li>Kind: %s</li><li>plain</li></ul></body></html>", "p_type"),
    )
    bare = F.concat(F.lit("<html><body>"), name, F.lit("</body></html>"))
    return spread(_t(spark, d, "part")).select(k.alias("page_id"), F.when(k % 7 == 0, bare).otherwise(full).alias("html"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return stored(dom.dom_nodes(_rendered(spark, d)), "nodes")


def _eav(spark: SparkSession, d: str) -> DataFrame:
    pages = stored(_rendered(spark, d), "rendered")
    return stored(engines.extract(pages, stored(dom.dom_nodes(pages), "nodes")), "eav")


def jsonld_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return engines.engine_jsonld(_rendered(spark, d)).where("key in ('name', 'size', '@type')").select("page_id", "key", "value")


def microdata_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return engines.engine_microdata(_nodes(spark, d)).select("page_id", "key", "value")


def opengraph_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return engines.engine_opengraph(_nodes(spark, d)).select("page_id", "key", "value")


def twitter_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return engines.engine_twitter(_nodes(spark, d)).select("page_id", "key", "value")


def meta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return engines.engine_meta(_rendered(spark, d)).select("page_id", "key", "value")


def label_value_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return engines.engine_label_value(_rendered(spark, d)).where("lower(key) = 'text:size'").select("page_id", "key", "value")


def deflist_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return engines.engine_deflist(_nodes(spark, d)).select("page_id", "key", "value")


def sections_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return engines.engine_sections(_nodes(spark, d)).select("page_id", "key", "value")


def itemlist_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return engines.items_jsonld(_rendered(spark, d)).select("page_id", "position", F.get_json_object("item", "$.name").alias("name"))


def items_microdata(spark: SparkSession, d: str) -> DataFrame:
    return engines.items_microdata(_nodes(spark, d)).select("page_id", "position", "key", "value")


def merge_engines(spark: SparkSession, d: str) -> DataFrame:
    return engines.merge_engines(_eav(spark, d))


def engine_confidence(spark: SparkSession, d: str) -> DataFrame:
    return engines.engine_confidence(_eav(spark, d))


def page_result(spark: SparkSession, d: str) -> DataFrame:
    return engines.page_result(_eav(spark, d))


def discover_fields(spark: SparkSession, d: str) -> DataFrame:
    return engines.discover_fields(_eav(spark, d)).select("page_id", F.array_join("keys", ",").alias("keys"))


def validate_extraction(spark: SparkSession, d: str) -> DataFrame:
    rows = _competing(spark, d).select("request_id", "ord", F.col("field").alias("key"), "value", F.lit("string").alias("vtype"))
    spec = _t(spark, d, "region").select(F.when(F.col("r_regionkey") == 0, "tax").otherwise(F.col("r_name")).alias("field"), F.lit("number").alias("type"))
    return unify.validate_extraction(rows, spec, ["request_id", "ord"]).select("request_id", "ord", "filled_fields", "valid", F.array_join("warnings", "; ").alias("warnings"))


from weftline.plans.data_sql import ORACLES  # noqa: E402

def dom_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.dom_blocks(_nodes(spark, d))


def selector_candidates(spark: SparkSession, d: str) -> DataFrame:
    return blocks.selector_candidates(dom.dom_nodes(_rendered(spark, d)))  # it reads the nodes once


def item_sources_chosen(spark: SparkSession, d: str) -> DataFrame:
    """Which source gives a rendered page's items."""
    pages = _rendered(spark, d)
    nodes = stored(dom.dom_nodes(pages), "nodes")
    return blocks.extract_items(engines.items_jsonld(pages), engines.items_microdata(nodes), dom.cluster_quality(dom.cluster_items(nodes))).select("page_id", "source", "n")


def field_tiers(spark: SparkSession, d: str) -> DataFrame:
    return records.tier_fields(_eav(spark, d), ["page_id"], ("og:type",)).groupBy("key", "tier").agg(F.count("*").alias("n"))


def page_recommendations(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    score = records.penalized((F.col("value") * 1.5 - 10).cast("int"), F.lit("detail_page"), F.when(F.col("event_id") % 3 == 0, "listing").when(F.col("event_id") % 3 == 1, "detail").otherwise("other"))
    return e.select(score.alias("score")).groupBy("score", records.recommend(F.col("score")).alias("advice")).agg(F.count("*").alias("n"))


def failure_stages(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).where("state = 'FAILED'")
    failure = F.when(F.col("request_id") % 5 == 0, "INVALID_SITE").when(F.col("request_id") % 5 == 1, "NETWORK_TIMEOUT")
    message = F.when(F.col("request_id") % 3 == 0, "Intent unclear").when(F.col("request_id") % 3 == 1, "policy denied")
    stage = records.failed_stage(F.coalesce(failure, F.lit("")), F.col("request_id") % 7 == 0, message)
    return o.groupBy(stage.alias("stage"), records.state_index(stage).alias("place")).agg(F.count("*").alias("n"))


def item_summaries(spark: SparkSession, d: str) -> DataFrame:
    return records.item_summaries(_items(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        unify_items, unify_sources, unify_stats, source_facets, unify_fields, conflict_report, weight_gap, value_forms, fill_gaps, keep_better, request_confidence, cache_exact, cache_latest_completed, cache_semantic,
        cache_two_tier, idempotent_action, fuzzy_keys, top_similar, robots_rules, robots_sitemaps, robots_check, robots_longest, fully_blocked, newly_disallowed, invalidate_patterns, intent_validate, actionable,
        capability_strategy, semantic_key, intent_hash, idempotency_key, vector_match, vector_index_exact, vector_index_copies, missing_fields_kw, jsonld_roundtrip, microdata_roundtrip, opengraph_roundtrip, twitter_roundtrip, meta_roundtrip,
        label_value_roundtrip, deflist_roundtrip, sections_roundtrip, itemlist_roundtrip, items_microdata, merge_engines, engine_confidence, page_result, discover_fields, validate_extraction,
        dom_blocks, selector_candidates, item_sources_chosen, field_tiers, page_recommendations, failure_stages, item_summaries,
    )
}
