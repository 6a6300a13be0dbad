"""Records and model outputs: tiers, envelopes, scores, selections and display forms, as column functions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of structured data, text keys, style words, page types, answer keys, states in order, failure stages.
STRUCTURED = ("@type", "actor", "director", "genre", "name", "dateCreated", "datePublished", "aggregateRating", "description", "image", "url", "video", "duration", "contentRating", "review", "productionCompany", "countryOfOrigin")
TEXT_KEYS = ("description", "articlebody", "headline", "name", "keywords", "articlesection")
STYLE_WORDS = (
    "color", "display", "position", "margin", "padding", "border", "font-", "width", "height", "flex", "grid", "transform", "transition", "animation", "opacity", "overflow", "z-index", "cursor", "background",
    "box-shadow", "outline", "align", "justify", "visibility", "pointer", "min-", "max-", "gap", "scale", "rotate", "inset", "top", "left", "right", "bottom", "float", "letter-spacing", "text-align",
    "text-decoration", "text-indent", "text-overflow", "text-transform", "white-space", "word-break", "line-height", "tab-size", "resize", "appearance", "fill", "shape-rendering", "will-change", "backface",
    "-webkit", "box-sizing", "list-style", "vertical-align", "border-collapse",
)
PAGE_TYPES = {"detail": "detail", "detail_page": "detail", "search_results": "list", "search": "list", "listing": "list", "list": "list", "list_page": "list"}
ANSWER_KEYS = ("@type", "actor", "director", "genre", "name", "aggregateRating", "dateCreated", "description", "image", "url", "video")
STATE_ORDER = ("INIT", "INTENT_DONE", "VALIDATED", "RELEVANCE_DONE", "PIPELINES_RUNNING", "EXTRACTION_DONE", "UNIFIED", "COMPLETED")
RUNNING_FAILURES = ("ROBOTS_BLOCKED", "BOT_PROTECTION", "PIPELINES_FAILED", "NO_VALID_URL", "ALL_SITES_BLOCKED", "NETWORK_TIMEOUT", "EXTRACTION_SCHEMA_FAIL", "DOM_STRUCTURE_CHANGED")
ENVELOPE = ("task", "domain", "schema_version", "result", "confidence")


def is_style_key(key: Column) -> Column:
    """A text: key that is a style declaration."""
    low = F.lower(key)
    words = "|".join(w.replace("-", "\\-") for w in ("--", *STYLE_WORDS))
    return low.startswith("text:") & low.rlike(f"^text:({words})")


def tier_fields(eav: DataFrame, keys: list[str], requested: tuple[str, ...] = (), most: int | None = None, longest: tuple[int, int, int] | None = None) -> DataFrame:
    """eav with tier 1 (structured or requested), 2 (text) or 3 (others); noise is out. most: others per group, longest: characters of a value by tier; all without."""
    low = F.lower("key")
    rows = eav.where((F.trim("value") != "") & ~F.col("key").startswith("_") & ~F.col("key").isin("source_url", "source_site") & ~is_style_key(F.col("key")) & ~low.rlike("^(og|twitter|meta):"))
    tier = F.when(F.col("key").isin(*STRUCTURED) | low.isin(*[r.lower() for r in requested]), 1).when(low.isin(*TEXT_KEYS), 2).otherwise(3)
    df = rows.withColumn("tier", tier)
    if most is not None:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "tier").orderBy("ord", "key"))).where((F.col("tier") < 3) | (F.col("_n") <= most)).drop("_n")
    if longest is not None:
        df = df.withColumn("value", F.substring("value", F.lit(1), F.get(F.array(*[F.lit(n) for n in longest]), F.col("tier") - 1)))
    return df


def envelope_errors(output: Column, domain: Column, version: Column, result_key: str | None = None) -> Column:
    """What is wrong with a model's JSON output, as an array of texts."""
    get = lambda p: F.get_json_object(output, f"$.{p}")
    checks = [F.when(get(k).isNull(), F.lit(f"missing key: {k}")) for k in ENVELOPE]
    checks += [F.when(get("domain") != domain, F.lit("domain mismatch")), F.when(get("schema_version") != version, F.lit("schema_version mismatch"))]
    if result_key:
        checks.append(F.when(get(f"result.{result_key}").isNull(), F.lit(f"missing key: result.{result_key}")))
    return F.array_compact(F.array(*checks))


def envelope_confidence(output: Column) -> Column:
    return F.coalesce(F.get_json_object(output, "$.confidence").try_cast("double"), F.lit(0.5))


def page_type(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in PAGE_TYPES.items() for x in (k, v)])
    return F.coalesce(names[c], c)


def penalized(score: Column, expected: Column, detected: Column) -> Column:
    """The score from 0 to 100, at most 5 where the page is of another type than expected."""
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), score))
    wrong = (page_type(expected) != page_type(detected)) & ~page_type(detected).isin("other", "error")
    return F.when(F.coalesce(wrong, F.lit(False)), F.least(clamped, F.lit(5))).otherwise(clamped)


def recommend(score: Column) -> Column:
    return F.when(score >= 90, "VALID").when(score >= 50, "RETRY").otherwise("SKIP")


def preselect(fields: DataFrame, least: float = 0.7) -> DataFrame:
    return fields.where(F.col("relevance") >= least)


def resumable(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("state").isin(*[s for s in STATE_ORDER if s not in ("INIT", "COMPLETED")]))


def needs_fallback(expected_multi: Column, is_multi: Column, completeness: Column) -> Column:
    return expected_multi & (~is_multi | (completeness < 0.35))


def needs_next_url(is_multi: Column, completeness: Column, attempts: Column) -> Column:
    return ~is_multi & (completeness < 0.70) & (attempts < 5)


def state_index(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATE_ORDER]), state).cast("int") - 1


def failed_stage(failure: Column, has_runs: Column, message: Column) -> Column:
    """The stage at which a failed request stopped: by failure class, then site runs, then words of the message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return (
        F.when(failure == "CLARIFICATION_REQUIRED", "INTENT_DONE").when(failure.isin("INVALID_SITE", "VALIDATION_FAILED"), "VALIDATED").when(failure.isin(*RUNNING_FAILURES) | has_runs, "PIPELINES_RUNNING")
        .when(has("intent", "clarification"), "INTENT_DONE").when(has("validation", "policy", "site"), "VALIDATED").otherwise("INIT")
    )


def answer_record(fields: Column) -> Column:
    """A map with the answer, suggestions, confidence and the key metadata; the whole map where there is no answer."""
    wanted = ("query_answer", "suggestions", "_qfe_confidence", *ANSWER_KEYS)
    return F.when(F.coalesce(fields["query_answer"], F.lit("")) != "", F.map_filter(fields, lambda k, v: k.isin(*wanted) & v.isNotNull())).otherwise(fields)


def cache_response(df: DataFrame, match_type: str) -> DataFrame:
    """Cached rows as responses: data as canonical JSON, sources, confidence, the original query, and how it matched."""
    return df.select("request_id", F.to_json(F.try_parse_json("unified_data")).alias("data"), "source_sites", "confidence", F.col("raw_query").alias("original_query"), F.lit(match_type).alias("match_type"))


def display_label(key: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(key, "^(text|meta):", ""), "[_-]+", " ")))


def display_rows(eav: DataFrame) -> DataFrame:
    """Shown fields: no internal keys or nulls; ratings as value / best, labels in title case."""
    rating = F.get_json_object("value", "$.ratingValue")
    shown = F.when(rating.isNotNull(), F.concat(rating, F.lit(" / "), F.coalesce(F.get_json_object("value", "$.bestRating"), F.lit("10")))).otherwise(F.col("value"))
    return eav.where(~F.col("key").startswith("_") & F.col("value").isNotNull()).withColumns({"label": display_label(F.col("key")), "shown": shown})


def item_summaries(items: DataFrame, most: int = 3) -> DataFrame:
    """(item_id, summary): the title and up to most further fields of at most 80 characters."""
    rows = items.select("item_id", "title", F.posexplode(F.map_entries("fields")).alias("i", "f")).where("f.value <> '' and length(f.value) <= 80 and f.value <> title and not startswith(f.key, '_')")
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy("item_id").orderBy("i"))).where(F.col("_n") <= most)
    extra = kept.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(": ", "f.key", "f.value").alias("t")))), lambda x: x["t"]), ", ").alias("extra"))
    return items.select("item_id", "title").join(extra.hint("merge"), "item_id", "left").select("item_id", F.concat_ws(" | ", "title", "extra").alias("summary"))


def match_raw_key(named: DataFrame, eav: DataFrame, group: str) -> DataFrame:
    """Each named field with the extracted key that it means: the equal key, else the first key that holds or is held by it."""
    keys = eav.select(group, F.col("key").alias("_key"), F.col("ord").alias("_ord"))
    both = named.join(keys.hint("merge"), group)
    a, b = F.lower("field"), F.lower("_key")
    how = F.when(a == b, 0).when(F.contains(b, a) | F.contains(a, b), 1)
    best = both.withColumn("_how", how).where("_how is not null").groupBy(group, "field").agg(F.min(F.struct("_how", "_ord", "_key")).alias("r"))
    return named.join(best.select(group, "field", F.col("r._key").alias("raw_key")).hint("merge"), [group, "field"], "left")


def rank_links(links: DataFrame, scores: DataFrame, visited: DataFrame, most: int = 3) -> DataFrame:
    """The best-scored links per page that were not visited."""
    new = links.join(scores.select("page_id", "target", "score").hint("merge"), ["page_id", "target"], "left").join(visited.select("target").hint("merge"), "target", "left_anti")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("score").desc_nulls_last(), "target"))
    return new.withColumn("rank", rank).where(F.col("rank") <= most)


def fields_by_tier(spec: DataFrame, tier: str) -> DataFrame:
    return spec.where(F.col("tier") == tier).select("field")


def owned(df: DataFrame, requests: DataFrame, user: int) -> DataFrame:
    """Rows of requests that belong to a user."""
    return df.join(requests.where(F.col("user_id") == user).select("request_id").hint("merge"), "request_id", "left_semi")


def reject_inaccessible(sites: DataFrame, signals: DataFrame) -> DataFrame:
    """sites with status rejected where their signals say they can't be reached."""
    known = signals.select("site", "accessible")
    return sites.join(known.hint("merge"), "site", "left").withColumn("status", F.when(F.col("accessible") == F.lit(False), "rejected").otherwise("candidate"))
