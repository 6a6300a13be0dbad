"""Column functions on parsed intents (JSON text): validation, keys, capabilities and strategy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import norm_title_ascii

#: Keys that vary for one and the same intent, query kinds, and flat filter fields.
VOLATILE = ("raw_query", "_is_single_entity", "_expanded_queries", "query_type")
QUERY_TYPES = ("details", "list", "search", "compare", "collection", "comparison", "discovery")
FLAT_FILTERS = ("year", "language", "genre", "director", "actor", "min_rating", "country")
#: Languages and their codes in URLs.
URL_LANGUAGES = {
    "hindi": "hi", "english": "en", "tamil": "ta", "telugu": "te", "malayalam": "ml", "kannada": "kn", "bengali": "bn", "marathi": "mr", "french": "fr", "spanish": "es", "german": "de", "japanese": "ja", "korean": "ko", "chinese": "zh",
}
CONSTRAINTS = ("title", "titles", "year", "year_range", "language", "genre", "genres", "director", "actor", "sort_by")


def get(intent: Column, path: str) -> Column:
    """The text at a path; null where it is absent or null."""
    return F.get_json_object(intent, f"$.{path}")


def _truthy(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", "0", "false", "[]", "{}")


def _low(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.lower(c)), F.lit("")) for c in options])


def _errors(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def filter_value(intent: Column, name: str) -> Column:
    """A filter's value, plain or under value."""
    plain = get(intent, f"filters.{name}")
    return F.when(plain.startswith("{"), get(intent, f"filters.{name}.value")).otherwise(plain)


def intent_year(intent: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (filter_value(intent, "release_year"), filter_value(intent, "year"), get(intent, "year"))], F.lit(""))


def intent_language(intent: Column) -> Column:
    return F.coalesce(_low(get(intent, "filters.language"), get(intent, "language")), F.lit(""))


def semantic_key(intent: Column, domain: Column) -> Column:
    """Eight slots joined by |, _ for empty ones. The intent is parsed once."""
    i = F.from_json(intent, "struct<entity:string,title:string,year:string,language:string,genre:string,limit:string,primary_goal:string,filters:map<string,string>>")
    of = lambda name: i["filters"][name]
    plain = lambda name: F.when(of(name).startswith("{"), F.get_json_object(of(name), "$.value")).otherwise(of(name))
    slots = (
        F.nullif(F.lower(F.trim(domain)), F.lit("")),
        _low(i["entity"]),
        F.coalesce(*[F.nullif(c, F.lit("")) for c in (plain("release_year"), plain("year"), i["year"])]),
        _low(of("language"), i["language"]),
        _low(i["title"]),
        _low(of("genre"), i["genre"]),
        F.nullif(F.nullif(i["limit"], F.lit("0")), F.lit("")),
        _low(i["primary_goal"]),
    )
    return F.concat_ws("|", *[F.coalesce(s, F.lit("_")) for s in slots])


def stable_intent(intent: Column) -> Column:
    """The intent's canonical text (keys sorted) without the volatile keys."""
    fields = F.map_filter(F.from_json(intent, "map<string,string>"), lambda k, v: ~k.isin(*VOLATILE))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def intent_hash(intent: Column, domain: Column, version: Column) -> Column:
    return F.sha2(F.concat_ws("|", stable_intent(intent), domain, version), 256)


def idempotency_key(user: Column, query: Column, domain: Column, version: Column, sites: Column) -> Column:
    return F.sha2(F.concat_ws("|", user, query, domain, version, F.concat_ws(",", F.array_sort(sites))), 256)


def intent_errors(intent: Column, limit_max: int = 250) -> Column:
    """Schema and range errors, as an array of texts."""
    kind, year, limit = get(intent, "query_type"), get(intent, "year"), get(intent, "limit").try_cast("int")
    number = year.try_cast("int")
    return _errors(
        F.when(kind.isNull(), F.lit("Schema validation: 'query_type' is a required property")).when(~kind.isin(*QUERY_TYPES), F.concat(F.lit("Schema validation: '"), kind, F.lit("' is not a known query_type"))),
        F.when(year.isNotNull() & number.isNull(), F.concat(F.lit("Invalid year value: "), year)),
        F.when((number < 1888) | (number > 2030), F.concat(F.lit("Year "), number.cast("string"), F.lit(" out of valid range (1888-2030)"))),
        F.when((limit < 1) | (limit > limit_max), F.concat(F.lit("Limit "), limit.cast("string"), F.lit(f" out of valid range (1-{limit_max})"))),
    )


def constraint_reasons(intent: Column, confidence: Column) -> Column:
    """Why an intent is not actionable, as an array of texts."""
    kind = get(intent, "query_type")
    filters = F.from_json(get(intent, "filters"), "map<string,string>")
    has = F.exists(F.array(*[_truthy(get(intent, c)) for c in CONSTRAINTS]), lambda x: x) | (F.coalesce(F.size(F.map_filter(filters, lambda k, v: v.isNotNull())), F.lit(0)) > 0)
    titles = F.coalesce(F.json_array_length(get(intent, "titles")), F.lit(0))
    return _errors(
        F.when(~_truthy(F.coalesce(kind, F.lit(""))), F.lit("query_type is missing")),
        F.when(confidence < 0.75, F.concat(F.lit("confidence "), F.format_string("%.2f", confidence), F.lit(" is below 0.75 threshold"))),
        F.when((kind == "details") & ~_truthy(F.coalesce(get(intent, "title"), F.lit(""))), F.lit("title is required for detail queries")),
        F.when((kind == "compare") & (titles < 2), F.lit("compare queries need at least 2 titles")),
        F.when(kind.isin("list", "search") & ~has, F.lit("query is too broad — specify at least a year, language, genre, director, or title")),
    )


def active_filters(intent: Column) -> Column:
    """map of filters in force: rich ones with a value, then flat fields, then a year range."""
    rich = F.map_filter(F.coalesce(F.from_json(get(intent, "filters"), "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (~v.startswith("{") | F.get_json_object(v, "$.value").isNotNull()))
    flat = F.map_filter(F.create_map(*[x for f in FLAT_FILTERS for x in (F.lit(f), get(intent, f))]), lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(rich), k))
    both = F.map_concat(rich, flat)
    span = get(intent, "year_range")
    bound = F.coalesce(F.get_json_object(span, "$.from"), F.get_json_object(span, "$.to")).isNotNull()
    free = ~F.array_contains(F.map_keys(both), "year") & ~F.array_contains(F.map_keys(both), "release_year")
    return F.when(bound & free, F.map_concat(both, F.create_map(F.lit("year_range"), span))).otherwise(both)


def capabilities(intent: Column, num_sites: Column) -> Column:
    """The capability vector as a struct."""
    title, titles = get(intent, "title").isNotNull(), F.coalesce(F.json_array_length(get(intent, "titles")), F.lit(0)) > 0
    compare = F.coalesce(get(intent, "comparison") == "true", F.lit(False))
    limit = get(intent, "limit")
    ranking = get(intent, "ranking_strategy").isNotNull() | get(intent, "ranking.strategy").isNotNull() | get(intent, "sort_by").isNotNull()
    return F.struct(
        F.when(title & ~titles, "single").otherwise("multiple").alias("cardinality"),
        (ranking | limit.isNotNull()).alias("needs_ranking"),
        (F.size(active_filters(intent)) > 0).alias("needs_filtering"),
        limit.isNotNull().alias("needs_limit"),
        (compare & (num_sites > 1)).alias("needs_aggregation"),
        compare.alias("needs_cross_site_alignment"),
        (title & ~compare & ~titles).alias("single_entity_lookup"),
        limit.try_cast("int").alias("limit_value"),
    )


def strategy(cap: Column, num_sites: Column) -> Column:
    """The execution strategy of a capability vector, as a struct."""
    single, merge = cap["single_entity_lookup"], cap["needs_aggregation"]
    several = (cap["cardinality"] == "multiple") & merge
    return F.struct(
        F.when(single & ~merge, "entity_detail_lookup").when(single | several, "per_site_lookup_then_unify").otherwise("search_endpoint_lookup").alias("strategy"),
        F.when(single, "direct").otherwise("search").alias("url_pattern_hint"),
        F.when(single, "detail_page").otherwise("list_page").alias("expected_page_type"),
        F.when(single, "single_item").otherwise("multi_item").alias("extraction_mode"),
        F.when(merge, "cross_site_merge").when(num_sites > 1, "best_source").otherwise("single_source").alias("unification_mode"),
        cap["limit_value"].alias("post_extraction_limit"),
        cap["needs_ranking"].alias("needs_sort"),
    )


def is_multi_item(cap: Column, plan: Column, query_type: Column) -> Column:
    """Whether several items are expected; detail strategies say no."""
    many = (cap["cardinality"] == "multiple") | (query_type == "list") | F.coalesce(cap["limit_value"] > 1, F.lit(False))
    return many & ~plan["strategy"].isin("entity_detail_lookup")


def url_matches_intent(url: Column, intent: Column, entity_title: Column) -> Column:
    """Whether a cached URL serves an intent: equal titles where both are known, and year and language (name or code) in the URL."""
    low = F.lower(url)
    year, language = F.nullif(get(intent, "year"), F.lit("")), _low(get(intent, "language"), get(intent, "filters.language"))
    codes = F.create_map(*[F.lit(x) for pair in URL_LANGUAGES.items() for x in pair])
    title = F.nullif(get(intent, "title"), F.lit(""))
    same = F.nullif(entity_title, F.lit("")).isNull() | title.isNull() | (norm_title_ascii(title) == norm_title_ascii(entity_title))
    spoken = language.isNull() | F.contains(low, language) | F.contains(low, F.coalesce(codes[language], language))
    return same & (year.isNull() | F.contains(low, F.lower(year))) & spoken


def cache_row_ok(request: Column, cached: Column, wanted_sites: Column, source_sites: Column) -> Column:
    """Whether a cached row serves a request: same year or none on both sides, no other language, a site in common."""
    ly, lc = intent_language(request), intent_language(cached)
    sites = (F.size(wanted_sites) <= 0) | F.coalesce(F.arrays_overlap(wanted_sites, source_sites), F.lit(False))
    return (intent_year(request) == intent_year(cached)) & ((ly == "") | (lc == "") | (ly == lc)) & sites
