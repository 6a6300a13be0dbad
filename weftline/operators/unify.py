"""Unification across sites: conflicts by trust weight, items by normalised title, completeness, field maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.tables import small

DEFAULT_WEIGHT, WEIGHT_GAP = 0.50, 0.1
#: Keys that don't count for an item's richness.
SKIP_KEYS = ("source_url", "source_site", "_source_sites", "_position")


def clean_site(site: Column) -> Column:
    s = F.lower(site)
    for part in ("www.", "https://", "http://"):
        s = F.replace(s, F.lit(part), F.lit(""))
    return F.regexp_replace(s, "/+$", "")


def with_trust_weight(df: DataFrame, weights: DataFrame, site: str = "site") -> DataFrame:
    """df with weight from weights (site, weight), 0.50 where unknown."""
    known = weights.select(F.col("site").alias("_site"), "weight")
    return df.withColumn("_site", clean_site(F.col(site))).join(small(known), "_site", "left").withColumn("weight", F.coalesce("weight", F.lit(DEFAULT_WEIGHT))).drop("_site")


def unify_fields(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and field the value, its site and status: single, agree, agree_normalized, by_weight or conflict.

    candidates: keys, field, value (text), weight, site, ord (order of arrival). Rows of one weight combine first, before the shuffle;
    what is left of a field are its weights, of which the first two and how many rows share the first decide.
    """
    number = F.col("value").try_cast("double")
    plain = F.when(number.isNotNull(), number.cast("string")).otherwise(F.lower(F.trim("value")))
    rows = candidates.where(F.col("value").isNotNull() & ~F.col("field").isin("source_url", "source_site"))
    per = rows.groupBy(*keys, "field", "weight").agg(
        F.count("*").alias("n"),
        F.min("value").alias("v0"), F.max("value").alias("v1"), F.min(plain).alias("p0"), F.max(plain).alias("p1"),
        F.min("ord").alias("ord"),
        F.min_by(F.struct("value", "site", "weight"), "ord").alias("first"),
    )
    df = per.groupBy(*keys, "field").agg(
        F.sum("n").alias("n"),
        (F.min("v0") == F.max("v1")).alias("equal"),
        (F.min("p0") == F.max("p1")).alias("alike"),
        F.min_by("first", "ord").alias("first"),
        F.max_by("first", "weight").alias("top"),
        F.max("weight").alias("w1"),
        F.max_by("n", "weight").alias("n_top"),
        F.get(F.sort_array(F.collect_list("weight"), asc=False), F.lit(1)).alias("below"),
    )
    gap = F.round(F.col("w1") - F.when(F.col("n_top") > 1, F.col("w1")).otherwise(F.col("below")), 9)
    status = F.when(F.col("n") == 1, "single").when(F.col("equal"), "agree").when(F.col("alike"), "agree_normalized").when(gap >= WEIGHT_GAP, "by_weight").otherwise("conflict")
    df = df.withColumn("status", status).withColumn("gap", gap)
    pick = F.when(F.col("status").isin("by_weight", "conflict"), F.col("top")).otherwise(F.col("first"))
    return df.select(*keys, "field", pick["value"].alias("value"), pick["site"].alias("site"), "status", "n", "gap")


def weight_gap(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Each candidate with the weight of the next one of its key and the gap to it."""
    nxt = F.lead("weight").over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "ord"))
    return candidates.withColumn("gap", F.round(F.col("weight") - nxt, 9))


def field_count(fields: Column) -> Column:
    """Filled fields of a map<string,string> but the skipped keys."""
    return F.size(F.map_filter(fields, lambda k, v: ~k.isin(*SKIP_KEYS) & v.isNotNull() & (v != "") & (v != "[]")))


def unify_items(items: DataFrame, title: Column) -> DataFrame:
    """(norm, key, value) rows and the item's sources: items of one normalised title merged, the richest first, gaps filled.

    items: item_id, site, fields map<string,string>. Untitled items stay alone. Values are chosen by an aggregate over
    (title, key), so a title that many sites share is combined before the shuffle.
    """
    ranked = items.withColumns({"norm": title, "richness": field_count(F.col("fields"))})
    ranked = ranked.withColumn("norm", F.when(F.coalesce(F.col("norm"), F.lit("")) == "", F.concat(F.lit("__notitle_"), F.col("item_id").cast("string"))).otherwise(F.col("norm")))
    eav = ranked.select("norm", "item_id", "richness", F.explode("fields").alias("key", "value"))
    best = eav.where(F.col("value").isNotNull() & (F.col("value") != "") & ~F.col("key").isin("_source_sites", "_position"))
    values = best.groupBy("norm", "key").agg(F.min_by("value", F.struct(-F.col("richness"), "item_id")).alias("value"))
    return values


def item_sources(items: DataFrame, title: Column) -> DataFrame:
    """(norm, n_items, sources): how many items share a normalised title, and their sites, sorted and joined by commas."""
    norm = F.when(F.coalesce(title, F.lit("")) == "", F.concat(F.lit("__notitle_"), F.col("item_id").cast("string"))).otherwise(title)
    return items.groupBy(norm.alias("norm")).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("site")), ",").alias("sources"))


def unify_stats(items: DataFrame, title: Column) -> DataFrame:
    sources = item_sources(items, title)
    return sources.agg(F.sum("n_items").alias("total"), F.count("*").alias("unique_items"), (F.sum("n_items") - F.count("*")).alias("removed"))


def source_facets(items: DataFrame) -> DataFrame:
    return items.groupBy("site").agg(F.count("*").alias("n_items"))


def map_aliases(eav: DataFrame, field_map: DataFrame) -> DataFrame:
    """eav with schema_field: the alias of the key, or of its part before the first dot."""
    exact = field_map.select(F.col("alias").alias("base"), "schema_field")
    return eav.withColumn("base", F.substring_index(F.regexp_replace("key", "^(meta|text):", ""), ".", 1)).join(small(exact), "base", "left").drop("base")


def semantic_completeness(eav: DataFrame, field_map: DataFrame, n_schema: int, keys: list[str]) -> DataFrame:
    """Share of the schema's fields that the keys (without leading _) of each group map to, to 4 places."""
    mapped = map_aliases(eav.where(~F.col("key").startswith("_")), field_map)
    return mapped.groupBy(*keys).agg(F.round(F.countDistinct("schema_field") / n_schema, 4).alias("completeness"))


def request_confidence(sites: DataFrame, answers: DataFrame) -> DataFrame:
    """Mean of the sites' confidences per request, or the answer's own where there is one."""
    mean = sites.groupBy("request_id").agg(F.avg("confidence").alias("mean_confidence"))
    return mean.join(answers.select("request_id", "answer_confidence").hint("merge"), "request_id", "left").select("request_id", F.coalesce("answer_confidence", "mean_confidence", F.lit(0.0)).alias("confidence"))


def fill_gaps(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """base with those rows of extra whose keys it lacks."""
    return base.unionByName(extra.join(base.select(*keys).distinct().hint("merge"), keys, "left_anti"))


def keep_better(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The attempt of strictly greatest confidence per key; the earlier one wins a tie."""
    cols = [c for c in attempts.columns if c not in keys]
    best = attempts.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("confidence", -F.col("attempt"))).alias("r"))
    return best.select(*keys, "r.*")


def fields_by_site(fields: DataFrame) -> DataFrame:
    """Per request and site its fields by falling relevance, as an array of structs."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("_r"), "raw_field_key", "relevance", "raw_value")))
    return fields.groupBy("request_id", "site_domain").agg(F.transform(ordered, lambda x: F.struct(x["raw_field_key"].alias("key"), x["relevance"].alias("relevance"), x["raw_value"].alias("value"))).alias("fields"))


def select_fields(fields: DataFrame, selection: DataFrame) -> DataFrame:
    """The fields whose (request_id, site_domain, raw_field_key) is selected."""
    return fields.join(selection.hint("merge"), ["request_id", "site_domain", "raw_field_key"], "left_semi")


def completeness(found: Column, schema: Column) -> Column:
    """Share of the schema's keys that are found, to 4 places."""
    return F.round(F.size(F.array_intersect(found, schema)) / F.greatest(F.size(F.array_distinct(schema)), F.lit(1)), 4)


def simple_confidence(fields: Column) -> Column:
    """Confidence of a record (map<string,string>) by its filled fields, five or more being certain."""
    filled = F.size(F.map_filter(fields, lambda k, v: v.isNotNull() & ~v.isin("", "0", "false", "[]", "{}") & ~k.isin("source_url", "source_site")))
    return F.least(filled / 5, F.lit(1.0))


def list_confidence(n_items: Column) -> Column:
    """Confidence of a list of items: 0.7 if there is any."""
    return F.when(n_items > 0, 0.7).otherwise(0.0)


def fields_found(missing: Column, still_missing: Column) -> Column:
    """The fields that a further look has found: those missing before and not after."""
    return F.array_except(missing, still_missing)


def type_ok(vtype: Column, wanted: Column) -> Column:
    """Whether a value's type is one of wanted (types parted by |); an integer is a number, null fits any, and so does an unknown field."""
    types = F.split(wanted, r"\|")
    return F.coalesce(wanted.isNull() | vtype.isNull() | (vtype == "null") | F.array_contains(types, vtype) | (F.array_contains(types, F.lit("number")) & (vtype == "integer")), F.lit(True))


def key_union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [f.select("key") for f in frames]).distinct()


def key_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").intersect(b.select("key"))


def key_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").exceptAll(b.select("key")).distinct()


def validate_extraction(eav: DataFrame, spec: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: filled fields, whether valid (one at least), and warnings of types and of values over 10,000 characters.

    eav: keys, key, value, vtype; spec: field, type.
    """
    known = eav.join(small(spec.select(F.col("field").alias("key"), "type")), "key", "left")
    fits = type_ok(F.col("vtype"), F.col("type"))
    wrong = F.when(F.col("value").isNotNull() & ~fits, F.concat(F.lit("Type mismatch for '"), "key", F.lit("': expected "), "type"))
    long_ = F.when((F.length("value") > 10_000) & ~F.col("key").isin("source_url", "source_site"), F.concat(F.lit("Field '"), "key", F.lit("' value unusually long ("), F.length("value").cast("string"), F.lit(" chars)")))
    per = known.groupBy(*keys).agg(F.count_if(F.col("value").isNotNull() & ~F.col("key").isin("source_url", "source_site")).alias("filled_fields"), F.array_sort(F.concat(F.collect_list(wrong), F.collect_list(long_))).alias("warnings"))
    return per.withColumn("valid", F.col("filled_fields") >= 1)
