"""Field matching by vectors or keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key prefixes that never name a field.
NOISE_PREFIXES = (
    "a:Go to ", "a:Learn more", "a:Set your", "a:View title page for", "label:", "button:", "nav:", "aside", "li:", "li[role=", "script:", "style:", "text:",
    "div:suggestion", "div:announcement", "div[role=presentation]", "div[role=group]", "span:nav-", "span[role=presentation]", "testid:nav-", "testid:drawer",
    "testid:panel", "testid:category-", "testid:list-container", "testid:grouped-link", "ul[role=", "meta:", "og:",
)


def is_noise(key: Column) -> Column:
    out = F.lit(False)
    for p in NOISE_PREFIXES:
        out = out | key.startswith(p)
    return out


def is_meaningful(value: Column) -> Column:
    """A value that holds data: non-empty lists and objects, else 15 characters or more that don't look like a menu."""
    s = F.trim(value)
    spaces = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    nested = s.rlike(r"^[\[{]") & F.try_parse_json(s).isNotNull()
    return F.coalesce(F.when(nested, ~s.isin("[]", "{}")).otherwise((F.length(s) >= 15) & ~((spaces > 10) & (F.length(s) < 100))), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def best_matches(fields: DataFrame, keys: DataFrame, group: str, least: float = 0.65) -> DataFrame:
    """(group, field, key, score, missing): the most similar key of the field's group; missing under the threshold.

    fields: group, field, vec; keys: group, key, vec. Fields are a query set that meets all keys of its group; the best key is an
    aggregate that combines before the shuffle. A key equal to the field itself doesn't count, nor does one whose value (if keys
    have that column) holds no data. For large groups see vectorindex.
    """
    if "value" in keys.columns:
        keys = keys.where(is_meaningful(F.col("value")))
    f = fields.withColumn("fn", norm(F.col("vec"))).select(group, "field", F.col("vec").alias("fv"), "fn")
    k = keys.withColumn("kn", norm(F.col("vec"))).select(group, "key", F.col("vec").alias("kv"), "kn")
    both = f.join(k.hint("merge"), group).where("not (key <=> field)").withColumn("score", dot(F.col("fv"), F.col("kv")) / (F.col("fn") * F.col("kn")))
    best = both.groupBy(group, "field").agg(F.max_by(F.struct("key", "score"), F.struct("score", "key")).alias("r"))
    return best.select(group, "field", "r.key", F.round("r.score", 6).alias("score"), (F.col("r.score") < least).alias("missing"))


def missing_fields_kw(fields: DataFrame, keys: DataFrame, group: str) -> DataFrame:
    """The fields whose name (with _ or blanks) no key of their group contains."""
    a = fields.withColumns({"_a": F.replace(F.lower("field"), F.lit("_"), F.lit(" ")), "_b": F.lower("field")})
    k = keys.select(F.col(group).alias("_g"), F.lower("key").alias("_k")).distinct()
    found = (F.col(group) == F.col("_g")) & (F.contains("_k", F.col("_a")) | F.contains("_k", F.col("_b")))
    return a.join(k.hint("merge"), found, "left_anti").drop("_a", "_b")


def drop_noise(eav: DataFrame) -> DataFrame:
    """Rows (key, value) whose key may name a field and whose value holds data."""
    return eav.where(~is_noise(F.col("key")) & is_meaningful(F.col("value")))


def missing_fields(fields: DataFrame, keys: DataFrame, group: str, least: float = 0.65) -> DataFrame:
    """(group, field): fields that no key of their group stands for, by vectors where both sides have a column vec, else by keywords."""
    if "vec" in fields.columns and "vec" in keys.columns:
        return best_matches(fields, keys, group, least).where("missing").select(group, "field")
    return missing_fields_kw(fields, keys, group).select(group, "field")
