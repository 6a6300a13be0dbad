"""Column functions for text, titles and values. All are built-in expressions but NFKD, which goes over Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: Language names and their codes.
LANGUAGES = {"hindi": "hi", "tamil": "ta", "telugu": "te", "malayalam": "ml", "english": "en", "kannada": "kn", "bengali": "bn", "marathi": "mr", "gujarati": "gu"}
#: The keys an item's title is taken from, in order.
TITLE_KEYS = ("_heading", "name", "title", "headline", "_primary_link_text")


def clean_query(c: Column) -> Column:
    """Without tags and characters outside the printable ranges, white space collapsed, trimmed."""
    bare = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"[^\x20-\x7E\u00A0-\uFFFF]", "")
    return F.trim(F.regexp_replace(bare, _SPACES, " "))


def query_meta(raw: Column, sites: Column) -> Column:
    """Lengths before and after cleaning, and the number of sites."""
    return F.struct(F.length(raw).alias("original_length"), F.length(clean_query(raw)).alias("cleaned_length"), F.size(sites).alias("n_sites"))


def request_query(c: Column) -> Column:
    return F.lower(F.trim(c))


def normalize_sites(sites: Column) -> Column:
    """Lower-cased, trimmed, without www., only those with a dot."""
    return F.filter(F.transform(sites, lambda s: F.replace(F.trim(F.lower(s)), F.lit("www."), F.lit(""))), lambda s: F.contains(s, F.lit(".")))


def language_hints(c: Column) -> Column:
    """The languages named in the text, as structs (language, code), in the fixed order."""
    known = F.array(*[F.struct(F.lit(k).alias("language"), F.lit(v).alias("code")) for k, v in LANGUAGES.items()])
    return F.filter(known, lambda x: F.contains(F.lower(c), x["language"]))


def pick_title(item: Column, keys: tuple[str, ...] = TITLE_KEYS) -> Column:
    """The first non-blank title of a map<string,string> item; '' if none."""
    return F.coalesce(*[F.nullif(F.trim(item[k]), F.lit("")) for k in keys], F.lit(""))


def _nfkd(c: Column) -> Column:
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFKD", x))

    return F.pandas_udf(compose, "string")(c)


def norm_title(c: Column, nfkd: bool = True) -> Column:
    """A title for fuzzy comparison: entities, a trailing (year), punctuation and case gone. Only rows with other than ASCII meet Python."""
    t = F.when(c.rlike(r"[^\x00-\x7F]"), _nfkd(c)).otherwise(c) if nfkd else c
    for entity, char in (("&amp;", "&"), ("&apos;", "'"), ("&quot;", '"')):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.lower(F.regexp_replace(t, r"(?U)&#?\w+;", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"\(\d{4}\)\s*$", ""), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def norm_title_ascii(c: Column) -> Column:
    """A title for cache keys: lower case, only a-z, digits and spaces."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9 ]", ""))


def norm_year(c: Column) -> Column:
    """The year as a number in text, or the text unchanged where it is none."""
    return F.coalesce(c.try_cast("int").cast("string"), c)


def norm_rating(c: Column) -> Column:
    """x of x/10, or a bare number up to 10, as text of a double; else unchanged (percentages stay)."""
    of_ten = F.regexp_extract(F.trim(c), r"^(\d+\.?\d*)\s*/\s*10$", 1)
    bare = F.regexp_extract(F.trim(c), r"^(\d+\.?\d*)$", 1).try_cast("double")
    return F.when(of_ten != "", of_ten.try_cast("double").cast("string")).when(bare <= 10, bare.cast("string")).otherwise(c)


def trim_fields(fields: Column, keys: tuple[str, ...] = ("title", "director")) -> Column:
    """A map<string,string> with the values of the keys trimmed."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*keys), F.trim(v)).otherwise(v))


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def display_value(json: Column) -> Column:
    """A nested value for display: rating (and votes), a name, up to ten names, or the raw text."""
    v = F.try_parse_json(json)
    get = lambda path: F.try_variant_get(v, path, "string")
    votes = F.coalesce(get("$.ratingCount"), get("$.reviewCount"))
    rating = F.concat(get("$.ratingValue"), F.when(votes.isNotNull(), F.concat(F.lit(" ("), votes, F.lit(" votes)"))).otherwise(F.lit("")))
    listed = F.slice(F.from_json(json, "array<string>"), 1, 10)
    names = F.transform(listed, lambda x: F.coalesce(F.get_json_object(x, "$.name"), x))
    return F.when(F.get_json_object(json, "$.ratingValue").isNotNull(), rating).when(F.get_json_object(json, "$.name").isNotNull(), F.get_json_object(json, "$.name")).when(F.ltrim(json).startswith("["), F.array_join(names, ", ")).otherwise(json)


def visible_text(html: Column, by: str = " ") -> Column:
    return F.regexp_replace(html, "<[^>]+>", by)


def strip_site_operator(c: Column) -> Column:
    """An expanded query without site: operators."""
    return F.trim(F.regexp_replace(c, r"\s*site:\S+", ""))


def clean_expanded(queries: Column, raw: Column) -> Column:
    """Up to five distinct expanded queries without site: operators; fewer than three: the raw query as well."""
    kept = F.slice(F.array_distinct(F.filter(F.transform(queries, strip_site_operator), lambda q: q != "")), 1, 5)
    return F.when(F.size(kept) >= 3, kept).otherwise(F.array_distinct(F.concat(kept, F.array(raw))))


def build_search_query(title: Column, year: Column, keywords: Column, raw: Column) -> Column:
    """Title, year and up to three field keywords (or movie); without a title the raw query."""
    words = F.when(F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, 3), " ")).otherwise(F.lit("movie"))
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat_ws(" ", title, year.cast("string"), words)).otherwise(raw)
