"""Column functions for URLs and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that tell what a URL points to, the first kind that fits wins; else direct.
PATTERN_SIGNALS = {
    "search": ("/search", "/find", "?q=", "?query=", "/results"),
    "browse": ("/genre", "/browse", "/discover", "/category", "/list"),
    "chart": ("/top", "/chart", "/best", "/popular", "/trending"),
}
#: Second-level labels under which names are registered, and hosts and schemes never fetched.
SECOND_LEVEL = ("co", "com", "org", "net", "ac")
BLOCKED_SCHEMES = ("file", "ftp", "data")
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0", "[::1]")
IP_LITERAL = r"^(\d{1,3}\.){3}\d{1,3}$|^\[?[0-9a-fA-F:]+\]?$"


def _with_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def site_domain(url: Column) -> Column:
    """The network location, https assumed where no scheme is given, without www."""
    return F.replace(netloc(_with_scheme(url)), F.lit("www."), F.lit(""))


def normalize_site_api(site: Column) -> Column:
    """Scheme and trailing slashes gone, trimmed and lower-cased; null where nothing is left (a rejected row)."""
    bare = F.regexp_replace(F.lower(F.trim(site)), "^https?://", "")
    return F.nullif(F.regexp_replace(bare, "/+$", ""), F.lit(""))


def normalize_site_ui(site: Column) -> Column:
    """As normalize_site_api, with www. and the path gone too."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(site)), "^https?://", ""), r"^www\.", ""), "/.*$", "")


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a second-level label like co.uk."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    take = F.when((n >= 3) & F.element_at(labels, F.when(n >= 2, F.lit(-2)).otherwise(F.lit(-1))).isin(*SECOND_LEVEL), 3).otherwise(2)
    return F.array_join(F.when(n <= take, labels).otherwise(F.slice(labels, n - take + 1, take)), ".")


def same_site(a: Column, b: Column) -> Column:
    return registrable_domain(netloc(a)) == registrable_domain(netloc(b))


def entity_id(url: Column) -> Column:
    """The last non-empty path segment; null without one."""
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.when(F.size(segments) > 0, F.element_at(segments, -1))


def pattern_type(url: Column) -> Column:
    low, out = F.lower(url), F.lit("direct")
    for kind, signals in reversed(PATTERN_SIGNALS.items()):
        has = F.lit(False)
        for s in signals:
            has = has | F.contains(low, F.lit(s))
        out = F.when(has, F.lit(kind)).otherwise(out)
    return out


def url_reason(url: Column) -> Column:
    """Why a URL must not be fetched; null if it may."""
    scheme = F.when(url.rlike("^(https?|file|ftp)://"), F.regexp_extract(url, "^([a-z]+)://", 1)).otherwise(F.lit("https"))
    rest = F.when(url.rlike("^(https?|file|ftp)://"), F.regexp_replace(url, "^[a-z]+://", "")).otherwise(url)
    location = F.regexp_extract(rest, "^([^/?#]*)", 1)
    bare = F.regexp_replace(location, "^[^@]*@", "")
    name = F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, ":.*$", "")))
    return (
        F.when(scheme.isin(*BLOCKED_SCHEMES), F.concat(F.lit("Blocked scheme: "), scheme, F.lit("://")))
        .when((scheme != "https") & F.contains(url, F.lit("://")), F.concat(F.lit("Only HTTPS allowed, got: "), scheme, F.lit("://")))
        .when(name.isin(*BLOCKED_HOSTS), F.concat(F.lit("Blocked host: "), name))
        .when(name.rlike(IP_LITERAL), F.concat(F.lit("IP literal URLs not allowed: "), name))
    )


def abs_url(base: Column, href: Column) -> Column:
    """href resolved against a page's URL (dot segments stay)."""
    scheme = F.regexp_extract(base, "^([a-zA-Z]+):", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path(base), "^(.*/)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .otherwise(F.concat(folder, href))
    )


def signed_confidence(confidence: Column, failed: Column) -> Column:
    """Positive for patterns that worked; a failed one gets the negated confidence, at least -1, or -0.5 if it was not positive."""
    return F.when(failed, F.when(confidence > 0, F.greatest(F.lit(-1.0), -confidence)).otherwise(F.lit(-0.5))).otherwise(confidence)


def adjusted_score(url: Column, confidence: Column, kind: Column) -> Column:
    """Confidence less 0.05 per path level over three, plus 0.1 for direct URLs, within 0 and 1."""
    depth = F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit(""))) - 2
    score = confidence - F.greatest(F.lit(0.0), (depth - 3) * F.lit(0.05)) + F.when(kind == "direct", F.lit(0.1)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
