"""robots.txt rules as a table; path checks and snapshot differences as equi-joins on exploded path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.urls import path
from weftline.sources.tables import stored


def robots_rules(files: DataFrame) -> DataFrame:
    """(site, ua, kind, path, ord) of robots files (site, raw): rules belong to the latest User-agent line only; empty paths are no rules."""
    lines = files.select("site", F.posexplode(F.split("raw", "\n")).alias("ord", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"[\r\t]", " ")))
    kept = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    agent = F.nullif(F.regexp_extract("line", r"(?i)^user-agent:\s*(.+)$", 1), F.lit(""))
    ua = F.last(agent, ignorenulls=True).over(Window.partitionBy("site").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rule = lambda kind: F.nullif(F.trim(F.regexp_extract("line", rf"(?i)^{kind}:\s*(.*)$", 1)), F.lit(""))
    typed = kept.withColumns({"ua": ua, "allow": rule("allow"), "disallow": rule("disallow")})
    out = typed.where("ua is not null and coalesce(allow, disallow) is not null")
    return out.select("site", "ua", F.when(F.col("allow").isNotNull(), "allow").otherwise("disallow").alias("kind"), F.coalesce("allow", "disallow").alias("path"), "ord")


def sitemaps(files: DataFrame) -> DataFrame:
    lines = files.select("site", F.explode(F.split("raw", "\n")).alias("line"))
    return lines.select("site", F.trim(F.regexp_extract(F.trim("line"), r"(?i)^sitemap:\s*(.*)$", 1)).alias("sitemap")).where("sitemap <> ''")


def robots_check(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (site, url) with the first blocking disallow path and blocked. A rule blocks by plain prefix, so the URL's path
    prefixes of the lengths that its site's rules have meet the rules by equality; Spark splits a site that many URLs share."""
    p = path(F.col("url"))
    deny = stored(rules.where("kind = 'disallow'").groupBy("site", "path").agg(F.min("ord").alias("ord")), "deny")
    lengths = stored(deny.groupBy("site").agg(F.collect_set(F.length("path")).alias("lengths")), "lengths")
    long_enough = F.filter("lengths", lambda n: n <= F.length(p))
    prefixes = urls.join(lengths.hint("merge"), "site").select("site", "url", F.explode(F.transform(long_enough, lambda n: F.substring(p, F.lit(1), n))).alias("path"))
    hits = prefixes.join(deny.hint("merge"), ["site", "path"]).groupBy("site", "url").agg(F.min_by("path", "ord").alias("blocking_path"))
    return urls.join(hits.hint("merge"), ["site", "url"], "left").withColumn("blocked", F.col("blocking_path").isNotNull())


def robots_groups(files: DataFrame) -> DataFrame:
    """(site, ua, kind, path, ord) of robots files as RFC 9309 groups them: successive User-agent lines share the rules that follow, groups of
    one agent (in lower case) are one, comments end a line, and empty paths are no rules."""
    lines = files.select("site", F.posexplode(F.split("raw", r"\r\n?|\n")).alias("ord", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"#.*|\t", " ")))
    parts = lines.select("site", "ord", F.lower(F.regexp_extract("line", r"(?i)^(user-agent|allow|disallow)\s*:", 1)).alias("kind"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value")).where("kind <> ''")
    order = Window.partitionBy("site").orderBy("ord")
    begins = (F.col("kind") == "user-agent") & (F.coalesce(F.lag("kind").over(order), F.lit("")) != "user-agent")
    numbered = parts.withColumn("_begins", begins).withColumn("g", F.sum(F.col("_begins").cast("int")).over(order))
    agents = numbered.where("kind = 'user-agent' and value <> ''").select("site", "g", F.lower("value").alias("ua")).distinct()
    rules = numbered.where("kind <> 'user-agent' and value <> ''").select("site", "g", "kind", F.col("value").alias("path"), "ord")
    return rules.join(agents.hint("merge"), ["site", "g"]).select("site", "ua", "kind", "path", "ord")


def pattern_regex(pattern: Column) -> Column:
    """A robots path pattern as a regular expression: * is any text, a $ at the end is the end, all else stands for itself."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.replace(F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q"))
    return F.concat(F.lit("(?s)^\\Q"), quoted, F.lit("\\E"), F.when(ends, F.lit("$")).otherwise(F.lit("")))


def robots_longest(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """urls (site, url) with rule and allowed by RFC 9309: of the agent's rules, or those of * if the site names it nowhere, the longest pattern
    that matches path and query decides, allow before disallow; without a match a URL is allowed.

    A pattern's text before its first * (or its end $) is a prefix of what it matches. So URLs are cut to the lengths of their site's
    prefixes and meet the patterns by equality, and only those are tried as expressions.
    """
    own = rules.where(F.col("ua") == agent.lower())
    shared = rules.where("ua = '*'").join(own.select("site").distinct().hint("merge"), "site", "left_anti")
    prefix = F.regexp_extract(F.regexp_replace("path", r"\$$", ""), r"^([^*]*)", 1)
    kept = own.unionByName(shared).select("site", "kind", F.col("path").alias("rule"), prefix.alias("prefix")).distinct()
    kept = stored(kept.withColumn("regex", pattern_regex(F.col("rule"))), "patterns")
    lengths = stored(kept.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("lengths")), "lengths")
    target = F.coalesce(F.nullif(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    asked = urls.select("site", "url").distinct().withColumn("target", F.when(target.startswith("?"), F.concat(F.lit("/"), target)).otherwise(target))
    cut = F.transform(F.filter("lengths", lambda n: n <= F.length("target")), lambda n: F.substring("target", F.lit(1), n))
    near = asked.join(lengths.hint("merge"), "site").select("site", "url", "target", F.explode(cut).alias("prefix")).join(kept.hint("merge"), ["site", "prefix"])
    hits = near.where(F.regexp_like("target", F.col("regex"))).groupBy("site", "url").agg(F.max(F.struct(F.octet_length("rule").alias("n"), (F.col("kind") == "allow").alias("allowed"), "rule")).alias("r"))
    best = stored(hits.select("site", "url", "r.rule", "r.allowed"), "longest")
    return urls.join(best.hint("merge"), ["site", "url"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def fully_blocked(rules: DataFrame) -> DataFrame:
    """Sites that disallow / and allow nothing."""
    per = rules.groupBy("site").agg(F.max(F.when((F.col("kind") == "disallow") & (F.col("path") == "/"), 1).otherwise(0)).alias("root"), F.count_if(F.col("kind") == "allow").alias("n_allow"))
    return per.select("site", ((F.col("root") == 1) & (F.col("n_allow") == 0)).alias("fully_blocked"))


def newly_disallowed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(site, path): formerly allowed paths that a disallow prefix now covers, or that are allowed no more while something is disallowed."""
    allowed = before.where("kind = 'allow'").select("site", "path").distinct()
    deny = now.where("kind = 'disallow'").select("site", "path").distinct()
    still = now.where("kind = 'allow'").select("site", "path").distinct()
    prefixes = allowed.select("site", F.col("path").alias("p"), F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring("path", F.lit(1), i))).alias("path"))
    covered = prefixes.join(deny.hint("merge"), ["site", "path"], "left_semi").select("site", F.col("p").alias("path"))
    dropped = allowed.join(still.hint("merge"), ["site", "path"], "left_anti").join(deny.select("site").distinct().hint("merge"), "site", "left_semi")
    return covered.union(dropped.select("site", "path")).distinct()


def invalidate_patterns(patterns: DataFrame, blocked: DataFrame) -> DataFrame:
    """Valid patterns that contain a blocked path of their site: to be set invalid. A site's patterns meet its rules, of which there are few."""
    b = blocked.select("site", F.col("path").alias("_path")).distinct()
    return patterns.where("status = 'valid'").join(b.hint("merge"), (patterns["site"] == b["site"]) & F.contains(patterns["pattern"], b["_path"]), "left_semi")


def robots_outcome(status: str = "status_code"):
    """What a robots fetch means, by its HTTP status."""
    c = F.col(status)
    return F.when(c == 200, "ok").when(c == 404, "allow_all").when(c.isin(429, 503), "retry").otherwise("fetch_failed")


def robots_source(cache: DataFrame, fetched: DataFrame, as_of: str) -> DataFrame:
    """The newest unexpired cached file of each site, else the fetched one."""
    live = cache.where(F.col("expires_at") > F.lit(as_of).cast("timestamp")).groupBy("site").agg(F.max_by("raw", "created_at").alias("raw"))
    return live.union(fetched.select("site", "raw").join(live.select("site").hint("merge"), "site", "left_anti"))
