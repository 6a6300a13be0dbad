"""Queries over the pages table: URLs, links, profiles, triggers, DOM nodes and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text, urls
from weftline.functions.tables import register_tables
from weftline.operators import blocks, dom, pages
from weftline.sources.tables import spread, stored


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """The DOM nodes of pages, parsed once by all cores."""
    return stored(dom.dom_nodes(spread(_pages(spark, d))), "nodes")


def link_facets(spark: SparkSession, d: str) -> DataFrame:
    """Sites by number of pages and of distinct links on them."""
    links = _pages(spark, d).select(urls.site_domain(F.col("url")).alias("site"), "page_id", F.explode_outer(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("site").agg(F.countDistinct("page_id").alias("pages"), F.countDistinct("href").alias("links"))


def url_profile(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    df = _pages(spark, d).select("page_id", "url", urls.site_domain(u).alias("site"), urls.registrable_domain(urls.netloc(u)).alias("registrable"), urls.entity_id(u).alias("entity_id"), urls.pattern_type(u).alias("pattern_type"))
    return df.withColumns({"reason": urls.url_reason(u), "site_api": urls.normalize_site_api(u), "site_ui": urls.normalize_site_ui(u), "score": F.round(urls.adjusted_score(u, F.lit(0.7), F.col("pattern_type")), 4)})


def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = pages.page_links(_pages(spark, d)).join(_pages(spark, d).select("page_id", "url").hint("merge"), "page_id")
    return links.select("page_id", F.col("ord").cast("bigint").alias("ord"), "href", "label", urls.abs_url(F.col("url"), F.col("href")).alias("target"))


def page_profile(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_profile(_pages(spark, d))


def render_triggers(spark: SparkSession, d: str) -> DataFrame:
    """pages, and four times as many made of them: shells with much markup and little text, hydrated ones, ones of many scripts, and whole ones."""
    n, p = F.col("page_id"), _pages(spark, d)
    pad = lambda m: F.repeat(F.lit("<i></i>"), m)
    words = lambda w, m: F.repeat(F.lit(w), m.cast("int"))
    ld = F.lit('<script type="application/ld+json">{}</script>')
    made = F.array(
        F.col("html"),
        F.concat(ld, F.lit('<body><div id="root">'), F.col("url"), words("word ", n % 180), pad(1000), F.lit("</div></body>")),
        F.concat(ld, F.lit("<body data-reactroot>"), words("word ", 100 + n % 190), pad(1000), F.lit("</body>")),
        F.concat(ld, F.lit("<head>"), words("head ", 300 + n % 3), F.lit("</head><body>"), words("few ", n % 97), words("<script></script>", n % 9), pad(1000), F.lit("</body>")),
        F.concat(ld, F.lit("<body>"), words("word ", 995 + n % 13), F.lit("</body>")),
    )
    return p.select("page_id", F.posexplode(made).alias("kind", "html")).select("page_id", "kind", pages.escalation(F.col("html")).alias("trigger"))


def search_page(spark: SparkSession, d: str) -> DataFrame:
    """Pages under a search URL made from their own."""
    u = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(F.col("page_id") % 2 == 0, "/search?q=x").otherwise("/item"))
    return _pages(spark, d).select("page_id", pages.is_search_page(u, F.col("html")).alias("is_search"))


def site_signals(spark: SparkSession, d: str) -> DataFrame:
    s = pages.site_signals(_pages(spark, d))
    return s.select("page_id", F.array_join("headings", " | ").alias("headings"), F.array_join("link_patterns", ",").alias("link_patterns"), "has_search")


def relevance_hint(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    queries = p.select("page_id", F.array(F.lit("the"), F.lit("que"), F.lit("der"), F.lit("zzz")).alias("keywords"))
    return pages.relevance_hint(queries, pages.site_signals(p)).select("page_id", "hint")


def resolve_entity(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose links are made detail pages on two of three pages, plain ones on the others, which give none."""
    made = F.when(F.col("page_id") % 3 != 0, F.replace("html", F.lit('<a href="/'), F.lit('<a href="/title/'))).otherwise(F.col("html"))
    p = _pages(spark, d).withColumns({"title": pages.tag_text(F.col("html"), "title"), "year": F.lit(2024), "html": made})
    return pages.resolve_entity(p)


def clean_html(spark: SparkSession, d: str) -> DataFrame:
    return pages.clean_html(spread(_pages(spark, d)))


def to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return pages.to_markdown(spread(_pages(spark, d)))


def dom_tag_census(spark: SparkSession, d: str) -> DataFrame:
    return dom.tag_census(dom.dom_nodes(spread(_pages(spark, d))))


def dom_depth(spark: SparkSession, d: str) -> DataFrame:
    nodes = dom.dom_nodes(spread(_pages(spark, d)))
    return nodes.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.max("depth").cast("bigint").alias("max_depth"), F.count_if(F.col("tag") == "li").alias("n_items"))


def dom_nodes_sql(spark: SparkSession, d: str) -> DataFrame:
    """Elements by page, depth and tag through the table function, with a lateral join."""
    register_tables(spark)
    spread(_pages(spark, d)).createOrReplaceTempView("_pages_of_dom_nodes")
    return spark.sql("SELECT page_id, depth, tag, count(*) AS n FROM _pages_of_dom_nodes, LATERAL dom_nodes(html) GROUP BY page_id, depth, tag")


def dom_nodes_of_table(spark: SparkSession, d: str) -> DataFrame:
    """Elements by tag through the table function over the whole table, partitioned by page."""
    register_tables(spark)
    _pages(spark, d).createOrReplaceTempView("_pages_of_page_nodes")
    return spark.sql("SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM page_nodes(TABLE(SELECT page_id, html FROM _pages_of_page_nodes) PARTITION BY page_id) GROUP BY tag")


def dom_implied_ends(spark: SparkSession, d: str) -> DataFrame:
    """Lists and tables without end tags, as long as the pages' own texts: nodes, depth and direct children with implied end tags."""
    n = (F.col("page_id") % 40 + 3).cast("int")
    html = F.concat(F.lit("<div><ul>"), F.repeat(F.lit("<li><p>a<p>b"), n), F.lit("</ul><table>"), F.repeat(F.lit("<tr><td>c<td>d"), n), F.lit("</table></div>"), F.col("url"))
    nodes = dom.dom_nodes(spread(_pages(spark, d)).select("page_id", html.alias("html")), implied_ends=True)
    return nodes.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.max("depth").cast("bigint").alias("max_depth"), F.count_if(F.col("tag").isin("li", "tr") & (F.col("depth") == 2)).alias("items"))


def selector_paths(spark: SparkSession, d: str) -> DataFrame:
    """Per page its elements, those with a CSS path of their own, and the distinct paths: all the same number."""
    nodes = _nodes(spark, d)
    paths = blocks.selector_paths(nodes)
    both = nodes.select("page_id", "node_id").join(paths.hint("merge"), ["page_id", "node_id"], "left")
    return both.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.count("path").alias("n_paths"), F.countDistinct("path").alias("n_distinct"))


def repeated_groups(spark: SparkSession, d: str) -> DataFrame:
    return dom.repeating_groups(_nodes(spark, d)).select("page_id", "parent_id", "sig", "n")


def rank_clusters(spark: SparkSession, d: str) -> DataFrame:
    df = dom.rank_clusters(_nodes(spark, d))
    return df.select("page_id", "cluster", "n", "rank", F.round("avg_text", 4).alias("avg_text"), F.round("quality", 2).alias("quality"))


def cluster_items(spark: SparkSession, d: str) -> DataFrame:
    items = dom.cluster_items(_nodes(spark, d))
    return items.select("page_id", "cluster", "position", "heading", "link_text", "link_href", F.array_join("snippets", " | ").alias("snippets"), F.array_join("numbers", ",").alias("numbers"))


def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    return dom.cluster_quality(dom.cluster_items(_nodes(spark, d)))


def best_cluster(spark: SparkSession, d: str) -> DataFrame:
    return dom.best_cluster(_nodes(spark, d)).select("page_id", "cluster", "position", "heading", "link_text", "link_href")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """pages with links after their article: under the own path, elsewhere on the site, of other sites, of menus and of no use."""
    site, own = F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1), F.regexp_extract("url", r"^([^?#]*)", 1)
    links = F.concat(
        F.lit('</article><div><a href="/other/'), F.col("page_id").cast("string"), F.lit('">Other <b>one</b></a><a href="'), own, F.lit('/part/1">First part</a><a href="'), own, F.lit('/part/1/">Again</a><a href="https://elsewhere.org/x">Away</a>'),
        F.lit('<a href="/news/today">News</a><a href="/about">About</a><a href="#top">Top</a><a href="javascript:go()">Go</a><a href="'), F.col("url"), F.lit('">Self</a><a href="/empty"></a><div role="navigation"><a href="/menu">Menu item</a></div><a href="'),
        site, F.lit('/wide">Whole site</a></div>'),
    )
    return _pages(spark, d).withColumn("html", F.replace("html", F.lit("</article>"), links))


def navigation(spark: SparkSession, d: str) -> DataFrame:
    p = stored(_linked(spark, d), "linked")
    return pages.discover_navigation(p, stored(dom.dom_nodes(p), "nodes")).select("page_id", "rank", "target", "label")


def query_cleaning(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    hints = F.array_join(F.transform(text.language_hints(t), lambda x: x["code"]), ",")
    sites = text.normalize_sites(F.array(F.concat(F.lit(" WWW."), F.lower("role"), F.lit(".com")), F.col("role")))
    df = spark.read.parquet(f"{d}/conversations.parquet")
    meta = text.query_meta(t, sites)
    return df.select("conv_id", "turn", text.clean_query(t).alias("cleaned"), text.request_query(t).alias("query"), hints.alias("hints"), F.array_join(sites, ",").alias("sites"), meta["original_length"].cast("bigint").alias("n_raw"), meta["n_sites"].cast("bigint").alias("n_sites"))


def title_keys(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of conversations, with a year at the end, in the forms that titles are compared in."""
    df = spark.read.parquet(f"{d}/conversations.parquet").withColumn("head", F.concat("text", F.lit(" (2010)")))
    return df.select("conv_id", "turn", text.norm_title(F.col("head"), nfkd=False).alias("title"), text.norm_title_ascii(F.col("head")).alias("ascii_title"))


def folded_titles(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of conversations as titles without accents: compatibility forms are parted, marks dropped."""
    df = spark.read.parquet(f"{d}/conversations.parquet")
    return df.select("conv_id", "turn", text.norm_title(F.col("text")).alias("title"))


QUERIES = {f.__name__: f for f in (link_facets, url_profile, page_links, page_profile, render_triggers, search_page, site_signals, relevance_hint, resolve_entity, clean_html, to_markdown, dom_tag_census, dom_depth, dom_nodes_sql, dom_nodes_of_table, dom_implied_ends, selector_paths, repeated_groups, rank_clusters, cluster_items, cluster_quality, best_cluster, navigation, query_cleaning, title_keys, folded_titles)}

from weftline.plans.page_sql import ORACLES as DOM_ORACLES  # noqa: E402

_NETLOC = "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
ORACLES = DOM_ORACLES | {
    "link_facets": f"""
SELECT site, count(DISTINCT page_id) AS pages, count(DISTINCT href) AS links FROM (
  SELECT replace({_NETLOC}, 'www.', '') AS site, page_id, unnest(CASE WHEN len(h) = 0 THEN [NULL] ELSE h END) AS href
  FROM (SELECT url, page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)) GROUP BY site""",
    "url_profile": f"""
WITH p AS (SELECT page_id, url, {_NETLOC} AS loc, {_PATH} AS path, lower(url) AS low FROM pages),
q AS (SELECT *, string_split(lower(loc), '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs,
  CASE WHEN regexp_matches(low, '/search|/find|\\?q=|\\?query=|/results') THEN 'search' WHEN regexp_matches(low, '/genre|/browse|/discover|/category|/list') THEN 'browse'
    WHEN regexp_matches(low, '/top|/chart|/best|/popular|/trending') THEN 'chart' ELSE 'direct' END AS pattern_type FROM p)
SELECT page_id, url, replace(loc, 'www.', '') AS site,
  array_to_string(list_slice(labels, greatest(len(labels) - CASE WHEN len(labels) >= 3 AND labels[len(labels) - 1] IN ('co','com','org','net','ac') THEN 2 ELSE 1 END, 1), len(labels)), '.') AS registrable,
  segs[len(segs)] AS entity_id, pattern_type,
  CASE WHEN url NOT LIKE 'https://%' THEN 'Only HTTPS allowed, got: http://' END AS reason,
  nullif(rtrim(regexp_replace(lower(trim(url)), '^https?://', ''), '/'), '') AS site_api,
  regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/.*$', '') AS site_ui,
  round(greatest(0.0, least(1.0, 0.7::DOUBLE - greatest(0.0, (length(url) - length(replace(url, '/', '')) - 2 - 3) * 0.05::DOUBLE) + CASE WHEN pattern_type = 'direct' THEN 0.1 ELSE 0 END::DOUBLE)), 4) AS score
FROM q""",
    "page_links": r"""
WITH l AS (SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1, 'si') AS h, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2, 'si') AS t FROM pages),
u AS (SELECT page_id, url, unnest(h) AS href, unnest(t) AS t, generate_subscripts(h, 1) - 1 AS ord FROM l)
SELECT page_id, ord, href, trim(regexp_replace(t, '<[^>]+>', '', 'g')) AS label, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || href AS target FROM u""",
    "page_profile": r"""
SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si')) AS title,
  array_to_string(list_transform(regexp_extract_all(html, '<h1[^>]*>(.*?)</h1>', 1, 'si'), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), ' | ') AS h1s,
  len(regexp_extract_all(html, '<a\s', 0, 'i')) AS n_links, len(regexp_extract_all(html, '<img\b', 0, 'i')) AS n_images, contains(html, 'application/ld+json') AS has_jsonld
FROM pages""",
    "render_triggers": """
WITH made AS (
  SELECT page_id, unnest(range(5)) AS kind, unnest([html, ld || '<body><div id="root">' || url || repeat('word ', page_id % 180) || pad || '</div></body>', ld || '<body data-reactroot>' || repeat('word ', 100 + page_id % 190) || pad || '</body>',
    ld || '<head>' || repeat('head ', 300 + page_id % 3) || '</head><body>' || repeat('few ', page_id % 97) || repeat('<script></script>', page_id % 9) || pad || '</body>', ld || '<body>' || repeat('word ', 995 + page_id % 13) || '</body>']) AS h
  FROM pages, (SELECT '<script type="application/ld+json">{}</script>' AS ld, repeat('<i></i>', 1000) AS pad)),
seen AS (SELECT *, length(trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS n, regexp_extract(h, '<body[^>]*>(.*?)</body>', 1, 's') AS b FROM made)
SELECT page_id, kind, CASE WHEN length(h) < 5000 THEN 'small' WHEN NOT contains(h, 'application/ld+json') AND length(h) < 50000 THEN 'no_jsonld' WHEN contains(h, '<div id="root"') AND n < 500 THEN 'spa_shell' WHEN contains(h, 'data-reactroot') AND n < 1000 THEN 'hydration'
  WHEN contains(h, '<body') AND length(trim(regexp_replace(regexp_replace(b, '<[^>]+>', '', 'g'), '[ \t\n\r]+', ' ', 'g'))) < 200 AND len(regexp_extract_all(lower(h), '<script')) > 5 THEN 'empty_body' END AS trigger FROM seen""",
    "search_page": r"""
SELECT page_id, page_id % 2 = 0 AND (regexp_matches(lower(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si')), 'search|find|results')
  OR regexp_matches(lower(array_to_string(regexp_extract_all(html, '<h1[^>]*>(.*?)</h1>', 1, 'si'), ' ')), 'search|find|results')
  OR (NOT contains(html, '<script type="application/ld+json">') AND len(regexp_extract_all(lower(html), '<a ')) > 15)) AS is_search FROM pages""",
    "site_signals": r"""
WITH h AS (SELECT page_id, html AS s FROM pages)
SELECT page_id, array_to_string(list_transform(regexp_extract_all(s, '<h[1-3][^>]*>(.*?)</h[1-3]>', 1, 'si'), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), ' | ') AS headings,
  array_to_string(list_sort(list_distinct(regexp_extract_all(s, 'href="(/[^"/?#]+)/', 1))), ',') AS link_patterns, regexp_matches(s, 'type="search"|name="q"|role="search"', 'i') AS has_search FROM h""",
    "relevance_hint": r"""
WITH h AS (SELECT page_id, lower(array_to_string(regexp_extract_all(html, '<h[1-3][^>]*>(.*?)</h[1-3]>', 1, 'si'), ' ')) AS t FROM pages)
SELECT page_id, round(least(1.0, (contains(t, 'the')::INT + contains(t, 'que')::INT + contains(t, 'der')::INT + contains(t, 'zzz')::INT) / 4 * 0.8::DOUBLE), 3) AS hint FROM h""",
    "dom_tag_census": r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script>.*?</script>', '<script>', 'gs'), '<!--.*?-->', '', 'gs') AS h FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)[^>]*>', 1)) AS tag FROM b)
SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY tag""",
    "title_keys": r"""
WITH h AS (SELECT conv_id, turn, text || ' (2010)' AS head FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(replace(replace(replace(head, '&amp;', '&'), '&apos;', ''''), '&quot;', '"'), '&#?[\p{L}\p{N}_]+;', '', 'g')), '\(\d{4}\)\s*$', ''), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS title,
  trim(regexp_replace(lower(trim(head)), '[^a-z0-9 ]', '', 'g')) AS ascii_title FROM h""",
}
ORACLES["folded_titles"] = r"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(replace(replace(replace(strip_accents(text), '&amp;', '&'), '&apos;', ''''), '&quot;', '"'), '&#?[\p{L}\p{N}_]+;', '', 'g')), '\(\d{4}\)\s*$', ''), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS title FROM conversations"""
_HINTS = " || ".join(f"CASE WHEN contains(lower(text), '{n}') THEN '{c},' ELSE '' END" for n, c in text.LANGUAGES.items())
ORACLES["query_cleaning"] = rf"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[^\x20-\x7E\x{{00A0}}-\x{{FFFF}}]', '', 'g'), '[\s\x{{00A0}}]+', ' ', 'g')) AS cleaned,
  lower(trim(text)) AS query, rtrim({_HINTS}, ',') AS hints, lower(role) || '.com' AS sites, length(text) AS n_raw, 1::BIGINT AS n_sites FROM conversations"""
