"""SQL for data_queries, written from the tables that the rendered pages and frames come from."""

_ITEMS = "(SELECT p_partkey AS item_id, p_brand AS site, p_name || ' ' || p_type AS name, p_type AS kind, CASE WHEN p_size % 2 = 1 THEN p_size::VARCHAR END AS size FROM part)"
_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(replace(replace(replace(name, '&amp;', '&'), '&apos;', ''''), '&quot;', '"'), '&#?[\p{L}\p{N}_]+;', '', 'g')), '\(\d{4}\)\s*$', ''), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"""
_TITLED = f"(SELECT *, CASE WHEN {_NORM} = '' THEN '__notitle_' || item_id ELSE {_NORM} END AS norm, (name <> '')::INT + 1 + (size IS NOT NULL)::INT AS rich FROM {_ITEMS})"
_COMPETE = """
SELECT request_id, ord, field, value, 0.5 + (s % 8) * 0.05::DOUBLE AS weight FROM (
  SELECT request_id, ord, s, CASE WHEN ord % 2 = 0 THEN lower(f) ELSE f END AS flag, round(t, 2)::VARCHAR AS tax FROM (
    SELECT l_orderkey AS request_id, l_linenumber AS ord, min(l_suppkey) AS s, min(l_returnflag) AS f, min(l_tax) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber))
UNPIVOT (value FOR field IN (flag, tax))"""
_UNIFIED = f"""
WITH c AS ({_COMPETE}),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id, field ORDER BY weight DESC, ord) AS rn, row_number() OVER (PARTITION BY request_id, field ORDER BY ord) AS first_rn FROM c),
a AS (SELECT request_id, field, count(*) AS n, count(DISTINCT value) AS nv, count(DISTINCT lower(trim(value))) AS np, max(value) FILTER (rn = 1) AS top, max(value) FILTER (first_rn = 1) AS first,
  round(max(weight) FILTER (rn = 1) - max(weight) FILTER (rn = 2), 9) AS gap FROM r GROUP BY ALL),
u AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN nv = 1 THEN 'agree' WHEN np = 1 THEN 'agree_normalized' WHEN gap >= 0.1 THEN 'by_weight' ELSE 'conflict' END AS status FROM a)"""
_ORD = "(SELECT o_orderkey AS request_id, o_custkey AS user_id, o_orderpriority AS domain, o_custkey % 100 AS intent_hash, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'INIT' END AS state, o_orderdate AS created_at, o_totalprice AS price FROM orders)"
_LIVE = f"(SELECT * FROM {_ORD} WHERE state = 'COMPLETED' AND request_id % 3 <> 0 AND created_at + INTERVAL 30 DAY > TIMESTAMP '1996-01-01')"
_SITE_URLS = "(SELECT page_id, url, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS site, regexp_extract(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '^(/[^/]*/.)', 1) AS start FROM pages)"
_DENY, _ALLOW = f"(SELECT DISTINCT site, start FROM {_SITE_URLS} WHERE page_id % 3 = 0)", f"(SELECT DISTINCT site, start FROM {_SITE_URLS} WHERE page_id % 3 = 1)"
_ODD_SITES = f"(SELECT site FROM {_SITE_URLS} GROUP BY site HAVING min(page_id) % 5 = 0)"
_INT = """(SELECT o_orderkey AS k, ['details','list','search','compare','unknown'][k % 5 + 1] AS kind, CASE WHEN k % 3 <> 0 THEN 'Part ' || k % 50 END AS title, CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END AS n_titles,
  CASE WHEN k % 7 = 1 THEN 'abc' WHEN k % 7 <> 0 THEN (1880 + k % 160)::VARCHAR END AS year, k % 6 = 0 AS english, CASE WHEN k % 5 <> 1 THEN k % 300 END AS lim, k % 8 = 0 AS compare, k % 2 = 0 AS drama,
  CASE WHEN k % 11 = 0 THEN (2000 + k % 20)::VARCHAR END AS release, 0.5 + (k % 50) / 100 AS confidence, k % 3 + 1 AS sites FROM orders)"""
_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(key), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3)))))"
_FUZZY = f"""
WITH p AS (SELECT p_partkey AS id, p_name || '|' || p_type AS key FROM part), k AS (SELECT key, {_TRI} AS g FROM (SELECT DISTINCT key FROM p)),
q AS (SELECT DISTINCT key FROM p WHERE id % 100 = 0),
s AS (SELECT a.key AS lkey, b.key AS rkey, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS n FROM k a JOIN q ON a.key = q.key, k b),
f AS (SELECT l.id AS left_id, r.id AS right_id, round(i / (n - i), 6) AS similarity FROM s JOIN p l ON l.key = s.lkey AND l.id % 100 = 0 JOIN p r ON r.key = s.rkey WHERE i / (n - i) > 0.65)"""
_FULL = "(SELECT * FROM part WHERE p_partkey % 7 <> 0)"

ORACLES = {
    "unify_items": f"""
WITH e AS (SELECT norm, item_id, rich, key, value FROM {_TITLED} UNPIVOT (value FOR key IN (name, kind, size)))
SELECT norm, key, value FROM (SELECT *, row_number() OVER (PARTITION BY norm, key ORDER BY rich DESC, item_id) AS rn FROM e WHERE value <> '') WHERE rn = 1""",
    "unify_sources": f"SELECT norm, count(*) AS n_items, string_agg(DISTINCT site, ',' ORDER BY site) AS sources FROM {_TITLED} GROUP BY norm",
    "unify_stats": f"SELECT count(*) AS total, count(DISTINCT norm) AS unique_items, count(*) - count(DISTINCT norm) AS removed FROM {_TITLED}",
    "source_facets": "SELECT p_brand AS site, count(*) AS n_items FROM part GROUP BY p_brand",
    "unify_fields": f"{_UNIFIED} SELECT request_id, field, CASE WHEN status IN ('by_weight', 'conflict') THEN top ELSE first END AS value, status, n FROM u",
    "conflict_report": f"{_UNIFIED} SELECT field, status, count(*) AS n FROM u GROUP BY ALL",
    "weight_gap": f"SELECT field, coalesce(gap, -1.0)::DOUBLE AS gap, count(*) AS n FROM (SELECT field, round(weight - lead(weight) OVER (PARTITION BY request_id, field ORDER BY weight DESC, ord), 9) AS gap FROM ({_COMPETE})) GROUP BY ALL",
    "value_forms": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_size / 5)::DOUBLE::VARCHAR WHEN 1 THEN p_size || '%' ELSE CASE WHEN p_size <= 10 THEN p_size::DOUBLE::VARCHAR ELSE p_size::VARCHAR END END AS rating, p_size::VARCHAR AS year FROM part",
    "fill_gaps": f"SELECT request_id, field, value, ord FROM ({_COMPETE})",
    "keep_better": f"SELECT request_id, field, ord AS attempt, round(weight, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY request_id, field ORDER BY weight DESC, ord) AS rn FROM ({_COMPETE})) WHERE rn = 1",
    "request_confidence": "SELECT l_orderkey AS request_id, round(CASE WHEN max(o_orderkey) IS NOT NULL THEN 0.9::DOUBLE ELSE avg(l_discount * 10) END, 4) AS confidence FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F' GROUP BY l_orderkey",
    "cache_exact": f"SELECT request_id, EXISTS (SELECT 1 FROM {_LIVE} c WHERE c.domain = o.domain AND c.intent_hash = o.intent_hash) AS hit FROM {_ORD} o",
    "cache_latest_completed": f"SELECT domain, intent_hash, request_id, price FROM (SELECT *, row_number() OVER (PARTITION BY domain, intent_hash ORDER BY created_at DESC, request_id DESC) AS rn FROM {_ORD} WHERE state = 'COMPLETED') WHERE rn = 1",
    "cache_semantic": f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY domain, intent_hash, user_id % 2 ORDER BY request_id % 10 DESC, created_at DESC, request_id DESC) AS rn FROM {_ORD} WHERE state = 'COMPLETED')
SELECT o.request_id, coalesce(r.request_id, -1) AS result_id FROM {_ORD} o LEFT JOIN r ON r.rn = 1 AND r.domain = o.domain AND r.intent_hash = o.intent_hash AND r.user_id % 2 = o.user_id % 2""",
    "cache_two_tier": f"""
WITH t1 AS (SELECT domain, intent_hash, user_id % 50 AS site, max(request_id % 10 / 10) AS score FROM {_LIVE} WHERE request_id % 10 / 10 >= 0.3 GROUP BY ALL),
t2 AS (SELECT domain, user_id % 50 AS site, count(*) % 10 / 10 AS score FROM {_ORD} GROUP BY ALL HAVING count(*) >= 2 AND count(*) % 10 / 10 >= 0.3)
SELECT request_id, CASE WHEN t1.score IS NOT NULL THEN 'tier1' WHEN t2.score IS NOT NULL THEN 'tier2' ELSE 'uncached' END AS tier, coalesce(t1.score, t2.score, -1.0)::DOUBLE AS score
FROM {_ORD} o LEFT JOIN t1 ON t1.domain = o.domain AND t1.intent_hash = o.intent_hash AND t1.site = o.user_id % 50 LEFT JOIN t2 ON t2.domain = o.domain AND t2.site = o.user_id % 50""",
    "idempotent_action": f"""
WITH e AS (SELECT domain, intent_hash, arg_max(state, (created_at, request_id)) AS state FROM {_ORD} WHERE created_at < TIMESTAMP '1996-01-01' GROUP BY ALL)
SELECT request_id, CASE WHEN e.state IS NULL THEN 'none' WHEN e.state = 'COMPLETED' THEN 'return' WHEN e.state = 'FAILED' THEN 'retry' ELSE 'attach' END AS action
FROM {_ORD} o LEFT JOIN e ON e.domain = o.domain AND e.intent_hash = o.intent_hash WHERE o.created_at >= TIMESTAMP '1996-01-01'""",
    "fuzzy_keys": f"{_FUZZY} SELECT * FROM f",
    "top_similar": f"{_FUZZY} SELECT left_id, right_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id % 10 DESC, right_id)::INT AS rank FROM f) WHERE rank <= 5",
    "robots_rules": f"SELECT site, '*' AS ua, 'disallow' AS kind, start AS path FROM {_DENY} UNION ALL SELECT site, '*', 'allow', start || '/x' FROM {_ALLOW}",
    "robots_sitemaps": f"SELECT DISTINCT site, 'https://' || site || '/map.xml' AS sitemap FROM {_SITE_URLS}",
    "robots_check": f"SELECT page_id, r.start IS NOT NULL AS blocked, coalesce(r.start, '') AS blocking_path FROM {_SITE_URLS} p LEFT JOIN {_DENY} r ON p.site = r.site AND p.start = r.start",
    "fully_blocked": f"""
SELECT site, site IN {_ODD_SITES} AND count(*) FILTER (page_id % 6 = 1) = 0 AS fully_blocked FROM {_SITE_URLS}
GROUP BY site HAVING site IN {_ODD_SITES} OR count(*) FILTER (page_id % 3 = 0 OR page_id % 6 = 1) > 0""",
    "newly_disallowed": f"""
SELECT site, start || '/x' AS path FROM {_ALLOW} a WHERE site IN {_ODD_SITES} OR EXISTS (SELECT 1 FROM {_DENY} d WHERE d.site = a.site AND d.start = a.start)
  OR (NOT EXISTS (SELECT 1 FROM {_SITE_URLS} u WHERE u.site = a.site AND u.start = a.start AND u.page_id % 6 = 1) AND EXISTS (SELECT 1 FROM {_DENY} d WHERE d.site = a.site))""",
    "robots_longest": f"""
WITH u AS (SELECT *, CASE WHEN t = '' THEN '/' WHEN t LIKE '?%' THEN '/' || t ELSE t END AS target FROM (SELECT *, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^#]*)', 1) AS t FROM {_SITE_URLS})),
lines AS (SELECT DISTINCT site, CASE page_id % 6 WHEN 0 THEN 'disallow' WHEN 1 THEN 'disallow' WHEN 3 THEN 'disallow' ELSE 'allow' END AS kind,
  CASE page_id % 6 WHEN 0 THEN start WHEN 1 THEN '/*' || right(start, 1) || '$' WHEN 2 THEN start || '*/' WHEN 3 THEN '/*?*page=' ELSE regexp_extract(start, '^(/[^/]*/)', 1) || '*' || right(start, 1) END AS rule FROM {_SITE_URLS} WHERE page_id % 6 < 5),
rules AS (SELECT *, '^' || replace(replace(regexp_replace(rule, '[$]$', ''), '?', '[?]'), '*', '.*') || CASE WHEN rule LIKE '%$' THEN '$' ELSE '' END AS re FROM lines WHERE rule <> ''),
best AS (SELECT page_id, arg_max({{'k': kind, 'r': rule}}, (strlen(rule), kind = 'allow', rule)) AS b FROM u JOIN rules ON rules.site = u.site AND regexp_matches(u.target, re) GROUP BY page_id)
SELECT u.page_id, coalesce(b.k = 'allow', true) AS allowed, coalesce(b.r, '') AS rule FROM u LEFT JOIN best ON best.page_id = u.page_id""",
    "invalidate_patterns": f"SELECT page_id FROM {_SITE_URLS} p WHERE page_id % 4 <> 0 AND EXISTS (SELECT 1 FROM {_DENY} d WHERE d.site = p.site AND contains(p.url, d.start))",
    "intent_validate": f"""
SELECT k AS request_id, concat_ws('; ', CASE WHEN kind = 'unknown' THEN 'Schema validation: ''unknown'' is not a known query_type' END, CASE WHEN year = 'abc' THEN 'Invalid year value: abc' END,
  CASE WHEN try_cast(year AS INT) < 1888 OR try_cast(year AS INT) > 2030 THEN 'Year ' || year || ' out of valid range (1888-2030)' END, CASE WHEN lim < 1 OR lim > 250 THEN 'Limit ' || lim || ' out of valid range (1-250)' END) AS errors FROM {_INT}""",
    "actionable": f"""
WITH r AS (SELECT k, list_filter([CASE WHEN confidence < 0.75 THEN printf('confidence %.2f is below 0.75 threshold', confidence) END, CASE WHEN kind = 'details' AND title IS NULL THEN 'title is required for detail queries' END,
  CASE WHEN kind = 'compare' AND n_titles < 2 THEN 'compare queries need at least 2 titles' END,
  CASE WHEN kind IN ('list', 'search') AND title IS NULL AND n_titles = 0 AND year IS NULL AND NOT english AND NOT drama AND release IS NULL THEN 'query is too broad — specify at least a year, language, genre, director, or title' END], lambda x: x IS NOT NULL) AS reasons FROM {_INT})
SELECT k AS request_id, len(reasons) AS n_reasons, array_to_string(reasons, '; ') AS reasons FROM r""",
    "capability_strategy": f"""
WITH c AS (SELECT *, title IS NOT NULL AND NOT compare AND n_titles = 0 AS single, compare AND sites > 1 AS merged, title IS NOT NULL AND n_titles = 0 AS one FROM {_INT})
SELECT k AS request_id, CASE WHEN one THEN 'single' ELSE 'multiple' END AS cardinality, lim IS NOT NULL AS needs_ranking, release IS NOT NULL OR year IS NOT NULL OR english OR drama AS needs_filtering, merged AS needs_aggregation, single AS single_entity_lookup,
  CASE WHEN single AND NOT merged THEN 'entity_detail_lookup' WHEN (single OR NOT one) AND merged THEN 'per_site_lookup_then_unify' ELSE 'search_endpoint_lookup' END AS strategy, CASE WHEN single THEN 'single_item' ELSE 'multi_item' END AS extraction_mode,
  CASE WHEN merged THEN 'cross_site_merge' WHEN sites > 1 THEN 'best_source' ELSE 'single_source' END AS unification_mode FROM c""",
    "semantic_key": f"SELECT k AS request_id, concat_ws('|', 'movie', '_', coalesce(release, year, '_'), CASE WHEN english THEN 'english' ELSE '_' END, coalesce(lower(title), '_'), CASE WHEN drama THEN 'drama' ELSE '_' END, CASE WHEN lim > 0 THEN lim::VARCHAR ELSE '_' END, '_') AS semantic_key FROM {_INT}",
    "intent_hash": f"SELECT min(k) AS first, count(*) AS n FROM {_INT} GROUP BY title, n_titles, year, english, lim, compare, drama, release",
    "idempotency_key": "SELECT o_orderkey, sha256(o_custkey || '|' || lower(o_orderpriority) || '|movie|1.0|a.com,b.com') AS key FROM orders",
    "vector_match": """
WITH s AS (SELECT f.vec_id AS field, k.vec_id AS key, list_cosine_similarity(f.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS score FROM embeddings f JOIN embeddings k ON f.label = k.label WHERE f.vec_id % 100 = 0 AND k.vec_id <> f.vec_id)
SELECT field, arg_max(key, (score, key)) AS key, round(max(score), 3) AS score, max(score) < 0.65 AS missing FROM s GROUP BY field""",
    "vector_index_exact": """
WITH s AS (SELECT f.vec_id AS field, k.vec_id AS key, list_cosine_similarity(f.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS score FROM embeddings f JOIN embeddings k ON f.label = k.label WHERE f.vec_id % 100 = 0 AND k.vec_id <> f.vec_id AND k.vec_id % 3 <> 0)
SELECT field, arg_max(key, (score, key)) AS key, round(max(score), 3) AS score, max(score) < 0.35 AS missing FROM s GROUP BY field""",
    "vector_index_copies": """
WITH f AS (SELECT label, -vec_id - 1 AS field, [x * 2 + CASE WHEN i = 1 THEN 0.01 ELSE 0 END FOR x, i IN embedding::DOUBLE[]] AS vec FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT field, k.vec_id AS key, list_cosine_similarity(f.vec, k.embedding::DOUBLE[]) AS score FROM f JOIN embeddings k ON f.label = k.label)
SELECT field, arg_max(key, (score, key)) AS key, round(max(score), 3) AS score, max(score) < 0.9 AS missing FROM s GROUP BY field""",
    "missing_fields_kw": """
WITH f AS (SELECT DISTINCT p_partkey % 50 AS g, lower(list_last(string_split(p_type, ' '))) AS field FROM part)
SELECT g, field FROM f WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey % 50 = f.g AND (contains(lower(p_name), f.field) OR contains(lower(p_name), replace(f.field, '_', ' '))))""",
    "jsonld_roundtrip": f"SELECT p_partkey AS page_id, unnest(['@type', 'name', 'size']) AS key, unnest(['Product', p_name, p_size::VARCHAR]) AS value FROM {_FULL} WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, '@type', 'ItemList' FROM {_FULL} WHERE p_partkey % 2 = 1",
    "microdata_roundtrip": f"""SELECT p_partkey AS page_id, unnest(['name', 'tag']) AS key, unnest(['["' || p_name || '","two"]', '["a","' || p_brand || '"]']) AS value FROM {_FULL}""",
    "opengraph_roundtrip": f"SELECT p_partkey AS page_id, unnest(['og:title', 'og:type']) AS key, unnest([p_name, p_type]) AS value FROM {_FULL}",
    "twitter_roundtrip": f"""SELECT p_partkey AS page_id, unnest(['twitter:label1', 'twitter:data1', 'twitter:title', '_labeled_pairs']) AS key, unnest(['Size', p_size::VARCHAR, p_name, '{{"Size":"' || p_size || '"}}']) AS value FROM {_FULL}""",
    "meta_roundtrip": f"SELECT p_partkey AS page_id, unnest(['_page_title', 'meta:brand', 'meta:kind']) AS key, unnest([p_name, p_brand, p_type]) AS value FROM {_FULL}",
    "label_value_roundtrip": f"SELECT p_partkey AS page_id, CASE WHEN p_size >= 10 THEN 'text:Size' ELSE 'text:size' END AS key, CASE WHEN p_size >= 10 THEN p_size::VARCHAR ELSE 'other' END AS value FROM {_FULL}",
    "deflist_roundtrip": f"SELECT p_partkey AS page_id, 'text:Brand name' AS key, p_brand AS value FROM {_FULL}",
    "sections_roundtrip": f"SELECT p_partkey AS page_id, 'text:Facts - Kind' AS key, p_type AS value FROM {_FULL}",
    "itemlist_roundtrip": f"SELECT p_partkey AS page_id, unnest([2, 2]) AS position, unnest([p_name, 'x']) AS name FROM {_FULL}",
    "items_microdata": f"SELECT p_partkey AS page_id, unnest([1, 1, 2]) AS position, unnest(['name', 'tag', 'name']) AS key, unnest([p_name, 'a', 'two']) AS value FROM {_FULL}",
    "merge_engines": f"""
SELECT p_partkey AS page_id,
  unnest(['@type', 'name', CASE WHEN p_partkey % 2 = 0 THEN 'size' ELSE 'itemListElement' END, 'tag', 'og:title', 'og:type', 'twitter:label1', 'twitter:data1', 'twitter:title', '_labeled_pairs',
    '_page_title', 'meta:brand', 'meta:kind', CASE WHEN p_size >= 10 THEN 'text:Size' ELSE 'text:size' END, 'text:Kind', 'text:Brand name', 'text:Facts - Kind']) AS key,
  unnest([CASE WHEN p_partkey % 2 = 0 THEN 'Product' ELSE 'ItemList' END, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '["' || p_name || '","two"]' END,
    CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '[{{"position":2,"item":{{"name":"' || p_name || '"}}}},{{"item":{{"name":"x"}}}}]' END, '["a","' || p_brand || '"]',
    p_name, p_type, 'Size', p_size::VARCHAR, p_name, '{{"Size":"' || p_size || '"}}', p_name, p_brand, p_type, CASE WHEN p_size >= 10 THEN p_size::VARCHAR ELSE 'other' END, p_type, p_brand, p_type]) AS value,
  unnest(['json_ld', CASE WHEN p_partkey % 2 = 0 THEN 'json_ld' ELSE 'microdata' END, 'json_ld', 'microdata', 'opengraph', 'opengraph', 'twitter_cards', 'twitter_cards', 'twitter_cards', 'twitter_cards',
    'heuristic', 'heuristic', 'heuristic', 'heuristic', 'heuristic', 'heuristic', 'heuristic']) AS engine FROM {_FULL}""",
    "engine_confidence": f"""
WITH e AS (SELECT p_partkey AS page_id, unnest(['json_ld', 'microdata', 'opengraph', 'twitter_cards', 'heuristic']) AS engine, unnest([0.95, 0.85, 0.75, 0.70, 0.50])::DOUBLE AS base, unnest([CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END, 2, 2, 4, 7]) AS n_fields FROM {_FULL})
SELECT page_id, engine, n_fields::BIGINT AS n_fields, round(base * n_fields / 17, 4) AS confidence FROM e""",
    "page_result": f"""
SELECT p_partkey AS page_id, 'json_ld+microdata+opengraph+twitter_cards+heuristic' AS methods, round(0.95::DOUBLE * CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END / 17, 4) AS confidence, true AS low_confidence, 17::BIGINT AS n_fields FROM {_FULL}""",
    "discover_fields": f"""
SELECT p_partkey AS page_id, array_to_string(list_sort(['@type', '_labeled_pairs', '_page_title', CASE WHEN p_partkey % 2 = 0 THEN 'size' ELSE 'itemListElement' END, 'meta:brand', 'meta:kind', 'name', 'og:title', 'og:type', 'tag', 'text:Brand name', 'text:Facts - Kind', 'text:Kind',
  CASE WHEN p_size < 10 THEN 'text:size' ELSE 'text:Size' END, 'twitter:data1', 'twitter:label1', 'twitter:title']), ',') AS keys FROM {_FULL}""",
    "dom_blocks": f"SELECT p_partkey AS page_id, unnest(['section:Facts', 'deflist:0']) AS key, unnest(['Kind: ' || p_type || 'plain', 'Brand name: ' || p_brand]) AS text FROM {_FULL}",
    "selector_candidates": f"SELECT p_partkey AS page_id, 'title' AS field, 1 AS rank, 'span' AS selector, p_name AS sample, 0.9::DOUBLE AS score FROM {_FULL}",
    "field_tiers": f"""
WITH k AS (
  SELECT unnest(['text:Brand name', 'text:Facts - Kind', 'text:Kind', CASE WHEN p_size < 10 THEN 'text:size' ELSE 'text:Size' END, 'tag', 'name', '@type', CASE WHEN p_partkey % 2 = 0 THEN 'size' ELSE 'itemListElement' END, CASE WHEN p_partkey % 2 = 0 THEN 'name' END]) AS key FROM {_FULL})
SELECT key, CASE WHEN key IN ('name', '@type') THEN 1 ELSE 3 END AS tier, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL""",
    "item_sources_chosen": f"SELECT p_partkey AS page_id, 'json_ld' AS source, 2 AS n FROM {_FULL}",
    "page_recommendations": """
WITH e AS (SELECT greatest(0, least(100, trunc(value * 1.5 - 10)::INT)) AS s, event_id FROM events), p AS (SELECT CASE WHEN event_id % 3 = 0 THEN least(s, 5) ELSE s END AS score FROM e)
SELECT score, CASE WHEN score >= 90 THEN 'VALID' WHEN score >= 50 THEN 'RETRY' ELSE 'SKIP' END AS advice, count(*) AS n FROM p GROUP BY ALL""",
    "failure_stages": f"""
WITH s AS (SELECT CASE WHEN request_id % 5 = 0 THEN 'VALIDATED' WHEN request_id % 5 = 1 OR request_id % 7 = 0 THEN 'PIPELINES_RUNNING' WHEN request_id % 3 = 0 THEN 'INTENT_DONE' WHEN request_id % 3 = 1 THEN 'VALIDATED' ELSE 'INIT' END AS stage FROM {_ORD} WHERE state = 'FAILED')
SELECT stage, CASE stage WHEN 'INIT' THEN 0 WHEN 'INTENT_DONE' THEN 1 WHEN 'VALIDATED' THEN 2 ELSE 4 END AS place, count(*) AS n FROM s GROUP BY ALL""",
    "item_summaries": f"SELECT item_id, concat_ws(' | ', name, concat_ws(', ', 'kind: ' || kind, 'size: ' || size)) AS summary FROM {_ITEMS}",
    "validate_extraction": f"""
SELECT request_id, ord, count(*) AS filled_fields, true AS valid, coalesce(string_agg('Type mismatch for ''tax'': expected number', '; ') FILTER (field = 'tax'), '') AS warnings FROM ({_COMPETE}) GROUP BY request_id, ord""",
}
