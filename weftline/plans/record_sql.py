"""SQL for record_queries, from the tables that its frames come from."""

from weftline.operators.records import STATE_ORDER

_NET = "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"
_FIELDS = """(SELECT p_partkey AS id, unnest([{'key': '_heading', 'value': CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE '' END}, {'key': 'name', 'value': CASE WHEN p_partkey % 3 <> 0 THEN ' ' || p_name END}, {'key': 'title', 'value': p_name || '  '},
  {'key': 'director', 'value': ' ' || p_brand}, {'key': 'genre', 'value': CASE WHEN p_partkey % 5 <> 0 THEN p_type END}, {'key': 'source_url', 'value': 'u'}, {'key': 'meta:size', 'value': p_size::VARCHAR},
  {'key': 'query_answer', 'value': CASE WHEN p_partkey % 2 = 0 THEN 'an answer' END}], recursive := true) FROM part)"""
_EAV = "(SELECT l_orderkey AS request_id, CASE WHEN l_returnflag = 'R' THEN '_' ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN 'meta:' ELSE '' END || 'k' || quarter(l_shipdate) || CASE WHEN l_linestatus = 'F' THEN '.sub' ELSE '' END AS key, quarter(l_shipdate) AS q, l_returnflag = 'R' AS hidden, l_linenumber % 2 = 0 AS meta FROM lineitem)"
_INTENTS = f"""(SELECT page_id AS n, url, {_NET} AS site, string_split({_NET}, '.')[1] AS t, CASE WHEN page_id % 7 <> 0 THEN string_split({_NET}, '.')[1] ELSE 'another' END AS entity, CASE WHEN page_id % 3 = 0 THEN (page_id % 10)::VARCHAR END AS year,
  ['english', 'german', 'french', NULL][page_id % 4 + 1] AS lang, ['en', 'de', 'fr', NULL][page_id % 4 + 1] AS code FROM pages)"""
_ASCII = "trim(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'))"
_SITE_FIELDS = "(SELECT l_orderkey AS request_id, 's' || l_suppkey || '.com' AS site_domain, 'key' || l_linenumber AS raw_field_key, l_linenumber AS ord, round(min(l_discount) * 10, 2) AS relevance, round(min(l_tax), 2)::VARCHAR AS raw_value FROM lineitem GROUP BY l_orderkey, l_suppkey, l_linenumber)"
_LISTED = "(SELECT l_orderkey AS request_id, l_linenumber AS position, max(l_quantity) AS q, min(l_returnflag) AS flag, CASE WHEN min(l_tax) > 0.01 THEN round(min(l_tax), 2) END AS tax FROM lineitem GROUP BY ALL)"
_KEYS = "(SELECT p_name || ' ' || p_type AS key, p_size < 10 AS a, p_retailprice > 1000 AS b FROM part)"
_CARDS = "(SELECT *, p_partkey AS page_id FROM part)"
_STATES = "[" + ", ".join(f"'{s}'" for s in STATE_ORDER) + ", 'FAILED']"
ORACLES = {
    "state_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "page_scan": "SELECT page_id, length(html) AS n_chars, md5(substr(html, 1, 500)) AS cut_md5 FROM pages",
    "domain_fields": "SELECT 'd' || p_partkey AS name, unnest([p_brand, 'kind']) AS alias, unnest(['brand', p_type]) AS schema_field FROM part WHERE p_partkey % 7 <> 0",
    "active_sites": "SELECT s_name AS name, unnest(CASE WHEN s_suppkey % 5 <> 0 THEN ['a' || s_suppkey || '.com', 'b' || s_suppkey || '.com'] ELSE [NULL] END) AS site FROM supplier WHERE s_acctbal > 0",
    "robots_texts": f"""
WITH c AS (SELECT {_NET} AS site, page_id, TIMESTAMP '2024-01-09' + page_id * INTERVAL 1 MINUTE AS made FROM pages), live AS (SELECT * FROM c WHERE made + (page_id % 3) * INTERVAL 1 DAY > TIMESTAMP '2024-01-10')
SELECT site, 'cached ' || arg_max(page_id, made) AS raw FROM live GROUP BY site UNION ALL SELECT DISTINCT site, 'fetched' FROM c WHERE site NOT IN (SELECT site FROM live)""",
    "serp_rows": "SELECT o_orderkey AS request_id, i::INT AS pos, 'https://r.example/' || o_orderkey || '/' || i AS url, 'title ' || i || ' ' || o_orderkey AS title, 's' AS snippet FROM orders, range(3) r(i) WHERE (o_orderkey + i) % 3 <> 0",
    "results_written": "SELECT o_orderkey AS request_id, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN '2024-01-01 01:00' ELSE '2024-01-02 01:00' END AS expires FROM orders",
    "log_written": """SELECT event_id, '{"type":"' || event_type || '","cache_stages_hit":"' || CASE WHEN event_type = 'error' THEN 'L1,L2' ELSE '' END || '"}' AS metadata FROM events""",
    "diagnostics_nested": """
WITH p AS (SELECT *, p_partkey % 5 <> 0 AS held, p_partkey % 3 <> 0 AS branded, CASE WHEN p_partkey % 2 = 0 THEN repeat(p_name, 20) ELSE p_name END AS name FROM part)
SELECT p_partkey AS request_id, 's' || p_size % 10 AS site, CASE WHEN NOT held THEN 0 WHEN branded THEN 3 ELSE 2 END AS n_keys, CASE WHEN NOT held THEN '' WHEN branded THEN 'brand,name,text:Size' ELSE 'name,text:Size' END AS keys,
  CASE WHEN NOT held THEN '' WHEN branded THEN 'heuristic:2:name+text:Size json_ld:2:brand+name' ELSE 'heuristic:2:name+text:Size json_ld:1:name' END AS engines,
  CASE WHEN NOT held THEN '' WHEN length(name) > 200 THEN substr(name, 1, 200) || '...' ELSE name END AS name FROM p""",
    "diagnostics_written": "SELECT source AS site, doc_id AS key, substr(text, 1, 200) AS value FROM documents",
    "csv_written": """SELECT 's' || p_size AS site_domain, '"' || p_name || '", ' || p_partkey AS "Field", p_type AS "Value", 'a,b' AS "Category", p_brand AS "Source" FROM part""",
    "semantic_rows": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS relevance, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'other' END AS category, md5(substr(text, 1, 500)) AS value_md5 FROM documents",
    "picked_titles": "SELECT p_partkey AS id, p_name AS title FROM part",
    "trimmed_fields": f"SELECT id, key, CASE WHEN key = 'name' THEN value ELSE trim(value) END AS value FROM {_FIELDS} WHERE key IN ('title', 'director', 'name') AND value IS NOT NULL",
    "signed_confidences": """
WITH l AS (SELECT l_returnflag = 'R' AS failed, l_discount * 12 - 0.1::DOUBLE AS c FROM lineitem)
SELECT failed, round(CASE WHEN NOT failed THEN c WHEN c > 0 THEN greatest(-1.0, -c) ELSE -0.5 END, 4)::DOUBLE AS confidence, count(*) AS n FROM l GROUP BY ALL""",
    "display_values": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || ' (' || p_partkey || ' votes)' WHEN 2 THEN p_name WHEN 3 THEN 'a, ' || p_name ELSE p_name END AS shown FROM part",
    "display_records": """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Unit Price Net' ELSE 'Size Of It' END AS label, CASE p_partkey % 3 WHEN 0 THEN p_size || ' / 10' WHEN 1 THEN p_size || ' / 50' ELSE p_name END AS shown
FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 3 <> 2 OR p_partkey % 11 <> 0)""",
    "previews": "SELECT doc_id, substr(text, 1, 20) AS p20, substr(text, 1, 120) AS p120 FROM documents",
    "search_queries": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE concat_ws(' ', p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END, CASE WHEN p_partkey % 3 = 0 THEN 'cast plot year' ELSE 'movie' END) END AS query FROM part",
    "expanded_queries": """
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN concat_ws('|', p_name, p_type, p_brand) WHEN p_partkey % 2 = 0 THEN concat_ws('|', p_name, p_type, 'raw') WHEN p_partkey % 3 = 0 THEN concat_ws('|', p_name, p_brand, 'raw') ELSE p_name || '|raw' END AS queries FROM part""",
    "multi_items": """
WITH o AS (SELECT o_orderkey AS k, k % 3 <> 0 AS titled, k % 5 = 0 AS compare, k % 2 + 1 AS sites, CASE WHEN k % 4 = 0 THEN k % 3 END AS lim FROM orders)
SELECT k AS request_id, (NOT titled OR k % 2 = 0 OR coalesce(lim > 1, false)) AND NOT (titled AND NOT compare AND NOT (compare AND sites > 1)) AS multi FROM o""",
    "mapped_aliases": f"SELECT key, CASE WHEN (meta OR NOT hidden) AND q < 4 AND NOT (hidden) THEN 'field' || q % 2 END AS schema_field, count(*) AS n FROM {_EAV} GROUP BY ALL",
    "semantic_completeness": f"SELECT request_id, round(count(DISTINCT CASE WHEN q < 4 THEN q % 2 END) / 3, 4) AS completeness FROM {_EAV} WHERE NOT hidden GROUP BY request_id",
    "field_completeness": f"SELECT id, round(count(*) FILTER (key IN ('title', 'name', 'genre')) / 4, 4) AS completeness FROM {_FIELDS} WHERE value IS NOT NULL GROUP BY id",
    "core_fields": "SELECT p_name AS field, count(*) AS n FROM part WHERE p_size > 40 GROUP BY p_name",
    "answer_records": f"SELECT id, key, value FROM {_FIELDS} WHERE value IS NOT NULL AND (id % 2 = 1 OR key IN ('name', 'query_answer', 'genre', 'director'))",
    "cached_responses": """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 9 <> 0 THEN '{"a":"x","b":' || o_custkey || '}' END AS data, o_orderpriority AS original_query, 'exact' AS match_type FROM orders""",
    "simple_confidences": f"SELECT id, least(count(*) FILTER (value <> '' AND key <> 'source_url') / 5, 1)::DOUBLE AS confidence, 0.7::DOUBLE AS list_confidence FROM {_FIELDS} GROUP BY id",
    "found_fields": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand || ',' || p_type END AS found FROM part",
    "policy_reasons": """
SELECT o_orderpriority AS domain, CASE WHEN o_orderpriority <> '5-LOW' THEN 'domain mismatch' WHEN o_custkey % 10 / 10 < 0.3 THEN 'confidence too low' WHEN o_orderkey % 7 > 4 THEN 'too many sites' WHEN o_totalprice > 300000 THEN 'too dear' ELSE '' END AS reason, count(*) AS n FROM orders GROUP BY ALL""",
    "rejected_sites": "SELECT DISTINCT l_suppkey AS site, CASE WHEN s_acctbal > 1000 AND s_acctbal <= 5000 THEN 'rejected' ELSE 'candidate' END AS status FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey",
    "url_matches": f"""
SELECT n AS page_id, (n % 5 = 0 OR {_ASCII.format('t')} = {_ASCII.format('entity')}) AND (year IS NULL OR contains(lower(url), year)) AND (lang IS NULL OR contains(lower(url), lang) OR contains(lower(url), code)) AS matches FROM {_INTENTS}""",
    "url_cache": f"""
WITH p AS (SELECT *, n % 11 / 10 AS confidence, n % 5 = 0 AS blocked FROM {_INTENTS}),
r AS (SELECT a.n AS request_id, a.year, a.lang, a.code, b.url AS pattern, b.confidence, b.blocked, row_number() OVER (PARTITION BY a.n ORDER BY b.confidence DESC, b.url) AS rank FROM p a JOIN p b ON a.site = b.site WHERE b.confidence > 0.5)
SELECT request_id, arg_min(pattern, rank) AS pattern, arg_min(confidence, rank) AS confidence FROM r
WHERE rank <= 5 AND NOT blocked AND (year IS NULL OR contains(lower(pattern), year)) AND (lang IS NULL OR contains(lower(pattern), lang) OR contains(lower(pattern), code)) GROUP BY request_id""",
    "cache_rows_ok": """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN k % 3 = 0 THEN k % 4 + 2000 ELSE 0 END AS y1, CASE WHEN c % 3 = 0 THEN c % 4 + 2000 ELSE 0 END AS y2, CASE WHEN k % 5 = 0 THEN 'english' WHEN k % 5 = 1 THEN 'french' END AS l1, CASE WHEN c % 2 = 0 THEN 'english' END AS l2 FROM orders)
SELECT k AS o_orderkey, y1 = y2 AND (l1 IS NULL OR l2 IS NULL OR l1 = l2) AND (k % 2 = 1 OR k % 3 = c % 3 OR k % 3 = 0) AS ok FROM o""",
    "robots_outcomes": "SELECT event_type, ['ok', 'allow_all', 'retry', 'retry', 'fetch_failed'][event_id % 5 + 1] AS outcome, count(*) AS n FROM events GROUP BY ALL",
    "noise_dropped": "SELECT p_partkey, p_brand AS key FROM part WHERE p_partkey % 3 = 2 AND p_partkey % 4 = 2",
    "envelope_errors": """
WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS d FROM orders)
SELECT k AS o_orderkey, concat_ws('; ', CASE WHEN k % 6 = 0 THEN 'missing key: task' END, CASE WHEN k % 5 = 0 THEN 'missing key: result' END, CASE WHEN k % 7 = 0 THEN 'missing key: confidence' END, CASE WHEN d <> '5-LOW' THEN 'domain mismatch' END,
  CASE WHEN k % 4 = 0 THEN 'schema_version mismatch' END, CASE WHEN k % 5 = 0 OR k % 3 = 0 THEN 'missing key: result.score' END) AS errors, CASE WHEN k % 7 = 0 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM o""",
    "type_checks": """
WITH o AS (SELECT ['string', 'integer', 'number', 'null', NULL][o_orderkey % 5 + 1] AS vtype, ['string', 'number', 'string|number', NULL][o_custkey % 4 + 1] AS wanted FROM orders)
SELECT vtype, wanted, coalesce(wanted IS NULL OR vtype IS NULL OR vtype = 'null' OR list_contains(string_split(wanted, '|'), vtype) OR (vtype = 'integer' AND wanted LIKE '%number%'), true) AS ok, count(*) AS n FROM o GROUP BY ALL""",
    "preselected": "SELECT l_orderkey AS request_id, l_linenumber FROM lineitem WHERE l_discount * 10 >= 0.7",
    "resumable_requests": f"SELECT {_STATES}[o_orderkey % 9 + 1] AS state, count(*) AS n FROM orders WHERE o_orderkey % 9 NOT IN (0, 7, 8) GROUP BY 1",
    "next_steps": """
WITH p AS (SELECT l_orderkey, count(*) / 7 AS c, max(l_linenumber) > 2 AS multi, max(l_linenumber) AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_orderkey % 2 = 0 AND (NOT multi OR c < 0.35) AS fallback, NOT multi AND c < 0.7 AND m < 5 AS next_url FROM p""",
    "versioned": "SELECT o_orderkey, '2' AS schema_version FROM orders WHERE o_orderpriority LIKE '2%'",
    "stale_types": """
WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 10 MINUTE)
SELECT 'request' AS kind, 'FAILED' AS what, count(*) AS n FROM o UNION ALL SELECT 'run', 'FAILED', count(*) FROM lineitem WHERE l_linestatus <> 'F' AND l_orderkey IN (FROM o) UNION ALL SELECT 'checkpoint', '{"reason":"stale","minutes":10}', count(*) FROM o""",
    "longest_values": "SELECT p_partkey AS page_id, 'k' AS key, CASE WHEN length(p_type) > length(p_name) THEN p_type ELSE p_name END AS value FROM part",
    "selected_fields": f"SELECT request_id, site_domain, raw_field_key, relevance FROM {_SITE_FIELDS} WHERE ord IN (2, 4, 6)",
    "fields_by_site": f"SELECT request_id, site_domain, string_agg(raw_field_key || '=' || raw_value, ';' ORDER BY relevance DESC, raw_field_key) AS fields FROM {_SITE_FIELDS} GROUP BY ALL",
    "owned_runs": "SELECT l_orderkey AS request_id, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "attached_selection": """
SELECT l_orderkey AS request_id, 'https://x/' || l_partkey AS url, l_quantity * 2 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber * 1000000 + l_partkey) AS rn FROM lineitem WHERE l_quantity * 2 >= 50) WHERE rn = 1""",
    "first_urls": "SELECT 'https://x/' || l_partkey AS url, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS request_id, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS line FROM lineitem GROUP BY 1",
    "confidence_order": """
WITH t AS (SELECT l_orderkey AS request_id, round(l_discount * 10, 2) AS c, l_shipdate AS s, min('https://x/' || l_partkey) AS url FROM lineitem GROUP BY ALL)
SELECT request_id, url, row_number() OVER (PARTITION BY request_id ORDER BY c DESC, s DESC, url)::INT AS place FROM t""",
    "latest_starts": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price FROM orders ORDER BY price NULLS LAST, o_orderkey LIMIT 10",
    "raw_keys": """
WITH n AS (SELECT DISTINCT p_partkey % 100 AS g, lower(list_last(string_split(p_name, ' '))) AS field FROM part),
k AS (SELECT p_partkey % 100 AS g, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS key, p_partkey AS ord FROM part),
m AS (SELECT n.g, n.field, k.key, row_number() OVER (PARTITION BY n.g, n.field ORDER BY (lower(k.key) <> n.field)::INT, k.ord, k.key) AS rn FROM n JOIN k ON n.g = k.g WHERE contains(lower(k.key), n.field) OR contains(n.field, lower(k.key)))
SELECT n.g, n.field, m.key AS raw_key FROM n LEFT JOIN m ON n.g = m.g AND n.field = m.field AND m.rn = 1""",
    "same_site_links": f"SELECT page_id, page_id % 2 = 0 OR {_NET} LIKE '%.example.org' OR {_NET} = 'example.org' AS same FROM pages",
    "link_ranks": """
WITH l AS (SELECT l_orderkey AS page_id, l_partkey AS target, CASE WHEN min(l_returnflag) <> 'N' THEN max(l_quantity) END AS score FROM lineitem GROUP BY ALL)
SELECT page_id, target, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC NULLS LAST, target)::INT AS rank FROM l WHERE target NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)) WHERE rank <= 3""",
    "log_replay": "SELECT event_id, event_type FROM events WHERE user_id = (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "intent_order": f"""
WITH i AS (SELECT l.*, o_orderkey % 2 = 0 AS down, CASE o_orderkey % 3 WHEN 0 THEN q WHEN 2 THEN tax END AS v, CASE o_orderkey % 3 WHEN 1 THEN flag END AS t FROM {_LISTED} l JOIN orders ON request_id = o_orderkey)
SELECT request_id, position, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN down THEN v END DESC NULLS LAST, CASE WHEN NOT down THEN v END NULLS LAST, CASE WHEN down THEN t END DESC NULLS LAST, CASE WHEN NOT down THEN t END NULLS LAST, position)::INT AS place FROM i""",
    "filtered_items": f"""
SELECT request_id, position FROM {_LISTED} l LEFT JOIN orders ON request_id = o_orderkey AND o_orderkey % 5 <> 0
WHERE o_orderkey IS NULL OR coalesce(CASE request_id % 4 WHEN 0 THEN q >= request_id % 40 WHEN 1 THEN flag = 'N' AND q < 30 WHEN 2 THEN q BETWEEN 10 AND 20 AND tax > 0.02 ELSE tax <= 0.05 END, false)""",
    "key_sets": f"""
SELECT DISTINCT 'union' AS kind, key FROM {_KEYS} WHERE a OR b UNION ALL (SELECT 'intersect', key FROM {_KEYS} WHERE a INTERSECT SELECT 'intersect', key FROM {_KEYS} WHERE b)
UNION ALL (SELECT 'except', key FROM {_KEYS} WHERE a EXCEPT SELECT 'except', key FROM {_KEYS} WHERE b)""",
    "tier_hits": "SELECT o_orderkey AS request_id, o_custkey % 50 AS site, o_orderkey % 10 / 10 AS score, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS tier FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "fragment_fields": f"""
SELECT page_id, 'text:Kind' AS key, p_type AS value FROM {_CARDS} UNION ALL SELECT page_id, 'name', p_name FROM {_CARDS} WHERE page_id % 5 = 0
UNION ALL SELECT page_id, unnest(['brand', 'Kind']), unnest([p_brand, 'json']) FROM {_CARDS} WHERE page_id % 2 = 0
UNION ALL SELECT page_id, '_fragment_title', p_name FROM {_CARDS} WHERE page_id % 5 <> 0 AND page_id % 3 <> 2""",
    "extra_engine": f"SELECT page_id, 'heading' AS key, 'Top' AS value, 'headings' AS engine FROM {_CARDS} WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'name', p_name, 'microdata' FROM {_CARDS} WHERE page_id % 5 = 0",
    "registered_operator": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "missing_by_vector": """
SELECT f.label, f.vec_id AS field FROM embeddings f JOIN embeddings k ON f.label = k.label AND f.vec_id <> k.vec_id WHERE f.vec_id % 100 = 0
GROUP BY ALL HAVING max(list_cosine_similarity(f.embedding::DOUBLE[], k.embedding::DOUBLE[])) < 0.95""",
    "silent_sessions_stream": """
WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS fresh FROM events), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, k""",
}
