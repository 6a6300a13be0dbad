"""Quirks of the operators on small frames."""

import datetime as dt
import re

from pyspark.sql import functions as F

from weftline.functions import intents, registry, text, urls
from weftline.operators import blocks, caches, candidates, dom, engines, oplog, pages, records, robots, unify, vectors
from weftline.sources import tables
from weftline.streaming import jobs, keyed


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_titles(spark):
    assert one(spark, text.norm_title(F.col("t")), t="Amélie &amp; Co. (2001)") == unicode_norm("amélie  co")
    assert one(spark, text.norm_title_ascii(F.col("t")), t=" The Best-Of 2! ") == "the bestof 2"
    assert one(spark, text.clean_query(F.col("t")), t="<b>a</b> \t x  y ") == "a x y"


def unicode_norm(s):
    import re
    import unicodedata

    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", unicodedata.normalize("NFKD", s))).strip()


def test_ratings(spark):
    for raw, want in (("8.8/10", "8.8"), ("93%", "93%"), ("11", "11"), ("7", "7.0"), ("9 / 10", "9.0")):
        assert one(spark, text.norm_rating(F.col("t")), t=raw) == want


def test_urls(spark):
    for url, want in (("http://a.com/x", "Only HTTPS allowed, got: http://"), ("ftp://a.com", "Blocked scheme: ftp://"), ("file:///etc", "Blocked scheme: file://"), ("localhost/x", "Blocked host: localhost"), ("https://10.0.0.1/", "IP literal URLs not allowed: 10.0.0.1"), ("https://[::1]/", "Blocked host: ::1"), ("a.com", None)):
        assert one(spark, urls.url_reason(F.col("u")), u=url) == want, url
    assert one(spark, urls.registrable_domain(F.col("u")), u="www.bbc.co.uk") == "bbc.co.uk"
    assert one(spark, urls.registrable_domain(F.col("u")), u="a.b.example.org") == "example.org"
    assert one(spark, urls.entity_id(F.col("u")), u="https://a.com/title/tt01/?x=1") == "tt01"
    for href, want in (("/x", "https://a.com/x"), ("y", "https://a.com/b/y"), ("//c.com/z", "https://c.com/z"), ("https://d.com", "https://d.com"), ("?q", "https://a.com/b/c?q"), ("#t", "https://a.com/b/c#t")):
        assert one(spark, urls.abs_url(F.col("b"), F.col("h")), b="https://a.com/b/c", h=href) == want


def test_intent_hash_ignores_volatile_keys(spark):
    h = lambda s: one(spark, intents.intent_hash(F.col("i"), F.lit("movie"), F.lit("1")), i=s)
    assert h('{"title":"A","raw_query":"x","query_type":"list"}') == h('{"query_type":"search","title":"A"}')
    assert h('{"title":"A"}') != h('{"title":"B"}')


def test_cache_row(spark):
    ok = lambda a, b: one(spark, intents.cache_row_ok(F.col("a"), F.col("b"), F.array().cast("array<string>"), F.array(F.lit("x"))), a=a, b=b)
    assert ok('{"year":2010}', '{"filters":{"release_year":{"value":2010}}}')
    assert not ok('{"year":2010}', "{}")
    assert not ok('{"language":"Hindi"}', '{"language":"tamil"}')


def test_robots_quirks(spark):
    raw = "User-agent: a\nDisallow: /a\nUser-agent: b\nUser-agent: c\n# no\nDisallow:\nDisallow: /c\nAllow: /c/d\nSitemap: https://x/s.xml"
    rules = robots.robots_rules(spark.createDataFrame([("s", raw)], "site string, raw string"))
    assert {(r.ua, r.kind, r.path) for r in rules.collect()} == {("a", "disallow", "/a"), ("c", "disallow", "/c"), ("c", "allow", "/c/d")}


def test_tag_soup(spark):
    html = "<div><p><b>x<br><p>y</div></i><img src=a><ul><li>1<li>2</ul>"
    nodes = {r.node_id: r for r in dom.dom_nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).collect()}
    assert [nodes[i].tag for i in sorted(nodes)] == ["div", "p", "b", "br", "p", "img", "ul", "li", "li"]
    assert nodes[0].subtree_end == 4 and nodes[4].parent_id == 2 and nodes[8].parent_id == 7


def test_jsonld_shapes(spark):
    html = '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"A","x":1,"y":null},{"@type":"A","x":2,"y":3}]}</script>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert {(r.key, r.value) for r in engines.engine_jsonld(df).collect()} == {("@type", "A"), ("x", "2"), ("y", "3")}
    assert engines.items_jsonld(df).count() == 2


def test_label_lines(spark):
    html = "<p>Size : 10</p><p>size: 12</p><p>A: x</p><p>Gone:</p><p>Next: yes</p>"
    got = {(r.key, r.value) for r in engines.engine_label_value(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert ("text:Size", "10") in got and not any(k.lower() == "text:a" for k, _ in got)


def test_conflicts(spark):
    rows = [(1, "a", "s1", "X", 0.9, 1), (1, "a", "s2", "x ", 0.5, 2), (1, "b", "s1", "1", 0.6, 1), (1, "b", "s2", "2", 0.5, 2), (1, "c", "s1", "1", 0.55, 1), (1, "c", "s2", "2", 0.5, 2), (1, "d", "s1", "1", 0.5, 1), (1, "e", "s1", "5", 0.5, 1), (1, "e", "s2", "5.0", 0.9, 2)]
    df = spark.createDataFrame(rows, "k long, field string, site string, value string, weight double, ord int")
    assert {r.field: (r.value, r.status) for r in unify.unify_fields(df, ["k"]).collect()} == {"a": ("X", "agree_normalized"), "b": ("1", "by_weight"), "c": ("1", "conflict"), "d": ("1", "single"), "e": ("5", "agree_normalized")}


def test_unify_keeps_untitled_apart(spark):
    df = spark.createDataFrame([(1, "s", "", {"x": "1"}), (2, "s", "", {"x": "2"}), (3, "t", "A!", {"x": "3"}), (4, "u", "a (2010)", {"x": "4", "y": "5"})], "item_id long, site string, title string, fields map<string,string>")
    got = {(r.norm, r.key): r.value for r in unify.unify_items(df, text.norm_title(F.col("title"))).collect()}
    assert got == {("__notitle_1", "x"): "1", ("__notitle_2", "x"): "2", ("a", "x"): "4", ("a", "y"): "5"}


def test_fuzzy_join_is_brute_force(spark):
    import random

    rng = random.Random(3)
    keys = [f"movie|{rng.choice('abc')}{rng.randint(0, 3)}|20{rng.randint(10, 13)}|{'x' * rng.randint(0, 6)}" for _ in range(60)] + ["", "||"]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, key string")

    def grams(k):
        import re

        return {p[i : i + 3] for w in re.split("[^a-z0-9]+", k) if w for p in [f"  {w} "] for i in range(len(p) - 2)}

    want = {(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys) if grams(a) and grams(b) and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > 0.65}
    assert {(r.left_id, r.right_id) for r in caches.fuzzy_join(df, df).collect()} == want


def test_attempts_stop_after_a_good_score(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([10.0, 95.0, 99.0, 20.0])] + [(2, i, 1.0) for i in range(9)], "r long, ord long, score double")
    got = candidates.attempts_until(df, ["r"], ["ord"]).groupBy("r").count().collect()
    assert {x.r: x["count"] for x in got} == {1: 2, 2: 5}


def test_filters_and_sort_by_intent(spark):
    items = spark.createDataFrame([(1, 1, {"y": "9"}), (1, 2, {"y": "10"}), (1, 3, {})], "request_id long, position int, fields map<string,string>")
    flt = spark.createDataFrame([(1, "y", ">=", "9", None)], "request_id long, field string, op string, value string, upper string")
    assert {r.position for r in candidates.apply_filters(items, flt).collect()} == {1, 2}
    how = spark.createDataFrame([(1, "y", "desc")], "request_id long, sort_by string, sort_order string")
    assert [r.position for r in candidates.order_by_intent(items, how).orderBy("place").collect()] == [2, 1, 3]


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 0.1), ("a", 3.0), ("a", None)], "l string, v double")
    assert {r.le: r.n for r in oplog.histogram(df, "v", (0.1, 1.0), ["l"]).collect()} == {"0.1": 2, "1": 2, "+Inf": 3}


def test_meaningful_values(spark):
    for v, want in (("short", False), ("long enough to be data", True), ("[1]", True), ("[]", False), ("a b c d e f g h i j k l m", False)):
        assert one(spark, vectors.is_meaningful(F.col("v")), v=v) is want
    assert one(spark, vectors.is_noise(F.col("v")), v="nav:x")


def test_rate_limiter_counts_admitted_only():
    verdicts, held = keyed.admitted([0, 1, 2, 61, 61.5], [], 60, 2)
    assert [a for a, _ in verdicts] == [True, True, False, True, True] and held == [61, 61.5]


def test_streams_match_batch(spark, data):
    df = jobs.run_all(keyed.rate_limit(tables.read_log_stream(spark, data).withWatermark("ts", "10 minutes"), 2, 3600), tables.scratch(spark, "o"), tables.scratch(spark, "c")).toPandas().sort_values("event_id")
    events = spark.read.parquet(f"{data}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    want = {}
    for _, g in events.groupby("user_id"):
        verdicts, _ = keyed.admitted([t.timestamp() for t in g["ts"]], [], 3600, 2)
        want |= dict(zip(g["event_id"], [a for a, _ in verdicts], strict=True))
    assert dict(zip(df["event_id"], df["accepted"], strict=True)) == want


def test_state_machine_stream(spark, tmp_path):
    rows = [(1, 1, "INIT", "INTENT_DONE"), (1, 2, "INIT", "FAILED"), (1, 3, "INTENT_DONE", "UNIFIED"), (1, 4, "INTENT_DONE", "VALIDATED"), (2, 5, "INIT", "COMPLETED")]
    schema = "request_id long, event_id long, from_state string, to_state string, ts timestamp"
    at = lambda i: dt.datetime(2024, 1, 1, 0, i)
    spark.createDataFrame([(*r, at(r[1])) for r in rows], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = jobs.run_all(keyed.apply_transitions(stream.withWatermark("ts", "10 minutes")), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert {r.event_id: r.verdict for r in out} == {1: "applied", 2: "STALE", 3: "INVALID_TRANSITION", 4: "applied", 5: "INVALID_TRANSITION"}


def test_stream_state_expires(spark, tmp_path):
    """A site's failures are forgotten after it was silent for keep: later batches start anew, and no state stays."""
    schema, source, state = "site string, event_id long, ts timestamp", str(tmp_path / "in"), str(tmp_path / "cp")
    got = {}
    for i, (hour, site) in enumerate([(0, "a"), (0, "a"), (1, "a"), (30, "b"), (31, "b"), (60, "a")]):
        spark.createDataFrame([(site, i, dt.datetime(2024, 1, 1 + hour // 24, hour % 24))], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        out = jobs.run_all(keyed.circuit_breaker(stream.withWatermark("ts", "1 minute"), keep=3600.0 * 10), str(tmp_path / "out"), state)
        got = {r.event_id: r.failures for r in out.collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 1, 4: 2, 5: 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    for _ in range(2):
        tables.write_results(df, str(tmp_path / "r"), ["id"], "2024-01-01 00:00:00", 60)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    csv = spark.createDataFrame([("s.com", 'say "x"', "v,1", None, "e")], "site_domain string, field string, value string, category string, source string")
    tables.export_csv(csv, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (back.Field, back.Value, back.site_domain) == ('say "x"', "v,1", "s.com")
    fields = spark.createDataFrame([("k", None, None, "x" * 600)], "key string, relevance double, category string, raw_value string")
    assert tables.semantic_fields(fields).select("relevance", "category", F.length("raw_value")).first()[:] == (0.5, "other", 500)


def test_sources(spark):
    domains = spark.createDataFrame([("m", "active", ["a.com"], '{"field_map":{"name":"title"}}'), ("x", "active", [], "{bad"), ("y", "off", ["b.com"], None)], "name string, status string, allowed_sites array<string>, config string")
    assert [tuple(r) for r in tables.domain_config(domains).collect()] == [("m", "name", "title")]
    assert tables.active_domains(domains).count() == 2
    serp = spark.createDataFrame([(1, '{"organic":[{"link":"u","title":"t"},{"title":"none"},{"link":"v"}]}')], "request_id long, payload string")
    assert [r.url for r in tables.serp_source(serp, 2).collect()] == ["u"]


def test_rules_registry(spark):
    registry.register_rule("movie", registry.domain_policy("movie"))
    df = spark.createDataFrame([("movie", 0.9, 2), ("movie", 0.1, 2), ("book", 0.9, 9)], "domain string, confidence double, n_sites int")
    assert [r.reason for r in registry.denied(df, "movie").collect()] == [None, "confidence too low", "domain mismatch"]


def test_the_parse_sends_small_batches_with_all_attributes():
    """Nodes go in batches that bound a worker's memory; attributes, empty ones too, stay with their nodes across batches."""
    import pyarrow as pa

    html = "".join(f'<p id="{i}" class="c">' if i % 3 else "<p>" for i in range(30_001))
    pages_in = pa.RecordBatch.from_arrays([pa.array([7, 8], pa.int64()), pa.array([html, None], pa.string())], names=["page_id", "html"])
    out = list(dom._parse(None, False)(iter([pages_in])))
    assert len(out) > 2 and max(b.num_rows for b in out) < 20_000
    attrs = [dict(a) for b in out for a in b.column(5).to_pylist()]
    assert attrs == [{"id": str(i), "class": "c"} if i % 3 else {} for i in range(30_001)]


def test_markdown_and_cleaning(spark):
    html = '<nav>x</nav><h2>T</h2><p>a <b>b</b> <a href="/l">c</a></p><ul><li>1</li></ul><script>z</script>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = {r.page_id: r.markdown for r in pages.to_markdown(df).collect()}
    assert got == {1: "## T\n\na b  [c]\n\n- 1", 2: ""}


def test_cleaning_leaves_references_as_they_are(spark):
    """A title that was cut within a reference gets no semicolon, wherever it stands: in a line, after lines, at the end."""
    html = "<title>a&amp</title>\n<p>\nb&amp;&am</p><b>c&#x27 &#x2;&#39</b>\n&lt;d&am"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert pages.clean_html(df).first().html == "<title>a&amp</title> <title>a&amp</title> <p> b&amp;&am</p><b>c&#x27 &#x2;&#39</b> &lt;d&am"


def markdown(html):
    return pages._markdown(html)


def test_markdown_and_its_sql_read_cut_references_alike(spark, tmp_path):
    """Titles that were cut within a reference: what HTML reads without a semicolon is read, the rest stays."""
    import duckdb

    from weftline.plans.page_sql import ORACLES

    cuts = ["&a", "&am", "&amp", "&amp;", "&q", "&quo", "&quot", "&quot;", "&#", "&#x", "&#x2", "&#x27", "&#x27;", "&l", "&lt", "&lt;", "&g", "&gt", "&gt;", "&amp;lt;", "&amp;&amp"]
    rows = [(i, f"<html><body><article><h1>T {c}</h1><p>a&amp;b</p></article></body></html>") for i, c in enumerate(cuts)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    got = {r.page_id: r.markdown for r in pages.to_markdown(spark.read.parquet(str(tmp_path / "pages"))).collect()}
    assert got == dict(con.sql(ORACLES["to_markdown"]).fetchall())
    assert got[2] == "# T &\n\na&b" and got[1] == "# T &am\n\na&b"


def test_markdown_leaves_out_junk_only():
    assert markdown("<div><form>junk<p>more</div><p>kept</p>") == "kept"  # an unclosed element ends with its parent
    assert markdown('<p>a</p><aside>x</aside><div class="big Ad_box">y</div><div id="toc">z</div><sup class="reference">1</sup><p>b<p>c') == "a\n\nb\n\nc"
    assert markdown("<table><tr><th>k<th>v|w<tr><td>1<td>2</table>") == "| k | v\\|w |\n| --- | --- |\n| 1 | 2 |"
    assert markdown('<ol><li>one<li>two <b>x</b></ol><img alt="pic"><a href="/q">go</a><h3>a\n b</h3>') == "1. one\n1. two x\n\n pic  [go] \n### a b"
    assert markdown("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def cleaned(html):
    p = pages._Cleaner()
    p.feed(html)
    p.close()
    return p.text()


def test_cleaned_html():
    html = (
        '<head><meta charset=x><meta property="og:title" content="O"><title> T &amp; u </title><link rel=x><script type="application/ld+json">{"a": 1}</script></head>'
        '<body onload="x()" class="c"><!-- n --><style>s</style><svg><g></g></svg><noscript>n</noscript><p id="i" title=\'q"q\'>a\n  b<br/></p><script>z</script>'
    )
    assert cleaned(html) == (
        '<script type="application/ld+json">{"a": 1}</script> <meta property="og:title" content="O"> <title>T &amp; u</title> <head><title> T &amp; u </title><script type="application/ld+json">{"a": 1}</script></head>'
        '<body class="c"><!-- n --><p title="q&quot;q">a b<br></p>'
    )


def test_urls_that_match_an_intent(spark):
    for url, intent, title, want in (
        ("https://x.com/en/2010/a", '{"title": "The Film!", "year": "2010", "language": "English"}', "the film", True), ("https://x.com/a", '{"title": "The Film"}', "other", False), ("https://x.com/a", '{"title": "The Film"}', "", True),
        ("https://x.com/2011", '{"year": 2010}', "t", False), ("https://x.com/hindi/a", '{"filters": {"language": "Hindi"}}', "t", True), ("https://x.com/qq", '{"language": "Korean"}', "t", False), ("https://x.com/qq", "{}", "t", True),
    ):
        got = spark.createDataFrame([(url, intent, title)], "u string, i string, t string").select(intents.url_matches_intent(F.col("u"), F.col("i"), F.col("t"))).first()[0]
        assert got is want, (url, intent)


def test_pages_are_read_whole(spark):
    html = "<html><body>" + "<p>x</p>" * 200_000 + '<h2>Late</h2><meta name="late" content="v"></body></html>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert dom.dom_nodes(df).where("tag = 'h2'").count() == 1 and dom.dom_nodes(df, cap=1000).where("tag = 'h2'").count() == 0
    assert pages.site_signals(df).first().headings == ["Late"] and engines.engine_meta(df).where("key = 'meta:late'").count() == 1


def test_escalation(spark):
    big = "<body>" + "word " * 2000 + "</body>"
    assert one(spark, pages.escalation(F.col("h")), h="x") == "small"
    assert one(spark, pages.escalation(F.col("h")), h=big) == "no_jsonld"
    assert one(spark, pages.escalation(F.col("h")), h=big + "application/ld+json") is None
    shell = '<div id="root"></div>application/ld+json' + "<i></i>" * 900
    assert one(spark, pages.escalation(F.col("h")), h=shell) == "spa_shell"


def test_plans_have_no_cartesian_product(spark, data):
    for name in ("fuzzy_keys", "robots_check", "vector_match", "unify_fields"):
        from weftline.plans.registry import QUERIES

        plan = QUERIES[name](spark, data)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan




def test_dom_blocks(spark):
    html = '<main><h2>Facts</h2><p>one two</p><ul><li>three</li></ul><h2>Next</h2><table><tr><th>a</th><td>b</td></tr></table><dl><dt>k</dt><dd>v</dd></dl><div data-testid="box">some text here</div></main>'
    nodes = dom.dom_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {r.key: r.text for r in blocks.dom_blocks(nodes).collect()}
    assert got["section:Facts"] == "one two\nthree" and got["table:0"] == "a | b" and got["deflist:0"] == "k: v" and got["testid:box"] == "some text here"


def test_selectors(spark):
    html = '<h1>The Title</h1><span itemprop="director">Ann</span><div class="rating-box x">8.8</div>'
    nodes = dom.dom_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {(r.field, r.selector): r.score for r in blocks.selector_candidates(nodes).collect()}
    assert got[("title", "h1")] == 0.75 and got[("director", "span")] == 0.9 and got[("rating", "div.rating-box")] == 0.6


def test_selectors_by_meaning(spark):
    html = '<div><p><span>7/10</span><span>8.8</span></p><time datetime="2010-07-16">July</time><time>1999</time><img src=a.png alt="The Poster"><img src=b.png class=poster></div>'
    nodes = dom.dom_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {(r.field, r.selector): (r.sample, r.score) for r in blocks.selector_candidates(nodes, unique=True).collect()}
    assert got == {("rating", "span:nth-of-type(1)"): ("7/10", 0.75), ("year", "time:nth-of-type(1)"): ("2010", 0.85), ("poster_url", "img:nth-of-type(1)"): ("a.png", 0.7)}


def test_record_rules(spark):
    assert one(spark, records.is_style_key(F.col("k")), k="text:margin-left") and not one(spark, records.is_style_key(F.col("k")), k="text:Budget")
    assert one(spark, records.failed_stage(F.col("f"), F.lit(False), F.col("m")), f="", m="Policy says no") == "VALIDATED"
    assert one(spark, F.array_join(records.envelope_errors(F.col("o"), F.lit("m"), F.lit("1")), ";"), o='{"task":"t","domain":"x","schema_version":"1","result":{},"confidence":1}') == "domain mismatch"
    assert one(spark, records.display_label(F.col("k")), k="meta:release_date") == "Release Date"
    named = spark.createDataFrame([(1, "Budget"), (1, "none")], "g long, field string")
    eav = spark.createDataFrame([(1, "text:Budget total", 1), (1, "budget", 2)], "g long, key string, ord int")
    assert {r.field: r.raw_key for r in records.match_raw_key(named, eav, "g").collect()} == {"Budget": "budget", "none": None}


def test_small_files_are_spread(spark, data):
    """One row group fills one task; what fills as many tasks as there are cores is left as it is."""
    one = spark.read.parquet(f"{data}/documents.parquet")
    wide = tables.spread(one)
    filled = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert filled(one) < 4 and filled(wide) == 4 and wide.count() == one.count()
    assert "RoundRobin" not in tables.spread(spark.range(0, 1000, 1, 8))._jdf.queryExecution().toString()


def test_equal_keys_of_nested_elements(spark):
    """Texts and card items of nested elements: each element has the text of all that lies in it, in document order."""
    html = "<div id=a>x<div id=b>y<p>z</p></div><div id=c>w</div></div><div id=d>v</div>"
    nodes = dom.dom_nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    got = {r.node_id: r.text for r in dom.subtree_text(nodes, F.col("tag") == "div").collect()}
    assert got == {0: "xyzw", 1: "yz", 3: "w", 4: "v"}
    heads = nodes.select("page_id", F.col("node_id").alias("head"), "subtree_end")
    pairs = {(r.node_id, r.head) for r in dom.inside(heads, nodes.select("page_id", "node_id"), itself=False).collect()}
    assert pairs == {(1, 0), (2, 0), (2, 1), (3, 0)} and {r.head for r in dom.outermost(heads).collect()} == {0, 4}


def test_unclosed_items_are_siblings():
    """With implied end tags; work and bytes grow with the nodes, however deep they nest without."""
    tree = lambda html: [(n[3], n[1], n[2]) for n in dom.parsed(html, None, True)]
    assert tree("<ul><li>1<li><p>2<p>3<ul><li>4</ul><li>5</ul>") == [("ul", -1, 0), ("li", 0, 1), ("li", 0, 1), ("p", 2, 2), ("p", 2, 2), ("ul", 2, 2), ("li", 5, 3), ("li", 0, 1)]
    assert tree("<table><tr><td>a<td>b<tr><th>c<td><table><tr><td>d</table></table>") == [("table", -1, 0), ("tr", 0, 1), ("td", 1, 2), ("td", 1, 2), ("tr", 0, 1), ("th", 4, 2), ("td", 4, 2), ("table", 6, 3), ("tr", 7, 4), ("td", 8, 5)]
    assert tree("<dl><dt>a<dd>b<dt>c</dl><select><option>x<option>y</select><p>t<div>u</div>") == [("dl", -1, 0), ("dt", 0, 1), ("dd", 0, 1), ("dt", 0, 1), ("select", -1, 0), ("option", 4, 1), ("option", 4, 1), ("p", -1, 0), ("div", -1, 0)]
    assert tree("<button><p>a<div>b</div></button>") == [("button", -1, 0), ("p", 0, 1), ("div", 0, 1)]
    wide = list(dom.parsed("<ul>" + "<li>x" * 100_000, None, True))
    assert max(n[2] for n in wide) == 1 and len(wide) == 100_001 and wide[0][6:] == (100_000, 0, 100_000, 100_000)
    deep = list(dom.parsed("<ul>" + "<li>x" * 20_000))
    assert deep[-1][2] == 20_000 and sum(len(repr(n)) for n in deep) < 100 * len(deep)


def test_texts_of_deep_pages(spark):
    """The innermost and the outermost text of 3,000 nested elements."""
    nodes = dom.dom_nodes(spark.createDataFrame([(1, "<b>x" * 3000)], "page_id long, html string"))
    got = {r.node_id: r.text for r in dom.subtree_text(nodes, F.col("node_id").isin(0, 2999)).collect()}
    assert got == {0: "x" * 3000, 2999: "x"} and nodes.agg(F.max("text_len")).first()[0] == 3000


def select(nodes, path):
    """The nodes that a path of child steps selects, by trying every node."""
    def fits(n, step):
        name, _, nth = step.partition(":nth-of-type(")
        tag, mark, value = re.match(r"([^#.]*)([#.]?)(.*)", name).groups()
        same = [m for m in sorted(nodes.values(), key=lambda m: m.node_id) if m.parent_id == n.parent_id and m.tag == n.tag]
        return n.tag == tag and (not mark or (n.attrs.get("id") == value if mark == "#" else value in (n.attrs.get("class") or "").split())) and (not nth or same.index(n) + 1 == int(nth[:-1]))

    found = []
    for n in nodes.values():
        at = n
        for step in reversed(path.split(" > ")):
            if at is None or not fits(at, step):
                break
            at = nodes.get(at.parent_id)
        else:
            found.append(n.node_id)
    return found


def test_paths_select_their_node_alone(spark, data):
    html = '<main id=m><div class="card a"><p>x</p><p>y</p></div><div class="card"><p>x</p></div><ul><li><a>1</a><li><a>2</a></ul></main><div><b><b><b>z</b></b></b></div>'
    made = spark.createDataFrame([(-1, html), (-2, "<b>" * 100)], "page_id long, html string")
    nodes = dom.dom_nodes(made.unionByName(spark.read.parquet(f"{data}/pages.parquet").where("page_id < 6").select("page_id", "html")))
    per = {}
    for r in nodes.collect():
        per.setdefault(r.page_id, {})[r.node_id] = r
    paths = blocks.selector_paths(nodes).collect()
    assert len(paths) == sum(map(len, per.values()))
    assert all(select(per[r.page_id], r.path) == [r.node_id] for r in paths if r.path is not None)
    # a second root's path is also that of an element below the first, and paths end after MOST_STEPS
    assert [(r.page_id, r.node_id) for r in paths if r.path is None and r.page_id != -2] == [(-1, 11)]
    own = {r.node_id: r.path for r in paths if r.page_id == -1}
    assert own[0] == "main#m" and own[1] == "div.a" and own[2] == "div:nth-of-type(1) > p:nth-of-type(1)" and own[3] == "p:nth-of-type(2)"


def test_labelled_list_items(spark):
    html = "<ul><li><span>Budget</span><span>$160M</span></li><li><span>Opening</span> weekend sum</li><li>plain</li><li><span>Same</span><span>Same</span></li></ul><ol><li><span>Kind:</span><i>x</i><span>Short film</span></li></ol>"
    nodes = dom.dom_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {r.key: r.text for r in blocks.dom_blocks(nodes).collect()}
    assert got == {"list:Budget": "Budget: $160M\nOpening: weekend sum", "list:Kind": "Kind:: Short film"}


def test_robots_by_the_longest_match(spark):
    """Examples of RFC 9309 and of patterns with * and $, groups of several agents, and agents without a group."""
    raw = "User-agent: a\r\nUser-Agent: B # both\nDisallow: /x\nAllow: /x/y$\nDisallow: /*.gif$\nAllow: /same\nDisallow: /same\nDisallow:\nUser-agent: *\nDisallow: /\nAllow: /p*?q=\nUser-agent: c\nAllow: /\\E.*"
    rules = robots.robots_groups(spark.createDataFrame([("s", raw), ("t", "Disallow: /lost\nUser-agent: z\nDisallow: /")], "site string, raw string"))
    assert {r.ua for r in rules.collect()} == {"a", "b", "*", "c", "z"}
    urls = ["/x", "/x/y", "/x/y/z", "/i/a.gif", "/i/a.gif?v", "/same", "/other", "", "?q=1", "/p1?q=2"]
    df = spark.createDataFrame([(s, f"https://h{u}") for s in "st" for u in urls], "site string, url string")
    allowed = lambda agent, site: [u for u in urls if {(r.site, r.url): r.allowed for r in robots.robots_longest(df, rules, agent).collect()}[site, f"https://h{u}"]]
    assert allowed("b", "s") == ["/x/y", "/i/a.gif?v", "/same", "/other", "", "?q=1", "/p1?q=2"]
    assert allowed("unknown", "s") == ["/p1?q=2"] and allowed("b", "t") == urls
    row = spark.range(1).select(F.regexp_like(F.lit("/a\\Eb.c"), robots.pattern_regex(F.lit("/*\\Eb.c"))).alias("x"), F.regexp_like(F.lit("/a\\Ebxc"), robots.pattern_regex(F.lit("/*\\Eb.c"))).alias("y")).first()
    assert row.x and not row.y


def test_table_functions(spark):
    from weftline.functions.tables import register_tables

    register_tables(spark)
    spark.createDataFrame([(1, "<p a=b>x<b>y</b></p>"), (2, None)], "page_id long, html string").createOrReplaceTempView("t_pages")
    nodes = dom.dom_nodes(spark.table("t_pages"))
    want = sorted(map(repr, nodes.collect()))
    assert sorted(map(repr, spark.sql("SELECT page_id, n.* FROM t_pages, LATERAL dom_nodes(html) n").collect())) == want
    assert sorted(map(repr, spark.sql("SELECT * FROM page_nodes(TABLE(t_pages) PARTITION BY page_id)").collect())) == want


def test_health_in_order(spark):
    health = spark.createDataFrame([("b", "x", 1), ("a", "y", 2), ("a", "x", 3)], "domain string, site string, failures long")
    assert [r.failures for r in oplog.health_report(health, ["domain", "site"]).collect()] == [3, 2, 1]


def test_copies_of_a_name_are_not_paired(spark, tmp_path, monkeypatch):
    """3,000 copies of each of five names: the five most similar are ranked by name, not picked from the pairs of all copies."""
    from weftline.plans.registry import QUERIES

    made = spark.range(15_000).selectExpr("id AS p_partkey", "concat('green almond part ', id % 5) AS p_name", "'STANDARD TIN' AS p_type")
    made.write.parquet(str(tmp_path / "part.parquet"))
    with monkeypatch.context() as m:
        m.delattr(caches, "fuzzy_join")  # whose 2,250,000 pairs or more it would sort
        got = {(r.left_id, r.rank): r.right_id for r in QUERIES["top_similar"](spark, str(tmp_path)).collect()}
    # the own name comes first, of its copies those of the greatest last digit, then the smallest
    assert len(got) == 750 and [got[100, i] for i in range(1, 6)] == [5, 15, 25, 35, 45]
    p = spark.createDataFrame([(i, k, (i * 7 % 4) / 10) for i, k in enumerate(["red tin", "red tin can", "red tins", "blue can", None, ""] * 9)], "id long, key string, confidence double")
    want = caches.top_similar(caches.fuzzy_join(p.where("id % 5 < 2"), p, 0.4).join(p.select(F.col("id").alias("right_id"), "confidence"), "right_id"), 4)
    cols = ["left_id", "right_id", "rank", "similarity", "confidence"]
    assert sorted(caches.fuzzy_top(p.where("id % 5 < 2"), p, 4, 0.4).select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_plain_tags_parse_as_the_parser_has_them():
    """The short way for plain tags gives what HTMLParser's own way gives, in pages of odd pieces."""
    import random
    from html.parser import HTMLParser

    class Own(dom._Nodes):
        parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag

    pieces = ['<div>', '</div>', '<p class="a b">', "<p class='x'>", '<br/>', '<img src="a&amp;b">', '<a href="x>y">', '<script type="a">', '</script>', '<title>', '</title>', '<style>', '</style >', '<b a="1" b c="2" a="3">', '<!-- c -->',
              '<P ID="Q">', '</P>', 'text', 'a & b', '&lt;', '<', '>', '"', ' ', '\n', '<a b="', '<div\nclass="a">', '<li itemscope itemprop="n">', '<x:y>', '</h1', '<a b="c"d="e">', '<a b="c" >', '<noscript>', '<svg viewBox="0">']
    dice = random.Random(7)
    for _ in range(2000):
        html = "".join(dice.choice(pieces) for _ in range(dice.randint(1, 12)))
        own, short = Own(), dom._Nodes()
        for p in (own, short):
            p.feed(html)
            p.close()
        assert own.nodes == short.nodes and own.open == short.open, html


def test_selectors_read_the_nodes_once(spark):
    """Texts and fields of a page come from one grouping: no node meets its page again in a join."""
    html = '<h1>The <i>Title</i></h1><span class="genre">a<b>b</b></span><span class="genre">c</span><img class="poster" src="p.png"><p>none</p><time datetime="2001-01-01"></time>'
    df = blocks.selector_candidates(dom.dom_nodes(spark.createDataFrame([(1, html), (2, None), (3, "<p>plain</p>")], "page_id long, html string")))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.page_id, r.field, r.rank, r.selector, r.sample, r.score) for r in df.collect()}
    assert got == {(1, "title", 1, "h1", "TheTitle", 0.75), (1, "genre", 1, "span.genre", "ab", 0.6), (1, "poster_url", 1, "img.poster", "p.png", 0.7), (1, "year", 1, "time", "2001", 0.85)}


def test_items_of_jsonld_need_no_shuffle(spark):
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    a, b, c = ('{"@type":"%s","v":%d}' % x for x in (("A", 1), ("B", 2), ("B", 3)))
    pages = [
        (1, ld('{"@type":"ItemList","itemListElement":[{"position":"7","item":{"x":1}},"y",null]}') + ld('{"@type":"ItemList","itemListElement":[{"z":1}]}') + ld(b) + ld(c)),
        (2, ld("{bad") + ld(f'[{a},{b},null,"s",{c}]')), (3, ld(f'{{"@graph":[{a},{b}]}}') + ld(a) + ld('{"@type":"ItemList","itemListElement":[]}') + ld(c)), (4, ld(a) + ld(b)), (5, None), (6, "[]" + ld("[]") + ld('[1,2]') + ld('{"v":1}')),
    ]
    df = engines.items_jsonld(spark.createDataFrame(pages, "page_id long, html string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted((r.page_id, r.position, r.item) for r in df.collect() if r.item is not None) == [(1, 1, '{"z":1}'), (1, 2, "y"), (1, 7, '{"x":1}'), (2, 1, b), (2, 2, c), (3, 1, a), (3, 2, a)]
    assert df.where("item is null").count() == 1


def test_signatures_of_nodes_asked_for(spark, data, monkeypatch):
    """Clusters need signatures only where enough siblings have one tag; sent to tasks or joined, they are those of all nodes."""
    nodes = tables.stored(dom.dom_nodes(spark.read.parquet(f"{data}/pages.parquet").where("page_id < 12").select("page_id", "html")), "nodes")
    every = {(r.page_id, r.node_id): r.sig for r in dom.subtree_signature(nodes).collect()}
    groups = {(r.page_id, r.first_node): r.n for r in dom.repeating_groups(nodes).collect()}
    for most in (50_000, 0):
        monkeypatch.setattr(tables, "FEW_ROWS", most)
        monkeypatch.setattr(dom, "FEW_ROWS", most)
        some = dom.subtree_signature(nodes, nodes.where("tag in ('div', 'ul', 'section')")).collect()
        assert some and all(every[r.page_id, r.node_id] == r.sig for r in some)
        members = dom.cluster_members(nodes).collect()
        assert {(r.page_id, r.cluster): r.n for r in members} == groups and len(members) == sum(groups.values())
    assert dom.cluster_items(nodes).count() > 0
