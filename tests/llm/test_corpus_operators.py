"""SimHash, suffix dedup, decontamination, URL filters, HTML extraction and the pipeline on odd rows and against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import prose

from weftline.llm import components, decontaminate, htmltext, simhash, suffixdedup, urlfilter
from weftline.llm.common import clear, written
from weftline.llm.queries import QUERIES


def as_dict(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix_dedup_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert as_dict(QUERIES["op6_suffix_array_dedup"](spark, data)) == brute.removed_bytes(rows)


def test_suffix_dedup_odd_rows(odd, odd_rows, empty, monkeypatch):
    want = brute.removed_bytes(odd_rows)
    assert sum(x[1] for x in want.values()) > 1000
    assert as_dict(suffixdedup.deduped(odd)) == want
    assert as_dict(suffixdedup.deduped(odd, shards=1)) == want
    assert suffixdedup.deduped(empty).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in suffixdedup.deduped(odd, with_text=True).collect()}
    assert kept[106] == odd_rows[6][1].encode()


def test_chunks_and_shards_grow_together():
    """Until a megabyte a chunk gives every shard many keys; at 100 TB neither is too large for a task."""
    assert suffixdedup.sizes_for(0) == suffixdedup.sizes_for(1 << 30) == (suffixdedup.CHUNK, suffixdedup.SHARD)
    for total in (1 << 40, 100 << 40):
        chunk, shard = suffixdedup.sizes_for(total)
        assert chunk / suffixdedup.KEY_BYTES / (total / shard) >= suffixdedup.KEYS * 0.99 and chunk <= 64 << 20 and shard <= 512 << 20


def test_copies_of_a_segment_travel_once():
    """What a chunk sends to shards doesn't grow with the copies that it holds of a passage; their places go back to it."""
    passage = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)

    def sent(copies: int) -> tuple[int, int]:
        ids, sizes = np.arange(copies), np.full(copies, 300)
        chunk = suffixdedup._pack(ids.astype("<i8"), sizes.astype("<i8"), np.tile(passage, copies))
        hashes = next(suffixdedup._sent_hashes(1)(iter([pa.RecordBatch.from_pydict({"chunk_id": [7], "body": [chunk]})])))
        all_bits = bytes([255]) * (len(hashes.column(2)[0].as_py()) // 4)
        asked = pa.RecordBatch.from_pydict({"body": [chunk], "chunk_id": [7], "answers": [[{"shard": 0, "bits": all_bits}]], "shards": [1]})
        out = list(suffixdedup._sent_segments(iter([asked])))
        answers = [r for b in suffixdedup._answered(iter(out)) for r in b.to_pylist()]
        gone = suffixdedup._gone(ids, sizes, answers)
        assert not gone[:300].any() and gone[300:].all()
        return [len(r["body"]) for b in out for r in b.to_pylist() if not r["places"]][0], len(answers)

    assert sent(2000)[0] <= sent(2)[0] + 32 and sent(2000)[1] == 2


def test_short_repeats_send_no_segments(spark):
    """Bytes of a minimiser that documents share by chance, the more of them the more text there is, make no candidates; 50 bytes do, wherever the minimiser lies."""
    rng = np.random.default_rng(2)
    pieces = rng.integers(97, 123, (40, 26)).astype(np.uint8)

    def sent(passage: bytes) -> int:
        texts = [b"".join(bytes(p) + bytes(rng.integers(97, 123, 20).astype(np.uint8)) for p in pieces[rng.permutation(40)]) + passage for _ in range(20)]
        sizes = np.array([len(t) for t in texts])
        chunk = suffixdedup._pack(np.arange(20).astype("<i8"), sizes.astype("<i8"), np.frombuffer(b"".join(texts), np.uint8))
        rows = {"chunk_id": [7], "body": [chunk]}
        hashes = pa.Table.from_batches(list(suffixdedup._sent_hashes(3)(iter([pa.RecordBatch.from_pydict(rows)]))))
        bits = [suffixdedup._repeated(hashes.filter(pa.compute.equal(hashes["shard"], i))).to_pylist() for i in set(hashes["shard"].to_pylist())]
        asked = rows | {"answers": [[{"shard": r["shard"], "bits": r["bits"]} for rs in bits for r in rs]], "shards": [3]}
        out = suffixdedup._sent_segments(iter([pa.RecordBatch.from_pydict({k: asked[k] for k in ("body", "chunk_id", "answers", "shards")})]))
        cols = [suffixdedup._unpack(r["body"], "u1", "u1", "<i8", "<i8") for b in out for r in b.to_pylist() if not r["places"]]
        return sum(int((c[0].astype(int) - 49).sum()) for c in cols)  # distinct windows

    assert sent(b"") == 0
    assert all(sent(bytes(rng.integers(97, 123, 50).astype(np.uint8))) > 0 for _ in range(5))


def test_chunks_are_dealt_once(spark, data):
    """Both joins of the chunks read one exchange of their bodies."""
    df = suffixdedup.deduped(spark.read.parquet(f"{data}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "- Exchange hashpartitioning(chunk_id" in line]
    assert "ReusedExchange" in plan and len(dealt) == 3, plan  # the chunks, and the two kinds of answers


def test_suffix_order_of_random_bytes():
    rng = np.random.default_rng(0)
    for part in (1 << 30, 200):
        for _ in range(10):
            size = rng.integers(50, 85, int(rng.integers(1, 20))).astype(np.int64)
            motif = rng.integers(0, 256, 60).astype(np.uint8)
            data = np.concatenate([np.tile(motif, 3)[(o := int(rng.integers(0, 60))) : o + n] if rng.random() < 0.6 else np.zeros(n, np.uint8) for n in size])
            doc = rng.integers(0, 9, len(size))
            ends, best = np.cumsum(size), {}
            windows = [(bytes(data[e - n + o : e - n + o + 50]), d) for e, n, d in zip(ends, size, doc, strict=True) for o in range(n - 49)]
            for w, d in windows:
                best[w] = min(d, best.get(w, 99))
            assert suffixdedup.least_documents(data, size, doc, part).tolist() == [best[w] for w, _ in windows]


def test_common_prefixes():
    data = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcXYZ" * 2, np.uint8)
    limit = np.full(len(data), len(data))
    order, _ = suffixdedup.refined(data, limit)
    got = suffixdedup.common_prefixes(data, order)
    for i in range(1, len(order)):
        a, b = bytes(data[order[i - 1] :][:50]), bytes(data[order[i] :][:50])
        assert a <= b and got[i] == next((k for k in range(50) if a[k] != b[k]), 50)


def test_minimisers_depend_on_content_only():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 400).astype(np.uint8)
    _, _, _, h1 = suffixdedup.segments(text, np.array([400]))
    a, b, row, h2 = suffixdedup.segments(np.concatenate([text[:37], text]), np.array([37, 400]))
    assert set(row) == {1} and list(h1) == list(h2) and a[0] == 37 and b[-1] == 37 + 350


def test_simhash_query(spark, data):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {d: brute.fingerprint(t) for d, t in rows.items()}
    want = brute.components(prints)
    got = QUERIES["op9_simhash_near_dedup"](spark, data).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in rows}


def test_simhash_odd_rows(odd, odd_rows, empty):
    want = brute.components({d: brute.fingerprint(t) for d, t in odd_rows})
    thirds = [((1 << 20) - 1, 1), (((1 << 20) - 1) << 20, 1), (((1 << 24) - 1) << 40, 0)]
    assert {r.doc_id: r.component_id for r in simhash.grouped(odd, parts=thirds).collect()} == want
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert simhash.grouped(empty).count() == 0


def test_representatives_of_shared_ids(spark):
    """An exact copy goes, whatever kept row has its id; null ids count as documents."""
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (None, "x y z"), (4, "x y z"), (1, b)], "doc_id long, text string")
    kept = [tuple(r) for r in simhash.representatives(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (1, b), (None, "x y z")], key=repr)


@pytest.mark.parametrize("direct", [5, 60])
def test_links_of_dense_clusters(spark, direct):
    rng = random.Random(4)
    seen = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            seen.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    prints = {i: f for i, f in enumerate(sorted(seen | {rng.getrandbits(64) for _ in range(200)}))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(f),) for f in prints.values()], "fp long")
    found = components.components(simhash.links(fps, direct=direct)).collect()
    roots = {r.node: r.root for r in found}
    want = brute.components(prints)
    groups = lambda label: {frozenset(i for i in prints if label(i) == label(j)) for j in prints}
    assert groups(lambda i: roots.get(signed(prints[i]), signed(prints[i]))) == groups(lambda i: want[i])


def test_plan_loses_no_pair():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sample &= np.uint64(0xFFFFFFFFFFFFFF00)
    for n in (400, 10**8, 10**11):
        parts = simhash.plan(sample, n)
        assert sum(t + 1 for _, t in parts) == simhash.DISTANCE + 1
        used = 0
        for m, _ in parts:
            assert not used & m
            used |= m


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaks(spark, odd, odd_rows, empty):
    rng = random.Random(9)
    long = odd_rows[5][1].split()
    items = [(1, " ".join(long[3000:3020])), (2, "".join(c.upper() if c.isascii() else c for c in " ".join(long[100:130]))), (3, prose(rng, 25)), (4, None), (5, ""), (6, "one two three"), (7, " ".join(long[500:530] + ["new"] * 3)), (8, " ".join(long[500:520] + ["new"] * 20))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(None).cast("string"))
    want = brute.leaks(odd_rows, items)
    assert (105, 1) in want and (105, 2) in want and (105, 8) not in want and (104, 6) in want
    for limit in (decontaminate.MAX_SHINGLES, 0):
        got = decontaminate.leaks(odd, bench, max_shingles=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = decontaminate.cleaned(odd, bench)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in odd_rows} - {d for d, _ in want}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0


def test_leaks_of_clashing_ids(spark):
    """Rows of one id but other texts, on both paths; a clean row stays beside one that leaks."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n"), (2, "quite other words that nobody else has"), (None, "h i j k l m n"), (1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g"), (7, "h i j k l m n"), (8, None), (None, "a b c d e f g")], "item_id long, text string")
    want = sorted([(1, 7), (1, 7), (1, None), (1, None), (2, 7), (None, 7)], key=repr)
    for limit in (decontaminate.MAX_SHINGLES, 0):
        found = decontaminate.leaks(docs, items, max_shingles=limit).collect()
        assert sorted([(r.doc_id, r.item_id) for r in found], key=repr) == want and all(r.containment == 1 and r.n_shared == 3 for r in found)
        assert [tuple(r) for r in decontaminate.cleaned(docs, items, max_shingles=limit).collect()] == [(2, "quite other words that nobody else has")]


def test_url_rules(spark):
    urls = ["https://WWW.Example.com/en/1?x=/en/", "http://example.com/en/2", "http://a.example.com/de", "ftp://x.net/es/9#t", "http://net/fr/", "http://example.net/en/", "http://a.com", "nothing", None, "http://com/x", "http://xcom/", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("own")).withColumn("label", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.UrlFilter(None, {}, 0.0).judge(pages).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("com/", "allow") and got[3][2:] == ("net/es/", "block") and got[4][2:] == ("net/fr/", "block")
    assert got[5] == ("example.net", "/en/", None, "allow") and got[6] == ("a.com", "", None, "allow")
    assert got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None) and got[9][2] == "com/" and got[10][2] is None and got[11][:2] == ("b:", "//c/d")


def test_url_trees_learn(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        path = "/".join("".join(rng.choice("0123456789" if bad else "abcdef") for _ in range(8)) for _ in range(4 if bad else 2))
        rows.append((f"http://h{i}.{'xyz' if bad else 'org'}/{path}" + ("?a=1&b=2&c=3" if bad else ""), float(bad)))
    df = spark.createDataFrame(rows, "url string, label double")
    fitted = urlfilter.UrlFilter.fit(df.limit(600))
    got = fitted.judge(df.subtract(df.limit(600)), ()).collect()
    assert sum((r.verdict == "block") == (r.label == 1) for r in got) / len(got) > 0.95
    assert urlfilter.UrlFilter.fit(df.limit(0)).judge(df, ()).where("verdict = 'block'").count() == 0


def test_url_features_that_share_names_with_columns(spark):
    rows = [(f"http://h{i}.{'xyz' if i % 2 else 'org'}/{i}", float(i % 2)) for i in range(400)]
    fitted = urlfilter.UrlFilter.fit(spark.createDataFrame(rows, "url string, label double"))
    urls = spark.createDataFrame([(1, rows[1][0], "own", -1.0, "p"), (2, rows[2][0], "own", -1.0, "p"), (3, None, None, None, None)], "page_id long, url string, depth string, suffix_rate double, prediction string")
    got = fitted.judge(urls.withColumn("_features", F.lit("f")).withColumn("suffix", F.lit("s")), ()).orderBy("page_id").collect()
    assert [(r.depth, r.suffix_rate, r.prediction, r["_features"], r.suffix) for r in got[:2]] == [("own", -1.0, "p", "f", "s")] * 2 and got[2].depth is None
    assert [r.verdict for r in got[:2]] == ["block", "allow"]


def test_suffix_rates_are_out_of_fold(spark):
    """Suffixes that occur once tell nothing; rates fitted on the rows themselves would."""
    rng = random.Random(6)
    rows = [(f"http://site{i}.t{i}/x", float(rng.random() < 0.5)) for i in range(800)]
    fitted = urlfilter.UrlFilter.fit(spark.createDataFrame(rows[:600], "url string, label double"))
    scores = [r.score for r in fitted.judge(spark.createDataFrame(rows[:600], "url string, label double"), ()).collect()]
    assert max(scores) - min(scores) < 0.75


def test_url_query(spark, data):
    """Host, path, rule and verdict of every page against plain Python; where no rule fits, the verdict is the trees'."""
    verdicts = {r.text: r.verdict for r in urlfilter.RULES}
    got = {r.page_id: r for r in QUERIES["op1_url_filters"](spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()
    assert set(got) == {p.page_id for p in pages}
    for p in pages:
        r, rule = got[p.page_id], brute.url_rule(p.url, verdicts)
        assert (r.host, r.path) == brute.host_and_path(p.url) and r.rule == rule
        assert r.verdict == (verdicts[rule] if rule else "allow" if r.score is None or r.score <= 0.5 else "block")


def test_minimum_cut_is_brute_force():
    import itertools

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.choice([0.3, 0.5, 1.0, 2.0])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]

        def cost(kept):
            return sum(max(-s, 0) if k else max(s, 0) for s, k in zip(scores, kept, strict=True)) + sum(w for a, b, w in edges if kept[a] != kept[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(htmltext.minimum_cut(scores, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div id="cookie-notice">We use cookies on this site.</div><div class="content"><div class="post-body"><h2>Real &amp; title</h2><p>First
   para<br>goes on &lt;here&gt; with a <a href=x>link</a> in it.<p>Ok</p><div class="ad-slot">Buy now, very cheap!</div><script>var a = "<p>no</p>";</script>
<p>Second paragraph of the text, long enough to count for prose.</p><form><label>Mail</label><button>Go</button></form><!-- hidden --></div>
<div id="comments"><h3>Comments</h3><p>Nice article, I liked the whole of it very much.</p></div></div><aside class="sidebar"><p>Other things to read.</p></aside><footer>&copy; me"""


def test_html_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "x", "just text < 5 and <b>bold</b> words here"), (5, "y", "<p>cut off <a href="), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = [(r.page_id, r.text) for r in htmltext.extracted(pages).collect()]
    want = "Real & title\nFirst para goes on <here> with a link in it.\nOk\nSecond paragraph of the text, long enough to count for prose."
    assert got.count((1, want)) == 2 and (2, "") in got and (3, "") in got and (4, "just text < 5 and bold words here") in got and len(got) == 6
    assert htmltext.extracted(pages.limit(0)).count() == 0


def test_a_word_does_not_erase_an_article():
    body = "<p>" + "Some words of the text that go on for a while. " * 4 + "</p>"
    want = " ".join(("Some words of the text that go on for a while. " * 4).split())
    for opened, closed in (
        ('<article class="post search-engines">', "</article>"), ('<article class="toc">', "</article>"), ('<div class="search-page"><article>', "</article></div>"), ('<form id="aspnetForm"><main>', "</main></form>"),
        ('<div class="post search-engines">', "</div>"), ('<body class="has-sidebar"><article id="menu-planning">', "</article>"), ("<article><header><div>", "</div></header></article>"),
    ):
        assert htmltext.main_text(f"<nav><a href=/>Home</a></nav>{opened}{body}{closed}<footer>x</footer>") == want, opened
    for opened, closed in (('<div id="comments"><article>', "</article></div>"), ('<article class="comment">', "</article>"), ('<div class="entry-footer">', "</div>"), ("<aside><article>", "</article></aside>"), ("<div hidden>", "</div>")):
        assert htmltext.main_text(f"<article>{body}</article>{opened}{body}{closed}") == want, opened


def test_the_cut_decides(spark, data):
    """Without their sectioning tags and names, and before any fit, many blocks of the table's pages are labelled by their neighbours, and better so."""
    import re

    alone = cut = n = 0
    pages = spark.read.parquet(f"{data}/pages.parquet").select("html").collect()
    for (page,) in pages:
        truth = [b.says[0] == htmltext.CONTENT for b in htmltext.blocks_of(page)]
        bare = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")
        blocks = htmltext.blocks_of(bare)
        scores = htmltext.scores_of(blocks)
        labels = htmltext.minimum_cut(scores, htmltext.edges_of(blocks))
        alone += sum((s > 0) == t for s, t in zip(scores, truth, strict=True))
        cut += sum(k == t for k, t in zip(labels, truth, strict=True))
        n += htmltext.n_decided(bare) > 0
    assert n > len(pages) / 4 and cut > alone


def test_very_long_page():
    body = "".join(f"<div><p>Paragraph {i} with some words in it.</p></div>" for i in range(4000))
    assert htmltext.main_text(f"<article>{body}</article><footer>x</footer>").count("\n") == 3999


def test_html_query(spark, data):
    """Every page gives its article, as the markup of the table has it."""
    import html
    import re

    got = {r.page_id: r for r in QUERIES["op2_html_extraction"](spark, data).collect()}
    for p in spark.read.parquet(f"{data}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("<p>|</p>|<h1>|</h1>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_pipeline(spark, data):
    """Each stage against brute force on all that the one before kept; the last one packs every document left, each id once."""
    import public_tokenizers
    from tests.llm.test_text_operators import check_packing
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    judged = {r.doc_id: r.kept for r in QUERIES["op8_quality_rules"](spark, data).collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), name)
        if name == "packing":
            check_packing(docs.collect(), list(before.items()), lambda t: tok.encode(t, add_special_tokens=False).ids)
            break
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        rows = docs.collect()
        left = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(left)
        if name == "quality_rules":
            want = {d: t for d, t in before.items() if judged[d]}  # the query is held against its SQL
        elif name == "line_dedup":
            want = {d: t for d, t in brute.without_passages(list(before.items())).items() if t.split() or t == before[d]}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "simhash_near_dedup":
            groups = brute.components({d: brute.fingerprint(t) for d, t in before.items()})
            want = {d: before[d] for d in set(groups.values())}
        else:
            dirty = {d for d, _ in brute.leaks(list(before.items()), items)}
            want = {d: t for d, t in before.items() if d not in dirty}
        assert left == want and len(left) > 0.7 * len(before)
        before = left


def test_pipeline_of_nothing(spark, data, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, data), name)
        assert empty.count() == 0


def test_intermediates_can_be_cleared(spark):
    import os

    df = written(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and "/weftline-" in path
    clear(spark)
    assert not os.path.exists(path)
