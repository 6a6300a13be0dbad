"""The n-gram join, whitening and fill-in-the-middle against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import prose

from weftline.llm import fillmiddle, ngramjoin, whitening
from weftline.llm.queries import QUERIES

# --- n-gram Jaccard join --------------------------------------------------------------------------------------------


def shingles(text, width=4):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return ({" ".join(w)} if w else set()) if len(w) < width else {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}


def joined(rows):
    """{doc_id: (n_shingles, component_id)} by all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    docs, n = sorted(sets), 0
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
                n += 1
    return {d: (len(sets[d]), root(d)) for d in docs}, n


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_join_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want, n = joined(rows)
    assert n and found(QUERIES["op11_ngram_jaccard_join"](spark, data)) == want


def test_join_of_odd_rows(odd, odd_rows, empty):
    want, _ = joined(odd_rows)
    assert found(ngramjoin.classes(odd)) == want
    assert ngramjoin.classes(empty).count() == 0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def clusters():
    """Groups of near copies around the threshold, texts that share a passage, and short texts."""
    rng = random.Random(3)
    rows, passage = [], prose(rng, 50)
    for size, length in ((60, 120), (25, 40), (10, 900)):
        base = [f"{w}{i}" for i, w in enumerate(prose(rng, length).split())]
        rows += [edited(rng, base, rng.randrange(0, max(2, length // 45))) for _ in range(size)]
    rows += [passage + " " + prose(rng, 25) for _ in range(30)]
    rows += ["one two", "one two", "One  two", "one two three four five", "one two three four six", "a b c d e f g h i", "a b c d e f g h i j"]
    return list(enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"leaf": 4, "direct": 8}, {"groups": 8, "buckets": 16}, {"direct": 3, "leaf": 2}])
def test_join_of_dense_clusters(spark, clusters, options):
    """Small leaves, blocks of few points and rough bounds change the work, not the classes."""
    want, n = joined(clusters)
    assert n > 300
    assert found(ngramjoin.classes(spark.createDataFrame(clusters, "doc_id long, text string"), **options)) == want


def test_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    v = rng.poisson(3, (300, 16)).astype(np.uint32)
    v[150:] = v[:150] + rng.integers(0, 2, (150, 16)).astype(np.uint32)
    sizes, kinds = v.sum(axis=1).astype(np.int64), rng.integers(0, 200, 300)
    got = {tuple(sorted(p)) for x, y in ngramjoin.RTree(v, sizes, kinds, 8).pairs() for p in zip(x.tolist(), y.tolist(), strict=True)}
    bound = np.minimum(v[:, None, :], v[None, :, :]).sum(axis=2)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if kinds[i] != kinds[j] and 185 * bound[i, j] >= 85 * (sizes[i] + sizes[j])}
    assert got == want and len(want) > 50


def test_tree_prunes_what_cannot_link():
    """Two far groups are never compared point by point, and points of one component not at all."""
    v = np.r_[np.full((64, 8), 9), np.full((64, 8), 2)].astype(np.uint32)
    sizes = v.sum(axis=1).astype(np.int64)
    pairs = sum(len(x) for x, _ in ngramjoin.RTree(v, sizes, np.arange(128), 8).pairs())
    assert pairs == 2 * 64 * 63 // 2
    assert not list(ngramjoin.RTree(v, sizes, np.repeat([0, 1], 64), 8).pairs())


def test_counts_beyond_a_byte(spark):
    a = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, a), (2, a + " tail"), (3, "x " + a[: len(a) // 2])], "doc_id long, text string")
    assert found(ngramjoin.classes(docs)) == {1: (29_997, 1), 2: (29_998, 1), 3: (len(shingles("x " + a[: len(a) // 2])), 3)}


# --- whitening ------------------------------------------------------------------------------------------------------


def brute_whitened(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(axis=1), e[::-1], v[:, ::-1], centred


def test_whitening_query(spark, data):
    rows = sorted((r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect())
    n, deviation, e, v, centred = brute_whitened([x for _, x in rows])
    got = QUERIES["op12_embedding_whitening"](spark, data).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    assert (got[got.component == 1].deviation.to_numpy() == deviation).all()
    w = got.whitened.to_numpy().reshape(n, 8)
    want = centred @ v[:, :8] / np.sqrt(e[:8])
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-9
    assert np.abs(got.explained.to_numpy().reshape(n, 8)[0] / (e[:8] / e.sum()) - 1).max() < 1e-9


def test_unusable_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(1)
    good = [[float(x) for x in rng.normal(size=3)] for _ in range(20)]
    odd = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows = [(i if i % 5 else None, x) for i, x in enumerate(good + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("own"))
    model = whitening.fitted(df)
    n, deviation, e, v, _ = brute_whitened(good)
    assert model.center.n == n == 20
    got = whitening.whitened(df, model).collect()
    assert sorted(r.deviation for r in got) == sorted(deviation.tolist()) and {len(r.whitened) for r in got} == {3} and any(r.vec_id is None for r in got)
    assert np.allclose(model.eigenvalues, e, rtol=1e-12) and whitening.identity_error(df, model) < 1e-10
    assert whitening.fitted(df.limit(0)) is None and whitening.fitted(df.where("embedding is null")) is None


def test_dimensions_without_variance(spark):
    """A constant and a copied dimension leave two components; equal vectors leave none."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), 0.5, float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fitted(df)
    assert (model.eigenvalues > 0).tolist() == [True, True, False, False] and whitening.identity_error(df, model) < 1e-9
    assert {tuple(x is None for x in r.whitened) for r in whitening.whitened(df, model).collect()} == {(False, False, True, True)}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [r.whitened for r in whitening.whitened(same, whitening.fitted(same)).collect()] == [[None, None]] * 5


def test_ill_conditioned_vectors(spark):
    """A direction with a hundred-millionth of the largest deviation keeps its digits, which a covariance would lose."""
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(-(10**8), 10**8, 400), rng.integers(-2, 3, 400)], axis=1)
    mixed = x @ np.array([[1, 1], [0, 1]])  # the small one hides in a difference of large ones
    df = spark.createDataFrame([(i, [float(v / 1024) for v in r]) for i, r in enumerate(mixed)], "vec_id long, embedding array<double>")
    model = whitening.fitted(df)
    exact = np.linalg.svd((400 * (mixed - 0) - mixed.sum(axis=0)) / 400)[1]
    assert np.allclose(np.sqrt(model.eigenvalues * 400), exact, rtol=1e-7) and whitening.identity_error(df, model) < 1e-4


def test_deviation_is_exact_or_null():
    center = whitening.Center(3, (10, 2**62))
    x = np.array([[4, 2**53], [1, 5]])
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(r, center.sums, strict=True)) for r in x]
    got = center.deviation(x).to_pylist()
    assert [g if g is None else g - w for g, w in zip(got, want, strict=True)] == [None if w > 9.2e18 else 0 for w in want]


# --- fill in the middle ---------------------------------------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_query(spark, data):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = {d: (*(x := brute_fim(d, t))[:4], sha(x[4]), sha(t)) for d, t in rows.items()}
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in QUERIES["op13_fill_in_middle"](spark, data).collect()}
    assert got == want and {x[1] for x in want.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_odd_rows(spark, odd, odd_rows, empty):
    more = [(None, "null id"), (1, "a<P>b"), (2, "<M"), (3, "<"), (4, "<S<S"), (5, "éé日本x\U0001f600y"), (6, "A-Z"), (7, "\x00\x00a"), (7, "other text"), (9, "<P<P a <S b M>")]
    docs = spark.createDataFrame(odd_rows + more, "doc_id long, text string")
    got = sorted((tuple(r[:6]) for r in fillmiddle.transformed(docs).collect()), key=repr)
    assert got == sorted(((d, *brute_fim(d, t)) for d, t in odd_rows + more), key=repr)
    back = fillmiddle.transformed(docs).select("doc_id", fillmiddle.restored().alias("text"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((d, t or "") for d, t in odd_rows + more), key=repr)
    assert fillmiddle.transformed(odd).count() == len(odd_rows) and fillmiddle.transformed(empty).count() == 0


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        x = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fillmiddle.WaveletMatrix(x, levels=3)
        at = rng.integers(0, n + 1, 50)
        for symbol in range(8):
            assert matrix.rank(symbol, at).tolist() == [int((x[:a] == symbol).sum()) for a in at]


def test_cuts_lie_on_units():
    texts = ["", "ab, cd", "日x日", "  a", "abc", "é"]
    data, at = fillmiddle.text_bytes(__import__("pyarrow").array(texts))
    units = fillmiddle.Units(data, at)
    parts = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert units.n.tolist() == [len(p) for p in parts]
    for k in range(max(map(len, parts)) + 1):
        after = np.minimum(units.n, k)
        cuts = units.cut(after)
        assert [bytes(data[a:c]).decode() for a, c in zip(at[:-1], cuts, strict=True)] == ["".join(p[:n]) for p, n in zip(parts, after, strict=True)]
        assert (units.chars(cuts) - units.chars(at[:-1])).tolist() == [len("".join(p[:n])) for p, n in zip(parts, after, strict=True)]
