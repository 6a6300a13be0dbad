"""Null ids and columns of clashing names in the operators that keep the input's columns or pass ids through."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import prose

import corpus_pipeline
from weftline.llm import decontaminate, fillmiddle, htmltext, linededup, ngramjoin, packing, quality, simhash, suffixdedup


@pytest.fixture(scope="module")
def rows():
    import random

    rng = random.Random(11)
    a, b = "\n".join(prose(rng, 20) for _ in range(6)), prose(rng, 90)
    return [(None, a), (1, a), (2, a + "\n" + b), (None, b), (3, None), (None, None), (4, b)]


@pytest.fixture(scope="module")
def named(spark, rows):
    """The rows with columns of the names that operators use inside."""
    names = "_at _lines _words _hashes _stop _sorted _again _n_lines _doc _mark _own _input _text _text_hash _id _hash _row _n h d key root".split()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names})


def kept_whole(out, docs):
    """Every column of docs but the text has its own values in out."""
    for c in set(docs.columns) - {"text", "doc_id"}:
        assert c in out.columns, c
        assert all(r[c] == f"own {r['doc_id'] if r['doc_id'] is not None else '-'}" for r in out.select("doc_id", c).collect()), c


def test_columns_of_clashing_names_stay(spark, named):
    items = spark.createDataFrame([(1, "no such benchmark item in any text")], "item_id long, text string")
    for out in (linededup.deduped(named), quality.judged(named), quality.kept(named), simhash.representatives(named), decontaminate.cleaned(named, items)):
        kept_whole(out, named)
        assert out.count()


def test_suffix_dedup_with_null_ids(spark, rows):
    got = suffixdedup.deduped(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert len(got) == len(rows)
    for r in (r for r in got if r.doc_id is None):
        assert r.n_removed == r.n_spans == 0 and r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].n_removed == 0 and by[2].n_removed == len(rows[1][1].encode()) and by[4].n_removed == by[4].n_bytes


def test_packing_with_null_ids(spark, rows):
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id for r in got} == {None, 1, 2, 3, 4}
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_pipeline_with_null_ids(spark, rows, data):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav><a href=x>Home</a></nav><article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be one of the things.</p></article>", "Let x=1 be one of the things."),
        ("<nav><a href=x>Home</a></nav><article><p>Before <span hidden>secret <span>in</span> tail</span> after this.</p></article>", "Before after this."),
        ('<nav><a href=x>Home</a></nav><article><p title="abc>Hello there</p><p>The next paragraph.</p></article>', "Hello there\nThe next paragraph."),
        ("<html><body><p>One</p></body></html>", "One"),
    ],
)
def test_no_text_is_lost_or_leaks(page, text):
    assert htmltext.main_text(page) == text


def test_new_operators_with_null_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert fillmiddle.transformed(docs).count() == len(rows)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngramjoin.classes(docs).collect()}
    assert got[(1, got and next(n for d, n in got if d == 1))] == 1
    assert all(c == 1 for (d, n), c in got.items() if d is None and n == next(n for d, n in got if d == 1))
    assert got[(3, 0)] == 3 and got[(None, 0)] is None
