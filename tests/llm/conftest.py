import random

import pytest

WORDS = "the of and to fox dog über señor run jump over lazy quick brown tree house".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, short, very long and repeated texts, near copies and shared passages."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 12) for _ in range(1500))
    passage = prose(rng, 60)
    texts = [None, "", " \t\n", "one", "one two three", long, prose(rng, 40), prose(rng, 40) + "\n" + passage, passage + " tail", "x" * 49, "x" * 120, "\x00" * 60 + "ab", "é" * 80, "a\r\nb\r\na\r\nb"]
    base = prose(rng, 300)
    texts += [base, base, base.replace("fox", "cat", 1), base + " end", base.upper(), long[: len(long) // 2]]
    return [(100 + i, t) for i, t in enumerate(texts)]


CLASH = ("n_words", "kept", "fp", "h", "key", "chunk", "start", "rule", "label", "_row", "id", "root", "verdict", "size")


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as a frame with the columns of documents and extra ones of clashing names, null in part."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.when(F.col("doc_id") % 2 == 0, F.lit("own")) for c in CLASH})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
