"""Line dedup by content-defined chunks of lines, with DataFrame operations only.

A rolling hash runs over the hashes of ROLL successive lines that hold a word. Boundaries lie where it changes between
hashes that the corpus repeats and hashes that occur once, so a chunk is a maximal run of lines under repeated hashes; it
depends on the text alone and shifts with it. A hash modulo a divisor as the mark would need two marks inside a repeated
passage, which short ones lack (README has figures); here every repeated passage of ROLL lines or more is a chunk,
wherever it begins.

Hashes only find candidates. Windows of ROLL lines meet by hash and bytes, the first one (smallest doc_id, then text hash,
then place) stays with its own lines, and the lines of all others go. Counts combine before the shuffle, repeated hashes
and first windows are written before they are joined, so those are plain joins that Spark splits where one passage stands
in very many rows. Rows are told apart by doc_id and a hash of the text, so rows that share an id lose only their own lines.

Defined cases: a null text is an empty one with one empty line and is returned as ''; lines without a word don't count as
lines of a window, and one that follows a removed line goes with it; a line that repeats alone, between others, stays; a
repeat that overlaps the first window's own lines stays; rows of equal doc_id and text count as one document; rows with a
null doc_id lose no line and count for nothing; empty tables give no rows. Input columns other than the text stay as they
are; n_lines, n_removed_lines and n_removed_chunks are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import text_table, written

#: Lines with words in the rolling hash, and so the least length of a chunk.
ROLL = 2
COUNTS = ("n_lines", "n_removed_lines", "n_removed_chunks")
_BASE = -7046029254386353131


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _held() -> Column:
    """The places (from 0) in _lines of lines that hold a word."""
    return F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())


def rolling_hashes(lines: Column, held: Column, roll: int = ROLL) -> Column:
    """Per window of roll lines a polynomial of the lines' hashes; fewer lines have no window."""
    hashes = F.transform(held, lambda i: F.xxhash64(F.get(lines, i)))
    mixed = lambda at, k: F.xxhash64(F.get(hashes, at + k), F.lit(_BASE + k))
    windows = F.sequence(F.lit(0), F.greatest(F.size(held) - roll, F.lit(0)))
    return F.when(F.size(held) >= roll, F.transform(windows, lambda at: reduce(Column.bitwiseXOR, [mixed(at, k) for k in range(roll)])))


def repeated_windows(docs: DataFrame, text: str = "text", roll: int = ROLL) -> DataFrame:
    """(doc_id, _text_hash, at): windows, by their place among the lines that hold a word, that occur before."""
    keys = ["doc_id", "_text_hash"]
    keyed = docs.select("doc_id", _text_hash(text).alias("_text_hash"), F.col(text).alias("_text"))
    lines = keyed.withColumn("_lines", _lines("_text")).withColumn("_held", _held())
    hashed = lines.select(*keys, F.posexplode(rolling_hashes(F.col("_lines"), F.col("_held"), roll)).alias("at", "h"))
    twice = written(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    places = written(hashed.join(twice.hint("merge"), "h").select(*keys, "at"), "places").groupBy(*keys).agg(F.collect_set("at").alias("_at"))
    # texts travel as they are and are split after the join; the windows leave their text before they become rows
    texts = keyed.join(places.hint("merge"), keys).withColumn("_lines", _lines("_text")).withColumn("_held", _held())
    window = lambda a: F.array_join(F.transform(F.slice("_held", a + 1, roll), lambda i: F.get("_lines", i)), "\n")
    windows = texts.select(*keys, F.explode(F.transform("_at", lambda a: F.struct(a.alias("at"), window(a).alias("window")))).alias("w"))
    found = written(windows.select(*keys, "w.at", "w.window", F.xxhash64("w.window").alias("h")), "windows")
    first = found.groupBy("h", "window").agg(F.min(F.struct(*keys, "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "first")
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("_text_hash") == F.col("first._text_hash")) & (F.col("at") - F.col("first.at")).between(0, roll - 1)
    return found.join(first.hint("merge"), ["h", "window"]).where(~own).select(*keys, "at")


def deduped(docs: DataFrame, text: str = "text", roll: int = ROLL) -> DataFrame:
    """docs with the repeated chunks gone from the text, and n_lines, n_removed_lines, n_removed_chunks (removed runs of lines)."""
    gone = repeated_windows(docs, text, roll).groupBy("doc_id", "_text_hash").agg(F.array_sort(F.collect_set("at")).alias("_at"))
    # the input's columns wait in a struct, so that none is taken for one of these
    others = [c for c in docs.columns if c not in (*COUNTS, text)]
    df = docs.select(F.struct(*others).alias("_own"), "doc_id", F.col(text).alias("_text"), _text_hash(text).alias("_text_hash")).join(gone.hint("merge"), ["doc_id", "_text_hash"], "left")
    # most rows lose nothing; their lines are only counted
    some = F.col("_at").isNotNull()
    df = df.withColumn("_lines", F.when(some, _lines("_text")))
    df = df.withColumn("_held", _held())
    # the lines from a window's first one to the next one with a word that follows its last one
    lines_of = lambda a: F.sequence(F.get("_held", a), F.coalesce(F.get("_held", a + roll), F.size("_lines")) - 1)
    df = df.withColumn("_gone", F.array_distinct(F.flatten(F.transform("_at", lines_of))))  # in rising order, as _at is
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i))
    runs = F.size(F.filter("_gone", lambda g, i: F.coalesce(F.get("_gone", i - 1) != g - 1, F.lit(True))))
    body = F.coalesce(F.col("_text"), F.lit(""))
    newlines = F.length(body) - F.length(F.translate(body, "\n", "")) + 1
    made = df.select(
        "_own",
        F.when(some, F.array_join(kept, "\n")).otherwise(body).alias("_text"),
        newlines.cast("bigint").alias("n_lines"),
        F.when(some, F.size("_gone")).otherwise(0).cast("bigint").alias("n_removed_lines"),
        F.when(some, runs).otherwise(0).cast("bigint").alias("n_removed_chunks"),
    )
    return made.select(*[F.col("_own")[c].alias(c) for c in others], F.col("_text").alias(text), *COUNTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = deduped(text_table(spark, sf_dir).select("doc_id", "text"))
    return df.select("doc_id", *COUNTS, F.sha2("text", 256).alias("text_sha256"))


#: By whole texts of windows, without hashes.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, md5(coalesce(text, '')) AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, t, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM docs),
held AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS p FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, t, p, l || chr(10) || next_l AS win FROM (SELECT *, lead(l) OVER (PARTITION BY doc_id, t ORDER BY p) AS next_l FROM held) WHERE next_l IS NOT NULL),
firsts AS (SELECT *, first_value({'d': doc_id, 't': t, 'p': p}) OVER (PARTITION BY win ORDER BY doc_id, t, p) AS f FROM windows),
again AS (SELECT doc_id, t, p FROM firsts WHERE NOT (doc_id = f.d AND t = f.t AND p - f.p <= 1)),
gone AS (SELECT DISTINCT h.doc_id, h.t, h.i FROM held h JOIN again a ON h.doc_id = a.doc_id AND h.t = a.t AND h.p - a.p IN (0, 1)),
marked AS (
  SELECT lines.*, last_value(h.i IGNORE NULLS) OVER (PARTITION BY lines.doc_id, lines.t ORDER BY lines.i) AS owner
  FROM lines LEFT JOIN held h ON lines.doc_id = h.doc_id AND lines.t = h.t AND lines.i = h.i),
judged AS (SELECT m.*, g.i IS NOT NULL AS gone FROM marked m LEFT JOIN gone g ON m.doc_id = g.doc_id AND m.t = g.t AND m.owner = g.i),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id, t ORDER BY i), false) AS fresh FROM judged)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed_lines, count(*) FILTER (fresh) AS n_removed_chunks,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM runs GROUP BY doc_id, t
"""
