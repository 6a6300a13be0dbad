"""Quality rules: a threshold table compiled into one Spark projection, without user functions or shuffles.

Defined cases: a null or empty text has no words and no lines, all its counts are 0 and it fails
(too few words). Texts under five words have no window. Columns of the input with the names of a
metric are replaced in the output; all other columns are left alone. Ties and repeated rows are
judged row by row. Windows of a text are compared by a 64-bit hash of their five words. Stop words are looked for
in lower case and without punctuation, and only in texts of which half the characters of words are A-Z letters: other
scripts have none of the listed words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import WHITE, text_table, where_computed

#: Frequent function words by language; a text in Latin letters without any is no prose.
STOP_WORDS = {
    "en": "the of and to a in is it that for was on are with as be at this by from or have not but",
    "fr": "le la les de des du et un une est en que qui dans pour sur au avec par pas ce il elle",
    "de": "der die das und ist ein eine von zu mit den im dem des auf nicht für sich auch als es",
    "es": "el la los las de del y en un una que es por con para se no su al lo como",
    "it": "il lo la i gli le di da in con su per tra e che non un una del della si è sono",
    "pt": "o a os as de do da em no na e que um uma para com por não se é ao",
    "nl": "de het een van en in is dat op te voor met niet zijn aan er maar om ook",
    "sv": "och att det som en på är av för med den till inte om ett har de",
    "da": "og at det som en på er af for med den til ikke et har de i",
    "pl": "i w na z do się nie to że o jak jest po za od dla co",
    "cs": "a v na se je že s z do o to jako ale pro by si",
    "ro": "și în de la a cu nu pe care o un din ce este pentru",
    "hu": "a az és hogy nem is egy van ez meg de azt csak mint",
    "fi": "ja on ei että se oli hän mutta kun niin ovat myös",
    "tr": "ve bir bu da de için ile çok ne gibi daha ama olarak",
    "id": "yang dan di itu dengan untuk tidak ini dari dalam akan pada",
    "vi": "và của là có không được các cho một người trong với",
}
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A metric that must lie in [low, high] for texts with at least min_words words, and of Latin letters if so said."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0
    latin: bool = False


#: The contract's base rules: ten words, at most 20 % of words in repeated windows.
BASE = (Rule("n_words", low=10), Rule("repeat_percent", high=20))
#: Thresholds measured on the labelled documents; ratios to words or lines.
RULES = (
    Rule("mean_word_chars", low=2.5, high=12),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.05, min_words=50, latin=True),
    Rule("dup_line_ratio", high=0.5),
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def counts(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """docs with the metrics as columns, computed inside each row.

    The repeated-window count looks for equal hashes first and sorts only in texts that have any.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.translate(body, WHITE, " " * len(WHITE)), " "), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = sorted({w for x in STOP_WORDS.values() for w in x.split()})
    plain = F.split(F.translate(F.lower(body), WHITE + PUNCTUATION, " " * len(WHITE + PUNCTUATION)), " ")
    df = docs.withColumns({"_words": words, "_lines": lines})
    df = df.withColumns(
        {
            "_hashes": F.when(
                F.size("_words") >= width,
                F.transform(F.sequence(F.lit(1), F.size("_words") - (width - 1)), lambda i: F.xxhash64(F.slice("_words", i, width))),
            ).otherwise(F.array().cast("array<bigint>")),
            "_stop": F.size(F.filter(plain, lambda w: w.isin(stop))),
            "_distinct_lines": F.size(F.array_distinct("_lines")),
        }
    )
    sorted_windows = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), sorted_windows))
    at = lambda j: F.get(F.col("_sorted"), j)["h"]
    again = F.filter("_sorted", lambda x, j: F.coalesce(x["h"] == at(j - 1), F.lit(False)) | F.coalesce(x["h"] == at(j + 1), F.lit(False)))
    df = df.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "_again",
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(width), i - s["last"])).alias("n"), i.alias("last")),
    )["n"]
    n = F.size("_words").cast("long")
    df = df.withColumns(
        {
            "n_words": n,
            "word_chars": F.length(_without(body, WHITE)).cast("long"),
            "n_symbols": (F.length(body) - F.length(_without(body, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.col("_distinct_lines")).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_n_lines": F.size("_lines"),
        }
    )
    at_least_one = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns(
        {
            "repeat_percent": 100 * F.col("n_repeat_words") / at_least_one,
            "mean_word_chars": F.col("word_chars") / at_least_one,
            "symbol_ratio": F.col("n_symbols") / at_least_one,
            "stop_word_ratio": F.col("_stop") / at_least_one,
            "latin_ratio": (F.length(body) - F.length(_without(body, ASCII_LETTERS))) / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        }
    ).drop("_words", "_lines", "_hashes", "_stop", "_distinct_lines", "_sorted", "_again", "_n_lines")


def failed(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row breaks, as an array column: the compiled threshold table."""
    broken = []
    for r in rules:
        outside = F.lit(False)
        if r.low is not None:
            outside = outside | (F.col(r.metric) < r.low)
        if r.high is not None:
            outside = outside | (F.col(r.metric) > r.high)
        counts_for = (F.col("n_words") >= r.min_words) & ((F.col("latin_ratio") >= 0.5) if r.latin else F.lit(True))
        broken.append(F.when(outside & counts_for, F.lit(r.metric)))
    return F.array_compact(F.array(*broken))


def judged(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the metrics, base_failed, failed_rules and kept."""
    # the input's columns wait in a struct, so that none is taken for one of these
    own = docs.select(F.struct(*docs.columns).alias("_input"), F.col(text).alias("_text"))
    df = counts(own, "_text").withColumns({"base_failed": F.size(failed(base)) > 0, "failed_rules": failed(base + rules)}).drop("_text")
    df = df.withColumn("kept", F.size("failed_rules") == 0)
    made = [c for c in df.columns if c != "_input"]
    return df.select(*[F.col("_input")[c].alias(c) for c in docs.columns if c not in made], *made)


def kept(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that keep to the rules, with the columns of docs."""
    own = docs.select(F.struct(*docs.columns).alias("_own"), F.col(text).alias("text"))  # its columns may have the metrics' names
    return where_computed(judged(own, **options), F.col("kept")).select("_own.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(text_table(spark, sf_dir).select("doc_id", "text"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LIST = ", ".join(f"'{w}'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))
_MARKS = PUNCTUATION.replace("'", "''")
ORACLE_SQL = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM base),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM parts),
windows AS (
  SELECT doc_id, i, w || chr(10) || w2 || chr(10) || w3 || chr(10) || w4 || chr(10) || w5 AS win FROM (
    SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
    FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  WHERE w5 IS NOT NULL),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
repeated AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id),
metrics AS (
  SELECT p.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(string_split(regexp_replace(translate(lower(t), '{_MARKS}', '{" " * len(PUNCTUATION)}'), '[\x20\x09-\x0D]', ' ', 'g'), ' '), lambda w: w IN ({_LIST}))) AS n_stop,
    len(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_latin
  FROM parts p LEFT JOIN repeated r ON p.doc_id = r.doc_id),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    word_chars / greatest(n_words, 1) BETWEEN 2.5 AND 12 AND n_symbols / greatest(n_words, 1) <= 0.1
      AND (n_words < 50 OR n_latin / greatest(word_chars, 1) < 0.5 OR n_stop / greatest(n_words, 1) >= 0.05) AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS passed
  FROM metrics)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passed AS kept FROM judged
"""
