"""Toxicity by a classifier chain of linear models over words.

The categories are predicted one after another: each model sees the words of a text and the probabilities of
the categories before it. In training those are out-of-fold predictions (each row's from words and models that did not see
it), so later models meet probabilities as uncertain as they will be in use. The label table has two judgements, so the
chain's categories are low_quality and, given that, toxic. A category's threshold is the one of the best F1 of its
out-of-fold probabilities.

Words are chosen by their chi-square with any category, counted in Spark for each fold. Words and models are fitted on at
most SAMPLE labelled documents, taken by a hash of doc_id: their word bits, at most SAMPLE times a few times WORDS, come to
the driver, where the logistic regressions are solved. Every document is then scored in one pass without a shuffle.

Defined cases: null and empty texts have no words and get the models' intercepts; labels that are null or whose
document is missing are not used; of rows that share a labelled doc_id the text of the smallest hash is the example; a
category with one kind of label only has that label as its probability; without any labelled document all probabilities
are 0; repeated rows are scored one by one; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, table, text_table, written

#: Labelled documents that words and models are fitted on, at most.
SAMPLE = 20_000
WORDS, FOLDS, LEAST_CHI2, PENALTY = 256, 3, 20.0, 1e-4
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Chain:
    """words -> place, and per category its weights (intercept, words, earlier probabilities) and threshold."""

    names: list[str]
    words: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, found: set[str]) -> list[float]:
        at = [self.words[w] for w in self.words.keys() & found]
        out: list[float] = []
        for w in self.weights:
            z = w[0] + w[1:][at].sum() + float(np.dot(w[1 + len(self.words) :], out))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out

    def scored(self, docs: DataFrame) -> DataFrame:
        """doc_id and a probability per category, in columns p_<category>."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = np.array([self.probabilities(words_of(t.as_py())) for t in batch.column(1)]).reshape(-1, len(self.names))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in rows.T.copy())], names=["doc_id", *(f"p_{n}" for n in self.names)])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"p_{n} double" for n in self.names))


def _presence(words: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for t in batch.column("text"):
                row = np.zeros(len(words), bool)
                row[[words[w] for w in words.keys() & words_of(t.as_py())]] = True
                bits.append(np.packbits(row).tobytes())
            yield batch.drop_columns(["text"]).append_column("bits", pa.array(bits, pa.binary()))

    return run


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.drop_columns(["text"]).append_column("words", pa.array([sorted(words_of(t.as_py())) for t in batch.column("text")], pa.list_(pa.string())))


def chosen_words(rows: DataFrame, names: list[str], folds: int = FOLDS, most: int = WORDS) -> list[list[str]]:
    """For each fold the words of the largest chi-square with any category in the other folds, and last those of all rows."""
    per_fold = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).collect()}
    schema = "fold int, " + ", ".join(f"{c} int" for c in names) + ", words array<string>"
    seen = rows.select("fold", *names, "text").mapInArrow(_distinct_words, schema).select("fold", *names, F.explode("words").alias("word"))
    sums = [F.count_if(F.col("fold") == f).cast("double").alias(f"d_{f}") for f in range(folds)]
    sums += [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).cast("double").alias(f"{c}_{f}") for f in range(folds) for c in names]
    counts = written(seen.groupBy("word").agg(*sums, F.count("*").alias("d")).where("d >= 3"), "word_counts")
    chosen = []
    for held in (*range(folds), None):
        used = [f for f in range(folds) if f != held]
        n = sum(per_fold[f]["n"] for f in used if f in per_fold)
        d = sum((F.col(f"d_{f}") for f in used), F.lit(0.0))
        chi = []
        for c in names:
            k = float(sum(per_fold[f][c] for f in used if f in per_fold))
            if 0 < k < n:
                both = sum((F.col(f"{c}_{f}") for f in used), F.lit(0.0))
                chi.append(n * F.pow(both * n - d * k, 2) / F.greatest(d * (n - d) * k * (n - k), F.lit(1.0)))
        if not chi:
            chosen.append([])
            continue
        best = counts.where(d >= 3).select("word", F.greatest(F.lit(0.0), *chi).alias("chi")).where(F.col("chi") >= LEAST_CHI2)
        chosen.append([r["word"] for r in best.orderBy(F.desc("chi"), "word").limit(most).collect()])
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 50) -> np.ndarray:
    """Intercept and weights of the least mean log-loss plus half the penalty times the weights' squares, by damped Newton steps."""
    if y.min() == y.max():
        return np.r_[50.0 if y[0] else -50.0, np.zeros(x.shape[1])]
    x = np.c_[np.ones(len(x)), x]
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-9
    loss = lambda w: np.logaddexp(0, x @ w).mean() - (y * (x @ w)).mean() + (ridge * w * w).sum() / 2
    w, now = np.zeros(x.shape[1]), np.log(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge), x.T @ (p - y) / len(y) + ridge * w)
        size = 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-10:
            break
        w, now = w - size * step, new
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on the F1 of y is greatest: half way to the next smaller probability; 0.5 without labels of both kinds."""
    if y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    last = np.r_[p[1:] != p[:-1], True]  # rows of one probability fall together
    f1 = np.where(last, 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum()), -1)
    i = int(np.argmax(f1))
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0.0)) / 2)


def chained(x: np.ndarray, y: np.ndarray, fold: np.ndarray, own: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights per category over all columns of x and the earlier probabilities, and the out-of-fold probabilities.

    own: for each fold, and last for the final models, the columns of x that its models may use.
    """

    def fit(rows: np.ndarray, columns: np.ndarray, before: np.ndarray, i: int) -> np.ndarray:
        got = logistic(np.c_[x[rows][:, columns], before[rows]], y[rows, i])
        full = np.zeros(1 + x.shape[1] + before.shape[1])
        full[0], full[1 + columns], full[1 + x.shape[1] :] = got[0], got[1 : 1 + len(columns)], got[1 + len(columns) :]
        return full

    out, weights = np.zeros(y.shape), []
    for i in range(y.shape[1]):
        before = out[:, :i]
        for f in np.unique(fold):
            rest = fold != f
            w = fit(rest, own[f], before, i) if rest.any() else np.zeros(1 + x.shape[1] + i)
            held = ~rest
            out[held, i] = 1 / (1 + np.exp(-np.clip(w[0] + np.c_[x[held], before[held]] @ w[1:], -500, 500)))
        weights.append(fit(np.ones(len(y), bool), own[-1], before, i))
    return weights, out


def fitted(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """The chain over categories (SQL conditions on the columns of labels), in their order."""
    names = list(categories)
    judged = labels.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in labels.columns if c != "doc_id"])
    judged = judged.select("doc_id", *[F.expr(x).cast("int").alias(c) for c, x in categories.items()]).dropna()
    some = bounded_sample(judged, ["doc_id"], sample).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(folds)).cast("int"))
    # at most sample rows of a few numbers: a proven bound for the broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    one = texts.groupBy("doc_id", "fold", *names).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = written(one, "labelled")
    if rows.isEmpty():
        return Chain(names, {}, [np.r_[-50.0, np.zeros(i)] for i in range(len(names))], [0.5] * len(names))
    chosen = chosen_words(rows, names, folds)
    words = {w: i for i, w in enumerate(sorted(set().union(*chosen)))}
    schema = "doc_id bigint, fold int, " + ", ".join(f"{c} int" for c in names) + ", bits binary"
    got = rows.mapInArrow(_presence(words), schema).toArrow().sort_by("doc_id")  # sample rows of a bit per word at most
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in got["bits"].to_pylist()]).reshape(got.num_rows, -1), axis=1, count=len(words)).astype(float) if words else np.zeros((got.num_rows, 0))
    y = np.array([got[c].to_numpy() for c in names], float).T
    weights, out = chained(x, y, got["fold"].to_numpy(), [np.array(sorted(words[w] for w in c), int) for c in chosen])
    kept = np.array(sorted(words[w] for w in chosen[-1]), int)  # the final models use the words of all rows only
    ordered = sorted(words)
    columns = np.r_[0, 1 + kept]
    final = [np.r_[w[columns], w[1 + len(words) :]] for w in weights]
    return Chain(names, {ordered[j]: i for i, j in enumerate(kept.tolist())}, final, [best_threshold(out[:, i], y[:, i]) for i in range(len(names))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir)
    chain = fitted(docs, table(spark, sf_dir, "labels"))
    return chain.scored(docs).withColumn("toxic", F.col("p_toxic") >= chain.thresholds[chain.names.index("toxic")])
