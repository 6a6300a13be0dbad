"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

A labelled URL is one whose document is labelled: the number in its path is the document's id, and low quality
or toxicity make it a URL to block. The trees are fitted on at most SAMPLE labelled URLs (taken by hash, so alike
at every size). Suffix statistics are smoothed block rates of a host's last label and of its last two, no more than SAMPLE
rows each; the trees are fitted on out-of-fold rates (a row's come from URLs of other folds), so they don't take a rate
for better than it is. Every URL is judged in one pass.

Defined cases: a null URL or one without :// has an empty host and path and is judged by the trees like any other;
rules apply only where the path starts with theirs, so not to an empty path; of the rules that fit the longest wins;
without labels of both kinds there is no model and what no rule decides is allowed; repeated rows are judged alike;
other input columns stay as they are, whatever their names, but host, path, rule, verdict and score are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, table, written

#: Labelled URLs that the trees are fitted on, at most.
SAMPLE = 20_000
SEED = 17
#: Folds of the suffix rates, and rows that the overall rate counts for in them.
FOLDS, SMOOTH = 4, 10


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host/path

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)
FEATURES = ("url_length", "host_length", "host_labels", "hyphens", "depth", "path_length", "digit_ratio", "entropy", "parameters", "query_length", "fragment", "suffix_rate", "domain_rate")
#: Suffix columns and the rate of each.
SUFFIXES = {"suffix": "suffix_rate", "domain": "domain_rate"}


def host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: tuple[Rule, ...], field: str) -> Column:
    """The text or verdict of the longest rule that fits the columns host and path."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the last, longest condition is the outermost
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def _count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def features(urls: DataFrame) -> DataFrame:
    """The lexical features of column url, and the host's suffixes."""
    u = F.coalesce(F.col("url"), F.lit(""))
    df = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "_query": F.regexp_extract(u, r"(?s)\?([^#]*)", 1), "_chars": F.array_distinct(F.split(u, ""))})
    n = F.greatest(F.length(u), F.lit(1))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter("_chars", lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return df.withColumns(
        {
            "url_length": F.length(u).cast("double"),
            "host_length": F.length("host").cast("double"),
            "host_labels": _count(F.col("host"), ".").cast("double") + 1,
            "hyphens": _count(F.col("host"), "-").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "path_length": F.length("path").cast("double"),
            "digit_ratio": _count(u, "0123456789") / n,
            "entropy": entropy,
            "parameters": F.size(F.filter(F.split("_query", "[&;]"), lambda x: x != "")).cast("double"),
            "query_length": F.length("_query").cast("double"),
            "fragment": F.contains(u, F.lit("#")).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "domain": F.substring_index("host", ".", -2),
        }
    ).drop("_query", "_chars")


def labelled(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """url and label (1: block) of the URLs whose document is labelled."""
    known = labels.select(F.col("doc_id").alias("_doc"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("double").alias("label")).where("label is not null")
    number = F.regexp_extract("url", r"://[^?#]*/([0-9]{1,18})([./?#]|$)", 1)
    return urls.select("url", F.nullif(number, F.lit("")).cast("bigint").alias("_doc")).join(known.hint("merge"), "_doc").select("url", "label")


class UrlFilter:
    """Fitted trees with their suffix statistics; without trees all URLs get the verdict allow."""

    def __init__(self, model: PipelineModel | None, rates: dict[str, DataFrame], rate: float):
        self.model, self.rates, self.rate = model, rates, rate

    @staticmethod
    def fit(examples: DataFrame, sample: int = SAMPLE, trees: int = 10, depth: int = 4) -> UrlFilter:
        rows = written(bounded_sample(examples.select("url", "label"), ["url", "label"], sample).coalesce(1), "urls")
        seen = features(rows).withColumn("_fold", F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(FOLDS)))
        # counts of the sampled URLs by suffix and fold: as many rows as the sample has, twice, at most
        kinds = F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), F.col(x).alias("value")) for x in SUFFIXES])).alias("s")
        per = seen.select("label", "_fold", kinds).groupBy("s.kind", "s.value", "_fold").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).toPandas()
        total = per[per["kind"] == next(iter(SUFFIXES))]
        bad, n = float(total["bad"].sum()), int(total["n"].sum())
        if bad in (0, n):
            return UrlFilter(None, {}, 0.0)
        rate = bad / n
        it = UrlFilter(None, {}, rate)
        smooth = lambda bad, n: (bad + SMOOTH * rate) / (n + SMOOTH)
        spark, train = examples.sparkSession, seen
        for suffix, name in SUFFIXES.items():
            own = per[per["kind"] == suffix]
            whole = own.groupby("value")[["bad", "n"]].sum()
            rates = smooth(whole["bad"], whole["n"])
            it.rates[suffix] = spark.createDataFrame(list(zip(rates.index.tolist(), rates.tolist(), strict=True)), f"{suffix} string, {name} double")
            rest = whole.loc[own["value"]].to_numpy() - own[["bad", "n"]].to_numpy()
            others = spark.createDataFrame(list(zip(own["value"].tolist(), own["_fold"].tolist(), smooth(rest[:, 0], rest[:, 1]).tolist(), strict=True)), f"{suffix} string, _fold bigint, {name} double")
            train = train.join(F.broadcast(others), [suffix, "_fold"])
        # the trees read their rows again for each level: features of at most sample rows, on one task
        train = train.select(*FEATURES, "label").coalesce(1).persist()
        gbt = GBTClassifier(featuresCol="_features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=SEED, minInstancesPerNode=5)
        it.model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_features"), gbt]).fit(train)
        train.unpersist()
        return it

    def judge(self, urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """urls with host, path, rule, verdict and score (the trees' probability of block; null without trees)."""
        # the input's columns wait in a struct, so that none is taken for a feature
        seen = features(urls.select(F.struct(*urls.columns).alias("_own"), "url"))
        if self.model is None:
            own, score = F.lit("allow"), F.lit(None).cast("double")
        else:
            for suffix, name in SUFFIXES.items():
                # as many suffixes as sampled URLs at most: a proven bound for the broadcast
                seen = seen.join(F.broadcast(self.rates[suffix]), suffix, "left").fillna({name: self.rate})
            seen = self.model.transform(seen)
            own = F.when(F.col("prediction") == 1, F.lit("block")).otherwise("allow")
            score = F.get(vector_to_array("probability"), F.lit(1))
        return seen.select(
            *[F.col("_own")[c].alias(c) for c in urls.columns if c not in ("host", "path", "rule", "verdict", "score")],
            "host",
            "path",
            rule_of(rules, "text").alias("rule"),
            F.coalesce(rule_of(rules, "verdict"), own).alias("verdict"),
            score.alias("score"),
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fitted = UrlFilter.fit(labelled(pages, table(spark, sf_dir, "labels")))
    return fitted.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
