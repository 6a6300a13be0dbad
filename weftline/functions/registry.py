"""Named operators and rules that users may add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

OPERATORS: dict[str, Callable[..., DataFrame]] = {}
RULES: dict[str, list[Callable[[], Column]]] = {}


def register(name: str, fn: Callable[..., DataFrame]) -> None:
    """Makes an operator known by name."""
    OPERATORS[name] = fn


def register_rule(domain: str, fn: Callable[[], Column]) -> None:
    """Adds a predicate of a domain; fn gives a column that is the reason of a denial, or null."""
    RULES.setdefault(domain, []).append(fn)


def denied(df: DataFrame, domain: str) -> DataFrame:
    """df with reason: the first rule of the domain that denies a row, null if none."""
    from pyspark.sql import functions as F

    rules = [fn() for fn in RULES.get(domain, [])]
    return df.withColumn("reason", F.coalesce(*rules, F.lit(None).cast("string")))


def domain_policy(domain: str, least_confidence: float = 0.5, most_sites: int = 5) -> Callable[[], Column]:
    """The standard rule: the row's domain, its intent's confidence, and the number of candidate sites."""
    from pyspark.sql import functions as F

    def rule() -> Column:
        return F.when(F.col("domain") != domain, F.lit("domain mismatch")).when(F.col("confidence") < least_confidence, F.lit("confidence too low")).when(F.col("n_sites") > most_sites, F.lit("too many sites"))

    return rule
