"""Arithmetic of scores, as column expressions: boosts, freshness, steadiness, variants of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boosted(base: float, boosts: list[tuple[Column, float]], cap: float = 1.0) -> Column:
    """A base plus an amount for each condition that holds, at most ``cap``; a null condition does not hold."""
    total = F.lit(base)
    for condition, amount in boosts:
        total = total + F.when(condition, amount).otherwise(0.0)
    return F.least(total, F.lit(cap))


def clipped_mean(ratios: list[Column]) -> Column:
    """Mean of ratios, each cut to [0, 1]; a null ratio counts as 0."""
    total = F.lit(0.0)
    for r in ratios:
        total = total + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0))))
    return total / len(ratios)


def linear_freshness(age_days: Column, span: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - age_days / span)


def steadiness(values: Column) -> Column:
    """1 - standard deviation over mean of an array, at least 0; 0 where the mean is 0 or nothing is there."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, n)
    var = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), n)
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(F.sqrt(var), mean)), F.lit(0.0))


def by_profile(df: DataFrame, kind: str, parts: list[str], profiles: dict[str, list[float]], default: list[float]) -> Column:
    """Weighted sum of ``parts`` with the weights of the row's kind."""
    total = F.lit(0.0)
    for i, p in enumerate(parts):
        w = F.lit(default[i])
        for name, weights in profiles.items():
            w = F.when(F.col(kind) == name, weights[i]).otherwise(w)
        total = total + w * F.col(p)
    return total


def word_variants(word: Column) -> Column:
    """A word, its plural and its forms with common endings and beginnings, in lower case."""
    w = F.lower(word)
    plural = F.when(w.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(w, "y$", ""), F.lit("ies"))).when(w.rlike("(s|x|ch|sh)$"), F.concat(w, F.lit("es"))).otherwise(F.concat(w, F.lit("s")))
    ends = [F.concat(w, F.lit(e)) for e in ("ing", "ed", "er", "service", "manager", "handler")]
    starts = [F.concat(F.lit(s), w) for s in ("get", "set", "create", "is")]
    return F.array_distinct(F.array(w, plural, *ends, *starts))


def related(a: Column, b: Column) -> Column:
    """Whether one text contains the other, whatever their case; an empty one is contained in any."""
    x, y = F.lower(a), F.lower(b)
    return x.contains(y) | y.contains(x)
