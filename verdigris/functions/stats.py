"""Numeric, ranking and budget expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def clean(x: Column) -> Column:
    """The number, with NaN as null: averages here skip what is missing."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(clean(x)), F.lit(0.0))


def std(x: Column) -> Column:
    """Sample deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(clean(x)), F.lit(0.0))


def ci95(x: Column) -> Column:
    return F.coalesce(Z * F.stddev_samp(clean(x)) / F.sqrt(F.count(clean(x))), F.lit(0.0))


def summary(x: Column) -> list[Column]:
    v = clean(x)
    return [mean(x).alias("mean"), std(x).alias("std"), F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"), F.count(v).cast("double").alias("n"), ci95(x).alias("ci95")]


def numeric_match(pred: Column, ref: Column, tol: float = 0.05) -> Column:
    """1 within a relative tolerance, absolute at a reference of 0; unreadable or NaN gives 0."""
    p, r = clean(pred.try_cast("double")), clean(ref.try_cast("double"))
    near = F.when(r == 0, F.abs(p) <= tol).otherwise(F.abs(p - r) / F.nullif(F.abs(r), F.lit(0.0)) <= tol)
    return F.coalesce(near, F.lit(False)).cast("double")


def brier(probability: Column, outcome: Column) -> Column:
    p = probability.try_cast("double")
    return F.when(p.isNull(), 1.0).otherwise(F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)) - outcome.cast("double"), F.lit(2)))


def hits_at_k(ranked: Column, gold: Column, k: int) -> Column:
    return F.coalesce(F.array_contains(F.slice(ranked, 1, k), gold), F.lit(False)).cast("double")


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    at = F.array_position(ranked, gold)
    return F.when(at > 0, 1.0 / F.nullif(at, F.lit(0))).otherwise(0.0)


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """Struct of low and high of Wilson's interval; n of 0 gives null."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, scale = k / n, 1 + z * z / n
    mid = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.struct((mid - half).alias("low"), (mid + half).alias("high"))


def comparison_pairs(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2)


def share_of_steps(values: Column, total: Column) -> Column:
    return F.size(F.filter(values, lambda x: x != 0)) / F.nullif(total, F.lit(0))


def list_agreement(a: Column, b: Column) -> Column:
    """Share of places where two lists are equal; lists of unequal length agree nowhere."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(same / F.nullif(F.size(a), F.lit(0)))


def quantize(value: Column, quantum: int = 512) -> Column:
    """Down to the grid, one quantum at the least."""
    return F.greatest(F.lit(quantum), F.floor(value / quantum) * quantum).cast("bigint")


def context_reserve(tokens: Column, fixed: int = 64, share: float = 0.05) -> Column:
    return (F.lit(fixed) + share * F.greatest(tokens, F.lit(0))).cast("bigint")


def output_budget(cap: Column, window: Column, tokens: Column, fixed: int = 64, share: float = 0.05, quantum: int = 512) -> Column:
    """What a reply may take: the cap or what the window leaves, on the grid where that fits, at least 1."""
    left = window - tokens - context_reserve(tokens, fixed, share)
    return F.greatest(F.lit(1), F.least(quantize(F.least(cap, left), quantum), cap, F.greatest(left, F.lit(1)))).cast("bigint")


def token_estimate(x: Column, per: float = 3.6) -> Column:
    """int(length / 3.6) + 1; an empty text has 0."""
    return F.when(F.coalesce(F.length(x), F.lit(0)) == 0, 0).otherwise(F.floor(F.length(x) / per) + 1).cast("bigint")


def backoff(attempt: Column, error: Column | None = None, draw: Column | None = None, base: float = 2.0, limited: float = 20.0, factor: float = 2.0, cap: float = 120.0, jitter: float = 0.3) -> Column:
    """Seconds to wait after an attempt (from 1), longer from the start where the error is a rate limit.

    `draw`, from 0 to 1, places the wait within jitter of itself on either side;
    without one there is no jitter.
    """
    start = F.lit(base) if error is None else F.when(error == "rate_limit", limited).otherwise(base)
    wait = F.least(F.lit(cap), start * F.pow(F.lit(factor), F.greatest(attempt - 1, F.lit(0))))
    return wait if draw is None else F.greatest(F.lit(0.0), wait * (1 + jitter * (2 * draw - 1)))


def clamp(x: Column, low: int = 64, high: int = 32_000) -> Column:
    return F.greatest(F.lit(low), F.least(x.cast("bigint"), F.lit(high)))
