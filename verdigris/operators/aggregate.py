"""Averages of sparse metrics under explicit rules for what is missing."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.stats import clean, mean
from verdigris.functions.text import once

# Metrics that are read together, so a sample has all of a group or counts for none of it.
CO_AVERAGED = (
    ("reasoning_observations_total", "reasoning_observations_used", "reasoning_observation_coverage"),
    ("reasoning_total_steps", "reasoning_useful_steps", "reasoning_useless_steps", "reasoning_useful_step_fraction", "reasoning_useless_step_fraction"),
)


def whole_groups(metrics: Column, groups: tuple[tuple[str, ...], ...] = CO_AVERAGED) -> Column:
    """The map of metrics without NaN, and without groups of which a sample has only a part."""
    out = F.map_filter(metrics, lambda k, v: v.isNotNull() & ~F.isnan(v))
    for group in groups:
        out = once(out, partial(_whole, group=group))
    return out


def _whole(metrics: Column, group: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(n) for n in group])
    had = F.size(F.array_intersect(F.map_keys(metrics), names))
    return F.when((had > 0) & (had < len(group)), F.map_filter(metrics, lambda k, v: ~F.array_contains(names, k))).otherwise(metrics)


def sparse_mean(df: DataFrame, keys: list[str], metrics: str = "metrics", co_averaged: bool = True, prefix: str = "") -> DataFrame:
    """keys, metric, value, n: the mean of each metric over the samples that carry it."""
    kept = whole_groups(F.col(metrics), CO_AVERAGED if co_averaged else ())
    long = df.select(*keys, F.explode(kept).alias("metric", "v"))
    return long.groupBy(*keys, F.concat(F.lit(prefix), "metric").alias("metric")).agg(F.avg("v").alias("value"), F.count("*").alias("n"))


def long_metrics(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, metric, value from wide columns; what is null or NaN has no row."""
    return df.select(*keys, *[clean(F.col(c)).alias(c) for c in columns]).unpivot(keys, columns, "metric", "value").where("value IS NOT NULL")


def macro_average(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    return df.groupBy(*keys, group).agg(mean(F.col(value)).alias("m")).groupBy(*keys).agg(F.avg("m").alias("macro_average"))


def coverage(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """How many samples have each metric: kept, skipped, coverage."""
    total = df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count(clean(F.col(c))).alias(c) for c in columns])
    out = total.unpivot([*keys, "total"], columns, "metric", "kept")
    return out.select(*keys, "metric", "kept", (F.col("total") - F.col("kept")).alias("skipped"), (F.col("kept") / F.col("total")).alias("coverage"))


def task_metrics(df: DataFrame, keys: list[str], primary: str, answered: Column, planned: Column, status: str = "status") -> DataFrame:
    """Primary metric over answered rows, its strict form over planned ones, and the rates of what went wrong."""
    n = F.count("*")
    out = df.groupBy(*keys).agg(
        F.avg(F.when(answered, clean(F.col(primary)))).alias("value"), F.sum(F.when(answered, clean(F.col(primary)))).alias("__sum"), F.max(planned).alias("n_planned"),
        n.alias("n_scored"), F.count_if(answered).alias("n_answered"), (F.count_if(F.col(status) == "truncated") / n).alias("truncation_rate"), (F.count_if(F.col(status) == "empty") / n).alias("empty_rate"),
    )
    return out.withColumn("strict", F.coalesce(F.col("__sum"), F.lit(0.0)) / F.col("n_planned")).withColumn("answer_coverage", F.col("n_answered") / F.col("n_planned")).drop("__sum")


def no_answer(df: DataFrame, keys: list[str], reason: str = "no_answer", status: str = "status") -> DataFrame:
    replies = F.count_if(F.col(status) != "error")
    empty, cut = F.count_if(F.col(reason) == "empty_reply"), F.count_if(F.col(reason) == "cut_off_before_answering")
    return df.groupBy(*keys).agg(replies.alias("replies"), empty.alias("empty"), cut.alias("cut_off"), ((empty + cut) / F.nullif(replies, F.lit(0))).alias("no_answer_rate"), F.count_if(F.col(status) == "error").alias("failed_calls"))


def balanced_accuracy(df: DataFrame, keys: list[str], label: str, correct: str) -> DataFrame:
    """Unweighted mean of the accuracies of the classes that occur."""
    return df.groupBy(*keys, label).agg(F.avg(correct).alias("a")).groupBy(*keys).agg(F.avg("a").alias("balanced_accuracy"), F.count("*").alias("n_classes"))


def stratum_gap(df: DataFrame, keys: list[str], stratum: str, a: str, b: str, value: str, name: str = "gap") -> DataFrame:
    """Mean of stratum a less mean of stratum b."""
    one, two = (F.avg(F.when(F.col(stratum) == s, clean(F.col(value)))) for s in (a, b))
    return df.groupBy(*keys).agg(one.alias(f"mean_{a}"), two.alias(f"mean_{b}"), (one - two).alias(name))
