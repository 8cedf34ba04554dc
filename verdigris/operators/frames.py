"""Frames of a run's report, and tables that compare models over episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import shapes, stats
from verdigris.operators import expand

# Statuses that are scored.
SCORED = ("ok", "empty", "truncated")


def for_modes(df: DataFrame, repeats: int = 1, per_option: bool = False, votes: int = 1) -> DataFrame:
    """Items as the requests that modes need: repeats, then one for each option, then votes; they multiply."""
    out = expand.repeats(df, repeats) if repeats > 1 else df
    out = expand.options(out) if per_option else out
    if votes > 1:
        grouped = F.col("group_id") if per_option else F.lit(None).cast("string")
        out = out.withColumn("__outer", grouped)
        out = expand.votes(out, votes).withColumn("group_id", F.coalesce("__outer", "group_id")).drop("__outer")
    return out


def sorted_summary(df: DataFrame) -> DataFrame:
    return df.orderBy("dataset_id", "model_id", "template_mode")


def tasks_frame(records: DataFrame, keys: list[str], primary: str) -> DataFrame:
    """A row for each task: what was planned, scored, failed and skipped, and the primary metric's mean as printed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    value = F.avg(F.when(F.col("status").isin(*SCORED), F.col(primary)))
    return records.groupBy(*keys).agg(F.count("*").alias("n_planned"), n(*SCORED).alias("n_scored"), n("error").alias("n_error"), n("skipped").alias("n_skipped"), shapes.round_report(value).alias("primary_value"))


def dimension(tasks: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row a key with the columns of its first task that has them."""
    return tasks.where(F.coalesce(*columns).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("__d")).select(key, "__d.*")


def sample_sheet(records: DataFrame, keys: list[str], metrics: list[str], lists: list[str]) -> DataFrame:
    """Wide rows: metric.<name> columns from the sparse map, lists as JSON text."""
    wide = [F.try_element_at("metrics", F.lit(m)).alias(f"metric.{m}") for m in metrics]
    return records.select(*keys, *wide, *[F.to_json(c).alias(c) for c in lists])


def heat_map(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Mean of the value by row and column, and the mean of the row's present cells."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.avg(value))
    cells = F.array_compact(F.array(*[F.col(f"`{c}`") for c in columns]))
    return wide.withColumn("mean", F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(cells), F.lit(0)))


def outcome_gap(df: DataFrame, group: str, value: str, correct: str) -> DataFrame:
    """The value's mean where right and where wrong, and their difference."""
    rows = df.where(F.col(value).isNotNull())
    out = rows.groupBy(group).agg(F.avg(F.when(F.col(correct), F.col(value))).alias("right"), F.avg(F.when(~F.col(correct), F.col(value))).alias("wrong"))
    return out.withColumn("gap", F.col("right") - F.col("wrong"))


def efficiency(df: DataFrame, group: str, **measures: str) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(c).alias(name) for name, c in measures.items()])


def first_element(df: DataFrame, steps: str, correct: str, group: list[str]) -> DataFrame:
    """Accuracy by whether an episode's first step was relevant, with Wilson bounds; episodes without a step are left out."""
    rows = df.withColumn("first", F.try_element_at(steps, F.lit(1)).cast("int")).where(F.col("first").isNotNull() & F.col(correct).isNotNull())
    out = rows.groupBy(*group, "first").agg(F.sum(F.col(correct).cast("double")).alias("__k"), F.count("*").alias("n"))
    bounds = stats.wilson(F.col("__k"), F.col("n"))
    return out.select(*group, "first", (F.col("__k") / F.col("n")).alias("accuracy"), bounds["low"].alias("low"), bounds["high"].alias("high"), "n")


def rescored(summary: DataFrame, records: DataFrame, keys: list[str], primary: str) -> DataFrame:
    """The summary with its value worked out again from scored records; null where there are none."""
    means = records.where(F.col("status").isin(*SCORED)).groupBy(*keys).agg(F.avg(primary).alias("value"))
    return summary.drop("value").join(means, keys, "left")


def agreement(calls: DataFrame, key: list[str], judge: str, verdict: str, judges: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """Requests that all judges answered, and the share on which each two agree.

    One aggregate by request sets the judges side by side, so nothing is joined.
    """
    side = calls.groupBy(*key).agg(*[F.max(F.when(F.col(judge) == j, F.col(verdict))).alias(j) for j in judges])
    full = side.where(" AND ".join(f"{j} IS NOT NULL" for j in judges))
    pairs = [(a, b) for i, a in enumerate(judges) for b in judges[i + 1 :]]
    return full.groupBy(*key[:-1]).agg(F.count("*").alias("n"), *[F.avg((F.col(a) == F.col(b)).cast("double")).alias(f"{a}{b}") for a, b in pairs])


def cache_coverage(requests: DataFrame, cache: DataFrame, content: str, group: list[str]) -> DataFrame:
    """How many requests a cache by content hash would answer."""
    known = cache.select(F.sha2(F.col(content), 256).alias("__h")).distinct().withColumn("__hit", F.lit(True))
    rows = requests.withColumn("__h", F.sha2(F.col(content), 256)).join(known, "__h", "left")
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if("__hit").alias("hits"), F.avg(F.coalesce("__hit", F.lit(False)).cast("double")).alias("coverage"))


def cached(requests: DataFrame, cache: DataFrame, content: str, result: str) -> DataFrame:
    """Requests with the stored result of the same content, null if there is none; of several stored, the last by `seq`."""
    known = cache.groupBy(F.sha2(F.col(content), 256).alias("__h")).agg(F.max_by(result, "seq").alias(result))
    return requests.withColumn("__h", F.sha2(F.col(content), 256)).join(known, "__h", "left").drop("__h")


def latest_round(records: DataFrame, log: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Records with the values of the log's latest round; their own where the log has none."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__l"))
    rows = records.join(last, key, "left")
    return rows.withColumns({c: F.coalesce(F.col(f"__l.{c}"), F.col(c)) for c in columns}).drop("__l")


def sample_facts(records: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Records with the value of their task's primary metric, from the sparse map; reduced ones are left out."""
    named = summary.groupBy(*keys).agg(F.max("primary_metric").alias("primary_metric"))
    return records.where(~F.coalesce("reduced", F.lit(False))).join(named, keys, "left").withColumn("correct", F.try_element_at("metrics", F.col("primary_metric")))


def summary_flags(summary: DataFrame, least: float = 0.9) -> DataFrame:
    """`partial`, below the coverage that counts as whole; `task`, the dataset with its kind where it has two."""
    kinds = summary.groupBy("dataset_id").agg((F.count_distinct("task_kind") > 1).alias("__both"))
    label = F.when(F.col("task_kind") == "selection", "sel").otherwise("gen")
    rows = summary.join(kinds, "dataset_id").withColumn("partial", F.col("coverage") < least)
    return rows.withColumn("task", F.when(F.col("__both"), F.concat("dataset_id", F.lit(" ("), label, F.lit(")"))).otherwise(F.col("dataset_id"))).drop("__both")


def projected(metrics: Column, allowed: list[str]) -> tuple[Column, Column]:
    """An episode's metrics that are columns, and the rest, which goes to the details."""
    inside = lambda k: k.isin(*allowed)
    return F.map_filter(metrics, lambda k, v: inside(k)), F.map_filter(metrics, lambda k, v: ~inside(k))


def with_interaction_steps(metrics: Column, delivery: Column, turns: Column) -> Column:
    """The map with interaction_steps, for interactive episodes that had a turn."""
    return F.when((delivery == "interactive") & (turns > 0), F.map_concat(F.map_filter(metrics, lambda k, v: k != "interaction_steps"), F.create_map(F.lit("interaction_steps"), turns.cast("double")))).otherwise(metrics)

