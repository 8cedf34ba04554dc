"""Turns and bins: first correct turn, revision, effects, steps, costs.  Ranks of groups are in ranks.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.stats import wilson


def first_correct(df: DataFrame, keys: list[str], turn: str, correct: str, cap: int | None = None) -> DataFrame:
    """First turn that is correct; null, or the cap, when none is."""
    first = F.min(F.when(F.col(correct), F.col(turn)))
    return df.groupBy(*keys).agg((first if cap is None else F.coalesce(first, F.lit(cap))).alias("first_correct_turn"), F.count("*").alias("n_turns"), F.avg(F.col(correct).cast("double")).alias("turn_accuracy"))


def belief_revision(df: DataFrame, keys: list[str], turn: str, prediction: str, correct: str) -> DataFrame:
    """How the belief moved: kept or revised, and between which outcomes at the first and last turn."""
    w = Window.partitionBy(*keys).orderBy(turn)
    rows = df.withColumn("__moved", F.coalesce(~F.col(prediction).eqNullSafe(F.lag(prediction).over(w)) & (F.row_number().over(w) > 1), F.lit(False)))
    out = rows.groupBy(*keys).agg(F.bool_or("__moved").alias("revised"), F.min_by(correct, turn).alias("first_ok"), F.max_by(correct, turn).alias("last_ok"))
    kind = F.when(F.col("first_ok") & F.col("last_ok"), "stayed_right").when(F.col("last_ok"), "became_right").when(F.col("first_ok"), "became_wrong").otherwise("stayed_wrong")
    return out.withColumn("revision", kind)


def length_bin(n: Column) -> Column:
    """Right-closed bins of episode length."""
    edges = (0, 3, 5, 8, 12, 16, 20)
    out = F.lit(None).cast("string")
    for low, high in list(zip(edges, edges[1:], strict=False))[::-1]:
        out = F.when((n > low) & (n <= high), f"({low},{high}]").otherwise(out)
    return out


def effect_size(df: DataFrame, keys: list[str], value: str, correct: str, least: int = 10) -> DataFrame:
    """Standardised difference of means of correct and wrong rows within a cell, by the sample deviation of both together.

    Rows without a value don't count; null with fewer than `least` rows on
    either side, or without spread.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    gap = F.avg(F.when(F.col(correct), F.col(value))) - F.avg(F.when(~F.col(correct), F.col(value)))
    enough = (F.count_if(F.col(correct)) >= least) & (F.count_if(~F.col(correct)) >= least)
    return rows.groupBy(*keys).agg(F.when(enough, gap / F.nullif(F.stddev_samp(value), F.lit(0.0))).alias("effect"), F.count("*").alias("n"))


def effect_over_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean, half_width (95 %), cells: effects over the cells that have one."""
    n = F.count("effect")
    return cells.groupBy(*keys).agg(F.avg("effect").alias("mean"), (1.96 * F.stddev_pop("effect") / F.sqrt(F.nullif(n, F.lit(0)))).alias("half_width"), n.alias("cells"))


def step_table(df: DataFrame, keys: list[str], per_step: str, least: int = 1) -> DataFrame:
    """keys, step (from 1), share, low, high, n: the share of episodes with a 1 at each step that at least so many reach, with Wilson bounds."""
    rows = df.select(*keys, F.posexplode(per_step).alias("step", "hit")).where("hit IS NOT NULL")
    per = rows.groupBy(*keys, (F.col("step") + 1).alias("step")).agg(F.sum((F.col("hit") > 0).cast("double")).alias("__k"), F.count("*").alias("n")).where(F.col("n") >= least)
    bounds = wilson(F.col("__k"), F.col("n"))
    return per.select(*keys, "step", (F.col("__k") / F.col("n")).alias("share"), bounds["low"].alias("low"), bounds["high"].alias("high"), "n")


def direction_flips(df: DataFrame, metric: str, score: str = "auc", high: float = 0.58, low: float = 0.42) -> DataFrame:
    """Adds direction_flips: does the metric speak for a right answer in one model and against it in another; of two models at least."""
    w = Window.partitionBy(metric)
    return df.withColumn("direction_flips", F.coalesce((F.count(score).over(w) >= 2) & (F.max(score).over(w) > high) & (F.min(score).over(w) < low), F.lit(False)))


def over_limit(df: DataFrame, keys: list[str], turn: str, limit: int) -> DataFrame:
    """Numbers the actions of a kind and marks those past the limit."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(turn))
    return df.withColumn("used", rn).withColumn("over_limit", rn > limit)


def running_cost(df: DataFrame, keys: list[str], turn: str, cost: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("cost", cost).withColumn("spent", F.sum("cost").over(w))


def bootstrap_gap(df: DataFrame, keys: list[str], a: str, b: str, id_col: str, reps: int = 2000, seed: int = 0) -> DataFrame:
    """95 % percentile interval of mean(b) - mean(a) over paired rows: low, high.

    Each replicate weighs rows by Poisson(1) counts drawn from a hash of seed,
    replicate and id, so it is a sum that tasks pre-aggregate, and reruns agree.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("__rep"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    weight, total, mass = F.lit(0), 0.0, 0.36787944117144233
    for k in range(9):
        total += mass
        weight = weight + (u >= total).cast("int")
        mass /= k + 1
    rows = df.withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("__w", weight)
    per = rows.groupBy(*keys, "__rep").agg((F.sum(F.col("__w") * (F.col(b) - F.col(a))) / F.nullif(F.sum("__w"), F.lit(0))).alias("gap"))
    return per.groupBy(*keys).agg(F.percentile("gap", F.lit(0.025)).alias("low"), F.percentile("gap", F.lit(0.975)).alias("high"))


def accuracy_by_turn(df: DataFrame, keys: list[str], turn: str, correct: str) -> DataFrame:
    """keys, turn, accuracy, n over the episodes that got as far as the turn and were judged there."""
    return df.where(F.col(correct).isNotNull()).groupBy(*keys, turn).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count("*").alias("n"))
