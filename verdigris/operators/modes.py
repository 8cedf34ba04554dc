"""Execution modes: which combinations a dataset offers, which a model admits, and why others are declined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PROMPT_MODES = ("io", "cot", "self-consistency")
SELECTION_MODES = ("SCS", "MCS", "BOV")


def mode_grid(datasets: DataFrame) -> DataFrame:
    """Every dataset (dataset_id, cardinality, delivery, objective) with every mode, and skip_reason where it is declined.

    cardinality is single, multi or none; without options there is no selection
    mode, and interactive delivery is asked in one prompt mode, n/a.
    """
    prompts, kinds = (F.array(*[F.lit(m) for m in modes]) for modes in (PROMPT_MODES, SELECTION_MODES))
    live = F.col("delivery") != "static"
    rows = datasets.withColumn("prompt_mode", F.explode(F.when(live, F.array(F.lit("n/a"))).otherwise(prompts)))
    rows = rows.withColumn("selection_mode", F.explode(F.when(live | (F.col("cardinality") == "none"), F.array(F.lit("n/a"))).otherwise(kinds)))
    return rows.withColumn("skip_reason", skip_reason())


def skip_reason() -> Column:
    vote, multi, single = F.col("prompt_mode") == "self-consistency", F.col("cardinality") == "multi", F.col("cardinality") == "single"
    return (
        F.when(vote & ~F.col("objective"), "answers that need a judge cannot be voted on").when((F.col("selection_mode") == "SCS") & multi, "several answers are right, one label cannot name them")
        .when((F.col("selection_mode") == "MCS") & single, "one answer is right, a set is not asked for").when((F.col("selection_mode") == "BOV") & vote, "an option's own question is not voted on")
    )


def admits(allowed: Column, value: Column) -> Column:
    """An empty list admits all."""
    return F.coalesce(F.size(allowed), F.lit(0)).isin(0, -1) | F.array_contains(allowed, value)


def plan_tasks(grid: DataFrame, models: DataFrame) -> DataFrame:
    """Accepted modes with every model (model_id, prompt_modes, selection_modes, kinds) that admits them; a mixed task passes if any kind does."""
    rows = grid.where("skip_reason IS NULL").crossJoin(F.broadcast(models))
    kinds = F.coalesce(F.size("kinds"), F.lit(0)).isin(0, -1) | F.arrays_overlap("kinds", "task_kinds")
    good = (admits(F.col("prompt_modes"), F.col("prompt_mode")) | (F.col("prompt_mode") == "n/a")) & (admits(F.col("selection_modes"), F.col("selection_mode")) | (F.col("selection_mode") == "n/a")) & kinds
    kind = F.when(F.size("task_kinds") > 1, "mixed").otherwise(F.try_element_at("task_kinds", F.lit(1)))
    return rows.where(good).select("dataset_id", "model_id", "prompt_mode", "selection_mode", kind.alias("kind"), F.concat_ws("|", "prompt_mode", "selection_mode", kind, "delivery").alias("template_mode"))


def mode_slug(template_mode: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(template_mode, F.lit("|"), F.lit("-"))), "[^a-z0-9._-]+", "_")


def token_budget(df: DataFrame, tokens: str, rank: str, budget: int, size: int, abort: float = 0.5, policy: str = "resample") -> DataFrame:
    """The first `size` rows of a pool that fit the budget, in pool order, under a policy for rows that are too long.

    `resample` replaces them by the next ones that fit, `skip` leaves them out,
    and `fail` accepts none.  All fail if more than `abort` of the first `size`
    rows are too long.
    """
    first = df.where(F.col(rank) <= size)
    over = first.agg(F.avg((F.col(tokens) > budget).cast("double"))).first()[0] or 0.0
    if over > (0.0 if policy == "fail" else abort):
        raise ValueError(f"{over:.0%} of the samples exceed the budget of {budget} tokens")
    if policy == "resample":
        return df.where(F.col(tokens) <= budget).orderBy(rank).limit(size)
    return first.where(F.col(tokens) <= budget)
