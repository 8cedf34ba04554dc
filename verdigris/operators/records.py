"""Records: last write wins, resuming, superseding, merging and repairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.plans.session import tasks_for

REUSABLE = ("ok", "empty", "truncated", "skipped")
SCORED = ("ok", "empty", "truncated")


def dedupe_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the highest sequence of each key, and first_seq, where the key first stood.

    An aggregate, so a key that holds much of the log leaves one row a map task.
    """
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*[f"`{c}`" for c in rest]), F.struct(seq)).alias("__last"), F.min(seq).alias("first_seq"))
    return last.select(*keys, "__last.*", "first_seq").select(*[f"`{c}`" for c in df.columns], "first_seq")


def reusable(df: DataFrame, keys: list[str], seq: str, status: str = "status", finish: str = "finish_reason") -> DataFrame:
    good = F.col(status).isin(*REUSABLE) & (F.coalesce(F.col(finish), F.lit("")) != "error")
    return dedupe_last(df.where(good), keys, seq)


def with_reused(prompts: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts with `reused`: whether their key has a record.  One join, dealt out so that no task grows with the tables."""
    known = records.select(*keys)
    tasks = tasks_for(prompts.sparkSession, max(prompts.count(), known.count()))
    done = known.repartition(tasks, *keys).distinct().withColumn("reused", F.lit(True))
    return prompts.repartition(tasks, *keys).join(done, keys, "left").withColumn("reused", F.coalesce("reused", F.lit(False))).select(*prompts.columns, "reused")


def resume_split(prompts: DataFrame, records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(reused, pending): prompts whose key has a record, and those without."""
    rows = with_reused(prompts, records, keys)
    return rows.where("reused").drop("reused"), rows.where("NOT reused").drop("reused")


def supersede(prior: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """This pass, and prior tasks that it did not run."""
    return prior.join(now.select(*keys).distinct(), keys, "left_anti").select(*prior.columns).unionByName(now)


def merge_update(records: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records with the given columns replaced where an update has the key; adds `changed`."""
    new = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    rows = records.join(new, records[key] == new["__key"], "left")
    out = [F.coalesce(F.when(F.col("__hit"), F.col(f"__{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in records.columns]
    return rows.select(*out, F.coalesce("__hit", F.lit(False)).alias("changed"))


def attach_last_turn(turns: DataFrame, records: DataFrame, id_col: str, turn: str, columns: list[str]) -> DataFrame:
    """Every turn with is_last; the episode's record columns stand on its last turn alone."""
    rows = turns.withColumn("is_last", F.col(turn) == F.max(turn).over(Window.partitionBy(id_col)))
    return rows.join(records.select(id_col, *columns), id_col, "left").withColumns({c: F.when(F.col("is_last"), F.col(c)) for c in columns})


def merge_verdict(metrics: Column, metric: str, score: Column, parsed: Column, judged: Column) -> Column:
    """Metrics after a verdict: the metric and its strata take the score; an unparsed verdict removes them; unjudged ones stay."""
    mine = lambda k: (k == metric) | F.startswith(k, F.lit(f"{metric}_"))
    return F.when(~judged, metrics).when(parsed, F.transform_values(metrics, lambda k, v: F.when(mine(k), score).otherwise(v))).otherwise(F.map_filter(metrics, lambda k, v: ~mine(k)))


def replace_families(old: Column, new: Column, ran: Column) -> Column:
    """Old metrics but those of families that ran, and what these gave now."""
    kept = F.map_filter(old, lambda k, v: ~F.exists(ran, lambda f: F.startswith(k, f)))
    return F.map_concat(F.map_filter(kept, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def strip_prefix(metrics: Column, prefix: str = "reasoning_") -> Column:
    return F.map_filter(metrics, lambda k, v: ~F.startswith(k, F.lit(prefix)))


def changed(df: DataFrame, columns: list[str], before: str = "old_", after: str = "new_") -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{before}{c}").eqNullSafe(F.col(f"{after}{c}"))
    return out


def owed_jobs(needed: DataFrame, done: DataFrame, keys: list[str], group: str, order: list[str], chunk: int) -> DataFrame:
    """Jobs without a result, in chunks of a group."""
    rows = needed.join(done.select(*keys).distinct(), keys, "left_anti")
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / chunk))


def kill_switch(df: DataFrame, keys: list[str], order: str, failed: str, least: int, limit: float) -> DataFrame:
    """Running share of failures; tripped from the first row on at which it exceeds the limit."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("sent", F.count("*").over(w)).withColumn("failed_share", F.avg(F.col(failed).cast("double")).over(w))
    return rows.withColumn("tripped", F.max((F.col("sent") >= least) & (F.col("failed_share") > limit)).over(w))
