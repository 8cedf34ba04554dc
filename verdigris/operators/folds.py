"""Many requests of one item to one score: votes, options, best of n, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.plans.session import tasks_for


def vote(df: DataFrame, group: str = "group_id", position: str = "pos", prediction: str = "prediction", parsed: str = "parse_ok", score: str = "score") -> DataFrame:
    """Plurality over parsed predictions; ties keep the first seen; without any the first member stays.

    group, prediction, score (of the first member with that answer), agreement
    (votes / members, null if nothing parsed), n_members.  One shuffle by group.
    """
    named = F.when(F.col(parsed), F.coalesce(F.col(prediction).cast("string"), F.lit("None")))
    kinds = df.withColumn("__p", named).groupBy(group, "__p").agg(F.count("*").alias("__n"), F.min(F.struct(F.col(position).alias("pos"), F.col(prediction).alias("prediction"), F.col(score).alias("score"))).alias("__first"))
    order = F.struct(F.col("__p").isNotNull().alias("parsed"), F.when(F.col("__p").isNotNull(), F.col("__n")).alias("n"), (-F.col("__first.pos")).alias("pos"))
    out = kinds.groupBy(group).agg(F.max_by(F.struct("__p", "__n", "__first"), order).alias("__w"), F.sum("__n").alias("n_members"))
    return out.select(group, F.col("__w.__first.prediction").alias("prediction"), F.col("__w.__first.score").alias("score"), F.when(F.col("__w.__p").isNotNull(), F.col("__w.__n") / F.col("n_members")).alias("agreement"), "n_members")


def selected_options(df: DataFrame, group: str = "group_id", index: str = "bov_index", label: str = "bov_label", yes: str = "yes") -> DataFrame:
    """Labels whose own question got a direct yes, in option order, and the share of yes."""
    chosen = F.array_sort(F.collect_list(F.when(F.col(yes), F.struct(F.col(index).alias("i"), F.col(label).alias("label")))))
    return df.groupBy(group).agg(F.transform(chosen, lambda x: x["label"]).alias("selected"), F.avg(F.col(yes).cast("double")).alias("bov_yes_rate"), F.count("*").alias("bov_questions"))


def best_of_n(df: DataFrame, item: str, primary: str, position: str, higher: bool = True) -> DataFrame:
    """Each item's repeat with the best primary metric, the first of equals; all its columns travel with it, items without the metric drop out."""
    value = F.col(primary).cast("double")
    rows = df.where(value.isNotNull() & ~F.isnan(value))
    first = F.min_by(F.struct(*[f"`{c}`" for c in df.columns]), F.struct(-value if higher else value, F.col(position)))
    return rows.groupBy(F.col(item).alias("__item")).agg(first.alias("__best")).select("__best.*")


def repeat_statistics(df: DataFrame, keys: list[str], item: str, prediction: str, score: str) -> DataFrame:
    """Over items with more than one repeat: share with equal predictions, and mean population deviation of the score."""
    per = df.groupBy(*keys, item).agg((F.count_distinct(F.coalesce(F.col(prediction).cast("string"), F.lit("None"))) == 1).cast("double").alias("same"), F.stddev_pop(score).alias("spread"), F.count("*").alias("n"))
    return per.where("n > 1").groupBy(*keys).agg(F.avg("same").alias("repeat_agreement"), F.avg("spread").alias("repeat_std"), F.count("*").alias("n_items"))


def repeat_error(df: DataFrame, keys: list[str], repeat: str, score: str) -> DataFrame:
    """Sample deviation of the repeats' means, times 100; needs two repeats."""
    per = df.groupBy(*keys, repeat).agg(F.avg(score).alias("m"))
    return per.groupBy(*keys).agg((100 * F.stddev_samp("m")).alias("repeat_error"), F.count("*").alias("n_repeats")).where("n_repeats >= 2")


def drop_members(df: DataFrame, group: str = "group_id", reduced: str = "reduced") -> DataFrame:
    """Reduced rows, and rows whose group has none.

    A group's rows are sorted once, where they meet, in tasks that hold about a
    million rows; rows without a group stay spread as they were read.
    """
    rows = df.withColumn("__alone", F.when(F.col(group).isNull(), F.spark_partition_id()))
    rows = rows.repartition(tasks_for(df.sparkSession, df.count()), group, "__alone")
    done = rows.withColumn("__done", F.max(reduced).over(Window.partitionBy(group, "__alone")) & F.col(group).isNotNull())
    return done.where(F.col(reduced) | (~F.col(reduced) & ~F.col("__done"))).select(*df.columns)


def reduce_groups(df: DataFrame, prompt_mode: str, selection_mode: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One scored row for each item that was asked as several requests; other rows as they are.

    df: sample_id, group_id, pos, prediction, parse_ok, score, and for options
    yes, bov_index, bov_label, gold_labels; `carry` names columns that are equal
    within a group.  Options are folded before votes, as their set is scored by
    the scorer of sets: score is its exact match, and set_f1 and bov_yes_rate
    stand beside it.  Out: sample_id, prediction, score, carry, reduced,
    n_members, set_f1, bov_yes_rate.  An empty group_id is none.
    """
    grouped = F.coalesce(F.col("group_id") != "", F.lit(False))
    plain = df.where(~grouped) if selection_mode == "BOV" or prompt_mode == "self-consistency" else df
    none = F.lit(None).cast("double")
    alone = plain.select("sample_id", F.col("prediction").cast("string").alias("prediction"), F.col("score").cast("double").alias("score"), *carry, F.lit(False).alias("reduced"), F.lit(1).cast("bigint").alias("n_members"), none.alias("set_f1"), none.alias("bov_yes_rate"))
    members = df.where(grouped)
    if selection_mode == "BOV":
        shared = members.groupBy("group_id").agg(*[F.first(c).alias(c) for c in ("gold_labels", *carry)])
        rows = selected_options(members).join(shared, "group_id")
        prf = text.set_prf(F.col("selected"), F.col("gold_labels"))
        same = F.array_sort(F.array_distinct("selected")) == F.array_sort(F.array_distinct("gold_labels"))
        said = F.when(F.size("selected") > 0, F.array_join("selected", ", ")).otherwise("none")
        folded = rows.select(F.col("group_id").alias("sample_id"), said.alias("prediction"), same.cast("double").alias("score"), *carry, F.lit(True).alias("reduced"), F.col("bov_questions").alias("n_members"), prf["f1"].alias("set_f1"), "bov_yes_rate")
    elif prompt_mode == "self-consistency":
        rows = vote(members)
        if carry:
            rows = rows.join(members.groupBy("group_id").agg(*[F.first(c).alias(c) for c in carry]), "group_id")
        folded = rows.select(F.col("group_id").alias("sample_id"), F.col("prediction").cast("string").alias("prediction"), F.col("score").cast("double").alias("score"), *carry, F.lit(True).alias("reduced"), "n_members", none.alias("set_f1"), none.alias("bov_yes_rate"))
    else:
        return alone
    return alone.unionByName(folded)
