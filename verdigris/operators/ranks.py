"""Ranks, quantiles and rank correlations of groups of any size.

No task has to see a whole group.  Distinct values are counted first; the
counts are dealt out by ranges of (group, value); what stands before a value is
what stands before its range, which is a sum of one row a range, and what stands
before it inside the range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.plans.session import durable, tasks_for


def same(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join by columns of one name, nulls being equal; b's own are dropped."""
    other = b.withColumnsRenamed({c: f"__b_{c}" for c in names})
    on = reduce(lambda x, y: x & y, [a[c].eqNullSafe(other[f"__b_{c}"]) for c in names])
    return a.join(other, on, how).drop(*[f"__b_{c}" for c in names])


def standing_before(df: DataFrame, keys: list[str], by: list[str], weight: str) -> DataFrame:
    """Adds `before`: the weight of the rows of the same keys that come earlier in order of `by`."""
    # ranges are drawn from a sample, so what was dealt is kept
    dealt = durable(df.repartitionByRange(*keys, *by).withColumn("__range", F.spark_partition_id()))
    past = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*keys, "__range").agg(F.sum(weight).alias("__sum")).withColumn("__past", F.coalesce(F.sum("__sum").over(past), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*keys, "__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("before", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return same(rows, ranges, [*keys, "__range"]).withColumn("before", F.col("before") + F.col("__past")).drop("__past", "__range")


def value_ranks(df: DataFrame, keys: list[str], value: str, **more: Column) -> DataFrame:
    """keys, value, n, before, rank and the aggregates `more`: a row for each distinct value, whose rows share their mean rank."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in more.items()])
    return standing_before(counts, keys, [value], "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)


def with_average_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Adds the rank of each row within its keys, ties sharing their mean rank."""
    ranks = value_ranks(df, keys, value).select(*keys, value, F.col("rank").alias("__rank"))
    return same(df, ranks, [*keys, value]).withColumnRenamed("__rank", out)


def length_quintile(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Fifth of the group by rank, ties by order: edges of equal shares of the ranks, as quantile cuts give."""
    ranked = standing_before(df.withColumn("__one", F.lit(1)), keys, [value, tie], "__one").drop("__one")
    rows = same(ranked, df.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    # the smallest k with rank <= 1 + k (n - 1) / 5
    return rows.withColumn("quintile", F.greatest(F.lit(1), F.ceil(5.0 * F.col("before") / F.nullif(F.col("__n") - 1, F.lit(0)))).cast("int")).drop("before", "__n")


def group_quantile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys, n, cut: the interpolated quantile of the values that are not null."""
    known = df.where(F.col(value).isNotNull())
    counts = standing_before(known.groupBy(*keys, value).agg(F.count("*").alias("n")), keys, [value], "n")
    totals = known.groupBy(*keys).agg(F.count("*").alias("__all"))
    rows = same(counts, totals, keys).withColumn("__at", F.lit(share) * (F.col("__all") - 1))
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    low, high = F.floor("__at"), F.ceil("__at")
    ends = rows.where(holds(low) | holds(high)).groupBy(*keys).agg(F.max("__all").alias("n"), F.max("__at").alias("__at"), F.max(F.when(holds(low), F.col(value))).alias("__low"), F.max(F.when(holds(high), F.col(value))).alias("__high"))
    between = F.when(F.col("__low") == F.col("__high"), F.col("__low").cast("double")).otherwise((high - F.col("__at")) * F.col("__low") + (F.col("__at") - low) * F.col("__high"))
    return ends.select(*keys, "n", between.alias("cut"))


def overthinking(df: DataFrame, keys: list[str], steps: str, wrong: str, share: float = 0.95, least: int = 20) -> DataFrame:
    """Wrong rows in the longest part of their group, for groups of some size."""
    cuts = group_quantile(df, keys, steps, share).where(F.col("n") >= least).drop("n")
    return same(df.where(F.col(wrong)), cuts, keys).where(F.col(steps) >= F.col("cut"))


def auc(df: DataFrame, keys: list[str], value: str, correct: str, least: int = 20) -> DataFrame:
    """Chance that a correct row has the higher value, ties half, from average ranks; null below `least` of either kind."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranks = value_ranks(known, keys, value, right=F.count_if(F.col(correct)), wrong=F.count_if(~F.col(correct)))
    pos, neg = F.sum("right"), F.sum("wrong")
    score = (F.sum(F.col("rank") * F.col("right")) - pos * (pos + 1) / 2) / (pos * neg)
    return ranks.groupBy(*keys).agg(F.when((pos >= least) & (neg >= least), score).alias("auc"), pos.alias("n_correct"), neg.alias("n_wrong"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks; 0 for fewer than two rows or a constant side."""
    points = df.groupBy(*keys, a, b).agg(F.count("*").alias("__many"))
    total = df.groupBy(*keys).agg(F.count("*").alias("__all"))
    for c, name in ((a, "__x"), (b, "__y")):
        points = same(points, value_ranks(df, keys, c).select(*keys, c, F.col("rank").alias(name)), [*keys, c])
    points = same(points, total, keys)
    # mean ranks are known, so what is summed is small
    dx, dy, n = (F.col("__x") - (F.col("__all") + 1) / 2.0), (F.col("__y") - (F.col("__all") + 1) / 2.0), F.col("__many")
    size = F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy))
    return points.groupBy(*keys).agg(F.coalesce(F.sum(n * dx * dy) / F.nullif(size, F.lit(0.0)), F.lit(0.0)).alias("spearman"), F.sum("__many").alias("n"))


def inversions(b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each place the weight of earlier places with a larger b, by merging sorted halves."""
    out = np.zeros(len(b), np.int64)
    # blocks of a few places are compared directly, many blocks at once
    small = 32
    earlier = np.triu(np.ones((small, small), bool), 1)
    for at in range(0, len(b), small << 12):
        x, y = b[at : at + (small << 12)], w[at : at + (small << 12)]
        more = -len(x) % small
        x, y = np.append(x, np.full(more, x.max())).reshape(-1, small), np.append(y, np.zeros(more, y.dtype)).reshape(-1, small)
        out[at : at + (small << 12)] = ((x[:, :, None] > x[:, None, :]) * earlier * y[:, :, None]).sum(1).ravel()[: out[at : at + (small << 12)].size]
    order = np.concatenate([at + np.argsort(b[at : at + small], kind="stable") for at in range(0, len(b), small)]) if len(b) else np.zeros(0, np.int64)
    while small < len(b):
        for at in range(0, len(b), 2 * small):
            left, right = order[at : at + small], order[at + small : at + 2 * small]
            if len(right):
                run = np.concatenate([[0], np.cumsum(w[left])])
                out[right] += run[-1] - run[np.searchsorted(b[left], b[right], "right")]
                both = order[at : at + 2 * small]
                order[at : at + 2 * small] = both[np.argsort(b[both], kind="stable")]
        small *= 2
    return out


#: Rows of a range that one Python worker holds, about.
HELD = 500_000


def _inverted(rows: DataFrame, keys: list[str], b: str) -> DataFrame:
    """keys, d: pairs of rows of a partition, in the order in which they stand there, whose b falls."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [p for p in parts if len(p)]
        if found:
            pdf = pd.concat(found, ignore_index=True)
            group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            # numbers that grow from group to group, so that none is inverted with another's
            rank = np.unique(pdf[b].to_numpy(), return_inverse=True)[1] + group * (len(pdf) + 1)
            w = pdf["n"].to_numpy()
            pdf["d"] = inversions(rank, w) * w
            yield pdf.groupby(keys, sort=False, dropna=False, as_index=False)["d"].sum()[[*keys, "d"]]

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, b, "n").mapInPandas(run, f"{schema}, d bigint")


def kendall_tau_b(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau-b within keys; 0 when degenerate.  Rows without a or b take no part; a group that has no others is 0.

    Pairs that fall are counted as inversions of b in order of (a, b): inside
    ranges of that order; between ranges that hold different ranges of b, from
    their numbers of rows; and between ranges inside one range of b.  So a
    group is spread over as many tasks as its size asks for, and no range grows
    with the table.
    """
    tasks = tasks_for(df.sparkSession, df.select(a).count(), HELD)
    x, y = F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")
    counts = df.select(*keys, x, y).where("a IS NOT NULL AND b IS NOT NULL").groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    one = durable(counts.repartitionByRange(tasks, *keys, "a", "b").sortWithinPartitions(*keys, "a", "b").withColumn("__p", F.spark_partition_id()))
    # a group inside one range is done; those that reach over a border are no more than twice the ranges
    wide = one.groupBy(*keys).agg(F.min("__p").alias("__from"), F.max("__p").alias("__to")).where("__from < __to")
    two = durable(same(one, wide.select(*keys), keys, "left_semi").repartitionByRange(tasks, *keys, "b").sortWithinPartitions(*keys, "__p", "b").withColumn("__q", F.spark_partition_id()))
    cells = two.groupBy(*keys, "__p", "__q").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(*keys, "__q").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # every range of a meets every range of b that the group has, also where the cell is empty
    grid = same(cells.select(*keys, "__p").distinct(), cells.groupBy(*keys).agg(F.collect_set("__q").alias("__q")), keys).withColumn("__q", F.explode("__q"))
    grid = same(grid, cells, [*keys, "__p", "__q"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("__past", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    higher = Window.partitionBy(*keys, "__p").orderBy(F.desc("__q")).rowsBetween(Window.unboundedPreceding, -1)
    crossed = grid.withColumn("d", F.col("n") * F.coalesce(F.sum("__past").over(higher), F.lit(0))).select(*keys, "d")
    fall = _inverted(one, keys, "b").unionByName(_inverted(two, keys, "b")).unionByName(crossed).groupBy(*keys).agg(F.sum("d").alias("d"))
    pairs = lambda n: F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)
    all_rows = one.groupBy(*keys).agg(F.sum("n").alias("n"), pairs("n").alias("both")).withColumn("all", F.col("n").cast("double") * (F.col("n") - 1) / 2)
    tied = {c: one.groupBy(*keys, c).agg(F.sum("n").alias("t")).groupBy(*keys).agg(pairs("t").alias(f"tied_{c}")) for c in ("a", "b")}
    rows = same(same(same(all_rows, fall, keys), tied["a"], keys), tied["b"], keys)
    na, nb = F.col("all") - F.col("tied_a"), F.col("all") - F.col("tied_b")
    s = F.col("all") - F.col("tied_a") - F.col("tied_b") + F.col("both") - 2 * F.col("d")
    tau = rows.select(*keys, (s / F.nullif(F.sqrt(na * nb), F.lit(0.0))).alias("tau_b"))
    return same(df.select(*keys).distinct(), tau, keys, "left").select(*keys, F.coalesce("tau_b", F.lit(0.0)).alias("tau_b"))
