"""Report tables: summary, pivot, long metrics, overall columns, run counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.shapes import round_report
from verdigris.sources import sinks


def summary_pivot(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A row for each `row`, a column for each of the fixed `columns`; the first value by column order."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))


def column_label(model: str, mode: str) -> DataFrame:
    """The model's name, with its mode only if the model has several."""
    return F.when(F.size(F.collect_set(mode).over(Window.partitionBy(model))) > 1, F.concat(F.col(model), F.lit(" ("), F.col(mode), F.lit(")"))).otherwise(F.col(model))


def question_level_overall(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds the mean over models of the same questions, on every row."""
    return df.withColumn("overall", F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))).over(Window.partitionBy(*keys)))


def bold_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Marks every row that ties for the highest value."""
    return df.withColumn("is_max", F.coalesce(F.col(value) == F.max(value).over(Window.partitionBy(*keys)), F.lit(False)))


def run_counts(df: DataFrame, keys: list[str], sample_id: str, status: str) -> DataFrame:
    """Records, distinct questions without the repeat suffix, and failures."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_records"), F.count_distinct(F.regexp_replace(sample_id, "#r\\d+$", "")).alias("n_questions"), F.count_if(F.col(status) == "error").alias("n_errors"))


def mode_gain(df: DataFrame, keys: list[str], mode: str, value: str, a: str = "cot", b: str = "io") -> DataFrame:
    """Mean under mode a less mean under mode b, where both exist."""
    one, two = (F.avg(F.when(F.col(mode) == m, F.col(value))) for m in (a, b))
    return df.groupBy(*keys).agg((one - two).alias("gain")).where("gain IS NOT NULL")


def _latex(df: DataFrame, kept: list[Column], values: list[str], errors: list[Column]) -> DataFrame:
    """kept, `cells` (of a row, the highest in bold, each with its error) and `mean` of those that are shown, in digits."""
    digits = lambda v: F.format_string("%.1f", round_report(v, 1))
    rows = df.select(*kept, F.array(*[F.when(F.col(v).isNotNull(), digits(F.col(v))) for v in values]).alias("__s"), F.array(*[F.concat(F.lit("$_{\\pm"), digits(e), F.lit("}$")) if e is not None else F.lit("") for e in errors]).alias("__e"))
    rows = rows.withColumn("__n", F.array_compact(F.transform("__s", lambda s: s.cast("double"))))
    mark = lambda s: F.when(s.cast("double") == F.array_max("__n"), F.concat(F.lit("\\textbf{"), s, F.lit("}"))).otherwise(s)
    cells = F.zip_with("__s", "__e", lambda s, e: F.coalesce(F.concat(mark(s), F.coalesce(e, F.lit(""))), F.lit("--")))
    mean = F.aggregate("__n", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("__n"), F.lit(0))
    return rows.withColumns({"cells": F.array_join(cells, " & "), "mean": F.when(F.size("__n") > 0, digits(mean)).otherwise("--")}).drop("__s", "__e", "__n")


def latex_rows(df: DataFrame, labels: list[str], cells: list[str], errors: Mapping[str, str] | None = None) -> DataFrame:
    """labels and `line`: a row of a LaTeX table, its highest cells in bold, then the mean of those it has."""
    rows = _latex(df, [F.col(c) for c in labels], cells, [F.col(errors[c]) if errors and c in errors else None for c in cells])
    return rows.select(*labels, F.concat(F.concat_ws(" & ", *labels, "cells", "mean"), F.lit(" \\\\")).alias("line"))


def latex_averages(df: DataFrame, n_labels: int, cells: list[str], counted: Column | None = None) -> DataFrame:
    """`line`: the table's last row, the mean of each column over the rows that count."""
    means = (df if counted is None else df.where(counted)).agg(*[F.avg(c).alias(c) for c in cells])
    return _latex(means, [], cells, [None] * len(cells)).select(F.concat(F.lit("\\textbf{Average}" + " &" * n_labels + " "), F.col("cells"), F.lit(" & \\\\")).alias("line"))


def task_documents(metrics: DataFrame, facts: DataFrame, keys: list[str], columns: list[str], primary: str = "primary_metric") -> DataFrame:
    """keys and `document`: Markdown on each task, its facts and its metrics in order of name, the primary one marked."""
    mark = F.when(F.col("metric") == F.col(primary), " **(primary)**").otherwise("")
    line = F.concat(F.lit("| `"), "metric", F.lit("`"), mark, F.lit(" | "), F.round("value", 4).cast("string"), F.lit(" |"))
    listed = metrics.join(facts.select(*keys, primary), keys).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))), lambda x: x["line"]), "\n").alias("__m"))
    told = [F.concat(F.lit(f"* **{c}**: "), F.coalesce(F.col(c).cast("string"), F.lit("--"))) for c in columns]
    table = F.coalesce(F.concat(F.lit("| metric | value |\n|---|---|\n"), F.col("__m")), F.lit("_No metrics were produced._"))
    document = F.concat_ws("\n\n", F.concat(F.lit("# "), F.concat_ws(" x ", *keys)), F.concat_ws("\n", *told), F.concat(F.lit("## Metrics\n\n"), table))
    return facts.join(listed, keys, "left").select(*keys, document.alias("document"))


def run_report(title: str, facts: Mapping[str, object], sections: Mapping[str, DataFrame]) -> str:
    """A run's Markdown report: what it was, and a table a section; sections without rows say so."""
    told = [f"# {title}", "", *[f"* **{k}**: {v}" for k, v in facts.items()], ""]
    for name, df in sections.items():
        told += [f"## {name}", "", sinks.markdown(df) if df.head(1) else "_None._\n"]
    return "\n".join(told)


def choice_gap(df: DataFrame, cell: list[str], model: str, selection: str, value: str) -> DataFrame:
    """model, scs, mcs, gap, cells: means of single and multiple choice over the cells that ran both."""
    one = lambda m: F.avg(F.when(F.col(selection) == m, F.col(value)))
    both = df.groupBy(*cell, model).agg(one("SCS").alias("scs"), one("MCS").alias("mcs")).where("scs IS NOT NULL AND mcs IS NOT NULL")
    return both.groupBy(model).agg(F.avg("scs").alias("scs"), F.avg("mcs").alias("mcs"), F.avg(F.col("scs") - F.col("mcs")).alias("gap"), F.count("*").alias("cells"))
