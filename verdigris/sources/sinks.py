"""Sinks.  Spark's commit protocol stands in for atomic renames and fsync."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partitions: tuple[str, ...] = ("dataset_id", "model_id")) -> None:
    """Append rows, partitioned so that a task's records prune to its folder."""
    df.write.mode("append").partitionBy(*[p for p in partitions if p in df.columns]).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def update(records: DataFrame, path_new: str) -> int:
    """Write merged records (see operators.records.merge_update) as a new version; the number of changed rows."""
    records.write.mode("overwrite").parquet(path_new)
    return records.sparkSession.read.parquet(path_new).where("changed").count()


def event_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def raw_sample(df: DataFrame, path: str, most: int) -> None:
    """Raw payloads, as many as the cap allows."""
    df.limit(most).write.mode("overwrite").json(path)


def report_csv(df: DataFrame, path: str) -> None:
    """A small aggregated report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 500) -> str:
    """A small aggregated report as a Markdown table."""
    rows = df.limit(most).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join("| " + " | ".join("" if v is None else str(round(v, 4) if isinstance(v, float) else v) for v in r) + " |\n" for r in rows)


def redact(df: DataFrame, config: str) -> DataFrame:
    """A map column with the values of keys that look like secrets hidden."""
    secret = "(?i)(key|token|secret|password|credential)"
    return df.withColumn(config, F.transform_values(config, lambda k, v: F.when(F.rlike(k, F.lit(secret)), F.lit("***")).otherwise(v)))
