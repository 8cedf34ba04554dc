"""One row to many: repeats, options, votes, and the item that a request came from."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

LEAVES = ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType())]))


def repeats(df: DataFrame, k: int) -> DataFrame:
    """k independent observations of each sample: id suffix #r{i}, repeat_of, repeat_index; no group."""
    rows = df.withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.withColumn("repeat_of", F.col("sample_id")).withColumn("sample_id", F.concat("sample_id", F.lit("#r"), F.col("repeat_index").cast("string")))


def options(df: DataFrame, labels: str = "labels", texts: str = "options") -> DataFrame:
    """A request for each option: id suffix #bov{i}, group_id, bov_label, bov_option; rows without options pass unchanged."""
    pairs = F.transform(F.arrays_zip(labels, texts), lambda x, i: F.struct(i.alias("i"), x[labels].alias("label"), x[texts].alias("option")))
    rows = df.withColumn("__o", F.explode_outer(pairs))
    named = F.when(F.col("__o").isNull(), F.col("sample_id")).otherwise(F.concat("sample_id", F.lit("#bov"), F.col("__o.i").cast("string")))
    rows = rows.withColumn("group_id", F.when(F.col("__o").isNotNull(), F.col("sample_id"))).withColumn("sample_id", named)
    return rows.withColumns({"bov_index": F.col("__o.i"), "bov_label": F.col("__o.label"), "bov_option": F.col("__o.option")}).drop("__o")


def votes(df: DataFrame, k: int) -> DataFrame:
    """k requests whose answers are voted on: id suffix #sc{i}, group_id."""
    rows = df.withColumn("vote_index", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.withColumn("group_id", F.col("sample_id")).withColumn("sample_id", F.concat("sample_id", F.lit("#sc"), F.col("vote_index").cast("string")))


def root_item(repeat_of: Column, group_id: Column, sample_id: Column) -> Column:
    return F.coalesce(F.nullif(repeat_of, F.lit("")), F.nullif(group_id, F.lit("")), sample_id)


def levels(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """A row for each item and level whose text is not blank."""
    return df.unpivot([id_col], columns, "level", "text").where(F.trim("text") != "")


@F.pandas_udf(LEAVES)
def _leaves(objects: pd.Series) -> pd.Series:
    """Leaves of JSON objects, in order; numbers keep their digits."""

    def told(value: object) -> str:
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    def of(text: str) -> list[dict]:
        try:
            todo, found = [("", json.loads(text, parse_int=str, parse_float=str))], []
        except ValueError:
            return []
        while todo:
            key, value = todo.pop()
            if isinstance(value, dict):
                todo += [(f"{key}.{k}" if key else k, v) for k, v in reversed(value.items())]
                continue
            said = ", ".join(told(v) for v in value if v is not None and told(v).strip()) if isinstance(value, list) else "" if value is None else told(value).strip()
            if key and said:
                found.append({"key": key, "value": said})
        return found

    return objects.map(of, na_action="ignore")


def flatten_fields(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, key, value of the leaves of a JSON object by dotted key; nulls and empties go, lists are joined by ', '.

    Objects nest to any depth, which no built-in follows, so they are walked in
    Arrow batches.  What is no JSON object has no leaves.
    """
    return df.select(F.col(id_col).alias("id"), F.inline(_leaves(F.col(json_col))))
