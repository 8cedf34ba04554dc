"""Readers with the tolerance that evaluation logs need.  Schemas are given, never inferred, where rows may be ragged."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fact row: what one reply was asked, said and scored.
RECORD = (
    "run_id string, dataset_id string, model_id string, template_id string, template_version string, prompt_mode string, selection_mode string, data_delivery_mode string, template_mode string, "
    "sample_id string, group_id string, status string, prompt_fingerprint string, task_kind string, input_tokens_est bigint, "
    "response struct<content: string, reasoning: string, finish_reason: string, status: string, attempts: bigint, latency_s: double, usage: map<string, bigint>>, "
    "metrics map<string, string>, prediction string, parse_ok boolean, reference string, metadata struct<repeat_of: string, repeat_index: int, bov_label: string, bov_index: int, vote_index: int, reduced: boolean, n_members: int>, "
    "created_at double, seq bigint"
)
# Which split is taken first.
SPLITS = ("test", "dev", "validation", "valid", "val", "train")


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files; bytes that are not UTF-8 are replaced."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, value of stripped lines that are not empty."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "(?U)^\\s+|\\s+$", "").alias("value")).where("value <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0) and value of a file's lines, for positional joins of files that one task can split."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n\\z", ""), "\\r?\\n")).alias("line_no", "value"))


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file, gzip too; blank and broken lines, a torn last one too, are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of whole-file JSON; a broken file fails, so that the caller can skip the dataset."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Header and strings only; .tsv and .tab are split at tabs."""
    sep = delimiter or ("\t" if re.search(r"\.(tsv|tab)(\.gz)?$", path) else ",")
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, quote='"', escape='"')


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Distinct paths below root, sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", "modificationTime").distinct().orderBy("path")


def pick_split(paths: DataFrame, path: str = "path", preference: tuple[str, ...] = SPLITS) -> DataFrame:
    """The path whose name has the split that comes first: path, split; no row if none does."""
    name = F.lower(F.regexp_extract(path, "([^/]+)$", 1))
    which = F.filter(F.array(*[F.lit(s) for s in preference]), lambda s: F.rlike(name, F.concat(F.lit("(^|[^a-z])"), s, F.lit("([^a-z]|$)"))))
    rows = paths.withColumn("split", F.try_element_at(which, F.lit(1))).where("split IS NOT NULL")
    rank = F.array_position(F.array(*[F.lit(s) for s in preference]), F.col("split"))
    return rows.orderBy(rank, path).limit(1)


def records(spark: SparkSession, path: str) -> DataFrame:
    """A run's records: torn lines dropped, last of each key kept, metrics as numbers, the marker "None" as absent."""
    from verdigris.operators.records import dedupe_last

    rows = jsonl(spark, path, RECORD)
    numbers = F.map_filter(F.transform_values("metrics", lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull() & ~F.isnan(v))
    return dedupe_last(rows, ["dataset_id", "model_id", "template_id", "template_version", "sample_id", "prompt_fingerprint"], "seq").withColumn("metrics", numbers)


def zip_join(left: DataFrame, right: DataFrame, position: str = "line_no") -> DataFrame:
    """Positional join of two tables with a position; unequal lengths fail."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"positional join of {a} and {b} rows")
    return left.join(right, position)


def payload_rows(payload: Column) -> Column:
    """The rows of a JSON payload as an array of JSON objects: a list of objects, or an object of lists, cut at its shortest list.

    What is neither, or is no JSON, has no rows.  Numbers and strings stay what they are.
    """
    none = F.array().cast("array<string>")
    v = F.try_parse_json(payload)
    kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
    listed = F.transform(v.cast("array<variant>"), lambda e: F.to_json(e))
    by_name = F.map_entries(v.try_cast("map<string,array<variant>>"))
    n = F.array_min(F.transform(by_name, lambda e: F.size(e["value"])))
    row = lambda i: F.to_json(F.map_from_entries(F.transform(by_name, lambda e: F.struct(e["key"], F.get(e["value"], i)))))
    across = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), row))
    return F.coalesce(F.when(F.startswith(kind, F.lit("ARRAY")), listed).when(F.startswith(kind, F.lit("OBJECT")), across), none)


def deep_merge(base: dict, override: dict) -> dict:
    """Recursive merge; the override wins and lists are replaced."""
    merged: dict = {}
    todo = [(merged, base, override)]
    while todo:
        into, low, high = todo.pop()
        both = {k for k in low.keys() & high.keys() if type(low[k]) is type(high[k]) is dict}
        into.update({k: v for k, v in (low | high).items() if k not in both})
        for k in sorted(both):
            into[k] = {}
            todo.append((into[k], low[k], high[k]))
    return merged
