"""Load shapes: rows that datasets nest, split over files, pool or repeat, made into one row an item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(df: DataFrame, nested: str, carry: list[str], needed: tuple[str, ...] = ()) -> DataFrame:
    """A row for each element of an array of structs: the columns `carry`, position, and the element's fields.

    Elements with a null or empty field among `needed` are left out.
    """
    rows = df.select(*carry, F.posexplode(nested).alias("position", "__e")).select(*carry, "position", "__e.*")
    return rows.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(c) != "", F.lit(False)) for c in needed], F.lit(True)))


def pooled(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of several sources, with their source; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that agree on the keys, the first in order.

    The aggregate keeps one row a key and map task, so a key that holds much of
    the data leaves little to shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return first.select(*keys, "__first.*").select(*df.columns)


def kept_by(df: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the kept ones."""
    return df.join(kept.select(key).distinct(), key, "left_semi")


def with_metadata(tasks: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Task rows with the metadata of their key; on a shared column the task's value wins, if it has any."""
    known = metadata.select(F.col(key), *[F.col(c).alias(f"__m_{c}") for c in metadata.columns if c != key])
    rows = tasks.join(known, key, "left")
    shared = {c: F.coalesce(F.col(c), F.col(f"__m_{c}")) if c in tasks.columns else F.col(f"__m_{c}") for c in metadata.columns if c != key}
    return rows.select(*[shared.get(c, F.col(c)).alias(c) for c in tasks.columns], *[shared[c].alias(c) for c in shared if c not in tasks.columns])


def with_context(items: DataFrame, topics: DataFrame, key: str, docs: str = "docs") -> DataFrame:
    """Items with their topic's documents; an unknown topic has none."""
    return items.join(topics.select(key, docs), key, "left").withColumn(docs, F.coalesce(docs, F.array().cast(topics.schema[docs].dataType)))


def row_of(rows: Column, field: str, value: Column) -> Column:
    """The first struct of an array whose field has the value."""
    return F.try_element_at(F.filter(rows, lambda r: r[field] == value), F.lit(1))


def vocabulary(df: DataFrame, nested: str, field: str) -> DataFrame:
    """The distinct values of a field over all elements, as one sorted array."""
    return df.select(F.explode(nested).alias("e")).select(F.col(f"e.{field}").alias("v")).where("v IS NOT NULL").distinct().agg(F.array_sort(F.collect_list("v")).alias("vocabulary"))


def built(df: DataFrame, sample: Column, name: str = "sample") -> DataFrame:
    """Items made into samples; those whose sample is null (a field missing, a cast that failed) are left out."""
    return df.withColumn(name, sample).where(F.col(name).isNotNull())


def candidates(listed: Column, gold: Column, negatives: Column, key: Column, salt: str) -> Column:
    """The options of a ranking item: the listed ones, else gold and negatives in an order fixed by the item's key.

    Fewer than two make no set.
    """
    clean = lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " "))
    some = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), clean), lambda x: x != "")
    pool = F.array_distinct(some(F.concat(F.array(gold), F.coalesce(negatives, F.array().cast("array<string>")))))
    drawn = F.transform(F.array_sort(F.transform(pool, lambda x: F.struct(F.sha2(F.concat_ws("|", F.lit(salt), key, x), 256).alias("h"), x.alias("x")))), lambda s: s["x"])
    return F.when(F.size(some(listed)) > 0, some(listed)).when((F.size(some(F.array(gold))) > 0) & (F.size(pool) > 1), drawn).otherwise(F.array().cast("array<string>"))


def paired_files(files: DataFrame, preference: list[str]) -> DataFrame:
    """stem, source and target of the stems that have both, each by the split that is preferred: from (stem, side, split, path)."""
    place = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("split"))
    best = F.struct(F.when(place > 0, place).otherwise(len(preference) + 1).alias("place"), "path")
    sides = files.groupBy("stem").agg(*[F.min(F.when(F.col("side") == s, best)).alias(s) for s in ("source", "target")])
    return sides.where("source IS NOT NULL AND target IS NOT NULL").select("stem", F.col("source.path").alias("source"), F.col("target.path").alias("target"))


def columns_as_rows(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """A row for each place of arrays of equal length."""
    return df.select(*keys, F.inline(F.arrays_zip(*arrays)))


def evidence_slice(df: DataFrame, group: list[str], tool: str, order: str, preferred: list[str], most: int) -> DataFrame:
    """The first findings of each item: preferred tools first, in their order, then by `order`; rank says which."""
    place = F.array_position(F.array(*[F.lit(t) for t in preferred]), F.col(tool))
    by = Window.partitionBy(*group).orderBy(F.when(place > 0, place).otherwise(len(preferred) + 1), order)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
