"""Exact dedup by content hash, with a byte comparison inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import cut, one_of_each, unused

#: Hash values with several rows that are broadcast at the most; with more, every text is grouped.
FEW = 500_000


def exact_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "min", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Each row's surviving id and group size.

    Returns id_col, keep_id, group_size, kept and text_sha256, a row for each
    row of the input.  `keep` says which id of equal texts stays: "min" or
    "max".  Texts are equal when their bytes are; a null text counts as empty.
    Rows that share an id and a text stand or fall together.  A null id never
    stays if its text has another; a group of null ids alone has keep_id null
    and stays.  Other columns are left out.  An empty table gives no rows.

    Rows are grouped by the 128-bit hash first.  Only a hash with several rows
    has its texts compared: they are grouped by (hash, text), where partial
    aggregation leaves each text once to a map task, however many copies it
    holds, and the grouping compares bytes.  The ids then meet their group by
    the hash alone, unless it has several texts; those few rows meet it by hash
    and text.  Very long texts are hashed whole, and move only if their hash
    has several rows.
    """
    first = F.min if keep == "min" else F.max
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text")).withColumn("__hash", content_hash(F.col("__text")))
    ids = rows.select("__id", "__hash", F.sha2("__text", 256).alias("text_sha256"))
    hashes = cut(rows.groupBy("__hash").agg(first("__id").alias("keep_id"), F.count("*").alias("group_size")))
    several = hashes.where("group_size > 1").select("__hash")
    compared = rows.join(F.broadcast(several), "__hash", "left_semi") if several.count() <= FEW else rows
    texts = compared.select("__hash", "__text").distinct().groupBy("__hash").agg(F.count("*").alias("__texts"))
    clashes = cut(texts.where("__texts > 1").select("__hash"))
    n = clashes.count()
    if not n:
        found = ids.join(hashes, "__hash")
    else:
        clashes = F.broadcast(clashes) if n <= FEW else clashes
        doubtful = rows.join(clashes, "__hash", "left_semi")
        apart = doubtful.groupBy("__hash", "__text").agg(first("__id").alias("keep_id"), F.count("*").alias("group_size"))
        found = ids.join(hashes.join(clashes, "__hash", "left_anti"), "__hash")
        found = found.unionByName(doubtful.join(apart, ["__hash", "__text"]).withColumn("text_sha256", F.sha2("__text", 256)).drop("__text"))
    return found.select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat an id and a text, one stays.

    Rows meet their verdict by id and text, so a repeated or null id says
    nothing about its other texts.  Where rows that repeat both differ in other
    columns, the one whose hash of all columns is the least stays.  An empty
    table gives no rows.
    """
    sha, own, other = unused(df, "__sha256", "__id", "__kept")
    stays = exact_groups(df, id_col, text, keep).where("kept").groupBy(F.col(id_col).alias(own), F.col("text_sha256").alias(other)).agg(F.count("*").alias("__many"))
    stays = cut(stays)
    rows = df.withColumn(sha, F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))
    match = rows[id_col].eqNullSafe(F.col(own)) & (F.col(sha) == F.col(other))
    out = rows.join(stays.where("__many = 1"), match, "left_semi")
    several = stays.where("__many > 1")
    if several.limit(1).count():
        out = out.unionByName(one_of_each(rows.join(several, match, "left_semi"), id_col, sha))
    return out.drop(sha)
