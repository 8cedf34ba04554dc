"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from verdigris.plans.session import durable

#: A word is a run of bytes other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table is called so (case apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python no more than so many rows at once: texts may be long, and a batch has to fit memory twice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def cut(df: DataFrame) -> DataFrame:
    """The rows in reliable storage, without their lineage: in spark.checkpoint.dir, which has to be set off a session in one process."""
    return durable(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def one_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """Of rows that agree in the keys, nulls too, the one whose hash of all columns is the least; so reruns agree."""
    own, least, *names = unused(df, "__own", "__least", *[f"__key{k}" for k in range(len(keys))])
    hashed = df.withColumn(own, F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType)]))
    found = hashed.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names, strict=True)]).agg(F.min(own).alias(least))
    same = F.col(own) == F.col(least)
    for c, n in zip(keys, names, strict=True):
        same = F.col(f"`{c}`").eqNullSafe(F.col(n)) & same
    return hashed.join(found, same, "left_semi").dropDuplicates(list(keys)).drop(own)
