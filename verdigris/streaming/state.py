"""Streaming: last-wins upserts, turn counts that expire, windowed events.  Episodes with disclosure and datasets as they complete have modules of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from verdigris.operators.records import dedupe_last

LOG = "version bigint, writer string, epoch bigint, bucket int"


class Upsert:
    """A foreachBatch sink: the table keeps the row with the highest sequence of each key.

    The table is dealt into buckets by a hash of the key.  A batch writes, in a
    version of its own, only the buckets that it has rows for, and then says in
    the table's log which they are; of each bucket the newest logged version
    counts.  Versions are numbered in order of their commits, whichever stream
    wrote them, so a stream with a new checkpoint goes on from all that is
    there.  A batch of the same stream that is run again takes its own version
    again and starts from those before it.  One stream writes at a time; a
    second one that meets it is told so.  `buckets` is fixed with the table;
    `vacuum` removes what newer versions have replaced.
    """

    def __init__(self, path: str, keys: list[str], seq: str, buckets: int = 64):
        self.path, self.keys, self.seq, self.buckets = path, keys, seq, buckets

    def _log(self, spark: SparkSession) -> list:
        """The log: a row for each version and bucket."""
        try:
            return spark.read.schema(LOG).parquet(f"{self.path}/log").distinct().collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _folder(self, version: int, writer: str, bucket: int | None = None) -> str:
        return f"{self.path}/v{version}" + f"_{writer}" * (writer != "direct") + ("" if bucket is None else f"/__bucket={bucket}")

    def _newest(self, log: list, before: int | None = None) -> dict[int, list[str]]:
        """Of each bucket the folders of its versions, older than one if given, newest first."""
        out: dict[int, list[str]] = {}
        for r in sorted(log, key=lambda r: -r["version"]):
            if before is None or r["version"] < before:
                out.setdefault(r["bucket"], []).append(self._folder(r["version"], r["writer"], r["bucket"]))
        return out

    def read(self, spark: SparkSession) -> DataFrame | None:
        paths = [v[0] for _, v in sorted(self._newest(self._log(spark)).items())]
        return spark.read.parquet(*paths) if paths else None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        writer = (spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct").replace("-", "")
        log = self._log(spark)
        own = {r["version"] for r in log if (r["writer"], r["epoch"]) == (writer, epoch)}
        version = own.pop() if own else max([r["version"] for r in log], default=-1) + 1
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch = batch.persist()
        hit = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # no more than there are buckets
        paths = [v[0] for b, v in self._newest(log, version).items() if b in hit]
        rows = spark.read.schema(batch.schema).parquet(*paths).unionByName(batch) if paths else batch
        last = dedupe_last(rows, self.keys, self.seq).drop("first_seq").withColumn("__bucket", bucket)
        if hit:
            last.write.mode("overwrite").partitionBy("__bucket").parquet(self._folder(version, writer))
            if any(r["version"] >= version and r["writer"] != writer for r in self._log(spark)):
                raise RuntimeError(f"another stream writes to {self.path}")
            spark.createDataFrame([(version, writer, epoch, b) for b in hit], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        batch.unpersist()

    def vacuum(self, spark: SparkSession) -> int:
        """Remove buckets that have two newer versions, so that the last batch can still be run again; how many."""
        jvm, gone = spark.sparkContext._jvm, 0
        for folder in (f for versions in self._newest(self._log(spark)).values() for f in versions[2:]):
            where = jvm.org.apache.hadoop.fs.Path(folder)
            gone += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return gone


def episodes(turns: DataFrame, max_turns: int = 20, keys: str = "conv_id", idle_ms: int | None = None) -> DataFrame:
    """Per dialogue, as turns arrive: turns so far, characters, and whether it has ended by the limit.

    With idle_ms the state of a dialogue that hears nothing for so long is
    dropped; without, it is kept for as long as the stream runs.
    """
    kind = turns.schema[keys].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, chars, done = state.get if state.exists else (0, 0, False)
        for pdf in parts:
            n, chars = n + len(pdf), chars + int(pdf["text"].str.len().sum())
            done = done or n >= max_turns
        state.update((n, chars, done))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({keys: [key[0]], "n_turns": [n], "n_chars": [chars], "ended": [done]})

    return turns.groupBy(keys).applyInPandasWithState(step, f"{keys} {kind}, n_turns bigint, n_chars bigint, ended boolean", "n bigint, chars bigint, done boolean", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def event_counts(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by window and type, late ones within the delay counted.  An extra: the engine's own logs need no windows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
