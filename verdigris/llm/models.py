"""What the trained scorers share: a bounded sample of labelled rows, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import held_out, text_batches, unused
from verdigris.llm.words import slices, strings


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(text, label) of about sample_rows labelled documents at the most, none of them held out.

    Ids are drawn by hash at the rate that gives sample_rows, so the draw is
    the same on each run and its size does not grow with the data.  An id with
    several labels counts with the largest; a null id or label takes no part.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    total = known.count()
    rate = min(1.0, sample_rows / max(1, total))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) < int(rate * (1 << 30)))
    # at most about sample_rows pairs of numbers, so a broadcast is safe at any size of the corpus
    small = F.broadcast(drawn)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(small, "doc_id").select("text", "__label", "doc_id")


def train(rows: DataFrame, fit: Callable[[list[pa.Array], np.ndarray], bytes]) -> bytes:
    """Fit in one task over the bounded sample; the model comes back as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(strings(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        ids = np.concatenate([x[2] for x in got]) if got else np.zeros(0, np.int64)
        y = np.concatenate([x[1] for x in got]) if got else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([fit([x[0] for x in got], y, ids)], pa.binary())], ["model"])

    text_batches(rows.sparkSession)
    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(found[0][0]) if found else fit([], np.zeros(0, np.int32), np.zeros(0, np.int64))


def with_scores(df: DataFrame, score: Callable[[pa.Array], np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """The rows with a column `out` of score(texts); a column of that name is replaced.

    A null text counts as empty.  Batches are cut to a few MB before scoring, so
    long texts do not add up.
    """
    text_batches(df.sparkSession)
    kept = [c for c in df.columns if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(*unused(df, "__text")))
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(len(kept)))
            found = [np.zeros(0)] + [score(texts.slice(a, b - a)) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.concatenate(found), pa.float64())], [*kept, out])

    return rows.mapInArrow(run, schema)
