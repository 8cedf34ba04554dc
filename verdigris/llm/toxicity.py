"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.models import train, training_rows, with_scores
from verdigris.llm.words import LETTER, Texts, U, join_hashes, slices

BITS = 20
#: Labelled rows that training sees at the most.
SAMPLE_ROWS = 30_000
EPOCHS = 2
#: Training leaves out buckets that fewer sampled rows have; L1 would not keep them.
LEAST_ROWS = 3


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word, pair of neighbours, and pair with one word between."""
    words, doc = texts.hashes(), texts.doc
    rows, cells = [doc], [words]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        rows.append(doc[gap:][same])
        cells.append(join_hashes(words[:-gap][same], words[gap:][same]) + U(gap))
    return np.concatenate(rows), (np.concatenate(cells) >> U(64 - BITS)).astype(np.int64)


def _sets(columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of the rows, the rows' distinct buckets in one array, and where each row's begin."""
    for column in columns:
        for a, b in slices(column):
            part = Texts(column.slice(a, b - a), ~LETTER)
            row, cell = features(part)
            key = np.unique(row << BITS | cell)
            yield (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(part.n + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(columns: list[pa.Array], labels: np.ndarray, ids: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.01) -> bytes:
    """One pass after another over the rows in an order fixed by their ids, with a rate for each coordinate.

    Returns the weights that L1 left, as (bucket, weight) pairs; bucket 2**BITS is the bias.
    Without rows the bias alone is left, at 0.
    """
    # buckets are counted before any set is kept, so only what training uses takes memory
    rows = np.zeros(1 << BITS, np.int64)
    for buckets, _ in _sets(columns):
        rows += np.bincount(buckets, minlength=1 << BITS)
    sets: list[np.ndarray] = []
    for buckets, at in _sets(columns):
        keep = rows[buckets] >= LEAST_ROWS
        at = np.concatenate([[0], np.cumsum(keep)])[at]
        buckets = buckets[keep]
        sets += [buckets[at[k] : at[k + 1]] for k in range(len(at) - 1)]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.argsort(ids * 2654435761 % (1 << 32), kind="stable")
    bias = np.array([1 << BITS], np.int32)
    for _ in range(EPOCHS):
        for k in order:
            i = np.concatenate([sets[k], bias])
            zi, root = z[i], np.sqrt(n[i])
            free = np.where(i == 1 << BITS, 0.0, l1)
            w = np.where(np.abs(zi) <= free, 0.0, (np.sign(zi) * free - zi) / ((beta + root) / alpha + l2))
            g = float(_sigmoid(w.sum()) - labels[k])
            z[i] += g - (np.sqrt(n[i] + g * g) - root) / alpha * w
            n[i] += g * g
    free = np.full(len(z), l1)
    free[-1] = 0
    w = np.where(np.abs(z) <= free, 0.0, (np.sign(z) * free - z) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return at.astype("<i4").tobytes() + w[at].astype("<f4").tobytes()


def scorer(model: bytes):
    """Scores of a string column under the pairs that fit() gave."""
    size = len(model) // 8
    weights = np.zeros((1 << BITS) + 1)
    weights[np.frombuffer(model[: 4 * size], "<i4")] = np.frombuffer(model[4 * size :], "<f4")

    def score(column: pa.Array) -> np.ndarray:
        part = Texts(column, ~LETTER)
        row, cell = features(part)
        hit = np.flatnonzero(weights[cell])
        key = np.unique(row[hit] << BITS | cell[hit])
        return _sigmoid(weights[-1] + np.bincount(key >> BITS, weights[key & ((1 << BITS) - 1)], part.n))

    return score


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes:
    return train(training_rows(docs, labels, "toxic", sample_rows), fit)


def score_toxicity(df: DataFrame, model: bytes, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with their toxicity from 0 to 1 in column `out`.

    Every whole text is scored; a null or empty one gets the bias alone.  Rows
    stay as they are, repeated ones too, and a column named like `out` is
    replaced.  The weights are those that L1 left: at most 2**BITS + 1 pairs.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    made: list = []

    def score(column: pa.Array) -> np.ndarray:
        if not made:
            made.append(scorer(sent.value))
        return made[0](column)

    return with_scores(df, score, text, out)


def rejected(score: Column, threshold: float = 0.5) -> Column:
    return (score >= F.lit(threshold)).cast("int")
