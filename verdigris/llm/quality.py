"""Quality: histogram gradient-boosted trees over statistics of each document."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdigris.llm.models import train, training_rows, with_scores
from verdigris.llm.words import LETTER, Texts, join_hashes, slices

#: Labelled rows that training sees at the most.
SAMPLE_ROWS = 16_000
TREES, DEPTH, BINS, RATE, LAMBDA, LEAST = 60, 4, 64, 0.15, 1.0, 20
_CLASS = np.zeros((256, 6), np.float32)
_CLASS[65:91, 0] = 1  # upper case
_CLASS[48:58, 1] = 1  # digits
for _b in range(33, 127):
    _CLASS[_b, 2] = chr(_b) in ".,;:?'\"-()"
    _CLASS[_b, 3] = not chr(_b).isalnum() and chr(_b) not in ".,;:?'\"-()"
_CLASS[128:, 4] = 1
_CLASS[10, 5] = 1  # ends of lines


def _repeats(doc: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the share of its keys that came before in it, and the share of its commonest key."""
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(k)))
    total = np.maximum(np.bincount(doc, minlength=n), 1)
    most = np.zeros(n)
    np.maximum.at(most, d[at], runs)
    return 1 - np.bincount(d[at], minlength=n) / total, most / total


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text; an empty text has zeros."""
    t = Texts(column)
    n, size = t.n, np.diff(t.offsets)
    per = np.maximum(size, 1)
    byte_doc = np.repeat(np.arange(n), size)
    classes = np.stack([np.bincount(byte_doc, _CLASS[t.raw, k], n) for k in range(6)], 1)
    words, length, doc = t.hashes(), t.end - t.start, t.doc
    count = np.bincount(doc, minlength=n)
    some = np.maximum(count, 1)
    mean = np.bincount(doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length.astype(float) ** 2, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    first, last = t.raw[t.start], t.raw[t.end - 1]
    bare = np.add.reduceat(LETTER[t.raw].astype(np.int32), np.ravel(np.column_stack([t.start, t.end]))[:-1])[::2] if len(words) else np.zeros(0)
    upper = np.add.reduceat(_CLASS[t.raw, 0], np.ravel(np.column_stack([t.start, t.end]))[:-1])[::2] if len(words) else np.zeros(0)
    next_same = np.zeros(len(words), bool)
    next_same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    share = lambda x: np.bincount(doc, x, n) / some
    pair = doc[1:] == doc[:-1]
    dup1, top1 = _repeats(doc, words, n)
    dup2, top2 = _repeats(doc[1:][pair], join_hashes(words[:-1][pair], words[1:][pair]), n)
    only_lines = np.zeros(256, bool)
    only_lines[10] = True
    lines = Texts(column, only_lines)
    dup3, top3 = _repeats(lines.doc, lines.hashes(), n)
    n_lines = np.bincount(lines.doc, minlength=n)
    out = [
        np.log1p(size), np.log1p(count), mean, spread, longest, *(classes / per[:, None]).T,
        share(LETTER[last] == 0), share(LETTER[first] == 0), share(bare == 0), share(bare < length - 1), share((upper >= 2) & (upper >= bare - 1)),
        share(next_same), dup1 * np.log1p(count), dup1, top1, dup2, top2, dup3, top3, n_lines, count / np.maximum(n_lines, 1),
        np.bincount(doc, (last == 46), n) / some, share(length <= 2), share(length >= 16),
    ]
    return np.nan_to_num(np.stack(out, 1)).astype(np.float64)


def _batched(columns: list[pa.Array]) -> np.ndarray:
    parts = [statistics(c.slice(a, b - a)) for c in columns for a, b in slices(c)]
    return np.concatenate(parts) if parts else np.zeros((0, len(statistics(pa.array([""]))[0])))


def fit(columns: list[pa.Array], labels: np.ndarray, ids: np.ndarray) -> bytes:
    """Boosted trees on the logistic loss, each grown level by level from histograms of gradients.

    A tree of DEPTH levels is three arrays in heap order: feature and limit of
    each inner node, value of each leaf.  Without rows of both labels only the
    base score is left.
    """
    x, y = _batched(columns), labels.astype(float)
    order = np.argsort(ids, kind="stable")
    x, y = x[order], y[order]
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    trees: list[tuple[list, list, list]] = []
    if 0 < y.sum() < len(y):
        limits = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(limits[f], x[:, f], "left") for f in range(x.shape[1])], 1)
        margin = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(DEPTH):
                here, best = 1 << level, np.zeros(1 << level)
                pick, at = np.zeros(here, np.int64), np.full(here, BINS)
                for f in range(x.shape[1]):
                    cell = node * (BINS + 1) + binned[:, f]
                    gs = np.bincount(cell, g, here * (BINS + 1)).reshape(here, -1).cumsum(1)
                    hs = np.bincount(cell, h, here * (BINS + 1)).reshape(here, -1).cumsum(1)
                    ns = np.bincount(cell, minlength=here * (BINS + 1)).reshape(here, -1).cumsum(1)
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + LAMBDA) + (gt - gs) ** 2 / (ht - hs + LAMBDA) - gt**2 / (ht + LAMBDA)
                    gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
                    gain[:, len(limits[f]) :] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(here), top]
                    better = value > best + 1e-9
                    best[better], pick[better], at[better] = value[better], f, top[better]
                for k in range(here):
                    if at[k] < BINS:
                        feature[here - 1 + k], limit[here - 1 + k] = pick[k], limits[pick[k]][at[k]]
                node = node * 2 + (x[np.arange(len(y)), feature[here - 1 + node]] > limit[here - 1 + node])
            value = -RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + LAMBDA)
            margin += value[node]
            trees.append((feature.tolist(), [min(v, 1e308) for v in limit.tolist()], value.tolist()))
    return json.dumps({"base": base, "trees": trees}).encode()


def scorer(model: bytes):
    """Scores of a string column: all trees walk all rows at once, a level at a time."""
    spec = json.loads(model)
    feature, limit, value = (np.array([t[k] for t in spec["trees"]]) for k in range(3)) if spec["trees"] else (None,) * 3

    def score(column: pa.Array) -> np.ndarray:
        x = statistics(column)
        margin = np.full(len(x), spec["base"])
        if feature is not None:
            tree = np.arange(len(feature))[None, :]
            node = np.zeros((len(x), len(feature)), np.int64)
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[tree, node]] > limit[tree, node])
            margin += value[tree, node - (1 << DEPTH) + 1].sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))

    return score


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes:
    return train(training_rows(docs, labels, "quality", sample_rows), fit)


def score_quality(df: DataFrame, model: bytes, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with their quality from 0 to 1 in column `out`.

    Every whole text is scored; a null or empty one has statistics of zero.
    Rows stay as they are, repeated ones too, and a column named like `out` is
    replaced.  The model is TREES trees of DEPTH levels, whatever the input.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    made: list = []

    def score(column: pa.Array) -> np.ndarray:
        if not made:
            made.append(scorer(sent.value))
        return made[0](column)

    return with_scores(df, score, text, out)
