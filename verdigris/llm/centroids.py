"""Centroid clustering (Lloyd's rounds) by filtering centroids through kd-trees.

Each partition's vectors are built into kd-trees once, which are kept; a node
holds its number of vectors, their integer sum and their box.  In a round the centroids go down
the trees: of those that reach a node, the one nearest to the box's middle
excludes each other that is farther from every corner the box could offer it.
A node that one centroid reaches is assigned whole, by its count and sum; at a
leaf what is left is resolved vector by vector.  Only strictly farther
centroids are excluded, so ties are left to the leaves.  All is in integers.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import cut

#: Vectors of one tree and of one leaf at the most, and numbers (vectors times dimensions) of one tree.
TREE, LEAF, NUMBERS = 4096, 24, 1 << 18
#: Components up to this size leave squared distances of up to 64 dimensions exact as doubles, and up to the second one, of up to 512, as 64-bit integers.
EXACT, WHOLE = 1 << 20, 1 << 25
MOST = (1 << 63) - 1


class KdTree:
    """Vectors dealt into nodes; nodes stand level by level, the root first."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        spans, self.levels = [(0, len(x))] if len(x) else [], []
        while spans:
            begin, end = np.array(spans).T
            boxes = [(x[self.order[a:b]].min(0), x[self.order[a:b]].max(0)) for a, b in spans]
            low, high = np.array([lo for lo, _ in boxes]), np.array([hi for _, hi in boxes])
            # vectors that are all alike stay a leaf, however many they are
            leaf = (end - begin <= LEAF) | (low == high).all(1)
            down, spans = np.full((len(begin), 2), -1), []
            for k in np.flatnonzero(~leaf).tolist():
                a, b = int(begin[k]), int(end[k])
                mid = (a + b) // 2
                part = self.order[a:b]
                self.order[a:b] = part[np.argpartition(x[part, int((high[k] - low[k]).argmax())], mid - a)]
                down[k] = len(spans), len(spans) + 1
                spans += [(a, mid), (mid, b)]
            self.levels.append((begin, end, low, high, leaf, down))
        self.x = x[self.order]
        self._add_up()

    def _add_up(self) -> None:
        """Sums up to each vector, which give the sum of any node."""
        self.sums = np.concatenate([np.zeros((1, self.x.shape[1]), self.x.dtype), np.cumsum(self.x, 0)])

    def __getstate__(self) -> dict:
        """As kept: numbers in as few bytes as they need, without what can be added up again."""
        return {"order": _short(self.order), "x": _short(self.x), "levels": [tuple(map(_short, level)) for level in self.levels]}

    def __setstate__(self, state: dict) -> None:
        long = lambda a: a.astype(np.int64) if a.dtype.kind == "i" else a
        self.order, self.x, self.levels = long(state["order"]), long(state["x"]), [tuple(map(long, level)) for level in state["levels"]]
        self._add_up()

    def filtered(self, centres: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, end, centroids that may be nearest) of nodes that together hold every vector once: nodes with one centroid left, and leaves."""
        reach = np.ones((1, len(centres)), bool)
        for begin, end, low, high, leaf, down in self.levels:
            reach = self._kept(low, high, centres, reach)
            alone = reach.sum(1) == 1
            done = alone | leaf & reach.any(1)
            for k in np.flatnonzero(done).tolist():
                yield int(begin[k]), int(end[k]), np.flatnonzero(reach[k])
            on = np.flatnonzero(~leaf)
            below = np.zeros((int((down >= 0).sum()), len(centres)), bool)
            below[down[on, 0]] = below[down[on, 1]] = np.where(alone[on, None], False, reach[on])
            reach = below

    @staticmethod
    def _kept(low: np.ndarray, high: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The centroids that no other excludes from the whole box; of nodes that none reaches, none."""
        out = reach.copy()
        some = np.flatnonzero(reach.sum(1) > 1)
        twice, size = low + high, max(1, (1 << 20) // max(1, centres.size))
        for at in range(0, len(some), size):
            k = some[at : at + size]
            off = 2 * centres[None] - twice[k][:, None]
            near = np.where(reach[k], (off * off).sum(2), _far(off))
            best = near.argmin(1)
            star = centres[best][:, None]
            # the corner that suits the other centroid best
            corner = np.where(centres[None] > star, high[k][:, None], low[k][:, None])
            gap = ((centres[None] - star) * (centres[None] + star - 2 * corner)).sum(2)
            out[k] &= gap <= 0
        return out

    def distances(self, begin: int, end: int, centres: np.ndarray) -> np.ndarray:
        """Squared distances of a node's vectors to some centroids."""
        x = self.x[begin:end]
        if x.dtype != object and max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) < EXACT and x.shape[1] <= 64:
            a, c = x.astype(np.float64), centres.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
        return np.array([((x - c) ** 2).sum(1) for c in centres]).T.reshape(end - begin, len(centres))

    def totals(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each centroid the number and the sum of the vectors that it is nearest to."""
        count, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, self.x.dtype)
        for begin, end, left in self.filtered(centres):
            if len(left) == 1 or (self.x[begin] == self.x[end - 1]).all() and (self.x[begin:end] == self.x[begin]).all():
                k = left[self.distances(begin, begin + 1, centres[left]).argmin()] if len(left) > 1 else left[0]
                count[k] += end - begin
                sums[k] += self.sums[end] - self.sums[begin]
            else:
                near = left[self.distances(begin, end, centres[left]).argmin(1)]
                np.add.at(count, near, 1)
                np.add.at(sums, near, self.x[begin:end])
        return count, sums

    def nearest(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector, in the order in which they came, the nearest centroid (the first of equal ones) and its squared distance."""
        near, away = np.zeros(len(self.x), np.int64), np.zeros(len(self.x), self.x.dtype)
        for begin, end, left in self.filtered(centres):
            d = self.distances(begin, end, centres[left])
            k = d.argmin(1)
            near[self.order[begin:end]], away[self.order[begin:end]] = left[k], d[np.arange(end - begin), k]
        return near, away


def _far(like: np.ndarray):
    return np.iinfo(np.int64).max if like.dtype != object else 1 << 400


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as whole numbers: 64-bit, or Python's own if components are so large that squares would not fit."""
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)
    return x if np.abs(x).max(initial=0) < WHOLE and dims <= 512 else x.astype(object)


def _short(a: np.ndarray) -> np.ndarray:
    """Integers in the shortest type that holds them."""
    if a.dtype.kind != "i" or not a.size:
        return a
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= a.min() and a.max() <= np.iinfo(t).max)
    return a.astype(kind)


def _centres(tree: KdTree, centres: list[list[int]]) -> np.ndarray:
    """Centroids in the numbers of the tree's vectors; both are Python's own if those are, or if a centroid is too large."""
    c = np.array(centres, object)
    if tree.x.dtype != object and np.abs(c).max(initial=0) < WHOLE:
        return c.astype(np.int64)
    if tree.x.dtype != object:
        tree.x, tree.sums = tree.x.astype(object), tree.sums.astype(object)
        tree.levels = [(a, b, low.astype(object), high.astype(object), leaf, down) for a, b, low, high, leaf, down in tree.levels]
    return c


def _in_trees(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in record batches of one tree each."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def kept_vectors(df: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): vectors with `dims` components, none null or not finite, each as floor(scale * component) in 64 bits."""
    v = F.col(f"`{vector}`")
    x = lambda c: c.cast("double")
    # the largest number of 64 bits is not a double
    whole = lambda c: F.coalesce(F.floor(F.greatest(F.least(x(c) * scale, F.lit(float((1 << 63) - 1024))), F.lit(-float((1 << 63) - 1024)))).cast("long"), F.lit(0))
    sound = (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    return df.where(v.isNotNull() & sound).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, whole).alias("v"))


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Clusters after `rounds` rounds from the k vectors whose sha256("<seed>:<id>") is smallest.

    Returns id_col, cluster, distance (squared, to the final centroid),
    cluster_inertia, inertia and centroid_sha256, a row for each vector with
    `dims` sound components; others take no part.  A component x counts as
    floor(scale * x).  A round assigns each vector to its nearest centroid, of
    equal ones the first, and moves each centroid that has vectors to
    floor(sum / count).  Repeated ids are vectors of their own; as first
    centroids, equal hashes stand in order of their vectors, and null ids, which
    have no hash, come last.  With fewer than k vectors each is a centroid.
    Distances and sums beyond 64 bits are given as 2^63 - 1.  Other columns are
    left out.  An empty table gives no rows.

    The vectors stay where they are read: they are built into trees there, and
    written as such.  Each round reads the trees and shuffles no more than a
    task's sum for each centroid.  Only the k centroids come to the driver.
    """
    spark = df.sparkSession
    most = max(1, min(TREE, NUMBERS // dims))
    rows = kept_vectors(df, dims, scale, id_col, vector)
    named = rows.select(F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")), 256).alias("h"), F.col("id").isNull().alias("last"), "v")
    centres = [list(r["v"]) for r in named.orderBy("last", F.when(~F.col("last"), F.col("h")).asc_nulls_last(), "v").limit(k).collect()]

    kind = rows.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_trees(batches, most):
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([ids, pa.array([pickle.dumps(KdTree(_matrix(part.column(1), dims)))], pa.binary())], ["ids", "tree"])

    def totals(batches: Iterator[pa.RecordBatch], centres: list[list[int]]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centres), object), np.zeros((len(centres), dims), object)
        for batch in batches:
            for blob in batch.column(0):
                tree = pickle.loads(blob.as_py())
                n, s = tree.totals(_centres(tree, centres))
                count, sums = count + n, sums + s
        some = np.flatnonzero(count)
        # a sum as text, as it may have more than 64 bits; the count stands behind the last component
        numbers = [str(int(n)) for j in some for n in (*sums[j], count[j])]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(some)), pa.int32()), pa.array(numbers, pa.string())], ["cluster", "d", "n"])

    trees = cut(rows.mapInArrow(build, f"ids array<{kind}>, tree binary"))
    for _ in range(rounds if centres else 0):
        sums = trees.select("tree").mapInArrow(lambda batches, now=centres: totals(batches, now), "cluster int, d int, n string")
        found: dict[int, dict[int, int]] = {}
        for c, d, n in sums.groupBy("cluster", "d").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # k * (dims + 1) rows at the most
            found.setdefault(c, {})[d] = int(n)
        centres = [[found[c][d] // found[c][dims] for d in range(dims)] if c in found else old for c, old in enumerate(centres)]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob in zip(batch.column(0), batch.column(1), strict=True):
                tree = pickle.loads(blob.as_py())
                near, away = tree.nearest(_centres(tree, centres))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(near, pa.int32()), pa.array([min(int(x), MOST) for x in away], pa.int64())], ["id", "cluster", "distance"])

    done = cut(trees.mapInArrow(nearest, f"id {kind}, cluster int, distance long"))
    bound = lambda n: F.least(n.cast("decimal(38,0)"), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    per = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centres)], "cluster int, centroid_sha256 string")
    # a row for each centroid, and one row
    per = per.select("cluster", bound(F.col("s")).alias("cluster_inertia")).join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(per.agg(bound(F.sum("s")).alias("inertia"))))
    return done.join(F.broadcast(per), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
