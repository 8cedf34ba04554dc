"""Clusters against plain Lloyd rounds in Python's own integers."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from verdigris.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<double>, cluster string, id string, v string, distance string"


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    """(id, cluster, distance, inertia of the cluster, inertia, digest), each vector tried with each centroid."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((away(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            if of := [v for (_, v), c in zip(kept, own, strict=True) if c == j]:
                centres[j] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    done = [(i, *near(v)) for i, v in kept]
    per = {j: sum(d for _, d, c in done if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    most = (1 << 63) - 1
    return sorted(((i, c, min(d, most), min(per[c], most), min(sum(per.values()), most), digest[c]) for i, d, c in done), key=repr)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "c", "i", "v", "d") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in centroids.cluster(df, **more).collect()), key=repr)


def clouds(n, dims, seed=1, spread=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (7, dims))
    return [(k, (middle[k % 7] + rng.normal(0, spread, dims)).tolist()) for k in range(n)]


@pytest.mark.parametrize(("tree", "leaf"), [(16_384, 24), (100, 1), (7, 3)])
def test_as_plain_rounds(spark, tree, leaf, monkeypatch):
    monkeypatch.setattr(centroids, "TREE", tree)
    monkeypatch.setattr(centroids, "LEAF", leaf)
    rows = clouds(400, 4)
    assert got(spark, rows, dims=4, k=9) == plain(rows, dims=4, k=9)


def test_unsound_repeated_and_few(spark):
    good = clouds(20, 2)
    rows = [*good, (3, good[3][1]), (3, [9.0, 9.0]), (None, [0.5, 0.25]), (None, [-0.5, 0.25]), (50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [float("nan"), 1.0]), (55, [float("inf"), 1.0]), (56, [1.0, 2.0, 3.0])]
    for k in (1, 5, 30):
        assert got(spark, rows, dims=2, k=k) == plain(rows, dims=2, k=k)
    assert got(spark, [(1, None)], dims=2) == [] == got(spark, [], dims=2)


def test_ties_and_many_alike(spark):
    """A third is one vector; distances are equal in many places, and some centroids get nothing."""
    rows = [(k, [1.0, 1.0]) for k in range(100)] + [(100 + k, [k % 5 / 2, k % 3 / 2]) for k in range(200)]
    for k in (4, 16):
        assert got(spark, rows, dims=2, k=k) == plain(rows, dims=2, k=k)


def test_very_large_components(spark):
    rows = [*clouds(30, 3), (100, [1e7, -1e7, 3.0]), (101, [1e7, -1e7, 4.0]), (102, [3e15, 1.0, 2.0]), (103, [-3e15, 1.0, 2.0])]
    assert got(spark, rows, dims=3, k=5) == plain(rows, dims=3, k=5)


def test_filtering_excludes_and_assigns_whole_nodes():
    x = (np.array([v for _, v in clouds(4000, 3, spread=0.02)]) * 64).astype(np.int64)
    centres = x[[0, 1, 2, 3, 4, 5, 6]]
    tree = centroids.KdTree(x)
    nodes = list(tree.filtered(centres))
    assert sum(b - a for a, b, _ in nodes) == len(x) and sorted(tree.order.tolist()) == list(range(len(x)))
    whole = sum(b - a for a, b, left in nodes if len(left) == 1)
    assert whole > 0.9 * len(x) and max(b - a for a, b, _ in nodes) > centroids.LEAF
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    near, away = tree.nearest(centres)
    assert (near == d.argmin(1)).all() and (away == d.min(1)).all()
    count, sums = tree.totals(centres)
    assert count.tolist() == np.bincount(near, minlength=7).tolist() and all((sums[j] == x[near == j].sum(0)).all() for j in range(7))


def test_query_as_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op12_centroid_clusters"])
    names = [c[0] for c in want.description]
    rows = sorted(want.fetchall(), key=repr)
    df = queries.QUERIES["op12_centroid_clusters"](spark, small)
    assert sorted(names) == sorted(df.columns) and len(rows) > 100
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == rows
