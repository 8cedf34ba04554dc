"""Ranks, quantiles and correlations against plain versions, and that no plan puts a whole group into one task."""

from __future__ import annotations

import re

import numpy as np
import pytest

from verdigris.operators import ranks

SCHEMA = "g string, a double, b double, id long, ok boolean"


@pytest.fixture(scope="module")
def points(spark):
    """A group with most of the rows, small ones, one row alone, a null group, ties and missing values."""
    rng = np.random.default_rng(4)
    rows = [("hot", float(rng.integers(40)), float(rng.integers(30)), k, bool(rng.integers(2))) for k in range(700)]
    rows += [(g, float(rng.integers(5)), float(rng.integers(5)), 1000 + k, True) for k, g in enumerate(["s"] * 9 + [None] * 7 + ["t"] * 2 + ["one"])]
    rows += [("flat", 1.0, float(k), 2000 + k, False) for k in range(5)] + [("hot", None, 1.0, 3000, True), ("lost", None, None, 3001, False)]
    return rows


def groups(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture
def several(spark):
    """More ranges than groups, whatever their size."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for c, v in before.items():
        spark.conf.set(c, v)


def test_tau_b(spark, points, several):
    want = {}
    for g, rows in groups(points).items():
        p = [(r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None]
        s = na = nb = 0
        for i, (a, b) in enumerate(p):
            for c, d in p[:i]:
                s, na, nb = s + np.sign(a - c) * np.sign(b - d), na + (a != c), nb + (b != d)
        want[g] = pytest.approx(float(s / np.sqrt(na * nb)) if na * nb else 0.0)
    found = ranks.kendall_tau_b(spark.createDataFrame(points, SCHEMA), ["g"], "a", "b")
    assert {r["g"]: r["tau_b"] for r in found.collect()} == want


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 31, 32, 33, 64, 500):
        b, w = rng.integers(0, 20, n), rng.integers(1, 5, n)
        assert ranks.inversions(b, w).tolist() == [int(sum(w[i] for i in range(j) if b[i] > b[j])) for j in range(n)]


def test_spearman_auc_ranks_quintiles_and_cuts(spark, points, several):
    df = spark.createDataFrame(points, SCHEMA).where("a IS NOT NULL AND b IS NOT NULL")
    known = groups([r for r in points if r[1] is not None and r[2] is not None])
    rank = lambda xs: [sum(y < x for y in xs) + (xs.count(x) + 1) / 2 for x in xs]
    got = {r["id"]: r["r"] for r in ranks.with_average_rank(df, ["g"], "a", "r").collect()}
    for rows in known.values():
        assert [got[r[3]] for r in rows] == rank([r[1] for r in rows])
    got = {r["g"]: r["spearman"] for r in ranks.spearman(df, ["g"], "a", "b").collect()}
    for g, rows in known.items():
        x, y = rank([r[1] for r in rows]), rank([r[2] for r in rows])
        flat = len(set(x)) < 2 or len(set(y)) < 2
        assert got[g] == pytest.approx(0.0 if flat else np.corrcoef(x, y)[0, 1])
    hot = known["hot"]
    right, wrong = [r[1] for r in hot if r[4]], [r[1] for r in hot if not r[4]]
    want = np.mean([(a > b) + (a == b) / 2 for a in right for b in wrong])
    got = {r["g"]: r["auc"] for r in ranks.auc(df, ["g"], "a", "ok").collect()}
    assert got["hot"] == pytest.approx(want) and got["s"] is None
    got = {r["id"]: r["quintile"] for r in ranks.length_quintile(df, ["g"], "a", "id").collect()}
    order = sorted(hot, key=lambda r: (r[1], r[3]))
    assert [got[r[3]] for r in order] == [max(1, int(np.ceil(5 * k / (len(order) - 1)))) for k in range(len(order))]
    got = {r["g"]: r["cut"] for r in ranks.group_quantile(df, ["g"], "a", 0.95).collect()}
    assert all(got[g] == pytest.approx(np.quantile([r[1] for r in rows], 0.95)) for g, rows in known.items())


def test_no_window_over_a_whole_group(spark, points):
    df = spark.createDataFrame(points, SCHEMA)
    for found in (ranks.value_ranks(df, ["g"], "a"), ranks.auc(df, ["g"], "a", "ok"), ranks.spearman(df, ["g"], "a", "b"), ranks.kendall_tau_b(df, ["g"], "a", "b"), ranks.length_quintile(df, ["g"], "a", "id")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # windows are by group and range, or run over a row a range
        for keys in re.findall(r"Window \[.*?\], \[([^\]]*)\], \[([^\]]*)\]", plan):
            assert "__range" in "".join(keys) or "__p" in "".join(keys) or "__q" in "".join(keys), keys


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ranks.kendall_tau_b(df, ["g"], "a", "b").count() == ranks.spearman(df, ["g"], "a", "b").count() == ranks.auc(df, ["g"], "a", "ok").count() == ranks.overthinking(df, ["g"], "a", "ok").count() == 0
