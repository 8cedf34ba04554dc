"""Longest common subsequences and overlaps against plain versions, whole long texts too."""

from __future__ import annotations

import collections

import numpy as np
from pyspark.sql import functions as F

from verdigris.functions import text


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        past = row
        row = [0]
        for j, y in enumerate(b):
            row.append(past[j] + 1 if x == y else max(row[-1], past[j + 1]))
    return row[-1]


def texts():
    rng = np.random.default_rng(2)
    out = [([], []), ([], ["a"]), (["a"], []), (["a"], ["a"]), (["a"], ["b"]), (["x"] * 200, ["x"] * 65)]
    return out + [([f"w{k}" for k in rng.integers(0, v, n)], [f"w{k}" for k in rng.integers(0, v, m)]) for v in (2, 5, 50) for n, m in ((1, 7), (63, 64), (65, 130), (200, 3))]


def test_lcs_and_overlap(rows):
    data = texts()
    got = rows("k int, a array<string>, b array<string>", [(k, a, b) for k, (a, b) in enumerate(data)], "k", text.lcs_length(F.col("a"), F.col("b")), text.overlap(F.col("a"), F.col("b")))
    want = {k: (plain_lcs(a, b), sum((collections.Counter(a) & collections.Counter(b)).values())) for k, (a, b) in enumerate(data)}
    assert {k: (n, m) for k, n, m in got} == want


def test_long_texts(rows):
    """Twenty thousand words on either side; a null has no length."""
    long = [f"w{k * k % 5003}" for k in range(20_000)]
    got = rows("k int, a array<string>, b array<string>", [(0, long, long[1:] + ["end"]), (1, None, long)], "k", text.lcs_length(F.col("a"), F.col("b")))
    assert dict(got) == {0: 19_999, 1: None}
    p, r = " ".join(long), " ".join([*long[5:], "the", "end"])
    got = rows("k int, p string, r string", [(0, p, r), (1, None, "x"), (2, "the", None)], "k", text.token_prf(F.col("p"), F.col("r")))
    assert [tuple(prf) for _, prf in got[1:]] == [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]
    assert tuple(got[0][1])[:2] == (19_995 / 20_000, 19_995 / 19_996)
