"""Rolling windows against a walk over all rows, also where blocks are heavy."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import queries, rolling

SCHEMA = "doc_id long, text string, lang string, source string, t long, w string, block string, id string, n string"


def plain(rows, windows, ranks=((1, 2), (9, 10))):
    """(id, W, t, rows, sum, kinds, values of the ranks) for each (id, text, lang, source, t)."""
    out = []
    for i, _, _, source, t in rows:
        for w in windows:
            seen = [r for r in rows if t is not None and r[4] is not None and r[3] == source and t - w <= r[4] < t]
            known = sorted(len(r[1]) for r in seen if r[1] is not None)
            chosen = [known[-(-len(known) * a // b) - 1] if known else None for a, b in ranks]
            out.append((i, w, t, len(seen), sum(known), len({r[2] for r in seen if r[2] is not None}), *chosen))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", "block", "id", "n") for r in rows], SCHEMA)


def got(df, windows, **more):
    found = rolling.rolling_features(df, F.col("t"), F.char_length("text"), windows, **more)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(13)
    texts = ["", "é", "日本語", None, "x" * 70, "y" * 3000, *["z" * int(k) for k in rng.integers(0, 40, 20)]]
    rows = [(k % 190, texts[rng.integers(len(texts))], [None, "en", "de", "fr"][rng.integers(4)], ["a", "a", "a", None, "", "b"][rng.integers(6)], int(rng.integers(-200, 200))) for k in range(400)]
    return [*rows, *rows[:9], (None, "lost", "en", "a", None), (7, "seven", "en", "a", 0), (8, "eight", None, "a", 10), (9, None, "de", "c", 5), (9, None, "de", "c", 6)]


@pytest.mark.parametrize(("light", "together"), [(200_000, 50_000), (200_000, 10), (20, 30), (0, 50_000)])
def test_rolling_as_a_plain_walk(spark, mixed, light, together, monkeypatch):
    """Light blocks, many to a task or a few, and heavy ones stage by stage."""
    monkeypatch.setattr(rolling, "LIGHT", light)
    monkeypatch.setattr(rolling, "TOGETHER", together)
    assert got(table(spark, mixed), (10, 60)) == plain(mixed, (10, 60))


def test_other_ranks_and_long_values(spark):
    rows = [(k, "a" * (k * 7919 % 50_021), "en", "s", k // 3) for k in range(60)]
    ranks = ((0, 1), (1, 3), (1, 1))
    want = plain(rows, (5,), ((1, 10**9), (1, 3), (1, 1)))
    found = got(table(spark, rows), (5,), ranks=((1, 10**9), (1, 3), (1, 1)))
    assert found == want and len(ranks) == 3


def test_persistent_versions():
    """Every pair of versions answers every rank, older ones too."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50, 40), rng.integers(0, 50, 30)
    for i in (-1, 0, 17, 39):
        for j in (-1, 3, 29):
            want = sorted([*a[: i + 1], *b[: j + 1]])
            if want:
                trees = [rolling.Tree(np.zeros(len(x), int), x, np.ones(len(x), int)) for x in (a, b)]
                value, left = rolling.select(trees, [np.full(len(want), i), np.full(len(want), j)], np.arange(1, len(want) + 1), 6)
                assert value.tolist() == want and all(1 <= k <= want.count(v) for k, v in zip(left, value, strict=True))


def test_rolling_edges(spark):
    empty = rolling.rolling_features(table(spark, []), F.col("t"), F.char_length("text"), (10,))
    assert empty.collect() == [] and empty.columns == ["doc_id", "window_s", "event_s", "n_events", "sum_value", "n_kinds", "rank_0", "rank_1"]
    long = [(1, "x" * 500_000, "en", "a", 1), (2, "", "en", "a", 2), (2, "", "en", "a", 2), (3, None, None, None, 3)]
    assert got(table(spark, long), (1, 7)) == plain(long, (1, 7))


def test_times(spark):
    ids = [0, 1, 5, 123_456, -7, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(rolling.event_seconds(F.col("doc_id")))
    assert [r[0] for r in df.collect()] == [None if i is None else 60 * ((i + zlib.crc32(str(i).encode()) % 10_000) // 6) for i in ids]


def test_query_as_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.execute(queries.ORACLES["op13_rolling_windows"])
    names = [c[0] for c in want.description]
    rows = sorted(want.fetchall(), key=repr)
    df = queries.QUERIES["op13_rolling_windows"](spark, small)
    assert sorted(names) == sorted(df.columns) and set(dict(df.dtypes).values()) == {"bigint"}
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == rows
