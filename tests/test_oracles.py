"""Each query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from verdigris.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def comparable(rows: list[tuple], order: list[int]) -> list[tuple]:
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cursor = duck.execute(ORACLES[name])
    theirs, columns = cursor.fetchall(), [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    mine = comparable([tuple(r) for r in df.collect()], [df.columns.index(c) for c in names])
    assert mine == comparable(theirs, [columns.index(c) for c in names])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
