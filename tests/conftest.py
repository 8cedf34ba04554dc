from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from verdigris.plans.session import local_session, reach_workers  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, **{"spark.driver.memory": "3g"})
    yield reach_workers(session)
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture
def rows(spark):
    """Evaluate columns over literal rows: rows(schema, data, *columns) -> list of tuples."""

    def run(schema: str, data: list[tuple], *columns):
        return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]

    return run
