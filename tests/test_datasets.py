from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verdigris.operators import modes
from verdigris.plans.datasets import PLANS

ROW = "content string, reasoning string, finish_reason string, gold string, gold_labels array<string>, accepted array<string>, verdict_label string, verdict_score double"
DATA = [
    ("Answer: B", None, "stop", "b", ["B"], None, "yes", None),
    ("Answer: A, B", None, "stop", "A", ["A", "C"], ["A, B"], None, 0.25),
    (None, None, "stop", "A", ["A"], [], None, None),
    ("", None, "length", "A", [], [], "no", 1.5),
]


@pytest.fixture(scope="module")
def replies(spark):
    strata = sorted({s for p in PLANS.values() for s in p.strata})
    return spark.createDataFrame(DATA, ROW).withColumns({s: F.when(F.col("gold") == "b", F.lit("X y")) for s in strata})


def test_every_plan_scores_and_averages(replies):
    names = None
    for name, plan in PLANS.items():
        part = plan.aggregate(plan.score(replies).withColumn("dataset_id", F.lit(name)), ("dataset_id",)).select("dataset_id", "metric", "value", "n")
        names = part if names is None else names.unionByName(part)
    got = {}
    for r in names.collect():
        got.setdefault(r["dataset_id"], {})[r["metric"]] = (r["value"], r["n"])
    assert set(got) == set(PLANS)
    assert got["xcopa"]["accuracy"] == (0.5, 4) and got["xcopa"]["accuracy_x_y"] == (1.0, 1)
    assert got["aer"]["set_f1"] == (pytest.approx(1.5 / 4), 4) and got["aer"]["set_recall"] == (pytest.approx(1.5 / 4), 4)
    assert got["hypogen"]["flip_judged"] == (pytest.approx((1 + 0.25 + 1) / 3), 3)


def test_plans_fit_the_mode_grid(spark):
    sets = spark.createDataFrame([(p.dataset_id, p.cardinality, p.delivery, p.objective, ["selection"]) for p in PLANS.values()], "dataset_id string, cardinality string, delivery string, objective boolean, task_kinds array<string>")
    models = spark.createDataFrame([("m", [], ["SCS"], []), ("n", ["io"], [], ["generation"])], "model_id string, prompt_modes array<string>, selection_modes array<string>, kinds array<string>")
    tasks = modes.plan_tasks(modes.mode_grid(sets), models)
    assert {r["model_id"] for r in tasks.collect()} == {"m"}
    assert tasks.where("dataset_id = 'art'").select("prompt_mode", "selection_mode").distinct().count() == 3


def test_token_budget(spark):
    pool = spark.createDataFrame([(k, 10 * k) for k in range(1, 9)], "r int, t int")
    assert [r["r"] for r in modes.token_budget(pool, "t", "r", 50, 6).collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        modes.token_budget(pool, "t", "r", 20, 6)
