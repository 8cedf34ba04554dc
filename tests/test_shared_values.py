"""Values that an expression names often are worked out once: their parts stand once in the plan, and narrow tables are spread."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verdigris.functions import notation, text
from verdigris.plans.catalogue import QUERIES
from verdigris.plans.datasets import PLANS


@pytest.mark.parametrize(("column", "part", "most"), [
    (lambda a, b: text.rouge_l(a, b), "split(", 2), (lambda a, b: text.bleu(a, b), "split(", 2), (lambda a, b: text.token_prf(a, b), "split(", 2), (lambda a, b: notation.system_sections(a), "split(coalesce", 1),
    (lambda a, b: PLANS["aer"].scorer("set_f1")(a)[0], "(?i)", 1), (lambda a, b: PLANS["uniadilr_hgc"].scorer("premise_set_match")(a)[0], "regexp_extract_all", 1),
])
def test_parts_stand_once(spark, column, part, most):
    df = spark.createDataFrame([("a", "b", ["A"])], "a string, b string, gold_labels array<string>").select(column(F.col("a"), F.col("b")).alias("x"))
    assert 0 < df._jdf.queryExecution().analyzed().toString().count(part) <= most


@pytest.mark.parametrize("name", ["rouge_and_bleu", "system_files", "math_notation", "dataset_free_text", "dataset_multi_selection", "dataset_number_set"])
def test_narrow_tables_are_spread(spark, small, name):
    assert "RepartitionByExpression" in QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_bleu_counts_repeats(rows):
    got = rows("a string, b string", [("x x y", "x y"), ("x", "x y z"), ("", "x"), ("x y z w v", "x y z w v")], F.round(text.bleu(F.col("a"), F.col("b")), 6))
    # one gram of x too many; brevity of one word against three; an empty side; the same
    assert got == [(round((3 / 4 * 2 / 3 * 1 / 2) ** (1 / 3), 6),), (round(2.718281828459045 ** -2, 6),), (0.0,), (1.0,)]
