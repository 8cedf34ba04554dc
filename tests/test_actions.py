from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verdigris.functions import actions
from verdigris.operators.windows import bootstrap_gap


def test_actions(rows):
    data = [('{"action": "ASK", "query": "fever?"}',), ('Sure.\n```json\n{"action_type": "test", "action_text": {"n": 1}}\n```',), ("I will ask: since when",), ("hm",), (None,), ('{"action": "fly"}',)]
    got = [tuple(r[0]) for r in rows("t string", data, actions.parse_action(F.col("t"), ("ask", "test")))]
    assert got == [("ask", "fever?", True), ("test", '{"n": 1}', True), ("ask", "since when", True), ("", "hm", False), ("", None, False), ("", '{"action": "fly"}', False)]


def test_objects(rows):
    assert rows("t string", [('x {"a": {"b": 1}} } {"c": 2} {',), (None,)], actions.json_objects(F.col("t"))) == [(['{"a": {"b": 1}}', '{"c": 2}'],), ([],)]


def test_texts(rows):
    got = rows("t string", [("Short. He has a high fever; - and a long cough\nno",)], actions.findings(F.col("t")))
    assert [tuple(x) for x in got[0][0]] == [("1", "He has a high fever;"), ("2", "and a long cough")]
    got = rows("e array<struct<name:string,type:string>>, g array<struct<source:string,target:string>>", [([("a", "svc"), (None, "x"), ("b", None)], []), ([], [("a", "b"), ("a", None)])], actions.topology_text(F.col("e"), F.col("g")))
    assert got == [("Entities in the incident window:\n- a (svc)\n- b",), ("Call/dependency edges:\n- a -> b",)]
    q = F.create_map(F.lit("E1"), F.lit("Pain?"))
    m = F.create_map(F.lit("V2"), F.lit("left arm"))
    assert rows("t string", [("E1_@_V2",), ("E1",), ("E9",), ("E1_@_7",)], actions.evidence_line(F.col("t"), q, m)) == [("Pain? left arm",), ("Pain? yes",), (None,), ("Pain? 7",)]


def test_bootstrap(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 2 + 0.5 + (F.col("id") % 5 - 2) / 10).alias("b"))
    low, high = bootstrap_gap(df, [], "a", "b", "id", reps=300).first()
    assert 0.45 < low < 0.5 < high < 0.55
    assert (low, high) == pytest.approx(tuple(bootstrap_gap(df.repartition(5), [], "a", "b", "id", reps=300).first()))
