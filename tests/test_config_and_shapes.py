from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from verdigris.functions import extract, shapes
from verdigris.operators import frames, loads
from verdigris.sources import config


def test_layers(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": [1]}, "b": 1}))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "more.json").write_text(json.dumps({"extends": "../base.json", "a": {"y": [2]}, "c": 3}))
    (tmp_path / "run.json").write_text(json.dumps({"extends": ["base.json", "sub/more.json"], "b": 2}))
    got = config.load_layers(tmp_path / "run.json")
    files = [f.rsplit("/", 1)[1] for f in got.pop("_source_files")]
    assert got == {"a": {"x": 1, "y": [2]}, "b": 2, "c": 3} and files == ["base.json", "base.json", "more.json", "run.json"]
    (tmp_path / "base.json").write_text(json.dumps({"extends": "run.json"}))
    with pytest.raises(config.ConfigError):
        config.load_layers(tmp_path / "run.json")


def test_placeholders(monkeypatch):
    monkeypatch.setenv("V_HOST", "h${env:NO}")
    monkeypatch.delenv("V_PORT", raising=False)
    assert config.interpolate({"u": ["http://${env:V_HOST}:${env:V_PORT|${env:V_OTHER|80}}", 3]}) == {"u": ["http://h${env:NO}:80", 3]}
    for bad in ("${env:V_PORT}", "${env:V_PORT|a", "${shell:ls}"):
        with pytest.raises(config.ConfigError):
            config.interpolate(bad)


def test_dotted():
    base = {"a": {"b": 1, "k": 2}}
    assert config.dotted(base, "a.b=off") == {"a": {"b": "off", "k": 2}} and config.dotted(base, "x.y=[1, 2]") == {"a": {"b": 1, "k": 2}, "x": {"y": [1, 2]}}
    assert config.dotted(base, "a.b=plain words")["a"]["b"] == "plain words" and base == {"a": {"b": 1, "k": 2}}
    with pytest.raises(config.ConfigError):
        config.dotted(base, "a.b.c=1")


def test_fields_of_nothing(rows):
    """Null and empty fields have defined values."""
    got = rows("t string", [(None,), ("",)], shapes.actor_name(F.col("t")), shapes.canonical_formula(F.col("t")), shapes.listish(F.col("t")), shapes.differential(F.col("t")), shapes.context_position(F.col("t")))
    assert got == [("", "", [], [], None)] * 2
    assert rows("t string", [("the team",), ("(a",), ("x (b (c)) d",)], shapes.actor_name(F.col("t")), shapes.formula_span(F.col("t"))) == [("the team", "the team"), ("a", "(a"), ("x b c d", "(b (c))")]
    assert rows("p array<string>", [(["Team X", "y", "x!"],), (["a", None],), ([],)], shapes.matches_final(F.col("p"))) == [([1, None, 1],), ([None, None],), ([],)]
    got = rows("c string, r string, f string", [("", "a<think>b</think><answer>c</answer>", "length"), (None, "no tags", "stop"), ("x", None, "stop")], shapes.misplaced(F.col("c"), F.col("r")), shapes.repaired_reply(F.col("c"), F.col("r"), F.col("f")))
    assert got == [(True, None), (True, "empty_reply"), (False, None)]


def test_verdict_words(rows):
    got = rows("l string, s double", [(" Yes ", None), ("1", None), ("positive", None), (None, 0.5), (None, None), ("yes", 0.4)], extract.positive(F.col("l"), F.col("s")))
    assert [g[0] for g in got] == [True, True, False, True, False, False]


def test_labels_of_the_last_line(rows):
    got = rows("t string", [("B or C?\nAnswer:",), ("A here\n\nD, b\nAnswer: **",), ("Answer: ",)], extract.choice_labels(F.col("t"), ("A", "B", "C", "D"), prefix="Answer:"))
    assert got[2] == (None,) and got[0] == (None,)


def test_waits_and_classes(rows):
    data = [(500, ""), (409, None), (418, "x cloudflared x"), (418, ""), (503, "Maximum context length"), (429, "maximum context length"), (200, "token limit")]
    assert [g[0] for g in rows("s int, b string", data, extract.error_class(F.col("s"), F.col("b")))] == ["transient", "transient", "transient", "unknown", "context_length", "rate_limit", "ok"]


def test_loads_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, q array<struct<text:string>>")
    assert loads.exploded(empty, "q", ["k"], ("text",)).count() == 0
    df = spark.createDataFrame([(1, None), (2, []), (3, [(None,), ("",), ("x",)])], "k int, q array<struct<text:string>>")
    assert [tuple(r) for r in loads.exploded(df, "q", ["k"], ("text",)).collect()] == [(3, 2, "x")]
    assert loads.vocabulary(df, "q", "text").first()["vocabulary"] == ["", "x"]


def test_votes_without_options(spark):
    df = spark.createDataFrame([("i", ["A"], ["a"]), ("j", [], [])], "sample_id string, labels array<string>, options array<string>")
    got = sorted((r["sample_id"], r["group_id"]) for r in frames.for_modes(df, per_option=True, votes=2).collect())
    assert got == [("i#bov0#sc0", "i"), ("i#bov0#sc1", "i"), ("j#sc0", "j"), ("j#sc1", "j")]
