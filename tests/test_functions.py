"""Worked examples and edge rows of the scalar functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from verdigris.functions import extract, stats, text, validators


def test_normalize(rows):
    got = rows("a string", [("The  Big-Cat!",), (None,), ("",), (" \t ",), ("Crème brûlée",)], text.normalize_answer(F.col("a")))
    assert [g[0] for g in got] == ["big cat", "", "", "", "creme brulee"]


def test_matching(rows):
    got = rows("a string, b string", [("A cat.", "the cat"), ("", ""), ("", "x"), ("it is the cat here", "cat"), ("x", None)], text.exact_match(F.col("a"), F.col("b")), text.contains_match(F.col("a"), F.col("b")), text.token_prf(F.col("a"), F.col("b"))["f1"])
    assert got[0] == (1.0, 1.0, 1.0)
    assert got[1] == (1.0, 0.0, 1.0)
    assert got[2] == (0.0, 0.0, 0.0)
    assert got[3][1] == 1.0 and got[3][2] == pytest.approx(2 * 0.25 / 1.25)
    assert got[4] == (0.0, 0.0, 0.0)


def test_repeated_words_count(rows):
    got = rows("a string, b string", [("x x y", "x y y")], text.token_prf(F.col("a"), F.col("b"))["precision"])
    assert got[0][0] == pytest.approx(2 / 3)


def test_rouge_and_bleu(rows):
    got = rows("a string, b string", [("b c d e", "b c d e"), ("", "x"), ("b q d", "b d")], text.rouge_l(F.col("a"), F.col("b"))["f"], text.bleu(F.col("a"), F.col("b")), text.rouge_l(F.col("a"), F.col("b"))["recall"])
    assert got[0][:2] == (pytest.approx(1.0), pytest.approx(1.0))
    assert got[1][:2] == (0.0, 0.0)
    assert got[2][2] == 1.0


def test_sets(rows):
    data = [([], []), (["a"], ["b"]), (["1", "2"], ["2", "3"])]
    got = rows("p array<string>, g array<string>", data, text.set_prf(F.col("p"), F.col("g"))["f1"], text.jaccard(F.col("p"), F.col("g")))
    assert got[0] == (1.0, 1.0) and got[1] == (0.0, 0.0) and got[2][1] == pytest.approx(1 / 3)


def test_ranked(rows):
    r = F.col("r")
    got = rows("r array<string>", [(["a", "b", "c"],)], stats.hits_at_k(r, F.lit("c"), 3), stats.hits_at_k(r, F.lit("c"), 2), stats.reciprocal_rank(r, F.lit("b")), stats.reciprocal_rank(r, F.lit("z")))
    assert got[0] == (1.0, 0.0, 0.5, 0.0)


def test_numbers(rows):
    got = rows("a string, b string", [("10.2", "10.0"), ("abc", "10"), ("0.04", "0"), (None, "1"), ("NaN", "1")], stats.numeric_match(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [1.0, 0.0, 1.0, 0.0, 0.0]
    got = rows("p string", [("0.9",), ("x",), ("7",)], stats.brier(F.col("p"), F.lit(1)))
    assert [g[0] for g in got] == [pytest.approx(0.01), 1.0, 0.0]
    got = rows("v int", [(1300,), (100,)], stats.quantize(F.col("v")))
    assert [g[0] for g in got] == [1024, 512]
    assert rows("t string", [("12345678",), ("",), (None,)], stats.token_estimate(F.col("t"))) == [(3,), (0,), (0,)]
    low, high = rows("k int", [(5,)], stats.wilson(F.col("k"), F.lit(10)))[0][0]
    assert (round(low, 4), round(high, 4)) == (0.2366, 0.7634)


def test_summary_skips_what_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", float("nan")), ("a", None), ("b", float("nan"))], "k string, v double")
    got = {r["k"]: r for r in df.groupBy("k").agg(*stats.summary(F.col("v"))).collect()}
    assert got["a"]["mean"] == 2.0 and got["a"]["std"] == 1.0 and got["a"]["ci95"] == pytest.approx(1.96 / math.sqrt(3))
    assert got["b"]["mean"] == 0.0 and got["b"]["n"] == 0.0 and got["b"]["std"] == 0.0


def test_answer_span(rows):
    data = [("x Answer: one. Answer: two",), ("**bold**",), (None,), ("no marker",)]
    assert [g[0] for g in rows("t string", data, extract.answer_span(F.col("t"), prefix="Answer:"))] == ["two", "bold", "", "no marker"]


def test_choice_labels(rows):
    data = [("Answer: (b) since",), ("The answer is C.",), ("maybe A, no: D",), ("nothing here?",), (None,), ("Answer: A and c",), ("Answer: none",), ("A is odd.\nAnswer: who knows",)]
    one = [g[0] for g in rows("t string", data, extract.choice_label(F.col("t"), ("A", "B", "C", "D"), prefix="Answer:"))]
    assert one[:5] == ["B", "C", "D", None, None]
    many = [g[0] for g in rows("t string", data, extract.choice_labels(F.col("t"), ("A", "B", "C", "D"), prefix="Answer:"))]
    assert many[5] == ["A", "C"] and many[6] == [] and many[7] is None


def test_yes_no(rows):
    data = [("Answer: Yes.",), ("Answer: no",), ("Perhaps yes",), ("",), (None,)]
    assert rows("t string", data, extract.said_yes(F.col("t")), extract.parsed_yes_or_no(F.col("t"))) == [(True, True), (False, True), (False, False), (False, False), (False, False)]


def test_trace_and_missing_answer(rows):
    data = [("<think>T</think><answer>x</answer>", "R", "stop"), ("<answer>x</answer>", "R", "stop"), ("<think>.</think><answer>x</answer>", "", "stop"), ("prose", None, "stop"), ("<think>cut off here", "", "length"), ("", None, "stop")]
    got = rows("c string, r string, f string", data, extract.reasoning_trace(F.col("c"), F.col("r")), extract.missing_answer(F.col("c"), F.col("f")))
    assert [tuple(g[0]) for g in got] == [("T", "visible_cot"), ("R", "native_reasoning"), ("", "none"), ("prose", "untagged_prose"), ("cut off here", "visible_cot"), ("", "none")]
    assert [g[1] for g in got] == [None, None, None, None, "cut_off_before_answering", "empty_reply"]


def test_format(rows):
    data = [("<answer>x</answer>", "", False), ("<think>a</think> <answer>x</answer>", "", True), ("<answer>x</answer>", "native", True), ("<answer>x</answer>", "", True), ("so <answer>x</answer>", "", False), ("<answer>x<answer>y</answer>", "", False)]
    assert [g[0] for g in rows("t string, r string, c boolean", data, extract.format_compliance(F.col("t"), F.col("r"), F.col("c")))] == [True, True, True, False, False, False]


def test_numbers_in_text(rows):
    data = [("costs 1,234.5 or",), ("-3",), ("2e3",), ("none",), (None,)]
    assert [g[0] for g in rows("t string", data, extract.first_number(F.col("t")))] == [1234.5, -3.0, 2000.0, None, None]


def test_verdicts(rows):
    data = [("Verdict: yes Score: 7",), ("Verdict: no Score: 70",), ("Verdict: no",), ("Label: yes score: x",)]
    assert [tuple(g[0]) for g in rows("t string", data, extract.verdict(F.col("t"), top=10))] == [("yes", 0.7), (None, None), ("no", None), (None, None)]


def test_contracts(rows):
    data = [([0.0, 1.0],), ([0.5],), ([-1.0, 0.0],), (None,), ([None],)]
    v = F.col("v")
    got = rows("v array<double>", data, validators.binary_list(v), validators.ternary_list(v), validators.directionality_list(v), validators.int_list(v, F.lit(2)))
    assert [tuple(x is not None for x in g) for g in got] == [(True, True, True, True), (False, False, True, False), (False, True, False, False), (False,) * 4, (False,) * 4]


def test_small_helpers(rows):
    assert rows("t string", [("a b c d",)], text.clip_words(F.col("t"), 2))[0][0] == "a b [... 2 more words omitted]"
    assert rows("n int", [(3,), (0,)], text.letter_labels(F.col("n"))) == [(["A", "B", "C"],), ([],)]
    assert rows("t string", [("Big bang (early (hot) universe)",), ("plain",)], text.parenthetical_forms(F.col("t"))) == [(["Big bang", "early (hot) universe"],), ([],)]
    assert rows("t string", [("x = 0",), ("\n a = b^2 ",)], extract.clean_expression(F.col("t"))) == [("x",), ("(a) - (b**2)",)]
    assert rows("t string", [("sent1 & sent22 -> sent3",)], extract.premise_ids(F.col("t"))) == [([1, 22],)]
    assert rows("a string, b string", [("one two three four five", "x one two three four five y"), ("one two", "two and one"), ("six", "one")], text.grounded(F.col("a"), F.col("b"))) == [(True,), (True,), (False,)]
