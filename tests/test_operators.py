"""Folds, averages, records, draws and windows on small tables with edge rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verdigris.operators import aggregate, expand, folds, ranks, reasoning, records, sampling, windows
from verdigris.plans import reports
from verdigris.sources import readers, sinks


def table(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_vote_ties_and_failures(spark):
    df = table(spark, "g int, pos int, p string, ok boolean, s double", (1, 0, "x", True, 0.1), (1, 1, "y", True, 0.2), (2, 0, "x", True, 0.1), (2, 1, "y", True, 0.2), (2, 2, "y", True, 0.3), (3, 0, "z", False, 0.5), (4, 0, None, True, 0.6))
    got = {r["g"]: r for r in folds.vote(df, "g", "pos", "p", "ok", "s").collect()}
    assert (got[1]["prediction"], got[1]["agreement"]) == ("x", 0.5)
    assert (got[2]["prediction"], got[2]["score"], got[2]["agreement"]) == ("y", 0.2, pytest.approx(2 / 3))
    assert (got[3]["prediction"], got[3]["agreement"]) == ("z", None)
    assert got[4]["agreement"] == 1.0


def test_best_of_n(spark):
    df = table(spark, "i int, pos int, m double", (1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (2, 0, None), (3, 0, float("nan")))
    assert [(r["i"], r["pos"]) for r in folds.best_of_n(df, "i", "m", "pos").collect()] == [(1, 1)]


def test_repeat_spread_is_of_the_population(spark):
    df = table(spark, "i int, p string, s double", (1, "a", 1.0), (1, "b", 0.0), (2, "c", 1.0))
    got = folds.repeat_statistics(df, [], "i", "p", "s").first()
    assert (got["repeat_agreement"], got["repeat_std"], got["n_items"]) == (0.0, 0.5, 1)


def test_co_averaged(spark):
    names = aggregate.CO_AVERAGED[0]
    rows = [({names[0]: 10.0, names[1]: 5.0, names[2]: 0.5},), ({names[0]: 90.0},), ({"other": float("nan")},)]
    got = {r["metric"]: r["value"] for r in aggregate.sparse_mean(table(spark, "metrics map<string,double>", *rows), []).collect()}
    assert got == {names[0]: 10.0, names[1]: 5.0, names[2]: 0.5}


def test_answered_and_strict(spark):
    df = table(spark, "t int, x double, status string", (1, 1.0, "ok"), (1, 1.0, "ok"), (1, 0.0, "ok"), (1, None, "truncated"))
    got = aggregate.task_metrics(df, ["t"], "x", F.col("status") == "ok", F.lit(4)).first()
    assert (got["value"], got["strict"]) == (pytest.approx(2 / 3), 0.5)


def test_macro(spark):
    assert aggregate.macro_average(table(spark, "g string, v double", ("a", 1.0), ("a", 0.0), ("b", 1.0)), [], "g", "v").first()[0] == 0.75


def test_last_write_wins(spark):
    df = table(spark, "k string, seq int, v string", ("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"))
    assert sorted((r["k"], r["v"], r["first_seq"]) for r in records.dedupe_last(df, ["k"], "seq").collect()) == [("a", "z", 1), ("b", "y", 2)]


def test_draws_are_prefixes_and_salts_differ(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    few, many = ([r["k"] for r in sampling.sample_prefix(df, "k", n, 1).orderBy("pool_rank").collect()] for n in (10, 30))
    assert many[:10] == few
    assert [r["k"] for r in sampling.sample_prefix(df, "k", 10, 1, "other").collect()] != few
    extra = sampling.replacements(df, "k", spark.createDataFrame([(k,) for k in few], "k long"), 5, 1)
    assert {r["k"] for r in extra.collect()} == set(many[10:15])
    assert [r["k"] for r in sampling.sample_offset(df, "k", F.lit(True), 10, 5, 1).orderBy("pool_rank").collect()] == many[10:15]


def test_fair_caps():
    assert sampling.fair_caps([10, 2, 2], 8) == [4, 2, 2]
    assert sampling.fair_caps([1, 1], 8) == [1, 1]
    assert sum(sampling.fair_caps([7, 7, 7], 8)) == 8


def test_expansion(spark):
    df = table(spark, "sample_id string, labels array<string>, options array<string>", ("q", ["A", "B"], ["x", "y"]), ("e", [], []), ("n", None, None))
    got = sorted((r["sample_id"], r["group_id"], r["bov_label"]) for r in expand.options(df).collect())
    assert got == [("e", None, None), ("n", None, None), ("q#bov0", "q", "A"), ("q#bov1", "q", "B")]
    assert sorted(r["sample_id"] for r in expand.repeats(df, 2).collect())[:2] == ["e#r0", "e#r1"]
    flat = expand.flatten_fields(table(spark, "id int, j string", (1, '{"a": {"b": "x", "c": null}, "d": ["p", "q"], "e": ""}')), "id", "j")
    assert sorted((r["key"], r["value"]) for r in flat.collect()) == [("a.b", "x"), ("d", "p, q")]
    deep = expand.flatten_fields(table(spark, "id int, j string", (1, '{"a": {"b": {"c": {"d": {"e": 1.50}}}}, "f": [1, null, " ", {"g": true}]}'), (2, None), (3, "[1]"), (4, "{"), (5, "{}")), "id", "j")
    assert [tuple(r) for r in deep.collect()] == [(1, "a.b.c.d.e", "1.50"), (1, "f", '1, {"g": true}')]


def test_kendall_and_spearman(spark):
    df = table(spark, "g int, a int, b int", *[(1, x, y) for x, y in zip([1, 2, 2, 3], [1, 2, 3, 4])], (2, 1, 1), *[(3, k, 3 - k) for k in range(3)])
    got = {r["g"]: r["tau_b"] for r in ranks.kendall_tau_b(df, ["g"], "a", "b").collect()}
    assert got[1] == pytest.approx(5 / 30**0.5) and got[2] == 0.0 and got[3] == -1.0
    got = {r["g"]: r["spearman"] for r in ranks.spearman(df, ["g"], "a", "b").collect()}
    assert got[2] == 0.0 and got[3] == pytest.approx(-1.0)


def test_overall_is_on_every_row(spark):
    df = table(spark, "d string, m string, v double", ("x", "a", 10.0), ("x", "b", 20.0), ("x", "c", 30.0), ("x", "d", float("nan")))
    assert {r["overall"] for r in reports.question_level_overall(df, ["d"], "v").collect()} == {20.0}


def test_reasoning(spark):
    lists = {
        "observations_per_step": [1.0, 1.0, 1.0, 0.0], "branchiness_per_step": [1.0, 1.0, 0.0, 0.0], "mentions_per_step": [1.0, 2.0, 1.0, 0.0], "step_directionality": [1.0, 1.0, 0.5, 0.5],
        "comparisons_per_step": [0.0, 1.0, 0.0, 0.0], "uncertainty_per_step": [1.0, 0.0, 1.0, 0.0], "prior_knowledge_per_step": [2.0, 1.0, 0.0, 0.0], "gold_alive_per_step": [1.0, 1.0, 1.0, 0.0],
        "unresolved_per_step": [0.0] * 4, "backtracking_per_step": [0.0] * 4, "proof_disproof_per_step": [1.0, 0.0, 1.0, 1.0], "helpfulness_per_step": [1.0, 1.0, 0.0, -1.0],
    }
    schema = "steps array<string>, observations array<string>, directionality double, anchoring_step int, anchoring_given boolean, diversity double, judged_options double, option_count int, selection boolean, correct boolean, trace_chars int, metrics_source string, " + ", ".join(f"{k} array<double>" for k in lists)
    head = (["a", "b", "c", "d"], ["o", "p", "q"], 1.0, 1, True, 1.0, None, 0, False, False, 10, "log")
    short = [v if k != "helpfulness_per_step" else [1.0] for k, v in lists.items()]
    df = table(spark, schema, (*head, *lists.values()), (*head, *short), ([], *head[1:], *lists.values()))
    good, bad, empty = reasoning.derive(df).collect()
    assert (good["total_steps"], good["observation_coverage"], good["step_directionality_mean"], good["differential_elimination_normalized"]) == (4.0, 1.0, 0.75, 0.25)
    assert (good["comparison_exhaustiveness"], good["uncertainty_rate"], good["prior_knowledge"], good["prior_knowledge_normalized"], good["gold_alive_rate"], good["anchoring_point_normalized"]) == (1.0, 0.5, 3.0, 0.5, 0.75, 0.25)
    assert good["errors"] == [] and bad["helpful_steps"] is None and bad["errors"] == ["helpfulness_per_step:missing_or_not_one_value_per_step"]
    assert empty["total_steps"] is None and "steps:no_reasoning_chain_to_segment" in empty["inapplicable"]
    found = {(r["rule"]) for r in reasoning.hits(reasoning.derive(df.limit(1)), reasoning.interesting(), ["selection"]).collect()}
    assert {"evidence_first_full_coverage_but_wrong", "gold_in_play_most_steps_but_wrong", "late_derailment"} <= found


def test_readers_and_sinks(spark, tmp_path):
    log = tmp_path / "r.jsonl"
    log.write_text('{"a": 1}\n\n{"a": 2}\n{"a": ')
    assert sorted(r["a"] for r in readers.jsonl(spark, str(log), "a int").collect()) == [1, 2]
    (tmp_path / "x.tsv").write_text("h\tk\n1\t007\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "x.tsv")).collect()] == [("1", "007")]
    (tmp_path / "l.txt").write_text(" one \n\n two\n")
    assert [r["value"] for r in readers.lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two"]
    left, right = (readers.numbered_lines(spark, str(tmp_path / n)) for n in ("l.txt", "x.tsv"))
    with pytest.raises(ValueError):
        readers.zip_join(left, right)
    paths = table(spark, "path string", "/d/train.json".split(), "/d/my_dev.json".split(), "/d/contest.json".split())
    assert readers.pick_split(paths).first()["split"] == "dev"
    assert readers.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    out = str(tmp_path / "out")
    sinks.append(table(spark, "dataset_id string, v int", ("d", 1)), out)
    sinks.append(table(spark, "dataset_id string, v int", ("d", 2)), out)
    assert spark.read.parquet(out).where("dataset_id = 'd'").count() == 2
    merged = records.merge_update(table(spark, "k int, s double", (1, 0.5), (2, 0.5)), table(spark, "k int, s double", (2, 1.0)), "k", ["s"])
    assert sinks.update(merged, str(tmp_path / "v2")) == 1
    assert "| 1 | 0.5 |" in sinks.markdown(table(spark, "k int, s double", (1, 0.5)))


def test_effects(spark):
    df = table(spark, "g int, v double, ok boolean", *[(1, float(k), k % 2 == 0) for k in range(8)], (2, 1.0, True), (2, 1.0, False), (3, None, True), (3, float("nan"), False))
    got = {r["g"]: (r["effect"], r["n"]) for r in windows.effect_size(df, ["g"], "v", "ok", least=1).collect()}
    assert got[1] == (pytest.approx(-1 / 6**0.5), 8) and got[2] == (None, 2) and 3 not in got
    few = windows.effect_size(df, ["g"], "v", "ok")
    assert windows.effect_over_cells(few, []).first()["cells"] == 0
    flips = windows.direction_flips(table(spark, "m string, auc double", ("a", 0.6), ("a", 0.4), ("b", 0.6), ("c", 0.9), ("c", None)), "m")
    assert {(r["m"], r["direction_flips"]) for r in flips.collect()} == {("a", True), ("b", False), ("c", False)}
