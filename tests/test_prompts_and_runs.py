from __future__ import annotations

import gzip
import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.functions import judging, notation, prompts, shapes
from verdigris.functions.stem import stem
from verdigris.operators import episodes, folds, retrieval
from verdigris.plans import datasets, reports
from verdigris.sources import config, documents, workbooks


def test_prompt_of_nothing(rows):
    """Null parts leave the mode's scaffolding alone."""
    none = {k: F.lit(None) for k in ("system", "context", "question")}
    got = rows("m string, s string", [("io", None), ("cot", "MCS")], prompts.static_messages(none, F.col("m"), F.col("s")), prompts.protocol_messages({}, F.col("m")))
    for mode, (static, protocol) in zip(("io", "cot"), got, strict=True):
        line = prompts.DIRECT if mode == "io" else prompts.STEPS.format(prompts.MANY)
        assert [m["role"] for m in static] == ["system", "user"] and static[0]["content"].startswith(line) and static[1]["content"] == "Give your answer."
        assert [(m["role"], m["content"]) for m in protocol] == [("user", line)]


def test_named_choices(rows):
    got = rows("l array<string>", [([],), (["1"],), (["A", "B"],), (["A", "B", "C"],)], prompts.label_choice(F.col("l")))
    assert [g[0] for g in got] == ["the label", "1", "A or B", "A, B or C"]


def test_templates_that_fail(tmp_path):
    (tmp_path / "a.yaml").write_text("templates:\n  - id: x\n    messages: [{role: user, content: 'q {{ a }}'}]\n  - id: y\n    version: 2\n    messages: [{role: user, content: z}]\n")
    found = documents.templates([tmp_path])
    assert sorted(found) == ["x", "y"] and found["y"]["version"] == "2" and found["x"]["version"] == "1.0"
    for bad in ("{{ b }}", "{% if a %}x", "{% if a %}{% for k in b %}{% endfor %}{% endif %}", "{% else %}", "{{ a | nothing }}", "{{ a b }}", "{% for %}{% endfor %}"):
        with pytest.raises(prompts.TemplateError):
            prompts.rendered([{"role": "user", "content": bad}], {"a": F.lit(1)})
    with pytest.raises(prompts.TemplateError):
        prompts.rendered(found["x"]["messages"], {"a": F.lit(1)}, required=("k",))
    (tmp_path / "b.json").write_text(json.dumps({"id": "x", "messages": [{"role": "user", "content": ""}]}))
    with pytest.raises(prompts.TemplateError, match="x is in"):
        documents.templates([tmp_path])
    (tmp_path / "b.json").write_text(json.dumps({"id": "z", "messages": [{"role": "user"}]}))
    with pytest.raises(prompts.TemplateError):
        documents.templates([tmp_path])


def test_documents(tmp_path, spark):
    with gzip.open(tmp_path / "i.yaml.gz", "wt") as f:
        f.write("- {id: 1, gold: a}\n- {id: 2, gold: ''}\n- 3\n")
    whole, lacking = documents.instances(documents.document(tmp_path / "i.yaml.gz"), ("id", "gold"))
    assert whole == [{"id": 1, "gold": "a"}] and lacking == {"id": 1, "gold": 2}
    assert documents.instances(None, ("id",)) == ([], {"id": 0})
    assert documents.first_existing([tmp_path / "no", tmp_path]) == tmp_path and documents.first_existing([]) is None
    (tmp_path / "run.yaml").write_text("extends: base.json\na: {y: 2}\n")
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": 1}}))
    assert config.load_layers(tmp_path / "run.yaml")["a"] == {"x": 1, "y": 2}
    tables, skipped = documents.loaded({"ok": lambda: spark.range(3), "gone": lambda: spark.read.schema("a int").json(str(tmp_path / "none.json")), "bad": lambda: spark.createDataFrame(documents.document(tmp_path / "lost.json"))})
    assert list(tables) == ["ok"] and sorted(skipped) == ["bad", "gone"] and all(skipped.values())


def test_judge_contracts(rows):
    fields = {"l": "list_of_binary", "n": "nonnegative_integer_or_null", "s": "string_or_null", "u": "unheard_of"}
    good = ['{"l": [], "n": null, "s": null, "u": {}}', '{"l": [1, 0], "n": 3, "s": "3", "u": 1}', '{"l": [1, 0.0], "n": 3.0, "s": "{", "u": 1}']
    bad = [None, "", "[1]", '{"l": ["1"], "n": 1, "s": "", "u": 1}', '{"l": [2], "n": 1, "s": "", "u": 1}', '{"l": [1], "n": "3", "s": "", "u": 1}', '{"l": [1], "n": -1, "s": "", "u": 1}', '{"l": [1], "n": 1, "s": 3, "u": 1}', '{"l": [1], "n": 1, "s": ""}', '{"l": [null], "n": 1, "s": "", "u": 1}', "{'l': [1]}"]
    got = rows("r string", [(r,) for r in good + bad], judging.verdict_object(F.col("r"), fields))
    assert [g[0] is not None for g in got] == [True] * len(good) + [False] * len(bad)
    last = rows("r string", [('{"l": 1} then {"l": 2} and {"x": 3}',)], judging.verdict_object(F.col("r"), {"l": "nonnegative_integer"}))
    assert json.loads(last[0][0]) == {"l": 2}


def test_notation_of_nothing(rows):
    got = rows("t string", [(None,), ("",), ("a=b=c)",), ("f(x))), g(y",), ("\\sqrt[3]{x}",), ("\\infty \\theta_1E^2",)], notation.plain_math(F.col("t")))
    assert [g[0] for g in got] == ["", "", "a=b=c", "f(x))*g(y", "((x)**(1/(3)))", "oo theta_1*E**2"]
    sections = rows("t string", [(None,), ("variables: ['a', 'b']\nVariables: none\nequations:\nUnits of measure of variables: [s, m]",)], notation.system_sections(F.col("t")))
    assert len(sections[0][0]) == 8 and not any(sections[0][0].values())
    assert sections[1][0]["variables"] == [] and sections[1][0]["units_variables"] == ["s", "m"] and sections[1][0]["equations"] == []


def test_stems():
    # examples of the published algorithm
    known = "consistency consist, consolatory consolatori, conspirators conspir, kneeled kneel, knightly knight, knives knive, knocker knocker, generously generous, communication communic, hopping hop, hoping hope, ties tie, cries cri, gas gas, this this, skies sky, inning inning, say say, by by"
    assert all(stem(a) == b for a, b in (pair.split() for pair in known.split(", ")))


def test_ranking_of_stems(spark):
    """Against a plain version, with documents that a query may not find."""
    docs = [(0, "coughs and coughing at night"), (1, "the pain"), (2, "night pains, painful cough"), (3, None), (4, "")]
    asked = [(7, "Do you cough at night?"), (8, "any of the"), (9, "painful")]
    allowed = [(7, 0), (7, 1), (7, 2), (9, 1), (9, 3)]
    term = lambda s: [stem(w) for w in "".join(c if c.isalnum() else " " for c in (s or "").lower()).split() if w not in retrieval.STOP_WORDS]
    bags = {k: Counter(term(s)) for k, s in docs}
    size = sum(sum(b.values()) for b in bags.values()) / len(docs)
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: math.log((len(docs) - n + 0.5) / (n + 0.5) + 1) for t, n in df.items()}
    score = lambda q, b: sum(idf[t] * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / size)) for t in set(term(q)) if t in b) / sum(idf[t] for t in set(term(q)) if t in idf)
    want = {(q, k): score(s, bags[k]) for q, s in asked for k in bags if (q, k) in allowed and set(term(s)) & set(bags[k])}
    out = retrieval.bm25_topk(spark.createDataFrame(asked, "q int, text string"), spark.createDataFrame(docs, "d int, text string"), "q", "d", "text", 3, stop=retrieval.STOP_WORDS, stem=True, allowed=spark.createDataFrame(allowed, "q int, d int"))
    got = {(r["q"], r["d"]): r["score"] for r in out.collect()}
    assert got == pytest.approx(want) and (7, 0) in got and (9, 1) in got


def test_printed_numbers(rows):
    values = [9.05, 9.15, 9.25, 0.25, 2.675, 1.005, 0.45, 0.05, -9.05, -0.25, 1e-9, 0.0, 123456.05, 0.00005, 0.12345, 1e20, 3.0]
    for digits in (1, 2, 4):
        got = rows("v double", [(v,) for v in values], shapes.round_report(F.col("v"), digits))
        assert [g[0] for g in got] == [round(v, digits) for v in values]
    assert rows("v double", [(None,)], shapes.round_report(F.col("v"))) == [(None,)]


def test_groups_folded(spark):
    schema = "sample_id string, group_id string, pos int, prediction string, parse_ok boolean, score double, yes boolean, bov_index int, bov_label string, gold_labels array<string>, dataset string"
    data = [("a#0", "a", 0, "yes", True, 1.0, True, 0, "A", ["A"], "d"), ("a#1", "a", 1, "no", True, 0.0, False, 1, "B", ["A"], "d"), ("b#0", "b", 0, None, False, 0.0, False, 0, "A", ["A"], "d"), ("c", None, 0, "x", True, 0.5, None, None, None, None, "d"), ("e", "", 0, "y", True, 0.5, None, None, None, None, "d")]
    df = spark.createDataFrame(data, schema)
    pick = lambda out: sorted((r["sample_id"], r["prediction"], r["score"], r["reduced"], r["n_members"], r["dataset"]) for r in out.collect())
    assert pick(folds.reduce_groups(df, "io", "BOV", ("dataset",))) == [("a", "A", 1.0, True, 2, "d"), ("b", "none", 0.0, True, 1, "d"), ("c", "x", 0.5, False, 1, "d"), ("e", "y", 0.5, False, 1, "d")]
    assert [r[:2] for r in pick(folds.reduce_groups(df, "self-consistency", "n/a", ("dataset",)))] == [("a", "yes"), ("b", None), ("c", "x"), ("e", "y")]
    assert len(pick(folds.reduce_groups(df, "cot", "SCS", ("dataset",)))) == 5
    assert folds.reduce_groups(df.limit(0), "io", "BOV").count() == 0


def test_episodes_of_nothing(spark):
    asks = spark.createDataFrame([(1, 1, "c", ["a.x", "a.x", "gone"]), (1, 2, "c", ["a.y"]), (1, 3, "c", []), (1, 4, "z", ["a.x"])], "episode int, turn int, category string, keys array<string>")
    case = spark.createDataFrame([(1, "c", k) for k in ("a.x", "a.y", "a.y.z", "b")], "episode int, category string, key string")
    got = [tuple(r) for r in episodes.disclosed(asks, case).orderBy("turn").collect()]
    assert got == [(1, 1, ["a.x", "a.y"], 2, 2), (1, 2, ["a.x", "a.y"], 0, 2), (1, 3, [], 0, 2), (1, 4, [], 0, 2)]
    payloads = spark.createDataFrame([("1", None), ("2", "{"), ("3", '{"request": {"sample_ids": ["s"], "messages": [{"content": "x"}]}}'), ("4", '{"request": {"sample_ids": ["q"], "messages": []}}'), ("5", '{"other": 1}')], "path string, body string")
    assert [tuple(r) for r in episodes.stored_conversations(payloads).collect()] == [("q", [])]
    e = spark.createDataFrame([("s", ["x", ""]), ("t", [])], "sample_id string, predictions array<string>")
    none = spark.createDataFrame([], "sample_id string, asks string, at int, positive boolean")
    got = {r["sample_id"]: (r["turn_correct"], r["turn_verdicts_missing"]) for r in episodes.turn_verdicts(e, none).collect()}
    assert got == {"s": ([0, 0], 1), "t": ([], 0)}


def test_workbooks(tmp_path, spark):
    df = spark.createDataFrame([("a&<b>\x01", 1, 2.5, True, None), (None, 2, float("nan"), False, " x ")], "Question string, n int, v double, ok boolean, note string")
    data = workbooks.workbook({"one/two": df, "one:two": df.limit(0), "x" * 40: df.select("n"), "x" * 35: df.select("n")})
    (tmp_path / "r.xlsx").write_bytes(data)
    (tmp_path / "broken.xlsx").write_bytes(b"PK no")
    got = workbooks.read_workbooks(spark, str(tmp_path), ["question", "v", "absent", "note"]).orderBy("row_no").drop("path")
    assert [tuple(r) for r in got.collect()] == [(0, "a&<b>", "2.5", None, None), (1, None, None, None, " x ")]
    assert workbooks.read_workbooks(spark, str(tmp_path), ["question"], needed="question").count() == 1
    assert workbooks._sheet_names(["a/b", "a:b", "A_B", ""]) == ["a_b", "a_b~2", "A_B~3", "sheet"]
    with pytest.raises(ValueError):
        workbooks.workbook({"s": df}, most=1)


def test_tables_of_nothing(spark):
    df = spark.createDataFrame([("d", 1.0, None), ("e", None, None)], "d string, a double, b double")
    assert [r["line"] for r in reports.latex_rows(df, ["d"], ["a", "b"]).orderBy("d").collect()] == ["d & \\textbf{1.0} & -- & 1.0 \\\\", "e & -- & -- & -- \\\\"]
    assert reports.latex_averages(df, 1, ["a", "b"]).first()["line"] == "\\textbf{Average} & \\textbf{1.0} & -- & \\\\"
    assert "_None._" in reports.run_report("r", {"seed": 1}, {"x": df.limit(0), "y": df})


def test_library_agrees_with_plans(spark):
    """One pass over all datasets gives what each plan gives by itself."""
    data = [("aer", "Answer: A, C", None, ["A"], None, None), ("xcopa", "Answer: b", "B", None, None, None), ("abd", "Answer: q", None, None, "yes", None), ("ddxplus", "Answer: flu", "flu", None, None, None), ("uniadilr_hgc", "Answer: 3", None, ["3"], None, None), ("aiops2025", "x", "y", None, None, None)]
    df = spark.createDataFrame(data, "dataset_id string, content string, gold string, gold_labels array<string>, verdict_label string, verdict_score double")
    df = df.withColumns({"accepted": F.lit(None).cast("array<string>"), "strata": F.create_map(F.lit("lang"), F.lit("et"), F.lit("level"), F.lit("9"))})
    got = {(r["dataset_id"], r["metric"]): r["value"] for r in datasets.aggregate_library(datasets.score_library(df)).collect()}
    want = {}
    for name in {d[0] for d in data}:
        plan = datasets.PLANS[name]
        own = df.where(F.col("dataset_id") == name).withColumns({s: F.try_element_at("strata", F.lit(s)) for s in plan.strata})
        want |= {(name, r["metric"]): r["value"] for r in plan.aggregate(plan.score(own)).collect()}
    assert got == pytest.approx(want) and ("xcopa", "accuracy_et") in got
    unknown = datasets.score_library(df.withColumn("dataset_id", F.lit("none")))
    assert datasets.aggregate_library(unknown).count() == 0
