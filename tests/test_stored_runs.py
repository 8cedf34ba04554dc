"""Stored runs rebuilt: how often their files are read, and records of odd shapes."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from verdigris.operators import rebuild
from verdigris.plans import stored_runs
from verdigris.plans.catalogue import QUERIES


def final_plan(df) -> str:
    """The plan as it ran, where equal exchanges are one."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def run(tmp_path):
    """write(folder, file, lines): a file of a task; returns the run's path."""

    def write(folder: str, file: str, *lines: dict | str) -> str:
        at = tmp_path / "datasets" / folder
        os.makedirs(at, exist_ok=True)
        (at / file).write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
        return str(tmp_path)

    return write


def test_tasks_read_records_once(spark, small):
    found = final_plan(QUERIES["rebuilt_tasks"](spark, small))
    # records, and what two files of a task say; names come from a listing
    assert found.count("FileScan json") == 3 and found.count("FileScan binaryFile") == 3
    # only versions of a record, which are few, meet in sorted aggregates; counts and means are sums of numbers
    assert "posexplode" in found and "HashAggregate(keys=[dataset_id" in found


def test_rows_are_dealt_out_whatever_their_folders(spark):
    rows = spark.range(0, 2_100_000, 1, 1).select("id", *[F.lit("x").alias(c) for c in ("dataset_id", "model_id", "template")])
    held = stored_runs.dealt(rows).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 2_100_000 and max(r["count"] for r in held) <= 1_000_000 and len(held) > 1


def test_tasks_of_odd_records(spark, run):
    record = {"sample_id": "a", "prompt_fingerprint": "p", "status": "ok", "seq": 5, "metrics": {"m": 1, "n": "None"}, "response": {"content": "x", "latency_s": 2.0}}
    head, member = {"sample_id": "g", "metadata": {"reduced": True}, "seq": 3, "status": "ok", "metrics": {"m": 0}}, {"sample_id": "b", "group_id": "g", "seq": 4, "status": "error"}
    run("d%2F1+x/m/t@2", "records.jsonl", record, record | {"seq": 6, "metrics": {"m": 0.5}, "parse_ok": False, "prompt_mode": "late"}, record | {"prompt_fingerprint": "q", "seq": 7, "status": "truncated", "prompt_mode": "later"}, head, member, json.dumps(record)[:30])
    # a head that is none in its last version, and a member whose group's head stands in another task
    run("e/m/t", "records.jsonl", head | {"seq": 1}, head | {"seq": 2, "metadata": None, "status": "empty", "metrics": None}, member, {"status": "ok", "seq": 1})
    run("e/m/t@1.0", "records.jsonl", {"sample_id": "z", "status": "skipped", "selection_mode": "SOV"})
    at = run("e/m/t@1.0", "metrics.json", {"metrics": {"m": 0.75}, "primary_metric": "m"})
    got = {r["dataset_id"]: r.asDict() for r in rebuild.run_tasks(spark, at).collect()}
    assert set(got) == {"d/1+x", "e"}
    one, two = got["d/1+x"], got["e"]
    assert (one["n_planned"], one["n_scored"], one["n_error"], one["metrics"], one["latency_s_mean"]) == (3, 3, 0, {"m": 0.5}, 2.0)
    assert (one["prompt_mode"], one["template_version"], one["parse_failure_rate"], one["truncation_rate"]) == ("io", "2", 1 / 3, 1 / 3)
    # without metrics of its records a task has what its own file says; a record without a sequence stands first
    assert (two["n_planned"], two["n_scored"], two["n_error"], two["n_skipped"], two["metrics"], two["primary"], two["latency_s_mean"]) == (3, 1, 1, 1, {"m": 0.75}, 0.75, None)
    assert (two["selection_mode"], two["template_id"], two["template_version"]) == ("SOV", "t", "1.0")


def test_columns_of_records(spark, run):
    at = run("d/m/t@2", "records.jsonl", {"sample_id": "a", "seq": 1, "response": {"content": "long", "latency_s": 2.0}})
    assert rebuild.run_records(spark, at, ("response.latency_s", "task_kind")).collect() == [("d", "m", "t", "2", "a", None, (2.0,), "generation")]
    assert set(rebuild.run_records(spark, at).columns) >= {*rebuild.TASK, "seq", "response", "metadata", "created_at"}


def test_turns_read_their_files_once(spark, small):
    found = final_plan(QUERIES["rebuilt_turns"](spark, small))
    assert found.count("FileScan json") == 2 and "content" not in found.split("FileScan json")[0]


def test_turns_take_the_latest_record(spark, run):
    run("d/m/t@1", "records.jsonl", *[{"sample_id": "a", "prompt_fingerprint": f"p{k}", "seq": k, "status": f"s{k}", "prediction": str(k)} for k in (3, 9, 1)])
    at = run("d/m/t@1", "turns.jsonl", {"sample_id": "a", "turn_number": 1}, {"sample_id": "a", "turn_number": 2}, {"sample_id": "b", "turn_number": 1}, {"sample_id": "c"}, {"turn_number": 4})
    got = rebuild.run_turns(spark, at).select("sample_id", "turn_number", "is_last", "record_status", "prediction").collect()
    assert sorted(map(tuple, got)) == [("a", 1, False, None, None), ("a", 2, True, "s9", "9"), ("b", 1, True, None, None), ("c", None, None, None, None)]


def test_prompts_read_records_once(spark, small):
    found = final_plan(QUERIES["rebuilt_prompts"](spark, small))
    assert found.count("FileScan json") == 1 and "created_at" not in found
