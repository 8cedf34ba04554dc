"""What grows with the input: how often rows are shuffled, read and held by one task."""

from __future__ import annotations

import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from verdigris.operators import episodes, folds, ranks, records, retrieval
from verdigris.plans import session
from verdigris.plans.catalogue import QUERIES
from verdigris.streaming import reports


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_within_records"])
def test_scores_stay_where_documents_lie(spark, small, name):
    found = plan(QUERIES[name](spark, small))
    # pairs of query and document are never dealt out, and no more than k of a query leave a task
    assert not re.search(r"hashpartitioning\(q#\d+L?, d#", found) and "Partial" in "".join(x for x in found.splitlines() if "WindowGroupLimit" in x)
    assert "ArrowEvalPython" not in found.split("REPARTITION_BY_NUM")[0]


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_repeated_documents_and_large_queries(spark, monkeypatch, few):
    """Rows of one id are one document, also where joins are left to Spark."""
    monkeypatch.setattr(retrieval, "FEW", few)
    docs, asked = [(1, "night"), (1, "cough night"), (2, "night"), (None, "night")], [(7, "Night"), (8, "absent"), (9, "coughs")]
    out = retrieval.bm25_topk(spark.createDataFrame(asked, "q int, text string"), spark.createDataFrame(docs, "d int, text string"), "q", "d", "text", 1, stem=True)
    # of 4 rows with 5 words, night is in three documents; that of length 3 has it twice
    tf = lambda f, n: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / 1.25))
    assert {(r["q"], r["d"]): r["score"] for r in out.collect()} == pytest.approx({(7, 1): tf(2, 3), (9, 1): tf(1, 3)} if tf(2, 3) > tf(1, 1) else {(7, 2): tf(1, 1), (9, 1): tf(1, 3)})


def test_disclosed_without_joins(spark, small):
    found = plan(QUERIES["disclosed_findings"](spark, small))
    assert "Join" not in found and len(re.findall(r"hashpartitioning\(__e", found)) == 1


def test_turns_that_disclose_nothing(spark):
    """Absent categories, empty and missing keys, a limit, a key shown under a parent and by its own name, keys of another case."""
    case = spark.createDataFrame([(1, "c", k) for k in ("a", "a.x", "a.x.y", "b", "b.z")] + [(2, "c", "q"), (1, None, "a")], "episode int, category string, key string")
    asks = [(1, 0, "c", ["q", "b.z", "a.x.y", "b"]), (1, 1, "c", ["a"]), (1, 2, "c", []), (1, 3, None, ["a"]), (1, 4, "c", None), (2, 0, "d", ["q"]), (None, 0, "c", ["a"])]
    got = {(r["episode"], r["turn"]): (r["shown"], r["fresh"], r["n_revealed"]) for r in episodes.disclosed(spark.createDataFrame(asks, "episode int, turn int, category string, keys array<string>"), case, limit=2).collect()}
    none = lambda n: ([], 0, n)
    assert got == {(1, 0): (["a.x", "a.x.y", "b", "b.z"], 4, 4), (1, 1): (["a", "a.x"], 1, 5), (1, 2): none(5), (1, 3): none(5), (1, 4): none(5), (2, 0): none(0), (None, 0): none(0)}


def test_members_dropped_in_one_pass(spark, small):
    found = plan(QUERIES["drop_reduced_members"](spark, small))
    assert "Join" not in found and found.count("FileScan") == 1
    rows = [(1, True), (1, False), (2, False), (2, None), (None, False), (None, True), (None, None), (3, None), (3, True), (1, True)]
    got = folds.drop_members(spark.createDataFrame(rows, "group_id int, reduced boolean")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, True), (1, True), (2, False), (None, False), (None, True), (3, True)], key=str)


def test_fixtures_are_dealt_by_size(spark, small, monkeypatch):
    from verdigris.plans import registry

    assert "REPARTITION" not in plan(registry.fixture(spark, small, "items"))
    monkeypatch.setattr(registry, "tasks_for", lambda spark, rows: session.tasks_for(spark, rows, 500))
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L, 1[0-9]\), REPARTITION_BY_NUM", plan(registry.fixture(spark, small, "items")))


def test_resuming_joins_once(spark, small, monkeypatch):
    monkeypatch.setattr(records, "tasks_for", lambda spark, rows: session.tasks_for(spark, rows, 1))
    prompts, done = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, x string"), spark.createDataFrame([(1,), (1,), (None,), (3,), (4,), (5,)], "id int")
    found = records.with_reused(prompts, done, ["id"])
    assert "hashpartitioning(id" in plan(found) and ", 6), REPARTITION_BY_NUM" in plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, "a", True), (1, "b", True), (2, "c", False), (None, "d", False)}
    assert [sorted(r["x"] for r in part.collect()) for part in records.resume_split(prompts, done, ["id"])] == [["a", "b"], ["c", "d"]]
    assert plan(QUERIES["resume_split"](spark, small)).count("Join") == 1


def test_reports_keep_the_tasks_of_their_state(spark, small, monkeypatch):
    """Large state is not held in memory, and no batch's state meets in one task."""
    seen, call = [], reports.CompletionReport.__call__
    monkeypatch.setattr(reports.CompletionReport, "__call__", lambda self, batch, epoch: (seen.append(batch.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")), call(self, batch, epoch)))
    kept, coalesced = DataFrame.coalesce, []
    monkeypatch.setattr(DataFrame, "coalesce", lambda self, n: (coalesced.append(n), kept(self, n))[1])
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    assert QUERIES["interim_reports"](spark, small).count() == 2
    spark.conf.set(name, before)
    assert len(seen) == 4 and all("RocksDB" in s for s in seen) and not coalesced


def test_ranges_of_tau_b_are_bounded(spark, monkeypatch):
    """However many rows a table has, a worker holds a range of a bounded number."""
    most, kept = [], ranks.durable

    def watched(df):
        out = kept(df)
        most.append(out.groupBy("__q" if "__q" in out.columns else "__p").count().agg({"count": "max"}).first()[0])
        return out

    rows = [(k % 2, float(k % 61), float(k * 7 % 83)) for k in range(4000)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    want = {r["g"]: r["tau_b"] for r in ranks.kendall_tau_b(df, ["g"], "a", "b").collect()}
    monkeypatch.setattr(ranks, "durable", watched)
    monkeypatch.setattr(ranks, "HELD", 200)
    got = {r["g"]: r["tau_b"] for r in ranks.kendall_tau_b(df, ["g"], "a", "b").collect()}
    assert got == pytest.approx(want) and max(most) < 600
