"""Streams that keep state: nothing is lost with a new checkpoint, and no split into batches changes a result."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from verdigris.operators import episodes as offline
from verdigris.streaming import episodes, reports
from verdigris.streaming.state import Upsert

ASKS = "episode string, turn bigint, category string, keys array<string>, said string, tokens bigint, failed boolean, ends boolean"


def test_upserts_of_a_second_checkpoint(spark, tmp_path):
    sink = Upsert(str(tmp_path / "t"), ["k"], "seq")
    for n, rows in enumerate(([("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z")])):
        spark.createDataFrame(rows, "k string, seq int, v string").write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema("k string, seq int, v string").parquet(str(tmp_path / f"in{n}"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["k"], r["v"]) for r in sink.read(spark).collect()) == [("a", "z"), ("b", "y")]
    # a third stream whose first batch is run twice, older rows among its own
    for _ in range(2):
        sink(spark.createDataFrame([("b", 1, "old"), ("c", 1, "new")], "k string, seq int, v string"), 0)
    assert sorted((r["k"], r["v"]) for r in sink.read(spark).collect()) == [("a", "z"), ("b", "y"), ("c", "new")]
    versions = {r["version"] for r in spark.read.parquet(str(tmp_path / "t" / "log")).collect()}
    assert versions == {0, 1, 2}


def run(spark, at, asks, case, rules, files=1, **hooks):
    episodes.use_state_store(spark)
    for n, part in enumerate(asks if files is None else [asks]):
        spark.createDataFrame(part, ASKS).coalesce(1).write.parquet(f"{at}/in/{n}")
    stream = spark.readStream.schema(ASKS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    done = episodes.run_episodes(stream, spark.createDataFrame(case, "episode string, category string, key string"), rules, **hooks)
    done.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return sorted((r["episode"], r["turn"], ",".join(r["shown"]), r["fresh"], r["n_revealed"], r["n_turns"], r["ended"]) for r in spark.read.parquet(f"{at}/out").collect())


def ask(e, t, keys=(), c="lab", tokens=10, failed=False, ends=False):
    return (e, t, c, list(keys), None, tokens, failed, ends)


CASE = [("a", "lab", k) for k in ("k.name", "k.value", "na.value", "gas")] + [("a", "image", "k.name"), ("b", "lab", "x")]


def test_disclosure_in_any_order_is_that_of_the_table(spark, tmp_path):
    asks = [ask("a", 0, ["k.value", "none"]), ask("a", 1, ["k.name", "gas"]), ask("a", 2, ["k.name"], "image"), ask("a", 3, []), ask("b", 0, ["x"]), ask("b", 1, ["x"])]
    table = offline.disclosed(spark.createDataFrame(asks, ASKS), spark.createDataFrame(CASE, "episode string, category string, key string"))
    want = sorted((r["episode"], r["turn"], ",".join(r["shown"]), r["fresh"], r["n_revealed"], r["turn"] + 1, None) for r in table.collect())
    orders = {"one": [asks], "each": [[x] for x in asks], "back": [[x] for x in asks[::-1]], "again": [asks[:3], asks, asks[::-1]]}
    for name, parts in orders.items():
        assert run(spark, tmp_path / name, parts, CASE, episodes.Rules(max_turns=9), files=None) == want, name


def test_what_ends_an_episode(spark, tmp_path):
    asks = [
        [ask("limit", t) for t in (3, 2, 1, 0)], [ask("full", 0, tokens=10), ask("full", 1, tokens=950), ask("full", 2)], [ask("call", 0), ask("call", 1, failed=True), ask("call", 2)],
        [ask("env", 0, ends=True), ask("env", 1)], [ask("gap", 1)], [ask("env", 0), ask("env", 2)], [(None, 0, "lab", [], None, 1, False, False), ("null", None, "lab", None, None, None, None, None), ("null", 0, None, None, None, None, None, None)],
    ]
    got = run(spark, tmp_path, asks, CASE, episodes.Rules(max_turns=3, window=1000, least=64), files=None)
    ends = {e: (n, why) for e, _, _, _, _, n, why in got if why}
    assert ends == {"limit": (3, "turn_limit"), "full": (1, "context"), "call": (2, "failed_call"), "env": (1, "environment")}
    assert sorted((e, t) for e, t, *_ in got) == [("call", 0), ("call", 1), ("env", 0), ("full", 0), ("full", 1), ("limit", 0), ("limit", 1), ("limit", 2), ("null", 0)]


def test_hooks_and_quotas(spark, tmp_path):
    def start(key, first):
        if key == "broken":
            raise ValueError("no such case")
        return {"left": 2}

    def step(state, turn):
        if turn["category"] == "bang":
            raise RuntimeError("environment fell over")
        state["failed"] = turn["category"] == "outage"
        state["left"] -= 1
        return state["left"] > 0 or None

    asks = [[ask("a", 0, ["gas"]), ask("broken", 0), ask("bang", 0, c="bang"), ask("out", 0, c="outage")], [ask("a", 1, ["gas"]), ask("broken", 1), ask("a", 2)]]
    got = run(spark, tmp_path / "hooks", asks, CASE, episodes.Rules(), files=None, start=start, step=step)
    assert {(e, n): why for e, _, _, _, _, n, why in got} == {("a", 1): None, ("a", 2): "environment", ("broken", 0): "not_started", ("bang", 1): "environment", ("out", 1): "environment_failed"}
    asks = [[ask("a", t, ["gas"] if t else ["k.name"]) for t in range(3)]]
    got = run(spark, tmp_path / "quota", asks, CASE, episodes.Rules(quotas=(("lab", 1),)), files=None)
    assert [(t, shown, n) for _, t, shown, _, n, _, _ in got] == [(0, "k.name,k.value", 2), (1, "", 2), (2, "", 2)]


def test_idle_episodes_end(spark, tmp_path):
    """The watermark of other episodes' turns ends one that hears no more, and later lets go of what has ended."""
    episodes.use_state_store(spark)
    schema = ASKS + ", ts timestamp"
    case = spark.createDataFrame(CASE, "episode string, category string, key string")
    at = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)
    parts = [[(*ask("a", 0, ["gas"]), at(0)), (*ask("b", 0, ["x"]), at(1))], [(*ask("b", 1, ["x"]), at(40)), (*ask("c", 0), at(100))], [(*ask("c", 1), at(101))], [(*ask("a", 1), at(102))]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("ts", "0 seconds")
    done = episodes.run_episodes(stream, case, episodes.Rules(idle_ms=50_000), time="ts")
    done.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["episode"], r["turn"], r["ended"] or "", r["n_turns"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 0, "", 1), ("a", 1, "idle", 1), ("b", 0, "", 1), ("b", 1, "", 2), ("b", 2, "idle", 2), ("c", 0, "", 1), ("c", 1, "", 2)]
    with pytest.raises(ValueError, match="time"):
        episodes.run_episodes(stream, case, episodes.Rules(idle_ms=1))


def test_reports_come_once(spark, tmp_path):
    """Also when records come again, when there are more than planned, and when a batch is run twice."""
    schema = "dataset_id string, id bigint, status string, score double"
    parts = [[("x", 1, "ok", 1.0), ("y", 1, "ok", 0.5)], [("x", 1, "ok", 1.0), ("y", 1, "ok", 0.5)], [("x", 2, "error", None), ("z", 1, "ok", 1.0)], [("x", 3, "ok", 0.0), ("y", 2, "ok", float("nan")), ("lost", 1, "ok", 1.0)]]
    planned = spark.createDataFrame([("x", 2), ("y", 2), ("z", 2)], "dataset_id string, planned bigint")
    sink = reports.CompletionReport(f"{tmp_path}/out", planned)

    def twice(batch, epoch):
        sink(batch, epoch)
        sink(batch, epoch)

    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        reports.progress(stream, ["id"]).writeStream.outputMode("update").foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = {r["dataset_id"]: (r["n"], r["n_scored"], r["n_error"], r["score"], r["coverage"], r["batch"]) for r in sink.read(spark).collect()}
    assert got == {"x": (2, 1, 1, 1.0, 0.5, 2), "y": (2, 2, 0, 0.5, 1.0, 3)} and sink.read(spark).count() == 2


@pytest.mark.parametrize("limit", [1, 6])
def test_findings_shown(rows, limit):
    got = rows("keys array<string>, held array<string>", [(["p.x", "q"], ["p", "p.x", "p.y", "p.y.z", "q"]), (["none"], ["p"]), ([], [])], episodes.findings_shown(F.col("keys"), F.col("held"), limit))
    assert got == [(["p", "p.x", "p.y"] + ["q"] * (limit > 1),), ([],), ([],)]


def test_episodes_of_one_bucket(spark, tmp_path):
    """Many episodes, named by integers, share a call and a value of state; each goes its own way."""
    schema = ASKS.replace("episode string", "episode bigint")
    parts = [[ask(e, t, ["gas"]) for e in range(40) if e % 2 == 0 or t > 0] for t in (1, 0, 2)]
    parts.append([ask(e, 0, ["gas"]) for e in range(1, 40, 2)])
    for n, part in enumerate(parts):
        spark.createDataFrame([p for p in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    case = spark.createDataFrame([(e, "lab", "gas") for e in range(40)], "episode bigint, category string, key string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    done = episodes.run_episodes(stream, case, episodes.Rules(max_turns=3), buckets=1, start=lambda key, first: {"own": key}, step=lambda own, turn: own["own"] < 30)
    done.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["episode"], r["turn"], r["fresh"], r["ended"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [(e, t, int(t == 0), "turn_limit" if t == 2 else None) for e in range(30) for t in range(3)] + [(e, 0, 0, "environment") for e in range(30, 40)]
    assert got == want
