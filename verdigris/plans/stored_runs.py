"""Queries of a stored run: its tasks are written to folders of their own, and all of its frames come back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import rebuild
from verdigris.plans.registry import fixture, query
from verdigris.plans.session import durable
from verdigris.plans.streams import fresh


def write_tasks(rows: DataFrame, run: str, name: str, value: Column) -> None:
    """A file of each task: `value` is a line of it; rows have dataset_id, model_id and template."""
    file = rows.select(value.alias("value"), F.col("dataset_id").alias("dataset"), F.col("model_id").alias("model"), "template", F.lit(name).alias("file"))
    file.write.mode("append").partitionBy("dataset", "model", "template", "file").text(f"{run}/datasets")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows over all tasks by their folder and one of some buckets, ahead of lines that are costly to write: a narrow table lies in a few file splits.

    A bucket has about a million rows at the most, whatever their folders, and
    a task writes to few folders, as the driver moves every file that is written.
    """
    n = rows.count()
    buckets = max(min(16, n // 250_000), -(-n // 1_000_000), 1)
    tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, 2 * buckets)
    return rows.repartition(tasks, "dataset_id", "model_id", "template", F.pmod(F.xxhash64("id"), F.lit(buckets)))


def stored_run(spark: SparkSession, d: str) -> str:
    """Every reply as a record of a task: some written twice, some lines torn, some folded from a group, and what the tasks' own files say."""
    run = fresh(spark, "run")
    g = F.when(F.col("id") % 13 == 1, F.concat(F.lit("g"), (F.col("id") - 1).cast("string")))
    name = F.when(F.col("id") % 13 == 0, F.concat(F.lit("g"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("s"), F.col("id").cast("string")))
    rows = fixture(spark, d, "replies").select("id", "status", "content", "finish_reason", F.concat(F.lit("set/"), "task").alias("dataset_id"), F.col("mode").alias("model_id"), F.concat(F.lit("t@"), F.when(F.col("id") % 2 == 0, "1.0").otherwise("2.5")).alias("template"), name.alias("sample_id"), g.alias("group_id"))
    metrics = F.create_map(F.lit("acc"), (F.col("id") % 5 / 4).cast("string"), F.lit("f1"), F.when(F.col("id") % 3 == 0, (F.col("id") % 7 / 6).cast("string")).otherwise("None"))
    response = F.struct("content", "finish_reason", F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.col("id") % 9 / 1.0).alias("latency_s"))
    record = F.struct("sample_id", "group_id", "status", F.concat(F.lit("p"), "id").alias("prompt_fingerprint"), response.alias("response"), metrics.alias("metrics"), (F.col("id") % 11 > 0).alias("parse_ok"), F.lit("guess").alias("prediction"), F.struct((F.col("id") % 13 == 0).alias("reduced")).alias("metadata"), F.col("id").alias("seq"), F.lit("cot").alias("prompt_mode"))
    older = record.withField("status", F.lit("error")).withField("seq", F.col("id") - 1)
    lines = F.filter(F.array(F.to_json(record), F.when(F.col("id") % 7 == 0, F.to_json(older)), F.when(F.col("id") % 17 == 0, F.left(F.to_json(record), F.lit(25)))), lambda x: x.isNotNull())
    spread = dealt(rows)
    write_tasks(spread.withColumn("line", F.explode(lines)), run, "records.jsonl", F.col("line"))
    tasks = rows.groupBy("dataset_id", "model_id", "template").agg(F.count("*").alias("n"))
    tasks = durable(tasks)  # a row for each folder
    odd = F.col("template") == "t@2.5"
    said = F.to_json(F.struct(F.create_map(F.lit("acc"), F.lit(0.5)).alias("metrics"), F.struct((F.col("n") + 10).alias("planned")).alias("counts"), F.lit("acc").alias("primary_metric")))
    write_tasks(tasks.where(odd), run, "metrics.json", said)
    write_tasks(tasks, run, "checkpoint.json", F.to_json(F.struct((F.col("n") + 5).alias("total_planned"))))
    turns = spread.where("id % 3 = 0").select("*", F.explode(F.sequence(F.lit(1), (F.col("id") % 4 + 1).cast("int"))).alias("t"))
    write_tasks(turns, run, "turns.jsonl", F.to_json(F.struct("sample_id", F.col("t").alias("turn_number"), F.lit("ok").alias("status"))))
    events = tasks.groupBy("dataset_id").agg(F.sum("n").alias("n")).select(F.explode(F.array(F.to_json(F.struct(F.lit("run_started").alias("event"), F.lit(5.5).alias("ts"))), F.to_json(F.struct(F.lit("dataset_skipped").alias("event"), "dataset_id", F.concat(F.lit("absent: "), F.col("n").cast("string")).alias("reason"))), F.lit('{"event": "run_fin'))).alias("value"))
    events.write.text(f"{run}/events.jsonl")
    return run


KEPT = """(SELECT *, 'set/' || task AS dataset_id, mode AS model_id, CASE WHEN id % 2 = 0 THEN '1.0' ELSE '2.5' END AS template_version, CASE WHEN id % 13 = 0 THEN 'g' ELSE 's' END || id AS sample_id FROM [replies] q
  WHERE NOT (id % 13 = 1 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = q.id - 1 AND o.o_orderstatus = q.task AND o.o_orderpriority = q.mode AND o.o_orderkey % 2 = q.id % 2)))"""


@query(
    f"""WITH n AS (SELECT 'set/' || task AS dataset_id, mode AS model_id, CASE WHEN id % 2 = 0 THEN '1.0' ELSE '2.5' END AS template_version, count(*) + CASE WHEN id % 2 = 0 THEN 5 ELSE 10 END AS planned FROM [replies] q GROUP BY 1, 2, 3, id % 2),
  k AS (SELECT *, status IN ('ok', 'empty', 'truncated') AS scored FROM {KEPT})
SELECT dataset_id, model_id, 't' AS template_id, template_version, 'cot' AS prompt_mode, 'n/a' AS selection_mode, planned AS n_planned, count(*) FILTER (scored) AS n_scored, count(*) FILTER (status = 'error') AS n_error,
  round(count(*) FILTER (scored) / planned, 9) AS coverage, round(count(*) FILTER (scored AND id % 11 = 0) / count(*) FILTER (scored), 9) AS parse_failure_rate, round(count(*) FILTER (status = 'truncated') / planned, 9) AS truncation_rate,
  round(count(*) FILTER (status = 'empty') / planned, 9) AS empty_response_rate, round(avg(id % 9) FILTER (id % 4 > 0 AND id % 9 > 0), 9) AS latency_s_mean,
  round(avg(id % 5 / 4) FILTER (scored), 9) AS acc, round(avg(id % 7 / 6) FILTER (scored AND id % 3 = 0), 9) AS f1,
  CASE WHEN template_version = '2.5' THEN round(avg(id % 5 / 4) FILTER (scored) * count(*) FILTER (scored) / planned, 9) END AS strict
FROM k JOIN n USING (dataset_id, model_id, template_version) GROUP BY 1, 2, 4, planned"""
)
def rebuilt_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A row for each task of a stored run, from its folders alone."""
    tasks = rebuild.run_tasks(spark, stored_run(spark, d))
    return tasks.select("dataset_id", "model_id", "template_id", "template_version", "prompt_mode", "selection_mode", "n_planned", "n_scored", "n_error", *[F.round(c, 9).alias(c) for c in ("coverage", "parse_failure_rate", "truncation_rate", "empty_response_rate", "latency_s_mean")], *[F.round(F.try_element_at("metrics", F.lit(m)), 9).alias(m) for m in ("acc", "f1")], F.round("strict", 9).alias("strict"))


@query(
    f"""WITH p AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'g' ELSE 's' END || id AS sample_id FROM [replies] q)
SELECT sample_id, 'Ask ' || p.id AS rendered, id % 5 > 0 AND k.id IS NOT NULL AS stored, CASE WHEN id % 5 > 0 THEN k.content END AS content, CASE WHEN id % 5 > 0 THEN k.status END AS status, CASE WHEN id % 5 > 0 AND k.status IN ('ok', 'empty', 'truncated') THEN id % 5 / 4 END AS acc,
  CASE WHEN id % 5 > 0 AND k.status IN ('ok', 'empty', 'truncated') THEN id % 11 > 0 END AS parse_ok FROM p LEFT JOIN {KEPT} k USING (id, sample_id)"""
)
def rebuilt_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Rendered prompts with their stored replies and scores; a fifth of the prompts has changed since."""
    records = rebuild.run_records(spark, stored_run(spark, d), rebuild.ANSWER)
    name = F.when(F.col("id") % 13 == 0, "g").otherwise("s")
    prompts = fixture(spark, d, "replies").select(F.concat(name, F.col("id").cast("string")).alias("sample_id"), F.concat(F.when(F.col("id") % 5 == 0, "new").otherwise("p"), F.col("id").cast("string")).alias("prompt_fingerprint"), F.concat(F.lit("Ask "), F.col("id").cast("string")).alias("rendered"))
    found = rebuild.run_prompts(records, prompts)
    return found.select("sample_id", "rendered", "stored", "response.content", "status", F.try_element_at("score.metrics", F.lit("acc")).alias("acc"), "score.parse_ok")


@query(
    f"""WITH t AS (SELECT id, 'set/' || task AS dataset_id, mode AS model_id, CASE WHEN id % 13 = 0 THEN 'g' ELSE 's' END || id AS sample_id, unnest(range(1, (id % 4 + 2)::BIGINT)) AS turn_number FROM [replies] q WHERE id % 3 = 0)
SELECT t.dataset_id, t.model_id, t.sample_id, turn_number, turn_number = t.id % 4 + 1 AS is_last, CASE WHEN turn_number = t.id % 4 + 1 THEN k.status END AS record_status, CASE WHEN turn_number = t.id % 4 + 1 AND k.id IS NOT NULL THEN 'guess' END AS prediction
FROM t LEFT JOIN {KEPT} k USING (id)"""
)
def rebuilt_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a stored run; an episode's record stands on its last one."""
    return rebuild.run_turns(spark, stored_run(spark, d)).select("dataset_id", "model_id", "sample_id", "turn_number", "is_last", "record_status", "prediction")


@query("SELECT 5.5::DOUBLE AS started_at, 0.0::DOUBLE AS finished_at, string_agg('set/' || task || ' absent: ' || n, ';' ORDER BY task) AS skipped FROM (SELECT task, count(*) AS n FROM [replies] q GROUP BY task)")
def rebuilt_events(spark: SparkSession, d: str) -> DataFrame:
    """What the event log of a stored run says of it."""
    found = rebuild.run_events(spark, stored_run(spark, d))
    return found.withColumn("skipped", F.array_join(F.transform("skipped", lambda s: F.concat_ws(" ", s["dataset_id"], s["reason"])), ";"))
