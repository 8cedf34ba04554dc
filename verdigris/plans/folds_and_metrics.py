"""Queries of expansions, folds and metric averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import extract, stats
from verdigris.operators import aggregate, expand, folds, records
from verdigris.plans import reports
from verdigris.plans.registry import fixture, query, table


def items(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "items")


@query("SELECT p_partkey || '#r' || i AS sample_id, p_partkey::VARCHAR AS repeat_of, i::INTEGER AS repeat_index FROM part, range(3) r(i)")
def expand_repeats(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("sample_id"))
    return expand.repeats(part, 3)


@query(
    """WITH o AS (SELECT item, list(prediction ORDER BY pos) AS opts FROM (SELECT o_orderkey AS item, pos, prediction FROM orders LEFT JOIN [items] i ON o_orderkey = item AND pos <= 3) q GROUP BY item),
  e AS (SELECT item, CASE WHEN opts[1] IS NULL THEN [NULL] ELSE opts END AS opts FROM o)
SELECT CASE WHEN opts[1] IS NULL THEN item::VARCHAR ELSE item || '#bov' || (i - 1) END AS sample_id, CASE WHEN opts[1] IS NOT NULL THEN item::VARCHAR END AS group_id,
  CASE WHEN opts[1] IS NOT NULL THEN chr((64 + i)::INTEGER) END AS bov_label, opts[i] AS bov_option
FROM (SELECT item, opts, unnest(range(1, len(opts) + 1)) AS i FROM e)"""
)
def expand_options(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"))
    first = items(spark, d).where("pos <= 3").groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prediction"))), lambda x: x["prediction"]).alias("options"))
    rows = orders.join(first, "item", "left").select(F.col("item").cast("string").alias("sample_id"), "options", F.transform("options", lambda x, i: F.char(i + 65)).alias("labels"))
    return expand.options(rows).select("sample_id", "group_id", "bov_label", "bov_option")


@query("SELECT conv_id, count(*) AS n_requests, count(DISTINCT conv_id || '#r' || (turn % 2)) AS n_items FROM conversations GROUP BY conv_id")
def root_item_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.concat_ws("#r", F.col("conv_id").cast("string"), (F.col("turn") % 2).cast("string")).alias("group_id"), F.concat_ws("#sc", "conv_id", "turn").alias("sample_id"))
    root = expand.root_item(F.lit(None).cast("string"), F.col("group_id"), F.col("sample_id"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_requests"), F.count_distinct(root).alias("n_items"))


@query(
    """WITH c AS (SELECT item, CASE WHEN parsed THEN prediction END AS p, count(*) AS n, min(pos) AS first, arg_min(prediction, pos) AS prediction, arg_min(score, pos) AS score FROM [items] i GROUP BY item, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p IS NULL, n DESC, first) AS rn, sum(n) OVER (PARTITION BY item) AS m FROM c)
SELECT item, prediction, score, CASE WHEN p IS NOT NULL THEN round(n / m, 9) END AS agreement, m::BIGINT AS n_members FROM r WHERE rn = 1"""
)
def vote_plurality(spark: SparkSession, d: str) -> DataFrame:
    out = folds.vote(items(spark, d), "item", "pos", "prediction", "parsed", "score")
    return out.withColumn("agreement", F.round("agreement", 9))


@query(
    """SELECT item, coalesce(string_agg(chr((64 + pos)::INTEGER), ',' ORDER BY pos) FILTER (qty > 25), '') AS selected, round(avg((qty > 25)::INT), 9) AS bov_yes_rate, count(*) AS bov_questions
FROM [items] i GROUP BY item"""
)
def bov_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).select("item", "pos", F.char(F.col("pos") + 64).alias("label"), (F.col("qty") > 25).alias("yes"))
    out = folds.selected_options(rows, "item", "pos", "label", "yes")
    return out.select("item", F.array_join("selected", ",").alias("selected"), F.round("bov_yes_rate", 9).alias("bov_yes_rate"), "bov_questions")


@query("SELECT item, pos, prediction, score, qty FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, pos) AS rn FROM [items] i) q WHERE rn = 1")
def best_of_n(spark: SparkSession, d: str) -> DataFrame:
    return folds.best_of_n(items(spark, d), "item", "score", "pos").select("item", "pos", "prediction", "score", "qty")


@query(
    """SELECT task, round(avg(same), 9) AS repeat_agreement, round(avg(spread), 9) AS repeat_std, count(*) AS n_items
FROM (SELECT item % 10 AS task, item, (count(DISTINCT coalesce(CASE WHEN parsed THEN prediction END, 'None')) = 1)::INT AS same, stddev_pop(score) AS spread FROM [items] i GROUP BY 1, 2 HAVING count(*) > 1) q GROUP BY task"""
)
def repeat_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).select((F.col("item") % 10).alias("task"), "item", F.when(F.col("parsed"), F.col("prediction")).alias("p"), "score")
    out = folds.repeat_statistics(rows, ["task"], "item", "p", "score")
    return out.withColumns({c: F.round(c, 9) for c in ("repeat_agreement", "repeat_std")})


@query("SELECT task, round(100 * stddev_samp(m), 7) AS repeat_error, count(*) AS n_repeats FROM (SELECT item % 10 AS task, pos, avg(score) AS m FROM [items] i GROUP BY 1, 2) q GROUP BY task HAVING count(*) >= 2")
def repeat_error_samp(spark: SparkSession, d: str) -> DataFrame:
    out = folds.repeat_error(items(spark, d).withColumn("task", F.col("item") % 10), ["task"], "pos", "score")
    return out.withColumn("repeat_error", F.round("repeat_error", 7))


@query(
    """WITH r AS (SELECT *, item % 3 = 0 AND pos = 1 AS reduced FROM [items] i)
SELECT item, pos, reduced FROM r WHERE reduced OR item NOT IN (SELECT item FROM r WHERE reduced)"""
)
def drop_reduced_members(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).select("item", "pos", ((F.col("item") % 3 == 0) & (F.col("pos") == 1)).alias("reduced"))
    return folds.drop_members(rows, "item").select("item", "pos", "reduced")


@query(
    """SELECT kind, round(coalesce(avg(x), 0), 7) AS mean, round(coalesce(stddev_samp(x), 0), 7) AS std, round(coalesce(min(x), 0), 7) AS min, round(coalesce(max(x), 0), 7) AS max, count(x)::DOUBLE AS n,
  round(coalesce(1.96 * stddev_samp(x) / sqrt(count(x)), 0), 7) AS ci95 FROM (SELECT kind, CASE WHEN NOT isnan(v) THEN v END AS x FROM [log] l) q GROUP BY kind"""
)
def mean_ci(spark: SparkSession, d: str) -> DataFrame:
    out = fixture(spark, d, "log").groupBy("kind").agg(*stats.summary(F.col("v")))
    return out.select("kind", *[F.round(c, 7).alias(c) for c in ("mean", "std", "min", "max", "n", "ci95")])


@query("SELECT dataset_id, round(avg(m), 9) AS macro_average FROM (SELECT dataset_id, kind, avg(correct) AS m FROM [grid] g GROUP BY 1, 2) q GROUP BY 1")
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.macro_average(fixture(spark, d, "grid"), ["dataset_id"], "kind", "correct").withColumn("macro_average", F.round("macro_average", 9))


LONG = """SELECT kind, unnest(['accuracy', 'value', 'late']) AS metric, unnest([correct::INT::DOUBLE, CASE WHEN NOT isnan(v) THEN v END, CASE WHEN turn > 20 THEN value END]) AS x FROM [log] l"""


@query(f"SELECT kind, metric, round(avg(x), 7) AS value, count(*) AS n FROM ({LONG}) q WHERE x IS NOT NULL GROUP BY 1, 2")
def sparse_mean(spark: SparkSession, d: str) -> DataFrame:
    m = F.map_from_arrays(F.array(F.lit("accuracy"), F.lit("value"), F.lit("late")), F.array(F.col("correct").cast("double"), F.col("v"), F.when(F.col("turn") > 20, F.col("value"))))
    rows = fixture(spark, d, "log").select("kind", m.alias("metrics"))
    return aggregate.sparse_mean(rows, ["kind"]).withColumn("value", F.round("value", 7))


@query(
    """WITH s AS (SELECT kind, value AS t, CASE WHEN id % 3 > 0 THEN value / 2 END AS u, CASE WHEN id % 3 > 0 THEN 0.5 END AS c FROM [log] l),
  g AS (SELECT * FROM s WHERE u IS NOT NULL)
SELECT kind, 'reasoning_observations_total' AS metric, round(avg(t), 7) AS value, count(*) AS n FROM g GROUP BY kind
UNION ALL SELECT kind, 'reasoning_observations_used', round(avg(u), 7), count(*) FROM g GROUP BY kind
UNION ALL SELECT kind, 'reasoning_observation_coverage', round(avg(c), 7), count(*) FROM g GROUP BY kind"""
)
def co_averaged_mean(spark: SparkSession, d: str) -> DataFrame:
    full = F.col("id") % 3 > 0
    names = F.array(*[F.lit(f"reasoning_{n}") for n in ("observations_total", "observations_used", "observation_coverage")])
    m = F.map_from_arrays(names, F.array(F.col("value"), F.when(full, F.col("value") / 2), F.when(full, F.lit(0.5))))
    return aggregate.sparse_mean(fixture(spark, d, "log").select("kind", m.alias("metrics")), ["kind"]).withColumn("value", F.round("value", 7))


@query(
    """SELECT kind, metric, kept, n - kept AS skipped, round(kept / n, 9) AS coverage FROM (SELECT kind, 'value' AS metric, count(CASE WHEN NOT isnan(v) THEN v END) AS kept, count(*) AS n FROM [log] l GROUP BY kind
UNION ALL SELECT kind, 'turn', count(turn), count(*) FROM [log] l GROUP BY kind) q"""
)
def metric_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "log").select("kind", F.col("v").alias("value"), F.col("turn").cast("double").alias("turn"))
    return aggregate.coverage(rows, ["kind"], ["value", "turn"]).withColumn("coverage", F.round("coverage", 9))


STATUS = "CASE WHEN id % 12 = 5 THEN 'empty' WHEN id % 12 = 11 THEN 'truncated' ELSE 'ok' END"


@query(
    f"""SELECT task, round(avg(x) FILTER (status = 'ok'), 9) AS value, round(coalesce(sum(x) FILTER (status = 'ok'), 0) / (count(*) + 10), 9) AS strict, count(*) FILTER (status = 'ok') AS n_answered, count(*) AS n_scored,
  round(count(*) FILTER (status = 'truncated') / count(*), 9) AS truncation_rate, round(count(*) FILTER (status = 'empty') / count(*), 9) AS empty_rate,
  round(count(*) FILTER (status = 'ok') / (count(*) + 10), 9) AS answer_coverage
FROM (SELECT task, (price > 200000)::INT AS x, {STATUS} AS status FROM [replies] r) q GROUP BY task"""
)
def strict_vs_answered(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "replies").withColumn("status", F.expr(STATUS)).withColumn("x", (F.col("price") > 200_000).cast("double"))
    planned = rows.groupBy("task").agg((F.count("*") + 10).alias("planned"))
    out = aggregate.task_metrics(rows.join(planned, "task"), ["task"], "x", F.col("status") == "ok", F.col("planned"))
    return out.select("task", "n_answered", "n_scored", *[F.round(c, 9).alias(c) for c in ("value", "strict", "truncation_rate", "empty_rate", "answer_coverage")])


@query(
    """SELECT task, replies, empty, cut_off, round((empty + cut_off) / replies, 9) AS no_answer_rate, failed_calls FROM (SELECT task, count(*) FILTER (status <> 'error') AS replies, count(*) FILTER (trim(content) = '') AS empty,
  count(*) FILTER (trim(content) <> '' AND finish_reason = 'length' AND NOT contains(lower(content), '</answer>')) AS cut_off, count(*) FILTER (status = 'error') AS failed_calls FROM [replies] r GROUP BY task) q"""
)
def no_answer_report(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "replies").withColumn("no_answer", extract.missing_answer(F.col("content"), F.col("finish_reason")))
    return aggregate.no_answer(rows, ["task"]).withColumn("no_answer_rate", F.round("no_answer_rate", 9))


@query("SELECT dataset_id, round(avg(a), 9) AS balanced_accuracy, count(*) AS n_classes FROM (SELECT dataset_id, kind, avg(correct) AS a FROM [grid] g GROUP BY 1, 2) q GROUP BY 1")
def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.balanced_accuracy(fixture(spark, d, "grid"), ["dataset_id"], "kind", "correct").withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@query("SELECT dataset_id, round(avg(correct) FILTER (prompt_mode = 'cot'), 9) AS mean_cot, round(avg(correct) FILTER (prompt_mode = 'io'), 9) AS mean_io, round(avg(correct) FILTER (prompt_mode = 'cot') - avg(correct) FILTER (prompt_mode = 'io'), 9) AS gap FROM [grid] g GROUP BY 1")
def stratum_gap(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.stratum_gap(fixture(spark, d, "grid"), ["dataset_id"], "prompt_mode", "cot", "io", "correct")
    return out.select("dataset_id", *[F.round(c, 9).alias(c) for c in ("mean_cot", "mean_io", "gap")])


@query("SELECT dataset_id, round(avg(price) FILTER (correct = 1), 7) AS valid_cost, count(*) FILTER (correct = 1) AS n_valid FROM [grid] g GROUP BY 1")
def valid_only_cost(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("correct") == 1
    return fixture(spark, d, "grid").groupBy("dataset_id").agg(F.round(F.avg(F.when(good, F.col("price"))), 7).alias("valid_cost"), F.count_if(good).alias("n_valid"))


@query("SELECT dataset_id, round(avg((correct = 1 AND size > 20)::INT), 9) AS joint_accuracy FROM [grid] g GROUP BY 1")
def joint_accuracy(spark: SparkSession, d: str) -> DataFrame:
    both = (F.col("correct") == 1) & (F.col("size") > 20)
    return fixture(spark, d, "grid").groupBy("dataset_id").agg(F.round(F.avg(both.cast("double")), 9).alias("joint_accuracy"))


@query("SELECT 'accuracy_' || lang AS metric, round(avg(quality), 9) AS value, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang UNION ALL SELECT 'accuracy', round(avg(quality), 9), count(*) FROM documents JOIN labels USING (doc_id)")
def per_language_strata(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    m = F.map_from_arrays(F.array(F.lit("accuracy"), F.concat(F.lit("accuracy_"), "lang")), F.array(F.col("quality").cast("double"), F.col("quality").cast("double")))
    return aggregate.sparse_mean(rows.select(m.alias("metrics")), []).select("metric", F.round("value", 9).alias("value"), "n")


@query("SELECT dataset_id, round(avg(price) FILTER (model_id = 'alpha'), 7) AS alpha, round(avg(price) FILTER (model_id = 'beta'), 7) AS beta, round(avg(price) FILTER (model_id = 'gamma'), 7) AS gamma FROM [grid] g GROUP BY 1")
def summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    cells = fixture(spark, d, "grid").groupBy("dataset_id", "model_id").agg(F.round(F.avg("price"), 7).alias("value"))
    return reports.summary_pivot(cells, "dataset_id", "model_id", "value", ["alpha", "beta", "gamma"])


@query(
    """WITH c AS (SELECT dataset_id, model_id, prompt_mode, avg(correct) AS m FROM [grid] g GROUP BY 1, 2, 3)
SELECT dataset_id, model_id, prompt_mode, round(m, 9) AS value, round(avg(m) OVER (PARTITION BY dataset_id, prompt_mode), 9) AS overall, m = max(m) OVER (PARTITION BY dataset_id, prompt_mode) AS is_max FROM c"""
)
def question_level_overall(spark: SparkSession, d: str) -> DataFrame:
    cells = fixture(spark, d, "grid").groupBy("dataset_id", "model_id", "prompt_mode").agg(F.avg("correct").alias("value"))
    out = reports.bold_max(reports.question_level_overall(cells, ["dataset_id", "prompt_mode"], "value"), ["dataset_id", "prompt_mode"], "value")
    return out.select("dataset_id", "model_id", "prompt_mode", F.round("value", 9).alias("value"), F.round("overall", 9).alias("overall"), "is_max")


@query("SELECT dataset_id, model_id, round(avg(correct) FILTER (prompt_mode = 'cot') - avg(correct) FILTER (prompt_mode = 'io'), 9) AS gain FROM [grid] g GROUP BY 1, 2 HAVING count(*) FILTER (prompt_mode = 'cot') > 0 AND count(*) FILTER (prompt_mode = 'io') > 0")
def mode_gain(spark: SparkSession, d: str) -> DataFrame:
    return reports.mode_gain(fixture(spark, d, "grid"), ["dataset_id", "model_id"], "prompt_mode", "correct").withColumn("gain", F.round("gain", 9))


@query("SELECT task, count(*) AS n_records, count(DISTINCT id // 4) AS n_questions, count(*) FILTER (status = 'error') AS n_errors FROM [replies] r GROUP BY task")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "replies").withColumn("sample_id", F.concat(F.floor(F.col("id") / 4).cast("string"), F.lit("#r"), (F.col("id") % 4).cast("string")))
    return reports.run_counts(rows, ["task"], "sample_id", "status")


@query(
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return records.dedupe_last(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey AS id, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS reused FROM orders")
def resume_split(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return records.with_reused(prompts, done, ["id"])


@query("SELECT l_returnflag AS task, 'new' AS run, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1 UNION ALL SELECT l_returnflag, 'old', count(*) FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def supersede_union(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(F.count("*").alias("n"))
    prior, now = per.withColumn("run", F.lit("old")), per.where("task <> 'N'").withColumn("run", F.lit("new"))
    return records.supersede(prior, now, ["task"]).select("task", "run", "n")


@query("SELECT conv_id, turn, is_last, CASE WHEN is_last THEN n END AS n_turns FROM (SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def turn_log_join(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    per = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return records.attach_last_turn(turns, per, "conv_id", "turn", ["n_turns"])


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_retailprice END AS score, p_partkey % 4 = 0 AS changed FROM part")
def merge_update(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    updates = rows.where("id % 4 = 0").select("id", F.lit(0.0).alias("score"))
    return records.merge_update(rows, updates, "id", ["score"])


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'judged=1.0,judged_easy=1.0,other=0.5' WHEN 1 THEN 'other=0.5' ELSE 'judged=0.0,judged_easy=0.0,other=0.5' END AS metrics FROM part")
def verdict_merge(spark: SparkSession, d: str) -> DataFrame:
    m = F.map_from_arrays(F.array(F.lit("judged"), F.lit("judged_easy"), F.lit("other")), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.5)))
    k = F.col("p_partkey") % 3
    out = records.merge_verdict(m, "judged", F.lit(1.0), k == 0, k < 2)
    said = F.array_join(F.array_sort(F.transform(F.map_entries(out), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), said.alias("metrics"))
