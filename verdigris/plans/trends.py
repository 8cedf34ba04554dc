"""Queries of derived reasoning measures, cross-run analytics and the flagship turn log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.stats import token_estimate
from verdigris.operators import modes, reasoning
from verdigris.plans.datasets import PLANS
from verdigris.plans.registry import fixture, query, table


@query(
    """SELECT final_role, count(*) AS n_conversations, sum(n_turns)::BIGINT AS n_turns, sum(n_tokens)::BIGINT AS n_tokens
FROM (SELECT conv_id, arg_max(role, turn) AS final_role, count(*) AS n_turns, sum(CASE WHEN length(text) = 0 THEN 0 ELSE floor(length(text) / 3.6) + 1 END) AS n_tokens FROM conversations GROUP BY conv_id)
GROUP BY final_role"""
)
def turn_log_summary(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    per = turns.groupBy("conv_id").agg(F.max_by("role", "turn").alias("final_role"), F.count("*").alias("n_turns"), F.sum(token_estimate(F.col("text"))).alias("n_tokens"))
    return per.groupBy("final_role").agg(F.count("*").alias("n_conversations"), F.sum("n_turns").alias("n_turns"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Judges' outputs for each order, one step for each line: lists follow from quantities, so each shape occurs."""
    i = fixture(spark, d, "items").withColumn("q", F.col("qty").cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "q", "prediction")))
    rows = i.groupBy("item").agg(ordered.alias("s")).withColumn("k", F.col("item") % 13)
    each = lambda f: F.transform("s", lambda x: f(x["q"]).cast("double"))
    return rows.select(
        "item", F.when(F.col("k") == 7, F.array().cast("array<string>")).otherwise(F.transform("s", lambda x: F.concat(F.lit("step "), x["prediction"]))).alias("steps"),
        F.when(F.col("k") == 5, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), (F.size("s") * 2).cast("int")), lambda x: F.concat(F.lit("o"), x.cast("string")))).alias("observations"),
        each(lambda q: q % 3).alias("observations_per_step"), each(lambda q: q % 4).alias("branchiness_per_step"), each(lambda q: q % 4 + q % 2).alias("mentions_per_step"),
        each(lambda q: (q % 3) / 2).alias("step_directionality"), each(lambda q: q % 2).alias("comparisons_per_step"), each(lambda q: (q % 5 == 0).cast("int")).alias("uncertainty_per_step"),
        each(lambda q: (q % 7 < 3).cast("int")).alias("prior_knowledge_per_step"), each(lambda q: (q % 2 == 0).cast("int")).alias("gold_alive_per_step"), each(lambda q: (q % 6 == 0).cast("int")).alias("unresolved_per_step"),
        each(lambda q: (q % 8 == 0).cast("int")).alias("backtracking_per_step"), F.when(F.col("k") == 3, F.array(F.lit(1.0))).otherwise(each(lambda q: q % 3)).alias("proof_disproof_per_step"), each(lambda q: q % 3 - 1).alias("helpfulness_per_step"),
        ((F.col("item") % 3) / 2).cast("double").alias("directionality"), F.when(F.col("k") != 2, (F.col("k") % 4 + 1).cast("int")).alias("anchoring_step"), (F.col("k") != 9).alias("anchoring_given"),
        (F.col("item") % 2).cast("double").alias("diversity"), F.lit(4.0).alias("judged_options"), (F.col("item") % 5).cast("int").alias("option_count"), (F.col("item") % 2 == 0).alias("selection"),
        F.when(F.col("k") != 4, F.col("item") % 3 == 0).alias("correct"), (F.size("s") * 900).alias("trace_chars"), F.when(F.col("k") == 1, "records").otherwise("log").alias("metrics_source"),
    )


@query(
    """WITH s AS (SELECT item, item % 13 AS k, count(*)::DOUBLE AS n, sum(q % 3)::DOUBLE AS used, sum(q % 4)::DOUBLE AS branches, sum((q % 3) / 2.0) AS dir, sum(q % 2)::DOUBLE AS compared, count(*) FILTER (q % 5 = 0)::DOUBLE AS unsure,
    count(*) FILTER (q % 2 = 0)::DOUBLE AS alive, count(*) FILTER (q % 3 = 0)::DOUBLE AS useless, count(*) FILTER (q % 3 = 2)::DOUBLE AS helpful, count(*) FILTER (q % 3 = 0)::DOUBLE AS harmful FROM (SELECT item, qty::INTEGER AS q FROM [items] i) x GROUP BY item),
  v AS (SELECT *, k <> 7 AS valid FROM s)
SELECT item, CASE WHEN valid THEN n END AS total_steps, CASE WHEN valid THEN used END AS observations_used, CASE WHEN valid AND k <> 5 THEN round(used / (2 * n), 9) END AS observation_coverage,
  CASE WHEN valid THEN branches END AS branchiness_total, CASE WHEN valid THEN round(dir / n, 9) END AS step_directionality_mean, CASE WHEN valid THEN round(compared / n, 9) END AS differential_elimination_normalized,
  CASE WHEN valid THEN round(unsure / n, 9) END AS uncertainty_rate, CASE WHEN valid THEN round(alive / n, 9) END AS gold_alive_rate,
  CASE WHEN valid AND (k <> 3 OR n = 1) THEN round(CASE WHEN k = 3 THEN 1.0 ELSE (n - useless) / n END, 9) END AS useful_step_fraction, CASE WHEN valid THEN round((helpful - harmful) / n, 9) END AS helpfulness_mean,
  CASE WHEN k <> 2 AND (k % 4 + 1 <= n OR NOT valid) THEN (k % 4 + 1)::DOUBLE END AS anchoring_point
FROM v"""
)
def reasoning_metrics(spark: SparkSession, d: str) -> DataFrame:
    names = ("observation_coverage", "step_directionality_mean", "differential_elimination_normalized", "uncertainty_rate", "gold_alive_rate", "useful_step_fraction", "helpfulness_mean")
    out = reasoning.derive(judged(spark, d))
    return out.select("item", "total_steps", "observations_used", "branchiness_total", "anchoring_point", *[F.round(c, 9).alias(c) for c in names])


@query()
def reasoning_errors(spark: SparkSession, d: str) -> DataFrame:
    """What judges' outputs broke, by kind."""
    out = reasoning.derive(judged(spark, d)).select(F.explode(F.concat("errors", "inapplicable")).alias("reason"))
    return out.groupBy("reason").agg(F.count("*").alias("n"))


@query()
def interesting_rules(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.hits(reasoning.derive(judged(spark, d)), reasoning.interesting(), ["item"])


@query()
def consistency_rules(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.hits(reasoning.derive(judged(spark, d)), reasoning.problems(), ["item"])


@query(
    """SELECT item, repeats, n_correct, n_wrong, correct_repeats, wrong_repeats, round(c, 9) AS score_correct, round(w, 9) AS score_wrong FROM (SELECT item, count(*) AS repeats, count(*) FILTER (ok) AS n_correct, count(*) FILTER (NOT ok) AS n_wrong,
  string_agg(pos, ';' ORDER BY pos::VARCHAR) FILTER (ok) AS correct_repeats, string_agg(pos, ';' ORDER BY pos::VARCHAR) FILTER (NOT ok) AS wrong_repeats, avg(score) FILTER (ok) AS c, avg(score) FILTER (NOT ok) AS w FROM [items] i GROUP BY item) q
WHERE n_correct > 0 AND n_wrong > 0"""
)
def repeat_divergence(spark: SparkSession, d: str) -> DataFrame:
    out = reasoning.repeat_divergence(fixture(spark, d, "items"), ["item"], "ok", ["score"], "pos")
    return out.withColumns({c: F.round(c, 9) for c in ("score_correct", "score_wrong")})


@query(
    """WITH m AS (SELECT item, prediction AS model, avg(ok::INT) AS a FROM [items] i GROUP BY 1, 2)
SELECT item, count(*) AS n_models, max(model) FILTER (a = 1) AS only_solver FROM m GROUP BY item HAVING count(*) >= 3 AND count(*) FILTER (a = 1) = 1 AND count(*) FILTER (a = 0) = count(*) - 1"""
)
def unique_solver(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.unique_solver(fixture(spark, d, "items"), ["item"], "prediction", "ok")


@query(
    """SELECT item, relevant AS relevant_actions, n - relevant AS irrelevant_actions, round(relevant / n, 9) AS relevance_rate
FROM (SELECT item, least(count(*), 4)::DOUBLE AS n, count(*) FILTER (ok AND pos <= 4)::DOUBLE AS relevant FROM [items] i GROUP BY item) q"""
)
def interaction_relevance(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ok"))), lambda x: x["ok"].cast("double"))
    rows = fixture(spark, d, "items").groupBy("item").agg(v.alias("v"))
    out = reasoning.interaction(rows.withColumn("n", F.least(F.size("v"), F.lit(4))), "v", "n").drop("v", "n")
    return out.withColumn("irrelevant_actions", F.col("irrelevant_actions").cast("double")).withColumn("relevance_rate", F.round("relevance_rate", 9))


@query(
    """WITH d AS (SELECT n_name AS dataset_id, CASE WHEN n_nationkey % 4 = 0 THEN 'single' WHEN n_nationkey % 4 = 1 THEN 'multi' ELSE 'none' END AS cardinality, CASE WHEN n_nationkey % 4 = 3 THEN 'interactive' ELSE 'static' END AS delivery, n_nationkey % 4 < 2 AS objective FROM nation),
  g AS (SELECT d.*, p, s FROM d, unnest(['io', 'cot', 'self-consistency', 'n/a']) x(p), unnest(['SCS', 'MCS', 'BOV', 'n/a']) y(s)
    WHERE (p = 'n/a') = (delivery <> 'static') AND (s = 'n/a') = (delivery <> 'static' OR cardinality = 'none'))
SELECT dataset_id, p AS prompt_mode, s AS selection_mode, NOT ((p = 'self-consistency' AND NOT objective) OR (s = 'SCS' AND cardinality = 'multi') OR (s = 'MCS' AND cardinality = 'single') OR (s = 'BOV' AND p = 'self-consistency')) AS accepted FROM g"""
)
def mode_admission(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    sets = table(spark, d, "nation").select(F.col("n_name").alias("dataset_id"), F.when(k == 0, "single").when(k == 1, "multi").otherwise("none").alias("cardinality"), F.when(k == 3, "interactive").otherwise("static").alias("delivery"), (k < 2).alias("objective"))
    return modes.mode_grid(sets).select("dataset_id", "prompt_mode", "selection_mode", F.col("skip_reason").isNull().alias("accepted"))


@query(
    """WITH r AS (SELECT lang, upper(chr((65 + quality)::INTEGER)) = 'B' AS ok FROM documents JOIN labels USING (doc_id))
SELECT 'accuracy' AS metric, round(avg(ok::INT), 9) AS value, count(*) AS n FROM r UNION ALL SELECT 'accuracy_' || lang, round(avg(ok::INT), 9), count(*) FROM r GROUP BY lang"""
)
def dataset_selection(spark: SparkSession, d: str) -> DataFrame:
    """A selection dataset with language strata: answers read from replies, scored, averaged as a sparse map."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    replies = rows.select("lang", F.concat(F.lit("I weigh A and B. Answer: ("), F.char(F.col("quality") + 65), F.lit(")")).alias("content"), F.lit("B").alias("gold"))
    plan = PLANS["xcopa"]
    return plan.aggregate(plan.score(replies)).withColumn("value", F.round("value", 9))


@query(
    """WITH r AS (SELECT dataset_id, prompt_mode, least(1, greatest(0, size / 40.0)) AS v FROM [grid] g WHERE id % 4 > 0),
  m AS (SELECT dataset_id, 'explanation_judged' AS metric, avg(v) AS value, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT dataset_id, 'explanation_judged_' || CASE prompt_mode WHEN 'cot' THEN 'head' ELSE 'longtail' END, avg(v), count(*) FROM r GROUP BY 1, 2)
SELECT dataset_id, metric, round(value, 9) AS value, n FROM m UNION ALL SELECT * FROM (SELECT dataset_id, 'popularity_gap' AS metric, round(max(value) FILTER (metric = 'explanation_judged_head') - max(value) FILTER (metric = 'explanation_judged_longtail'), 9) AS value, sum(n) FILTER (metric <> 'explanation_judged')::BIGINT AS n FROM m GROUP BY 1) g WHERE value IS NOT NULL"""
)
def dataset_judged(spark: SparkSession, d: str) -> DataFrame:
    """A judged dataset with strata and their gap: items without a verdict have no metric."""
    g = fixture(spark, d, "grid")
    said = F.col("id") % 4 > 0
    rows = g.select("dataset_id", F.lit("an answer").alias("content"), F.when(F.col("prompt_mode") == "cot", "head").otherwise("longtail").alias("popularity"), F.lit(None).cast("string").alias("verdict_label"), F.when(said, F.col("size") / 40.0).alias("verdict_score"))
    plan = PLANS["commonwhy"]
    return plan.aggregate(plan.score(rows), ("dataset_id",)).withColumn("value", F.round("value", 9))
