"""Per-step reasoning measures from judges' outputs, and the predicates over them.

Input: a row for each reply with typed columns, each nullable:
steps array<string>, observations array<string>, one array<double> for each
family of PER_STEP, directionality double, anchoring_step int and
anchoring_given boolean, diversity double, judged_options double,
option_count int, selection boolean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.stats import comparison_pairs
from verdigris.functions.validators import binary, binary_list, directionality_list, int_list, nonnegative_int, string_list, ternary_list

# The lists that judges return for each step, and their contracts.
PER_STEP = {
    "observations_per_step": int_list,
    "branchiness_per_step": int_list,
    "mentions_per_step": int_list,
    "step_directionality": directionality_list,
    "comparisons_per_step": int_list,
    "uncertainty_per_step": int_list,
    "prior_knowledge_per_step": int_list,
    "gold_alive_per_step": binary_list,
    "unresolved_per_step": binary_list,
    "backtracking_per_step": int_list,
    "proof_disproof_per_step": int_list,
    "helpfulness_per_step": ternary_list,
}


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _count(x: Column, test) -> Column:
    return F.size(F.filter(x, test)).cast("double")


def derive(df: DataFrame) -> DataFrame:
    """Adds total_steps, the metrics, and arrays `errors` and `inapplicable`.

    A list that has not one valid value per step is an error and gives no
    metric; what a task's shape rules out is inapplicable.  Nothing is coerced.
    """
    steps = string_list(F.col("steps"))
    none = F.coalesce(F.size("steps") == 0, F.lit(False))
    df = df.withColumn("__steps", steps).withColumn("__n", F.coalesce(F.size(F.col("__steps")), F.lit(0)))
    df = df.withColumn("__n", F.when(F.col("__steps").isNull(), 0).otherwise(F.col("__n")))
    valid = F.col("__steps").isNotNull()
    df = df.withColumns({f"__{name}": F.when(valid, check(F.col(name), F.col("__n"))) for name, check in PER_STEP.items()})
    n, per = F.nullif(F.col("__n").cast("double"), F.lit(0.0)), lambda name: F.col(f"__{name}")
    inventory = string_list(F.col("observations"))
    total = F.size(inventory).cast("double")
    total = F.when(inventory.isNotNull(), total)
    used = _sum(per("observations_per_step"))
    over = F.coalesce(used > total, F.lit(False))
    branches, mentions = _sum(per("branchiness_per_step")), _sum(per("mentions_per_step"))
    options = nonnegative_int(F.col("judged_options")).cast("double")
    diversity = binary(F.col("diversity")).cast("double")
    hypotheses = F.when(F.col("selection"), F.when(F.col("option_count") >= 2, F.col("option_count").cast("double")).otherwise(options)).otherwise(branches)
    pairs = comparison_pairs(F.coalesce(hypotheses, F.lit(0.0)))
    compared, share = _sum(per("comparisons_per_step")), lambda name: _count(per(name), lambda x: x != 0) / n
    direction = F.when(F.col("directionality").isin(0.0, 0.5, 1.0), F.col("directionality"))
    anchor_ok = (F.col("anchoring_step") >= 1) & (~valid | (F.col("anchoring_step") <= F.col("__n")))
    anchor = F.when(anchor_ok, F.col("anchoring_step").cast("double"))
    alive, left, help_ = per("gold_alive_per_step"), per("unresolved_per_step"), per("helpfulness_per_step")
    useless = _count(per("proof_disproof_per_step"), lambda x: x == 0)
    helpful, harmful = _count(help_, lambda x: x > 0), _count(help_, lambda x: x < 0)
    known = lambda name, x: F.when(per(name).isNotNull(), x)
    metrics = {
        "total_steps": F.when(valid, F.col("__n").cast("double")),
        "observations_total": total,
        "observations_used": F.when(~over, used),
        "observation_coverage": F.when(~over, used / total),
        "branchiness_total": branches,
        "diversity": F.when(~F.col("selection"), diversity),
        "option_count_judged": F.when(F.col("selection"), options),
        "directionality": direction,
        "step_directionality_mean": _sum(per("step_directionality")) / n,
        "differential_elimination": compared,
        "differential_elimination_normalized": known("comparisons_per_step", share("comparisons_per_step")),
        "comparison_exhaustiveness": compared / F.nullif(pairs.cast("double"), F.lit(0.0)),
        "uncertainty_steps": _sum(per("uncertainty_per_step")),
        "uncertainty_rate": known("uncertainty_per_step", share("uncertainty_per_step")),
        "prior_knowledge": _sum(per("prior_knowledge_per_step")),
        "prior_knowledge_normalized": known("prior_knowledge_per_step", share("prior_knowledge_per_step")),
        "anchoring_point": anchor,
        "anchoring_point_normalized": anchor / n,
        "gold_alive_steps": _sum(alive),
        "gold_alive_rate": _sum(alive) / n,
        "unresolved_contradictions": _sum(left),
        "unresolved_contradiction_normalized": known("unresolved_per_step", share("unresolved_per_step")),
        "backtracking_steps": _sum(per("backtracking_per_step")),
        "backtracking_rate": known("backtracking_per_step", share("backtracking_per_step")),
        "proof_disproof_total": _sum(per("proof_disproof_per_step")),
        "useful_steps": known("proof_disproof_per_step", F.col("__n") - useless),
        "useless_steps": known("proof_disproof_per_step", useless),
        "useful_step_fraction": known("proof_disproof_per_step", (F.col("__n") - useless) / n),
        "useless_step_fraction": known("proof_disproof_per_step", useless / n),
        "mentions_total": mentions,
        "mention_ratio": mentions / F.nullif(branches, F.lit(0.0)),
        "helpful_steps": known("helpfulness_per_step", helpful),
        "neutral_steps": known("helpfulness_per_step", F.size(help_) - helpful - harmful),
        "harmful_steps": known("helpfulness_per_step", harmful),
        "helpfulness_mean": _sum(help_) / n,
        "helpful_fraction": known("helpfulness_per_step", helpful / n),
        "neutral_fraction": known("helpfulness_per_step", (F.size(help_) - helpful - harmful) / n),
        "harmful_fraction": known("helpfulness_per_step", harmful / n),
    }
    errors = [
        F.when(~valid & ~none, F.lit("steps:invalid_or_missing_step_list")),
        *[F.when(valid & per(name).isNull(), F.lit(f"{name}:missing_or_not_one_value_per_step")) for name in PER_STEP],
        F.when(inventory.isNull(), F.lit("observation_inventory:invalid_or_missing_observations")),
        F.when(over, F.lit("observation_coverage:used_exceeds_the_inventory")),
        F.when(direction.isNull(), F.lit("directionality:expected_0_0.5_or_1")),
        F.when(~F.col("selection") & diversity.isNull(), F.lit("branchiness_generation:invalid_or_missing_diversity")),
        F.when(F.col("selection") & options.isNull(), F.lit("option_count:invalid_or_missing_option_count")),
        F.when(~F.col("anchoring_given"), F.lit("anchoring_point:missing_output")),
        F.when(F.col("anchoring_given") & F.col("anchoring_step").isNotNull() & ~anchor_ok, F.lit("anchoring_point:not_an_index_into_the_step_list")),
    ]
    shape = [
        F.when(none, F.lit("steps:no_reasoning_chain_to_segment")),
        F.when(~valid, F.lit("per_step:no_step_list_to_index_against")),
        F.when(F.col("selection"), F.lit("diversity:selection_candidates_are_the_questions_not_the_models")).otherwise(F.lit("option_count:generation_task_has_no_answer_options")),
        F.when(per("comparisons_per_step").isNotNull() & (pairs == 0), F.lit("comparison_exhaustiveness:fewer_than_two_hypotheses_to_pair")),
        F.when(F.col("anchoring_given") & F.col("anchoring_step").isNull(), F.lit("anchoring_point:correct_answer_never_considered")),
    ]
    out = df.withColumns({**{k: v for k, v in metrics.items() if k != "directionality"}, "directionality": direction, "errors": F.array_compact(F.array(*errors)), "inapplicable": F.array_compact(F.array(*shape))})
    return out.drop("__steps", "__n", *[f"__{name}" for name in PER_STEP])


METRICS = (
    "total_steps", "observations_total", "observations_used", "observation_coverage", "branchiness_total", "diversity", "option_count_judged", "directionality", "step_directionality_mean",
    "differential_elimination", "differential_elimination_normalized", "comparison_exhaustiveness", "uncertainty_steps", "uncertainty_rate", "prior_knowledge", "prior_knowledge_normalized",
    "anchoring_point", "anchoring_point_normalized", "gold_alive_steps", "gold_alive_rate", "unresolved_contradictions", "unresolved_contradiction_normalized", "backtracking_steps",
    "backtracking_rate", "proof_disproof_total", "useful_steps", "useless_steps", "useful_step_fraction", "useless_step_fraction", "mentions_total", "mention_ratio", "helpful_steps",
    "neutral_steps", "harmful_steps", "helpfulness_mean", "helpful_fraction", "neutral_fraction", "harmful_fraction",
)


def interesting() -> dict[str, Column]:
    """Predicates over derived rows with `correct` (null when not scored): what is worth a look.  Null counts as false."""
    c, right, wrong = F.col, F.col("correct"), ~F.col("correct")
    steps, alive, help_ = F.col("total_steps"), F.col("gold_alive_per_step"), F.col("helpfulness_per_step")
    half = F.floor(F.size(alive) / 2).cast("int")
    early, late = F.slice(alive, 1, half), F.slice(alive, half + 1, F.size(alive))
    return {
        "all_helpful_but_wrong": (c("helpful_fraction") == 1) & (steps >= 3) & wrong,
        "mostly_harmful_but_correct": (c("harmful_fraction") >= 0.5) & right,
        "gold_in_play_most_steps_but_wrong": (c("gold_alive_rate") >= 0.5) & (steps >= 3) & wrong,
        "gold_dropped_then_wrong": (F.size(alive) >= 4) & F.array_contains(early, 1.0) & ~F.array_contains(late, 1.0) & wrong,
        "answer_appears_only_at_last_step_correct": (c("anchoring_point_normalized") == 1) & (steps >= 4) & right,
        "guess_first_anchored_at_step1_wrong": (c("directionality") == 0) & (c("anchoring_point") == 1) & (steps >= 3) & wrong,
        "evidence_first_full_coverage_but_wrong": (c("directionality") == 1) & (c("observation_coverage") == 1) & wrong,
        "correct_without_using_any_observation": (c("observations_used") == 0) & right,
        "world_knowledge_not_evidence_correct": (c("prior_knowledge_normalized") >= 0.8) & (c("observation_coverage") <= 0.25) & right,
        "incoherent_but_correct": (c("unresolved_contradictions") >= 2) & right,
        "confidently_wrong": (c("uncertainty_steps") == 0) & (steps >= 5) & wrong,
        "hedges_everywhere_but_correct": (c("uncertainty_rate") >= 0.8) & (steps >= 3) & right,
        "recovered_after_harm": (c("harmful_steps") >= 1) & (c("backtracking_steps") >= 1) & right,
        "exhaustive_comparison_but_wrong": c("selection") & (c("comparison_exhaustiveness") >= 1) & wrong,
        "tunnel_vision": c("selection") & (c("option_count") >= 4) & (c("branchiness_total") <= 1),
        "rumination": c("mention_ratio") >= 5,
        "late_derailment": (F.size(help_) >= 3) & (F.element_at(help_, -1) == -1) & F.array_contains(F.slice(help_, 1, F.greatest(F.size(help_) - 1, F.lit(0))), 1.0) & wrong,
        "filler_but_correct": (c("useful_step_fraction") <= 0.25) & (steps >= 4) & right,
    }


def problems() -> dict[str, Column]:
    """Predicates over derived rows: where judges contradict each other or a list breaks its invariant."""
    c, right, steps = F.col, F.col("correct"), F.col("total_steps")
    alive = F.col("gold_alive_per_step")
    lengths = F.lit(False)
    for name in PER_STEP:
        lengths = lengths | F.coalesce(F.size(F.when(F.col(name).isNotNull(), F.col(name))) != steps, F.lit(False))
    first = F.array_position(alive, F.lit(1.0))
    return {
        "coverage_used_exceeds_inventory": F.array_contains("errors", "observation_coverage:used_exceeds_the_inventory") | F.coalesce(_sum(c("observations_per_step")) > c("observations_total"), F.lit(False)),
        "list_length_mismatch": steps.isNotNull() & lengths,
        "anchoring_out_of_range": (c("anchoring_step") < 1) | (c("anchoring_step") > steps),
        "correct_but_gold_never_in_play": right & (c("gold_alive_steps") == 0) & (steps >= 2),
        "anchoring_contradicts_gold_alive": right & c("selection") & (first > 0) & ((c("anchoring_given") & c("anchoring_step").isNull()) | (c("anchoring_point") > first)),
        "counts_do_not_sum": ((c("helpful_steps") + c("neutral_steps") + c("harmful_steps")) != steps) | ((c("useful_steps") + c("useless_steps")) != steps),
        "mentions_below_branchiness": c("mentions_total") < c("branchiness_total"),
        "more_candidates_than_options": c("selection") & (c("option_count") >= 2) & (c("branchiness_total") > c("option_count")),
        "directionality_judges_disagree": (F.abs(c("directionality") - c("step_directionality_mean")) >= 0.9) & (steps >= 3),
        "helpful_but_proves_nothing": (c("helpful_fraction") == 1) & (c("useful_step_fraction") == 0) & (steps >= 3),
        "under_segmented": (c("trace_chars") > 3000) & ((steps == 1) | (c("trace_chars") / F.nullif(steps, F.lit(0.0)) > 4000)),
        "over_segmented": steps >= 80,
        "metrics_from_records_only": c("metrics_source") == "records",
    }


def hits(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """keys, rule: a row for each rule that a row meets; a rule that is null is not met."""
    met = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(*keys, F.explode(met).alias("rule"))


def repeat_divergence(df: DataFrame, keys: list[str], correct: str, means: list[str], name: str) -> DataFrame:
    """Questions with both a correct and a wrong repeat, and each side's means."""
    ok = F.col(correct)
    listed = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col(name).cast("string")))), ";")
    out = df.groupBy(*keys).agg(
        F.count("*").alias("repeats"), F.count_if(ok).alias("n_correct"), F.count_if(~ok).alias("n_wrong"), listed(ok).alias("correct_repeats"), listed(~ok).alias("wrong_repeats"),
        *[F.avg(F.when(ok, F.col(m))).alias(f"{m}_correct") for m in means], *[F.avg(F.when(~ok, F.col(m))).alias(f"{m}_wrong") for m in means],
    )
    return out.where("n_correct > 0 AND n_wrong > 0")


def unique_solver(df: DataFrame, keys: list[str], model: str, correct: str) -> DataFrame:
    """Questions of three models or more that one always solves and all others never do."""
    per = df.groupBy(*keys, model).agg(F.avg(F.col(correct).cast("double")).alias("m"))
    out = per.groupBy(*keys).agg(F.count("*").alias("n_models"), F.count_if(F.col("m") == 1).alias("always"), F.count_if(F.col("m") == 0).alias("never"), F.max(F.when(F.col("m") == 1, F.col(model))).alias("only_solver"))
    return out.where("n_models >= 3 AND always = 1 AND never = n_models - 1").drop("always", "never")


def interaction(df: DataFrame, verdicts: str, n_actions: str) -> DataFrame:
    """Relevant and irrelevant actions; verdicts past the last action are dropped."""
    kept = F.slice(F.col(verdicts), F.lit(1), F.col(n_actions).cast("int"))
    relevant = _count(kept, lambda x: x == 1)
    return df.withColumn("relevant_actions", relevant).withColumn("irrelevant_actions", F.size(kept) - relevant).withColumn("relevance_rate", relevant / F.nullif(F.size(kept), F.lit(0)))
