"""The query library: what each dataset scores and averages, as plans over one table of replies.

A plan's input has a row for each reply: sample_id, content, reasoning,
finish_reason, and as far as its scorer reads them gold (string),
gold_labels (array<string>), accepted (array<string>), labels (array<string>),
verdict_label, verdict_score, and the columns of its strata and gates.
`score` adds a sparse map of metrics, prediction and parse_ok; `aggregate`
averages the map and adds the plan's derived figures.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import extract, text
from verdigris.operators.aggregate import sparse_mean

LETTERS = tuple("ABCDEFGHIJ")


def _map(**metrics: Column) -> Column:
    """A sparse map: null values have no key."""
    full = F.map_from_arrays(F.array(*[F.lit(k) for k in metrics]), F.array(*[v.cast("double") for v in metrics.values()]))
    return F.map_filter(full, lambda k, v: v.isNotNull())


def selection(metric: str) -> Callable[[Column], tuple[Column, Column, Column]]:
    def score(c: Column) -> tuple[Column, Column, Column]:
        found = extract.choice_label(c, LETTERS, prefix="Answer:")
        return _map(**{metric: F.coalesce(found == F.upper(F.trim("gold")), F.lit(False))}), found, found.isNotNull()

    return score


def multi_selection(metric: str) -> Callable[[Column], tuple[Column, Column, Column]]:
    def score(c: Column) -> tuple[Column, Column, Column]:
        found = extract.choice_labels(c, LETTERS, prefix="Answer:")
        held = lambda found: F.coalesce(found, F.array().cast("array<string>"))

        def metrics(found: Column) -> Column:
            mine = held(found)
            same = F.array_sort(F.array_distinct(mine)) == F.array_sort(F.array_distinct("gold_labels"))
            return text.once(F.struct(found.isNotNull().alias("read"), text.set_prf(mine, F.col("gold_labels")).alias("prf"), same.cast("double").alias("same"), F.size(mine).alias("n")), named)

        def named(s: Column) -> Column:
            zero = lambda x: F.when(s["read"], x).otherwise(0.0)
            f1, same = zero(s["prf"]["f1"]), zero(s["same"])
            return _map(**{"exact_set": same, "set_f1": f1, "set_precision": zero(s["prf"]["precision"]), "set_recall": zero(s["prf"]["recall"]), "n_selected": s["n"], metric: f1 if metric.endswith("f1") else same})

        return text.once(found, metrics), F.array_join(held(found), ","), found.isNotNull()

    return score


def number_set(metric: str) -> Callable[[Column], tuple[Column, Column, Column]]:
    """The whole numbers of the answer as a set against the gold ones: equal, F1, and as many."""

    def score(c: Column) -> tuple[Column, Column, Column]:
        span = extract.answer_span(c, prefix="Answer:")
        found = F.array_distinct(F.transform(F.regexp_extract_all(span, F.lit("\\d+"), F.lit(0)), lambda x: x.cast("int")))
        gold = F.array_distinct(F.transform("gold_labels", lambda x: x.cast("int")))

        # a gold list of other labels is not read as numbers where no reply is
        def metrics(found: Column) -> Column:
            read, same = F.size(found) > 0, F.array_sort(found) == F.array_sort(gold)
            count = F.when(read, (F.size(found) == F.size(gold)).cast("double"))
            return _map(**{metric: read & same, "premise_f1": F.when(read, text.set_prf(found, gold)["f1"]).otherwise(0.0), "premise_count_match": count})

        said = F.array_join(F.transform(F.array_sort(found), lambda x: x.cast("string")), " ")
        read = F.size(found) > 0
        return text.once(found, metrics), F.when(read, said).otherwise(F.left(span, F.lit(200))), read

    return score


def free_text(metric: str) -> Callable[[Column], tuple[Column, Column, Column]]:
    """Match (equal to or containing the gold answer or an accepted one), exact match, token F1 and ROUGE-L."""

    def score(c: Column) -> tuple[Column, Column, Column]:
        span = extract.answer_span(c, prefix="Answer:")
        own = text.normalize_answer(span)
        accepted = F.transform(F.coalesce("accepted", F.array().cast("array<string>")), lambda a: text.normalize_answer(a))
        match = (text.contains_match(span, F.col("gold")) == 1) | F.exists(accepted, lambda a: (a != "") & F.contains(own, a))
        named = {"match": match, "exact_match": text.exact_match(span, F.col("gold")), "token_f1": text.token_prf(span, F.col("gold"))["f1"], "rouge_l": text.rouge_l(span, F.col("gold"))["f"]}
        return _map(**{**named, metric: named.get(metric, match)}), span, span != ""

    return score


def judged(metric: str) -> Callable[[Column], tuple[Column, Column, Column]]:
    """The verdict's score, clamped to [0, 1], or whether its label is positive; absent where there is no verdict."""

    def score(c: Column) -> tuple[Column, Column, Column]:
        span = extract.answer_span(c, prefix="Answer:")
        said = F.col("verdict_label").isNotNull() | F.col("verdict_score").isNotNull()
        value = F.coalesce(F.when(F.col("verdict_score").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "verdict_score"))), extract.positive(F.col("verdict_label"), F.col("verdict_score")).cast("double"))
        return _map(**{metric: F.when(said, value)}), span, span != ""

    return score


def contained(metric: str) -> Callable[[Column], tuple[Column, Column, Column]]:
    """Strict containment of the gold label in the answer, lenient in the whole reply; variants of the label count."""

    def score(c: Column) -> tuple[Column, Column, Column]:
        span = extract.answer_span(c, prefix="Answer:")
        forms = text.label_variants(F.col("gold"))
        return _map(**{metric: text.any_contains(span, forms), f"{metric}_lenient": text.any_contains(c, forms)}), span, span != ""

    return score


@dataclass(frozen=True)
class Plan:
    dataset_id: str
    delivery: str
    cardinality: str
    objective: bool
    primary: str
    scorer: Callable[[str], Callable[[Column], tuple[Column, Column, Column]]]
    strata: tuple[str, ...] = ()
    #: name -> (metric of one stratum, metric of the other): their difference
    gaps: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: name -> the prefix of stratum metrics whose unweighted mean it is
    balanced: dict[str, str] = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        metrics, prediction, ok = self.scorer(self.primary)(F.col("content"))
        rows = df.withColumns({"__m": metrics, "prediction": prediction, "parse_ok": ok})
        value = F.try_element_at("__m", F.lit(self.primary))
        for s in self.strata:
            label = F.regexp_replace(F.lower(F.col(s).cast("string")), "[^a-z0-9.]+", "_")
            key = F.concat(F.lit(f"{self.primary}_"), label)
            new = F.col(s).isNotNull() & value.isNotNull() & ~F.array_contains(F.map_keys("__m"), key)
            extra = F.when(new, F.map_from_arrays(F.array(key), F.array(value)))
            rows = rows.withColumn("__m", F.map_concat("__m", F.coalesce(extra, F.create_map().cast("map<string,double>"))))
        return rows.withColumnRenamed("__m", "metrics")

    def aggregate(self, df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """keys, metric, value, n."""
        means = sparse_mean(df, list(keys))
        out = means
        for name, (a, b) in self.gaps.items():
            one, two = (F.max(F.when(F.col("metric") == m, F.col("value"))) for m in (a, b))
            gap = means.groupBy(*keys).agg((one - two).alias("value"), F.sum(F.when(F.col("metric").isin(a, b), F.col("n"))).alias("n")).where("value IS NOT NULL")
            out = out.unionByName(gap.withColumn("metric", F.lit(name)))
        for name, prefix in self.balanced.items():
            flat = means.where(F.startswith("metric", F.lit(prefix))).groupBy(*keys).agg(F.avg("value").alias("value"), F.sum("n").alias("n"))
            out = out.unionByName(flat.withColumn("metric", F.lit(name)))
        return out


def _plan(*args, **options) -> tuple[str, Plan]:
    return args[0], Plan(*args, **options)


#: Each dataset's delivery, answer cardinality, whether a machine can check it, primary metric and strata.
PLANS: dict[str, Plan] = dict(
    [
        _plan("abd", "static", "none", True, "valid", judged),
        _plan("abductionrules", "static", "none", True, "exact_match", free_text, strata=("subset",)),
        _plan("aer", "static", "multi", True, "set_f1", multi_selection),
        _plan("agentrx", "static", "single", True, "accuracy", selection, strata=("collection",)),
        _plan("aiops2025", "static", "none", True, "root_cause_match", contained),
        _plan("art", "static", "single", True, "accuracy", selection),
        _plan("athena_bench", "sequential", "none", False, "final_answer_accuracy", judged),
        _plan("b_copa", "static", "single", True, "accuracy", selection, strata=("variant",), gaps={"mirror_gap": ("accuracy_original", "accuracy_mirrored")}),
        _plan("causalopsbench", "static", "none", True, "component_match", contained),
        _plan("causelogics", "static", "single", True, "accuracy", selection, strata=("level",)),
        _plan("climate_fever", "static", "single", True, "accuracy", selection, strata=("class",), balanced={"balanced_accuracy": "accuracy_"}),
        _plan("cloud_opsbench", "interactive", "none", False, "joint_rca_accuracy", judged),
        _plan("commonwhy", "static", "none", False, "explanation_judged", judged, strata=("popularity",), gaps={"popularity_gap": ("explanation_judged_head", "explanation_judged_longtail")}),
        _plan("crosstrace", "static", "none", False, "insight_judged", judged, strata=("domain",)),
        _plan("ddxplus", "interactive", "single", True, "diagnosis_match", free_text),
        _plan("defab", "static", "single", True, "accuracy", selection, strata=("level", "source")),
        _plan("diagnosisarena", "static", "single", True, "diagnosis_match", free_text),
        _plan("ecare", "static", "single", True, "accuracy", selection),
        _plan("enwn_entailmentbank", "static", "none", False, "premise_judged", judged, strata=("corpus",)),
        _plan("gear", "static", "single", True, "accuracy", selection, strata=("gold_kind",)),
        _plan("house_md", "static", "none", False, "diagnosis_judged", judged),
        _plan("hypoarena", "static", "none", False, "proxy_hypothesis_quality_score", judged, strata=("domain",)),
        _plan("hypobench", "static", "none", False, "proxy_closest_hypothesis_score", judged, strata=("task",)),
        _plan("hypogen", "static", "none", False, "flip_judged", judged),
        _plan("inabhyd", "static", "none", False, "hypothesis_judged", judged, strata=("recover", "hops")),
        _plan("llm4biohypogen", "static", "none", False, "hypothesis_judged", judged),
        _plan("matter_to_mechanism", "static", "none", False, "hypothesis_judged", judged),
        _plan("med_inquire", "interactive", "none", False, "diagnosis_judged", judged),
        _plan("medcasereasoning", "static", "none", False, "diagnosis_judged", judged),
        _plan("medqdx", "interactive", "none", False, "diagnosis_judged", judged, strata=("level",), gaps={"information_sensitivity": ("diagnosis_judged_100", "diagnosis_judged_50")}),
        _plan("medr_bench", "static", "none", False, "diagnosis_judged", judged),
        _plan("medups", "static", "none", False, "next_step_judged", judged, strata=("position",)),
        _plan("moose_chem2", "static", "none", False, "hypothesis_judged", judged),
        _plan("musr", "static", "single", True, "accuracy", selection, strata=("subset",)),
        _plan("neulr", "static", "none", False, "premise_judged", judged),
        _plan("proof_writer", "static", "none", True, "exact_match", free_text, strata=("depth", "config")),
        _plan("researchbench", "static", "single", False, "hypothesis_judged", judged),
        _plan("scir", "static", "single", True, "accuracy", selection, strata=("task",)),
        _plan("synpat", "static", "none", True, "equation_equivalent", judged),
        _plan("true_detective", "static", "single", True, "accuracy", selection),
        _plan("uncommonsense", "static", "none", False, "proxy_closest_explanation_score", judged),
        _plan("uniadilr_hgc", "static", "none", True, "premise_set_match", number_set),
        _plan("vivabench", "interactive", "none", False, "diagnosis_judged", judged),
        _plan("xcopa", "static", "single", True, "accuracy", selection, strata=("lang",)),
    ]
)


def _by_dataset(value: Callable[[Plan], object], kind: str) -> Column:
    """A literal of each plan, looked up by the row's dataset_id."""
    told = [x for name, p in PLANS.items() for x in (F.lit(name), F.array(*[F.lit(v) for v in value(p)]).cast(kind) if isinstance(value(p), tuple) else F.lit(value(p)).cast(kind))]
    return F.try_element_at(F.create_map(*told), F.col("dataset_id"))


#: Scorers whose figures do not depend on the primary metric's name, so that one expression serves all their datasets.
NAMED_ONCE = (selection, number_set, judged, contained)


def score_library(df: DataFrame) -> DataFrame:
    """Replies of any datasets with metrics, prediction and parse_ok, each row by its dataset's plan.

    df: dataset_id, the scorers' columns (see above) and `strata`, a map of the
    names of strata to their labels.  One pass over the rows, whatever the
    number of datasets; a row of an unknown dataset has no metrics.
    """
    groups: dict[tuple, list[str]] = {}
    for name, p in PLANS.items():
        groups.setdefault((p.scorer, "primary" if p.scorer in NAMED_ONCE else p.primary), []).append(name)
    out = F.when(F.lit(False), F.lit(None))
    for (scorer, primary), names in groups.items():
        metrics, prediction, ok = scorer(primary)(F.col("content"))
        out = out.when(F.col("dataset_id").isin(*names), F.struct(metrics.alias("m"), prediction.alias("prediction"), ok.alias("ok")))
    rows = df.withColumns({"__o": out, "__p": _by_dataset(lambda p: p.primary, "string"), "__s": _by_dataset(lambda p: p.strata, "array<string>")})
    own = F.transform_keys("__o.m", lambda k, v: F.when((k == "primary") | (k == "primary_lenient"), F.replace(k, F.lit("primary"), F.col("__p"))).otherwise(k))
    rows = rows.withColumns({"__m": own, "prediction": F.col("__o.prediction"), "parse_ok": F.col("__o.ok")})
    value = F.try_element_at("__m", F.col("__p"))
    labels = F.array_compact(F.transform("__s", lambda s: F.try_element_at("strata", s)))
    named = F.array_distinct(F.transform(labels, lambda x: F.concat(F.col("__p"), F.lit("_"), F.regexp_replace(F.lower(x), "[^a-z0-9.]+", "_"))))
    new = F.filter(named, lambda k: value.isNotNull() & ~F.map_contains_key("__m", k))
    extra = F.map_from_arrays(new, F.transform(new, lambda k: value))
    return rows.withColumn("metrics", F.map_concat("__m", F.coalesce(extra, F.create_map().cast("map<string,double>")))).drop("__o", "__m", "__p", "__s")


def aggregate_library(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """dataset_id, keys, metric, value, n: means of all datasets' metrics, and the figures that their plans derive.

    The means are few, so what is derived from them is a second small aggregate:
    a gap sums its strata with their signs and stands only where both exist.
    """
    by = ["dataset_id", *keys]
    means = sparse_mean(df, by)
    role = lambda d, name, kind, metric, sign: F.struct(F.lit(d).alias("d"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(metric).alias("m"), F.lit(sign).alias("sign"))
    gaps = [role(d, g, "gap", m, sign) for d, p in PLANS.items() for g, pair in p.gaps.items() for m, sign in zip(pair, (1.0, -1.0), strict=True)]
    flat = [role(d, b, "mean", prefix, 1.0) for d, p in PLANS.items() for b, prefix in p.balanced.items()]
    fits = lambda r: (r["d"] == F.col("dataset_id")) & F.when(r["kind"] == "gap", r["m"] == F.col("metric")).otherwise(F.startswith("metric", r["m"]))
    parts = means.withColumn("__r", F.explode(F.filter(F.array(*gaps, *flat), fits))).groupBy(*by, "__r.name", "__r.kind")
    derived = parts.agg(F.sum(F.col("__r.sign") * F.col("value")).alias("__s"), F.count("*").alias("__k"), F.sum("n").alias("n")).where("kind = 'mean' OR __k = 2")
    return means.unionByName(derived.select(*by, F.col("name").alias("metric"), F.when(F.col("kind") == "gap", F.col("__s")).otherwise(F.col("__s") / F.col("__k")).alias("value"), "n"))
