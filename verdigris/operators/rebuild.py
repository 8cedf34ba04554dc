"""A stored run, rebuilt from its task folders in one scan.

A run lies in <run>/datasets/<dataset>/<model>/<template>@<version>/ with
records.jsonl, metrics.json, checkpoint.json and turns.jsonl, and an event log
beside them.  A task is its folder, so what it is called comes from the path of
each file; nothing walks over folders.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.operators.aggregate import whole_groups
from verdigris.operators.records import SCORED, dedupe_last
from verdigris.sources.readers import RECORD

TASK = ["dataset_id", "model_id", "template_id", "template_version"]
MODES = {"prompt_mode": "io", "selection_mode": "n/a", "task_kind": "generation", "data_delivery_mode": "static"}
#: What a record says of the reply to its prompt.
ANSWER = ("response", "status", "metrics", "prediction", "parse_ok")
#: What a task's own files say of it.
METRICS = "metrics map<string,string>, counts struct<planned:bigint>, primary_metric string, failure string"
CHECKPOINT = "total_planned bigint"
TURN = "sample_id string, turn_number bigint, status string, input_tokens_est bigint, response struct<content:string,finish_reason:string,latency_s:double>"
EVENT = "event string, ts double, dataset_id string, reason string"


def task_of(path: Column) -> dict[str, Column]:
    """A task's names from the path of one of its files; folders may be written as name=value."""
    part = lambda n: F.regexp_replace(F.try_url_decode(F.replace(F.regexp_extract(path, "/datasets/([^/]+)/([^/]+)/([^/]+)/", n), F.lit("+"), F.lit("%2B"))), "^[a-z_]+=", "")
    unescaped = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))  # noqa: E731  a folder name is escaped once more than its path
    template = unescaped(part(3))
    version = F.substring_index(template, "@", -1)
    return {"dataset_id": unescaped(part(1)), "model_id": unescaped(part(2)), "template_id": F.substring_index(template, "@", 1), "template_version": F.when(F.contains(template, F.lit("@")) & (version != ""), version).otherwise("1.0")}


def task_files(spark: SparkSession, run: str, name: str, schema: str, **options: bool) -> DataFrame:
    """The rows of one file of all tasks, in one scan, with the task's names; no rows if no task has the file.  Torn and broken lines are dropped.

    Names are worked out once a file, and sent to where its rows are read: as
    many as there are files, which Spark's own listing holds as well.
    """
    path, files = F.col("_metadata.file_path").alias("__path"), f"{run}/datasets/*/*/*/*{name}"
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").options(**options).json(files)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema).withColumn("__path", F.lit(None).cast("string"))
        return rows.withColumns(task_of(F.col("__path"))).drop("__path")
    # listed after the rows' files, so that none of these is missing
    names = spark.read.format("binaryFile").load(files).select(path).withColumns(task_of(F.col("__path")))
    return rows.drop(*TASK).select("*", path).join(F.broadcast(names), "__path").drop("__path")


def run_records(spark: SparkSession, run: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The records of all tasks: the last of each sample and prompt, metrics as numbers, without members of reduced groups.

    Modes that a record does not name are those of a static generation task.
    With `columns` only these stand beside a record's key, and no others are
    carried to where its versions meet; response.x is a response of x alone.
    """
    rows = task_files(spark, run, "records.jsonl", RECORD).where("sample_id IS NOT NULL")
    key = ["__key", *TASK, "sample_id", "prompt_fingerprint"]  # a hash stands before the names: these begin alike, and so sort by a number
    asked = tuple(c for c in rows.columns if c not in key) if columns is None else columns
    columns = [c.split(".")[0] for c in asked]
    held = [F.struct(c).alias(c.split(".")[0]) if "." in c else F.col(c) for c in dict.fromkeys((*asked, "seq", "group_id"))]
    folded = F.coalesce(F.col("metadata.reduced"), F.lit(False)).alias("__folded")
    rows = rows.select(F.xxhash64(*key[1:]).alias("__key"), *key[1:], *held, folded)
    last = dedupe_last(rows, key, "seq").drop("__key", "first_seq")
    # a head meets the members of its group; a row without a group lies anywhere
    met = last.withColumn("__group", F.when(F.col("__folded"), F.col("sample_id")).otherwise(F.col("group_id")))
    met = met.withColumn("__key", F.xxhash64(*TASK, F.coalesce("__group", "sample_id")))
    kept = met.withColumn("__has_head", F.max("__folded").over(Window.partitionBy("__key", *TASK, "__group"))).where("__folded OR NOT __has_head")
    numbers = F.map_filter(F.transform_values("metrics", lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    given = {"metrics": numbers, **{c: F.coalesce(c, F.lit(v)) for c, v in MODES.items()}}
    return kept.select(*TASK, "sample_id", "prompt_fingerprint", *[given[c].alias(c) if c in given else c for c in columns])


def run_prompts(records: DataFrame, prompts: DataFrame, keys: tuple[str, ...] = ("sample_id", "prompt_fingerprint")) -> DataFrame:
    """Rendered prompts with the response and the score that a stored record has for them: the columns of prompts, response, status, score, stored.

    A record answers a prompt with its sample and its fingerprint; a prompt
    without one has stored = false.  A reply that is not scored has no score.
    Of the records' columns beside the keys ANSWER is all that is read.
    """
    score = F.when(F.col("status").isin(*SCORED), F.struct("metrics", "prediction", F.coalesce("parse_ok", F.lit(True)).alias("parse_ok")))
    known = records.select(*keys, "response", "status", score.alias("score"), F.lit(True).alias("stored"))
    return prompts.join(known, list(keys), "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def run_tasks(spark: SparkSession, run: str, records: DataFrame | None = None) -> DataFrame:
    """A row for each task: its names and modes, counts, rates, primary metric, and the map of its metrics.

    Metrics are the means of the records on disk, over the records that have
    each of them; what metrics.json says counts only where records have none.
    Planned rows come from metrics.json, else from the checkpoint, else from
    the records.  The strict value takes what is missing as 0; tasks in
    episodes have none.  Modes are those of the record with the lowest sequence.
    """
    rows = run_records(spark, run, (*MODES, "seq", "status", "response.latency_s", "parse_ok", "metrics")) if records is None else records
    scored = F.col("status").isin(*SCORED)
    latency = F.when(F.col("response.latency_s") != 0, F.col("response.latency_s"))
    # a row of each metric, or one without: the first stands for the record, so that one pass of sums of numbers has it all
    entries = F.posexplode_outer(F.when(scored, whole_groups(F.col("metrics")))).alias("__at", "__metric", "__v")
    rows = rows.select(*TASK, *MODES, F.coalesce("seq", F.lit(-(2**63))).alias("__seq"), "status", scored.alias("__scored"), (scored & ~F.coalesce("parse_ok", F.lit(True))).alias("__unparsed"), latency.alias("__latency"), entries)
    once = F.coalesce("__at", F.lit(0)) == 0
    n = {"n_records": once, "n_scored": once & F.col("__scored"), **{f"n_{s}": once & (F.col("status") == s) for s in ("error", "skipped", "truncated", "empty")}, "n_unparsed": once & F.col("__unparsed"), "__timed": once & F.col("__latency").isNotNull(), "__n": F.col("__v").isNotNull()}
    parts = rows.groupBy(*TASK, *MODES, "__metric").agg(F.min("__seq").alias("__seq"), *[F.count_if(x).alias(c) for c, x in n.items()], F.sum(F.when(once, F.col("__latency"))).alias("__latency"), F.sum("__v").alias("__v"))
    # what is left is a row for each task, mode and metric
    sums = [F.sum(c).alias(c) for c in (*n, "__latency", "__v")]
    parts = parts.groupBy(*TASK, "__metric").agg(F.min(F.struct("__seq", *MODES)).alias("__first"), *sums)
    found = F.array_sort(F.collect_list(F.when(F.col("__metric").isNotNull(), F.struct(F.col("__metric").alias("metric"), (F.col("__v") / F.col("__n")).alias("value")))))
    counts = parts.groupBy(*TASK).agg(F.min("__first").alias("__first"), found.alias("__found"), *sums)
    counts = counts.select(*TASK, *[F.col(f"__first.{c}").alias(c) for c in MODES], *[c for c in n if c not in ("__n", "__timed")], (F.col("__latency") / F.nullif("__timed", F.lit(0))).alias("latency_s_mean"), F.when(F.size("__found") > 0, F.map_from_entries("__found")).alias("found"))
    said = task_files(spark, run, "metrics.json", METRICS, multiLine=True).select(*TASK, F.col("metrics").alias("__stored"), F.col("counts.planned").alias("__planned"), F.col("primary_metric").alias("__primary"), "failure")
    begun = task_files(spark, run, "checkpoint.json", CHECKPOINT, multiLine=True).select(*TASK, F.col("total_planned").alias("__total"))
    one = lambda df: df.groupBy(*TASK).agg(*[F.first(c, True).alias(c) for c in df.columns if c not in TASK])
    tasks = counts.join(one(said), TASK, "left").join(one(begun), TASK, "left")
    stored = F.map_filter(F.transform_values("__stored", lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    tasks = tasks.withColumn("n_planned", F.coalesce(F.nullif("__planned", F.lit(0)), F.nullif("__total", F.lit(0)), "n_records")).withColumn("primary_metric", F.coalesce("__primary", F.lit("")))
    tasks = tasks.withColumn("metrics", F.coalesce("found", stored, F.create_map().cast("map<string,double>")))
    of = lambda n, d: F.col(n) / F.greatest(F.col(d), F.lit(1))
    episode = F.col("data_delivery_mode") == "interactive"
    tasks = tasks.withColumns({"coverage": of("n_scored", "n_planned"), "parse_failure_rate": of("n_unparsed", "n_scored"), "truncation_rate": of("n_truncated", "n_planned"), "empty_response_rate": of("n_empty", "n_planned")})
    primary = F.try_element_at("metrics", F.col("primary_metric"))
    tasks = tasks.withColumns({"primary": primary, "strict": F.when(~episode, primary * F.col("coverage"))})
    return tasks.select(*TASK, *MODES, "n_planned", "n_scored", "n_error", "n_skipped", "coverage", "parse_failure_rate", "truncation_rate", "empty_response_rate", "latency_s_mean", "primary_metric", "primary", "strict", "failure", "metrics")


def run_turns(spark: SparkSession, run: str, records: DataFrame | None = None) -> DataFrame:
    """The turns of all tasks with is_last, and on each episode's last turn the status and prediction of its latest record.

    Turns are read once and meet by episode, where the record comes to them.
    """
    rows = run_records(spark, run, ("seq", "status", "prediction")) if records is None else records
    turns = task_files(spark, run, "turns.jsonl", TURN).where("sample_id IS NOT NULL")
    key = ["__key", *TASK, "sample_id"]
    turns = turns.withColumn("__key", F.xxhash64(*key[1:]))
    marked = turns.withColumn("is_last", F.col("turn_number") == F.max("turn_number").over(Window.partitionBy(*key)))
    record = rows.select(F.xxhash64(*key[1:]).alias("__key"), *key[1:], F.col("status").alias("record_status"), "prediction", "seq")
    record = dedupe_last(record, key, "seq").drop("seq", "first_seq")
    joined = marked.join(record, key, "left").drop("__key")
    return joined.withColumns({c: F.when(F.col("is_last"), F.col(c)) for c in ("record_status", "prediction")})


def run_events(spark: SparkSession, run: str) -> DataFrame:
    """What the event log says of the run: started_at, finished_at (the last of each), and the datasets that were skipped, with reasons."""
    rows = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(f"{run}/events.jsonl")
    at = lambda name: F.coalesce(F.max(F.when(F.col("event") == name, F.col("ts"))), F.lit(0.0))
    skipped = F.when(F.col("event") == "dataset_skipped", F.struct(F.coalesce("dataset_id", F.lit("")).alias("dataset_id"), F.coalesce("reason", F.lit("")).alias("reason")))
    return rows.agg(at("run_started").alias("started_at"), at("run_finished").alias("finished_at"), F.array_sort(F.collect_set(skipped)).alias("skipped"))  # as many as there are datasets
