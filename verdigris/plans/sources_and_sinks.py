"""Queries of sources, sinks and streams: tables go out by a sink, come back by a reader, and are compared with what went out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import modes, records, sampling, windows
from verdigris.plans import reports
from verdigris.plans.registry import fixture, query, table
from verdigris.plans.session import scratch
from verdigris.sources import readers, sinks
from verdigris.streaming import state


@query("SELECT id, name, size FROM [grid] g WHERE id % 5 > 1")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Gzipped JSON lines with blank and torn ones between, which are dropped."""
    path, g = scratch(spark, "json_lines"), fixture(spark, d, "grid")
    whole = F.to_json(F.struct("id", "name", "size"))
    g.select(F.when(F.col("id") % 5 == 0, " ").when(F.col("id") % 5 == 1, F.substr(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole)).write.mode("overwrite").option("compression", "gzip").text(path)
    return readers.jsonl(spark, path, g.select("id", "name", "size").schema)


@query("SELECT id::VARCHAR AS id, CASE WHEN id % 3 = 0 THEN 'a \"b\"' || chr(10) || 'c' ELSE name END AS name, CASE WHEN id % 4 > 0 THEN size::VARCHAR END AS size FROM [grid] g")
def delimited(spark: SparkSession, d: str) -> DataFrame:
    """A report written as CSV and read as strings: quotes, line breaks, missing values."""
    path = scratch(spark, "delimited.csv")
    g = fixture(spark, d, "grid").select("id", F.when(F.col("id") % 3 == 0, 'a "b"\nc').otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 4 > 0, F.col("size")).alias("size"))
    g.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return readers.csv(spark, path)


@query("SELECT id, kind FROM [grid] g")
def tab_delimited(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "kinds.tsv")
    fixture(spark, d, "grid").select("id", "kind").write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    return readers.csv(spark, path).select(F.col("id").cast("bigint").alias("id"), "kind")


@query("SELECT name || ' ' || id AS value FROM [grid] g WHERE id % 3 > 0")
def stripped_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "stripped_lines")
    fixture(spark, d, "grid").select(F.when(F.col("id") % 3 > 0, F.concat(F.lit(" \t"), "name", F.lit(" "), "id", F.lit("\t "))).otherwise("\t ")).write.mode("overwrite").text(path)
    return readers.lines(spark, path).select("value")


@query("SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS line_no, name AS source, kind AS target FROM [grid] g")
def paired_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two files of lines, joined by position."""
    g = fixture(spark, d, "grid")
    sides = {}
    for side, column in (("source", "name"), ("target", "kind")):
        path = scratch(spark, f"paired_{side}")
        g.coalesce(1).sortWithinPartitions("id").select(column).write.mode("overwrite").text(path)
        sides[side] = readers.numbered_lines(spark, path).withColumnRenamed("value", side)
    return readers.zip_join(sides["source"], sides["target"])


@query("SELECT model_id, count(*) AS n, count(*) AS good FROM [grid] g GROUP BY model_id")
def whole_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder for each model, read whole: their lines, and those of files that end with one."""
    path = scratch(spark, "whole_files")
    fixture(spark, d, "grid").select("model_id", "name").write.mode("overwrite").partitionBy("model_id").text(path)
    whole = readers.text_file(spark, f"{path}/*").withColumn("model_id", F.regexp_extract("path", "model_id=([^/]+)/", 1))
    n = F.regexp_count("text", F.lit("\n"))
    return whole.groupBy("model_id").agg(F.sum(n).cast("bigint").alias("n"), F.sum(F.when(F.endswith("text", F.lit("\n")), n)).cast("bigint").alias("good"))


@query("SELECT min('x/' || CASE WHEN n_nationkey % 5 = 2 THEN 'new-dev_' || n_nationkey ELSE 'z_dev' END || '.json') AS path, 'dev' AS split FROM nation WHERE n_nationkey % 5 IN (2, 4)")
def split_choice(spark: SparkSession, d: str) -> DataFrame:
    """The split that comes first, by tokens of the name; 'testament' is no test split."""
    k = F.col("n_nationkey")
    name = F.when(k % 5 == 0, "train").when(k % 5 == 1, "testament").when(k % 5 == 2, F.concat(F.lit("new-dev_"), k.cast("string"))).when(k % 5 == 3, "validation").otherwise("z_dev")
    return readers.pick_split(table(spark, d, "nation").select(F.concat(F.lit("x/"), name, F.lit(".json")).alias("path")))


@query(
    """WITH r AS (SELECT *, id // 2 AS sample FROM [replies] r WHERE id % 11 > 0), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY sample, task ORDER BY id DESC) = 1)
SELECT 's' || sample AS sample_id, task AS model_id, id AS seq, CASE WHEN id % 3 = 0 THEN price::DOUBLE END AS price, (1 + (id % 3 = 0)::INT)::INTEGER AS n_metrics, status FROM l"""
)
def record_log(spark: SparkSession, d: str) -> DataFrame:
    """A run's record log: torn lines, rewritten records, metrics as text, and the marker of a missing value."""
    path = scratch(spark, "record_log")
    r = fixture(spark, d, "replies")
    metrics = F.create_map(F.lit("price"), F.when(F.col("id") % 3 == 0, F.col("price").cast("string")).otherwise("None"), F.lit("one"), F.lit("1"), F.lit("bad"), F.lit("NaN"))
    line = F.to_json(F.struct(F.lit("d").alias("dataset_id"), F.col("task").alias("model_id"), F.concat(F.lit("s"), F.floor(F.col("id") / 2).cast("string")).alias("sample_id"), "status", metrics.alias("metrics"), F.col("id").alias("seq")))
    r.select(F.when(F.col("id") % 11 == 0, F.left(line, F.lit(30))).otherwise(line)).write.mode("overwrite").text(path)
    return readers.records(spark, path).select("sample_id", "model_id", "seq", F.try_element_at("metrics", F.lit("price")).alias("price"), F.size("metrics").alias("n_metrics"), "status")


@query("SELECT dataset_id, model_id, count(*) AS n, max(id) AS last FROM (SELECT dataset_id, model_id, id FROM [grid] g UNION ALL SELECT dataset_id, model_id, id FROM [grid] g WHERE id % 2 = 0) q WHERE model_id <> 'gamma' GROUP BY 1, 2")
def appended_records(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to a partitioned log; the reader prunes to the models that it asks for."""
    path, g = scratch(spark, "appended_records"), fixture(spark, d, "grid").select("dataset_id", "model_id", "id")
    sinks.overwrite(g.limit(0), path)
    sinks.append(g.repartition("model_id"), path, ("model_id",))
    sinks.append(g.where("id % 2 = 0").repartition("model_id"), path, ("model_id",))
    rows = readers.parquet(spark, path, ["dataset_id", "model_id", "id"])
    return rows.where("model_id <> 'gamma'").groupBy("dataset_id", "model_id").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("SELECT kind, count(*) AS n, round(sum(value), 6) AS value FROM [log] l GROUP BY kind")
def event_log(spark: SparkSession, d: str) -> DataFrame:
    path, log = scratch(spark, "event_log"), fixture(spark, d, "log").select("id", "kind", "value")
    log.limit(0).write.mode("overwrite").json(path)
    for k in (0, 1):
        sinks.event_log(log.where(F.col("id") % 2 == k), path)
    return readers.jsonl(spark, path, log.schema).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


@query("SELECT count(*) FILTER (id % 4 = 0) AS changed, sum(CASE WHEN id % 4 = 0 THEN -1 ELSE size END)::BIGINT AS total FROM [grid] g")
def updated_records(spark: SparkSession, d: str) -> DataFrame:
    """Updates merged into a table, which is written as a new version."""
    path, g = scratch(spark, "updated_records"), fixture(spark, d, "grid").select("id", F.col("size").cast("bigint").alias("size"))
    merged = records.merge_update(g, g.where("id % 4 = 0").withColumn("size", F.lit(-1).cast("bigint")), "id", ["size"])
    n = sinks.update(merged, path)
    return readers.parquet(spark, path).agg(F.lit(n).cast("bigint").alias("changed"), F.sum("size").alias("total"))


@query("SELECT id, name, '***' AS api_key, '***' AS \"Auth-Token\" FROM [grid] g")
def redacted(spark: SparkSession, d: str) -> DataFrame:
    shown = F.create_map(F.lit("name"), F.col("name"), F.lit("api_key"), F.col("kind"), F.lit("Auth-Token"), F.col("kind"))
    g = sinks.redact(fixture(spark, d, "grid").select("id", shown.alias("c")), "c")
    return g.select("id", *[F.col("c")[k].alias(k) for k in ("name", "api_key", "Auth-Token")])


@query(
    """SELECT id, n AS row_no, CASE WHEN n = 0 THEN size ELSE id END AS a, CASE WHEN n = 0 THEN name ELSE '7' END AS b, 'number string' AS kinds
FROM (SELECT *, unnest(CASE WHEN id % 4 < 2 THEN [0, 1] ELSE [] END)::INTEGER AS n FROM [grid] g) q"""
)
def payload_rows(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that are a list of objects or an object of lists, as rows; broken ones and others have none."""
    g = fixture(spark, d, "grid")
    one, two = F.struct(F.col("size").alias("a"), F.col("name").alias("b")), F.struct(F.col("id").alias("a"), F.lit("7").alias("b"))
    columns = F.struct(F.array(F.col("size").cast("bigint"), F.col("id").cast("bigint")).alias("a"), F.array(F.col("name"), F.lit("7"), F.lit("beyond the shorter list")).alias("b"))
    payload = F.when(F.col("id") % 4 == 0, F.to_json(F.array(one, two))).when(F.col("id") % 4 == 1, F.to_json(columns)).when(F.col("id") % 4 == 2, "[{torn").otherwise("12")
    rows = g.select("id", F.posexplode(readers.payload_rows(payload)).alias("row_no", "row"))
    kind = lambda k: F.when(F.rlike("row", F.lit(f'"{k}":"')), "string").otherwise("number")
    return rows.select("id", "row_no", F.get_json_object("row", "$.a").cast("bigint").alias("a"), F.get_json_object("row", "$.b").alias("b"), F.concat_ws(" ", kind("a"), kind("b")).alias("kinds"))


# ---------------------------------------------------------------- planning and turns


@query(
    """WITH g AS (SELECT r_name AS dataset_id, CASE CAST(r_regionkey % 3 AS INT) WHEN 0 THEN 'single' WHEN 1 THEN 'multi' ELSE 'none' END AS cardinality FROM region), m(model_id, prompts) AS (VALUES ('all', []), ('plain', ['io']))
SELECT dataset_id, model_id, 'io' AS prompt_mode, s AS selection_mode FROM g, m, (SELECT unnest(['SCS', 'MCS', 'BOV', 'n/a']) AS s) x WHERE (cardinality = 'none') = (s = 'n/a') AND NOT (s = 'SCS' AND cardinality = 'multi') AND NOT (s = 'MCS' AND cardinality = 'single')
UNION ALL SELECT dataset_id, model_id, p, s FROM g, m, (SELECT unnest(['cot', 'self-consistency']) AS p) y, (SELECT unnest(['SCS', 'MCS', 'BOV', 'n/a']) AS s) x WHERE model_id = 'all' AND (cardinality = 'none') = (s = 'n/a') AND NOT (s = 'SCS' AND cardinality = 'multi') AND NOT (s = 'MCS' AND cardinality = 'single') AND NOT (p = 'self-consistency' AND s = 'BOV')"""
)
def planned_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Which model runs which dataset in which modes."""
    r = table(spark, d, "region")
    kind = F.when(F.col("r_regionkey") % 3 == 0, "single").when(F.col("r_regionkey") % 3 == 1, "multi").otherwise("none")
    sets = r.select(F.col("r_name").alias("dataset_id"), kind.alias("cardinality"), F.lit("static").alias("delivery"), F.lit(True).alias("objective"), F.array(F.lit("selection")).alias("task_kinds"))
    models = spark.createDataFrame([("all", [], None, None), ("plain", ["io"], [], ["selection"])], "model_id string, prompt_modes array<string>, selection_modes array<string>, kinds array<string>")
    return modes.plan_tasks(modes.mode_grid(sets), models).select("dataset_id", "model_id", "prompt_mode", "selection_mode")


@query(
    """WITH q AS (SELECT id, size, row_number() OVER (ORDER BY id) AS r FROM [grid] g) SELECT 'resample' AS policy, id FROM (SELECT id FROM q WHERE size <= 35 ORDER BY r LIMIT 50) x UNION ALL SELECT 'skip', id FROM q WHERE r <= 50 AND size <= 35"""
)
def token_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Rows that exceed a budget, replaced or left out."""
    from pyspark.sql import Window

    # one window over all rows, as the pool of a dataset is small and its order is total
    pool = fixture(spark, d, "grid").select("id", "size").withColumn("r", F.row_number().over(Window.orderBy("id")))
    parts = [modes.token_budget(pool, "size", "r", 35, 50, 0.9, p).select(F.lit(p).alias("policy"), "id") for p in ("resample", "skip")]
    return parts[0].unionByName(parts[1])


@query("SELECT 1 + (SELECT count(*) FROM region) AS next_offset, (SELECT count(*) FROM region) + 1 AS n_ids, true AS fresh")
def draw_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The ids of a draw in order, and where the next draw begins."""
    size = table(spark, d, "region").count() + 1
    draw = sampling.sample_prefix(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", size, 7)
    m = sampling.manifest(draw, "n_nationkey")
    return m.select(F.col("next_offset").cast("bigint").alias("next_offset"), F.size("sample_ids").cast("bigint").alias("n_ids"), (F.size(F.array_distinct("sample_ids")) == F.size("sample_ids")).alias("fresh"))


@query("SELECT kind, turn, round(avg(correct::INT), 9) AS accuracy, count(*) AS n FROM [log] l GROUP BY kind, turn")
def accuracy_by_turn(spark: SparkSession, d: str) -> DataFrame:
    return windows.accuracy_by_turn(fixture(spark, d, "log"), ["kind"], "turn", "correct").withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT dataset_id, id, coalesce(size = max(size) OVER (PARTITION BY dataset_id), false) AS is_max FROM [grid] g")
def best_in_row(spark: SparkSession, d: str) -> DataFrame:
    return reports.bold_max(fixture(spark, d, "grid"), ["dataset_id"], "size").select("dataset_id", "id", "is_max")


@query(
    """WITH c AS (SELECT kind, item, CASE WHEN count(*) FILTER (correct) >= 2 AND count(*) FILTER (NOT correct) >= 2 THEN (avg(value) FILTER (correct) - avg(value) FILTER (NOT correct)) / nullif(stddev_samp(value), 0) END AS e FROM [log] l GROUP BY kind, item)
SELECT kind, round(avg(e), 7) AS mean, round(1.96 * stddev_pop(e) / sqrt(nullif(count(e), 0)), 7) AS half_width, count(e) AS cells FROM c GROUP BY kind"""
)
def effect_over_cells(spark: SparkSession, d: str) -> DataFrame:
    """Effects of a measure within each cell that has rows enough, and their mean over cells."""
    cells = windows.effect_size(fixture(spark, d, "log"), ["kind", "item"], "value", "correct", least=2)
    return windows.effect_over_cells(cells, ["kind"]).withColumns({c: F.round(c, 7) for c in ("mean", "half_width")})


@query(
    """WITH s AS (SELECT pos AS step, sum(ok::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM [items] i GROUP BY pos HAVING count(*) >= 100)
SELECT step::INTEGER AS step, round(k / n, 7) AS share, round(((k / n + 3.8416 / (2 * n)) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 7) AS low, n::BIGINT AS n FROM s"""
)
def step_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares by step, of steps that enough episodes reach."""
    per = fixture(spark, d, "items").groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ok"))), lambda x: x["ok"].cast("int")).alias("hits"))
    return windows.step_table(per, [], "hits", 100).select("step", F.round("share", 7).alias("share"), F.round("low", 7).alias("low"), "n")


@query(
    """WITH c AS (SELECT dataset_id, model_id, avg(price) FILTER (size % 2 = 0) AS s, avg(price) FILTER (size % 2 = 1) AS m FROM [grid] g GROUP BY 1, 2) SELECT model_id, round(avg(s), 7) AS scs, round(avg(m), 7) AS mcs, round(avg(s - m), 7) AS gap, count(*) AS cells FROM c WHERE s IS NOT NULL AND m IS NOT NULL GROUP BY 1"""
)
def choice_gap(spark: SparkSession, d: str) -> DataFrame:
    g = fixture(spark, d, "grid").withColumn("sel", F.when(F.col("size") % 2 == 0, "SCS").otherwise("MCS"))
    return reports.choice_gap(g, ["dataset_id"], "model_id", "sel", "price").withColumns({c: F.round(c, 7) for c in ("scs", "mcs", "gap")})


@query("SELECT kind, model_id, m AS auc, count(*) OVER (PARTITION BY kind) >= 2 AND max(m) OVER (PARTITION BY kind) > 0.58 AND min(m) OVER (PARTITION BY kind) < 0.42 AS direction_flips FROM (SELECT kind, model_id, round(avg(correct), 9) AS m FROM [grid] g GROUP BY 1, 2) q")
def direction_flips(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "grid").groupBy("kind", "model_id").agg(F.round(F.avg("correct"), 9).alias("auc"))
    return windows.direction_flips(rows, "kind")


@query()
def bootstrap_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of a paired difference, from hashed weights."""
    rows = fixture(spark, d, "grid").select("id", F.col("size").cast("double").alias("a"), (F.col("size") + F.col("correct")).cast("double").alias("b"))
    return windows.bootstrap_gap(rows, [], "a", "b", "id", reps=200)


# ---------------------------------------------------------------- streams


@query("SELECT item, arg_max(v, id) AS v, max(id) AS id FROM (SELECT id, item, CASE WHEN id % 3 = 0 THEN 'late' ELSE kind END AS v FROM [log] l) q GROUP BY item")
def streamed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Corrections that arrive in several batches; the last of each key stands."""
    source = scratch(spark, f"upsert_source_{_fresh(spark)}")
    rows = fixture(spark, d, "log").select("id", "item", F.when(F.col("id") % 3 == 0, "late").otherwise(F.col("kind")).alias("v"))
    rows.repartition(4, "id").write.mode("overwrite").parquet(source)
    sink = state.Upsert(scratch(spark, f"upsert_table_{_fresh(spark)}"), ["item"], "id", buckets=8)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{sink.path}_log").trigger(availableNow=True).start().awaitTermination()
    return sink.read(spark).select("item", "v", "id")


@query("SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars, count(*) >= 6 AS ended FROM conversations GROUP BY conv_id")
def streamed_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues as their turns arrive; of each the latest state."""
    kind = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").schema
    out = scratch(spark, f"episodes_{_fresh(spark)}")
    # a pattern that only the table matches: a stream reads a folder or a pattern, and the table may be a file or a folder of files
    turns = spark.readStream.schema(kind).parquet(f"{d}/conversations.parque[t]").fillna("", ["text"])

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/b={epoch}")

    state.episodes(turns, 6).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}_log").trigger(availableNow=True).start().awaitTermination()
    return records.dedupe_last(spark.read.parquet(out).drop("b"), ["conv_id"], "epoch").select("conv_id", "n_turns", "n_chars", "ended")


def _fresh(spark: SparkSession) -> str:
    """A name that no earlier run of the application has used: a stream's log must not outlive its table."""
    return spark.sql("SELECT uuid()").first()[0]
