"""Queries of streams that keep state: episodes answered turn by turn, and datasets reported as they complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.plans.registry import fixture, query
from verdigris.plans.session import scratch
from verdigris.streaming import episodes, reports


def fresh(spark: SparkSession, name: str) -> str:
    """A folder that no earlier run has used: a stream's log must not outlive its table."""
    return scratch(spark, f"{name}_{spark.sql('SELECT uuid()').first()[0]}")


RULES = episodes.Rules(max_turns=6, window=7000, quotas=(("A", 1),))


@query(
    """WITH c AS (SELECT item AS episode, prediction AS category, unnest(['p' || pos, 'p' || pos || '.x', 'p' || pos || '.y', 'p' || pos || '.y.z']) AS key FROM [items] i),
  r AS (SELECT item AS episode, pos - 1 AS turn, prediction AS category, ['p' || (pos - 1) || '.x', 'p' || pos || '.x', 'none'] AS keys,
    CASE WHEN 7000 - (pos * 1000 + qty * 10)::BIGINT - floor(64 + 0.05 * (pos * 1000 + qty * 10)::BIGINT)::BIGINT < 64 THEN 'context' WHEN score = 0 AND pos % 2 = 1 THEN 'failed_call'
         WHEN qty > 48 THEN 'environment' WHEN pos = 6 THEN 'turn_limit' END AS ended FROM [items] i),
  a AS (SELECT * FROM (SELECT *, min(turn) FILTER (ended IS NOT NULL) OVER (PARTITION BY episode) AS stop FROM r) WHERE stop IS NULL OR turn <= stop),
  q AS (SELECT *, count(*) FILTER (ended IS NULL OR ended = 'turn_limit') OVER (PARTITION BY episode, category ORDER BY turn) AS nth FROM a),
  s AS (SELECT DISTINCT q.episode, q.turn, q.category, c.key FROM (SELECT *, unnest(keys) AS asked FROM q WHERE (ended IS NULL OR ended = 'turn_limit') AND (category <> 'A' OR nth <= 1)) q
    JOIN c h ON h.episode = q.episode AND h.category = q.category AND h.key = q.asked JOIN c ON c.episode = q.episode AND c.category = q.category AND (c.key = regexp_replace(q.asked, '\\.[^.]*$', '') OR regexp_replace(c.key, '\\.[^.]*$', '') = regexp_replace(q.asked, '\\.[^.]*$', ''))),
  f AS (SELECT *, turn = min(turn) OVER (PARTITION BY episode, category, key) AS fresh FROM s),
  t AS (SELECT episode, turn, array_to_string(list_sort(list(DISTINCT key)), ',') AS shown, count(*) FILTER (fresh) AS fresh FROM f GROUP BY 1, 2)
SELECT a.episode, a.turn, coalesce(shown, '') AS shown, coalesce(fresh, 0) AS fresh, sum(coalesce(fresh, 0)) OVER (PARTITION BY a.episode ORDER BY a.turn)::BIGINT AS n_revealed, a.turn + (ended IS DISTINCT FROM 'context')::BIGINT AS n_turns, ended FROM a LEFT JOIN t USING (episode, turn)"""
)
def streamed_disclosures(spark: SparkSession, d: str) -> DataFrame:
    """Episodes whose turns arrive out of order over several batches: what each discloses, and why each episode ends."""
    episodes.use_state_store(spark)
    i = fixture(spark, d, "items").select(F.col("item").alias("episode"), F.col("pos").alias("n"), F.col("prediction").alias("category"), "qty", "score")
    p = lambda n: F.concat(F.lit("p"), n.cast("string"))
    here, before = p(F.col("n")), p(F.col("n") - 1)
    case = i.select("episode", "category", F.explode(F.array(here, *[F.concat(here, F.lit(s)) for s in (".x", ".y", ".y.z")])).alias("key"))
    asks = i.select("episode", (F.col("n") - 1).alias("turn"), "category", F.array(F.concat(before, F.lit(".x")), F.concat(here, F.lit(".x")), F.lit("none")).alias("keys"), F.lit(None).cast("string").alias("said"), (F.col("n") * 1000 + F.col("qty") * 10).cast("bigint").alias("tokens"), ((F.col("score") == 0) & (F.col("n") % 2 == 1)).alias("failed"), (F.col("qty") > 48).alias("ends"))
    at = fresh(spark, "disclosures")
    # three batches with turns from anywhere in an episode, each of as many files as tasks may read
    files = spark.sparkContext.defaultParallelism
    asks.repartition(3 * files, F.xxhash64("episode", "turn")).write.parquet(f"{at}/in")
    case.write.parquet(f"{at}/case")
    stream = spark.readStream.schema(asks.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    answered = episodes.run_episodes(stream, spark.read.parquet(f"{at}/case"), RULES)
    answered.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("shown", F.array_join("shown", ","))


@query(
    """WITH r AS (SELECT DISTINCT task AS dataset_id, id, status, price FROM [replies] q), p AS (SELECT dataset_id, count(*) AS planned FROM r GROUP BY 1)
SELECT dataset_id, planned, count(*) AS n, count(*) FILTER (status IN ('ok', 'empty', 'truncated')) AS n_scored, count(*) FILTER (status = 'error') AS n_error,
  round(avg(price) FILTER (status IN ('ok', 'empty', 'truncated')), 6) AS score, count(*) FILTER (status IN ('ok', 'empty', 'truncated')) / planned AS coverage, 1::BIGINT AS times
FROM r JOIN p USING (dataset_id) WHERE dataset_id <> 'P' GROUP BY 1, 2"""
)
def interim_reports(spark: SparkSession, d: str) -> DataFrame:
    """Records that arrive in batches, some twice: each dataset is reported once; one with records still owed is not."""
    episodes.use_state_store(spark)
    rows = fixture(spark, d, "replies").select(F.col("task").alias("dataset_id"), "id", "status", F.col("price").alias("score"))
    at = fresh(spark, "interim")
    # four batches, each of as many files as tasks may read
    files = spark.sparkContext.defaultParallelism
    rows.unionByName(rows.where("id % 3 = 0")).repartition(4 * files, F.xxhash64("score", "id")).write.parquet(f"{at}/in")
    owed = F.when(F.col("dataset_id") == "P", 1).otherwise(0)
    planned = rows.groupBy("dataset_id").agg((F.count("*") + F.max(owed)).alias("planned"))
    planned.write.parquet(f"{at}/planned")
    sink = reports.CompletionReport(f"{at}/out", spark.read.parquet(f"{at}/planned"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    reports.progress(stream, ["id"]).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    found = sink.read(spark).withColumn("score", F.round("score", 6))
    times = found.groupBy("dataset_id").agg(F.count("*").alias("times"))
    return found.drop("batch").join(times, "dataset_id")
