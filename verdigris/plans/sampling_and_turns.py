"""Queries of draws, batches, turns, ranks and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import stats
from verdigris.operators import ranks, records, retrieval, sampling, windows
from verdigris.plans.registry import fixture, query, table

KEY = "sha256('7' || '::' || 'pool' || '::' || p_partkey)"


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY {KEY}, p_partkey)::INTEGER AS pool_rank FROM part QUALIFY pool_rank <= 50")
def hash_sample_prefix(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_prefix(table(spark, d, "part").select("p_partkey"), "p_partkey", 50, 7, "pool")


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY {KEY}, p_partkey)::INTEGER AS pool_rank FROM part WHERE p_size > 10 QUALIFY pool_rank BETWEEN 31 AND 60")
def sample_offset(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_offset(table(spark, d, "part"), "p_partkey", F.col("p_size") > 10, 30, 30, 7, "pool").select("p_partkey", "pool_rank")


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY {KEY}, p_partkey)::INTEGER AS pool_rank FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1) QUALIFY pool_rank <= 20")
def replacement_draw(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return sampling.replacements(table(spark, d, "part").select("p_partkey"), "p_partkey", used, 20, 7, "pool")


@query("SELECT p_partkey, p_type AS stratum, row_number() OVER (PARTITION BY p_type ORDER BY sha256('7' || '::' || '' || '::' || p_partkey), p_partkey)::INTEGER AS round FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO')")
def stratified_interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.interleave(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("stratum")), "p_partkey", "stratum", 7, ["ECONOMY", "SMALL", "PROMO"])
    return rows.select("p_partkey", "stratum", "round")


@query(
    """SELECT p_brand, block, string_agg(p_partkey, ',' ORDER BY rn) AS members FROM (SELECT p_brand, p_partkey, rn, ((rn - 1) // 12)::BIGINT AS block FROM (SELECT p_brand, p_partkey,
  row_number() OVER (PARTITION BY p_brand ORDER BY sha256('7' || '::' || '' || '::' || p_partkey), p_partkey) AS rn FROM part)) GROUP BY 1, 2 HAVING count(*) = 12"""
)
def example_blocks(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.blocks(table(spark, d, "part"), "p_brand", "p_partkey", 12, 7)
    return out.select("p_brand", "block", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT doc_id, string_agg(o, '' ORDER BY sha256('7:' || doc_id || ':' || o)) AS options FROM documents, unnest(['A', 'B', 'C', 'D', 'E']) u(o) GROUP BY doc_id")
def option_shuffle(spark: SparkSession, d: str) -> DataFrame:
    given = F.array(*[F.lit(x) for x in "ABCDE"])
    return table(spark, d, "documents").select("doc_id", F.array_join(sampling.shuffled_options(given, F.col("doc_id"), 7), "").alias("options"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER () AS n, (SELECT count(DISTINCT event_type) FROM events) AS kinds FROM events) q WHERE n <= 1000 OR rn <= 1000 // kinds")
def fair_row_cap(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an event log, fairly by type; the shares come from a loop over a count for each type."""
    return sampling.fair_rows(table(spark, d, "events"), "event_type", ["event_id"], 1_000).select("event_type", "event_id")


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY role ORDER BY length(text), conv_id * 100 + turn) - 1) // 64)::BIGINT AS batch_index, role FROM conversations")
def plan_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("tokens"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return sampling.plan_batches(rows, "role", "tokens", "id", 64).select("conv_id", "turn", "role", "batch_index")


@query("SELECT item, coalesce(min(turn) FILTER (correct), 20)::INTEGER AS first_correct_turn, count(*) AS n_turns, round(avg(correct::INT), 9) AS turn_accuracy FROM [log] l GROUP BY item")
def first_correct_turn(spark: SparkSession, d: str) -> DataFrame:
    out = windows.first_correct(fixture(spark, d, "log"), ["item"], "turn", "correct", 20)
    return out.withColumn("turn_accuracy", F.round("turn_accuracy", 9)).withColumn("first_correct_turn", F.col("first_correct_turn").cast("int"))


@query(
    """WITH l AS (SELECT item, turn, kind, correct, lag(kind) OVER (PARTITION BY item ORDER BY turn) AS before FROM [log] l),
  a AS (SELECT item, bool_or(turn > 1 AND kind IS DISTINCT FROM before) AS revised, arg_min(correct, turn) AS first_ok, arg_max(correct, turn) AS last_ok FROM l GROUP BY item)
SELECT item, revised, first_ok, last_ok, CASE WHEN first_ok AND last_ok THEN 'stayed_right' WHEN last_ok THEN 'became_right' WHEN first_ok THEN 'became_wrong' ELSE 'stayed_wrong' END AS revision FROM a"""
)
def belief_revision(spark: SparkSession, d: str) -> DataFrame:
    return windows.belief_revision(fixture(spark, d, "log"), ["item"], "turn", "kind", "correct")


@query("SELECT id, greatest(1, ceil(5.0 * (r - 1) / (n - 1)))::INTEGER AS quintile FROM (SELECT id, row_number() OVER (PARTITION BY kind ORDER BY value, id) AS r, count(*) OVER (PARTITION BY kind) AS n FROM [log] l) q")
def length_quintile(spark: SparkSession, d: str) -> DataFrame:
    return ranks.length_quintile(fixture(spark, d, "log").select("id", "kind", "value"), ["kind"], "value", "id").select("id", "quintile")


@query("SELECT id, kind FROM (SELECT id, kind, value, correct, quantile_cont(value, 0.95) OVER (PARTITION BY kind) AS q FROM [log] l) x WHERE value >= q AND NOT correct")
def overthinking(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "log").withColumn("wrong", ~F.col("correct"))
    return ranks.overthinking(rows, ["kind"], "value", "wrong").select("id", "kind")


RANKS = "rank() OVER (PARTITION BY kind ORDER BY {x}) + (count(*) OVER (PARTITION BY kind, {x}) - 1) / 2.0"


@query(f"SELECT id, ({RANKS.format(x='floor(value)')})::DOUBLE AS avg_rank FROM [log] l")
def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "log").withColumn("x", F.floor("value"))
    return ranks.with_average_rank(rows, ["kind"], "x", "avg_rank").select("id", "avg_rank")


@query(
    f"""SELECT kind, CASE WHEN count(*) FILTER (correct) >= 20 AND count(*) FILTER (NOT correct) >= 20 THEN
  round((sum(r) FILTER (correct) - count(*) FILTER (correct) * (count(*) FILTER (correct) + 1) / 2) / (count(*) FILTER (correct) * count(*) FILTER (NOT correct)), 9) END AS auc,
  count(*) FILTER (correct) AS n_correct, count(*) FILTER (NOT correct) AS n_wrong FROM (SELECT kind, correct, {RANKS.format(x="v")} AS r FROM [log] l WHERE v IS NOT NULL AND NOT isnan(v)) q GROUP BY kind"""
)
def auc_by_metric(spark: SparkSession, d: str) -> DataFrame:
    return ranks.auc(fixture(spark, d, "log"), ["kind"], "v", "correct").withColumn("auc", F.round("auc", 9))


@query(f"SELECT kind, round(coalesce(corr(a, b), 0), 9) AS spearman, count(*) AS n FROM (SELECT kind, {RANKS.format(x='value')} AS a, {RANKS.format(x='turn')} AS b FROM [log] l) q GROUP BY kind")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return ranks.spearman(fixture(spark, d, "log"), ["kind"], "value", "turn").withColumn("spearman", F.round("spearman", 9))


@query(
    """WITH p AS (SELECT item, pos, score, qty FROM [items] i),
  s AS (SELECT a.item, sum(sign(a.score - b.score) * sign(a.qty - b.qty)) / 2 AS s, sum(abs(sign(a.score - b.score))) / 2 AS na, sum(abs(sign(a.qty - b.qty))) / 2 AS nb FROM p a JOIN p b USING (item) GROUP BY 1)
SELECT item, round(coalesce(s / nullif(sqrt(na * nb), 0), 0), 9) AS tau_b FROM s"""
)
def kendall_tau_b(spark: SparkSession, d: str) -> DataFrame:
    return ranks.kendall_tau_b(fixture(spark, d, "items"), ["item"], "score", "qty").withColumn("tau_b", F.round("tau_b", 9))


@query(
    """WITH b AS (SELECT CASE WHEN n <= 3 THEN '(0,3]' WHEN n <= 5 THEN '(3,5]' WHEN n <= 8 THEN '(5,8]' WHEN n <= 12 THEN '(8,12]' WHEN n <= 16 THEN '(12,16]' WHEN n <= 20 THEN '(16,20]' END AS bin, hit
    FROM (SELECT item, count(*) AS n, bool_or(prediction = 'R' AND ok)::INT AS hit FROM [items] i GROUP BY item) q),
  s AS (SELECT bin, count(*)::DOUBLE AS n, sum(hit)::DOUBLE AS k FROM b GROUP BY bin)
SELECT bin, n::BIGINT AS n, round(((k / n + 3.8416 / (2 * n)) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 7) AS low,
  round(((k / n + 3.8416 / (2 * n)) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 7) AS high FROM s"""
)
def wilson_by_bin(spark: SparkSession, d: str) -> DataFrame:
    per = fixture(spark, d, "items").groupBy("item").agg(F.count("*").alias("n"), F.bool_or((F.col("prediction") == "R") & F.col("ok")).cast("int").alias("hit"))
    s = per.groupBy(windows.length_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return s.select("bin", "n", F.round(w["low"], 7).alias("low"), F.round(w["high"], 7).alias("high"))


@query("SELECT kind, round((avg(value) FILTER (correct) - avg(value) FILTER (NOT correct)) / stddev_samp(value), 7) AS effect, count(*) AS n FROM [log] l GROUP BY kind")
def effect_size(spark: SparkSession, d: str) -> DataFrame:
    return windows.effect_size(fixture(spark, d, "log"), ["kind"], "value", "correct").withColumn("effect", F.round("effect", 7))


@query("SELECT id, row_number() OVER (PARTITION BY item, kind ORDER BY turn)::INTEGER AS used, row_number() OVER (PARTITION BY item, kind ORDER BY turn) > 5 AS over_limit FROM [log] l")
def action_limits(spark: SparkSession, d: str) -> DataFrame:
    return windows.over_limit(fixture(spark, d, "log"), ["item", "kind"], "turn", 5).select("id", "used", "over_limit")


@query("SELECT id, CASE kind WHEN 'view' THEN 1.5 WHEN 'purchase' THEN 10.0 ELSE 1.0 END::DOUBLE AS cost, sum(CASE kind WHEN 'view' THEN 1.5 WHEN 'purchase' THEN 10.0 ELSE 1.0 END) OVER (PARTITION BY item ORDER BY turn)::DOUBLE AS spent FROM [log] l")
def encounter_cost(spark: SparkSession, d: str) -> DataFrame:
    cost = F.when(F.col("kind") == "view", 1.5).when(F.col("kind") == "purchase", 10.0).otherwise(1.0)
    return windows.running_cost(fixture(spark, d, "log"), ["item"], "turn", cost).select("id", "cost", "spent")


@query(
    """WITH w AS (SELECT kind, id, count(*) OVER o AS sent, avg((turn % 4 = 0)::INT) OVER o AS share FROM [log] l WINDOW o AS (PARTITION BY kind ORDER BY id ROWS UNBOUNDED PRECEDING))
SELECT id, sent, round(share, 9) AS failed_share, bool_or(sent >= 20 AND share > 0.25) OVER (PARTITION BY kind ORDER BY id ROWS UNBOUNDED PRECEDING) AS tripped FROM w"""
)
def kill_switch(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "log").withColumn("failed", F.col("turn") % 4 == 0)
    return records.kill_switch(rows, ["kind"], "id", "failed", 20, 0.25).select("id", "sent", F.round("failed_share", 9).alias("failed_share"), "tripped")


BM25 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
  t AS (SELECT doc_id, unnest(w) AS t FROM d), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1),
  n AS (SELECT count(*)::DOUBLE AS n FROM d), a AS (SELECT sum(len) / n AS avgdl FROM l, n GROUP BY n),
  f AS (SELECT t, doc_id, count(*) AS f FROM t GROUP BY 1, 2),
  i AS (SELECT t, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1.0) AS idf FROM f, n GROUP BY t, n),
  q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark)),
  c AS (SELECT item_id, sum(idf) AS top FROM q JOIN i USING (t) GROUP BY 1),
  s AS (SELECT item_id, doc_id, sum(idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avgdl))) AS s FROM q JOIN i USING (t) JOIN f USING (t) JOIN l USING (doc_id), a GROUP BY 1, 2),
  r AS (SELECT item_id, doc_id, round(s / top, 7) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(s / top, 9) DESC, doc_id)::INTEGER AS rank FROM s JOIN c USING (item_id))
SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 3"""


@query(BM25)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """All documents count and can be found, whatever their characters."""
    out = retrieval.bm25_topk(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", "text", 3)
    return out.withColumn("score", F.round("score", 7))


EVIDENCE = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2), lambda w: left(w, 4)))"


@query(
    f"""WITH q AS (SELECT dataset_id, replace(name, ' ', '_') || '_' || id AS key, kind AS value FROM [grid] g),
  t AS (SELECT dataset_id, key, len(list_intersect(['red', 'widg', 'econ'], {EVIDENCE.format(x="regexp_replace(key, '[._]', ' ', 'g')")})) AS k, len(list_intersect(['red', 'widg', 'econ'], {EVIDENCE.format(x="value")})) AS v FROM q),
  s AS (SELECT dataset_id, key, CASE WHEN k > 0 THEN k / 3.0 ELSE v / 3.0 END AS coverage, CASE WHEN k > 0 THEN 1.0 ELSE 0.5 END AS weight FROM t),
  r AS (SELECT dataset_id, key, round((weight * coverage)::DOUBLE, 9) AS score, row_number() OVER (PARTITION BY dataset_id ORDER BY weight * coverage DESC, key)::INTEGER AS rank FROM s WHERE coverage >= 0.5)
SELECT * FROM r WHERE rank <= 6"""
)
def evidence_topk(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each brand that a request names; ranks ties by key."""
    g = fixture(spark, d, "grid").select("dataset_id", F.concat_ws("_", F.replace("name", F.lit(" "), F.lit("_")), "id").alias("key"), F.col("kind").alias("value"), F.lit("red widget economy").alias("query"))
    return retrieval.evidence_topk(g, "query", "key", "value", ["dataset_id"], 6).select("dataset_id", "key", F.round("score", 9).alias("score"), "rank")


@query(
    """WITH a AS (SELECT o_orderkey AS ask_id, o_orderpriority AS tool, lower(o_orderstatus) AS arg FROM orders), c AS (SELECT o_orderpriority AS tool, lower(o_orderstatus) AS arg, min(o_orderkey) AS key_no FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
SELECT ask_id, key_no FROM a LEFT JOIN c USING (tool, arg)"""
)
def best_match_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    asks = o.select(F.col("o_orderkey").alias("ask_id"), F.col("o_orderpriority").alias("tool"), F.array("o_orderstatus").alias("args"))
    cache = o.where("o_orderkey % 3 = 0").groupBy(F.col("o_orderpriority").alias("tool"), F.col("o_orderstatus").alias("s")).agg(F.min("o_orderkey").alias("key_no")).select("key_no", "tool", F.array("s").alias("args"), F.lit("x").alias("result"))
    return retrieval.best_match(asks, cache).select("ask_id", "key_no")
