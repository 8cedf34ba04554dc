"""Queries of load shapes, report frames, and the fields that datasets ship as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from verdigris.functions import actions, extract, shapes, stats, text, validators
from verdigris.operators import expand, frames, loads, records
from verdigris.plans.datasets import PLANS
from verdigris.plans.registry import fixture, query, spread, table

# ---------------------------------------------------------------- fields


@query(
    """WITH q AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'The APT group' ELSE 'APT-' || size || ' ' || name END AS x FROM [grid] g),
  w AS (SELECT id, list_filter(string_split(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM q),
  k AS (SELECT id, w, list_filter(w, lambda x: x NOT IN ('the', 'group', 'apt', 'team', 'actor', 'threat', 'cluster')) AS k FROM w)
SELECT id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w END, ' ') AS actor FROM k"""
)
def actor_names(spark: SparkSession, d: str) -> DataFrame:
    g = fixture(spark, d, "grid")
    said = F.when(F.col("id") % 3 == 0, F.lit("The APT group")).otherwise(F.concat(F.lit("APT-"), F.col("size").cast("string"), F.lit(" "), "name"))
    return g.select("id", shapes.actor_name(said).alias("actor"))


@query(
    """SELECT id, CASE WHEN id % 5 = 0 THEN '(open  ' || size WHEN id % 5 = 1 THEN 'no formula ' || size ELSE '(And  (P  x) ( Q ' || size || ' ))' END AS span,
  CASE WHEN id % 5 = 0 THEN '(open ' || size WHEN id % 5 = 1 THEN 'no formula ' || size ELSE '(and(p x)(q ' || size || '))' END AS canonical FROM [grid] g"""
)
def formulas(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("size").cast("string")
    said = F.when(F.col("id") % 5 == 0, F.concat(F.lit("so (open  "), n)).when(F.col("id") % 5 == 1, F.concat(F.lit("`no formula "), n, F.lit("`"))).otherwise(F.concat(F.lit("so (And  (P  x) ( Q "), n, F.lit(" )) holds (y)")))
    g = fixture(spark, d, "grid").select("id", shapes.formula_span(said).alias("span"))
    return g.select("id", "span", shapes.canonical_formula(F.col("span")).alias("canonical"))


@query(
    """SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN size > 20 THEN dataset_id ELSE 'flu' END AS top, CASE WHEN id % 4 = 0 THEN 0 ELSE 3 END AS n_names,
  CASE CAST(id % 4 AS INT) WHEN 0 THEN 'plain ' || name WHEN 1 THEN 'a|' || dataset_id WHEN 2 THEN '' ELSE 'x''s|y' END AS listed FROM [grid] g"""
)
def list_literals(spark: SparkSession, d: str) -> DataFrame:
    g = fixture(spark, d, "grid")
    cell = F.when(F.col("id") % 4 == 0, F.lit("[['oops', ")).otherwise(F.concat(F.lit("[['flu', 0.2], ['"), "dataset_id", F.lit("', "), (F.col("size") / 100).cast("string"), F.lit("], ['cold']]")))
    cells = F.when(F.col("id") % 4 == 0, F.concat(F.lit("plain "), "name")).when(F.col("id") % 4 == 1, F.concat(F.lit("['a', '"), "dataset_id", F.lit("']"))).when(F.col("id") % 4 == 2, F.lit("[]")).otherwise(F.lit("[\"x's\", 'y']"))
    named = shapes.differential(cell)
    return g.select("id", F.try_element_at(named, F.lit(1))["name"].alias("top"), F.size(named).alias("n_names"), F.array_join(shapes.listish(cells), "|").alias("listed"))


@query(
    """SELECT id, CASE WHEN id % 3 > 0 THEN size::INTEGER - 1 END AS context_position, CASE WHEN id % 2 = 0 THEN name ELSE kind END AS first_present, size::INTEGER AS first_reading, round_even(price / 7, 4)::DOUBLE AS printed,
  greatest(64, least(size::BIGINT * 1000, 32000)) AS clamped, (size * (size - 1) // 2)::BIGINT AS pairs, array_to_string(list_transform(range(0, (size % 5)::BIGINT), lambda i: chr((65 + i)::INTEGER)), '') AS letters,
  array_to_string(range(1, (size % 5)::BIGINT + 1), ',') AS numbers FROM [grid] g"""
)
def field_helpers(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "grid").select(
        "id", shapes.context_position(F.when(F.col("id") % 3 > 0, F.col("size").cast("string")).otherwise("many")).alias("context_position"),
        shapes.first_present(F.lit(""), F.when(F.col("id") % 2 == 0, F.col("name")), F.col("kind")).alias("first_present"), shapes.first_reading(F.array(F.col("size").cast("int"), F.lit(-1))).alias("first_reading"),
        shapes.round_report(F.col("price") / 7).alias("printed"), stats.clamp(F.col("size") * 1000).alias("clamped"), stats.comparison_pairs(F.col("size")).cast("bigint").alias("pairs"),
        F.array_join(text.letter_labels(F.col("size") % 5), "").alias("letters"), F.array_join(text.number_labels(F.col("size") % 5), ",").alias("numbers"),
    )


@query(
    """SELECT conv_id, (8 + sum(4 + CASE WHEN length(text) = 0 THEN 0 ELSE floor(length(text) / 3.6)::BIGINT + 1 END + CASE WHEN length(role) = 0 THEN 0 ELSE floor(length(role) / 3.6)::BIGINT + 1 END))::BIGINT AS tokens
FROM conversations GROUP BY conv_id"""
)
def conversation_tokens(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("m"))
    return said.select("conv_id", shapes.conversation_tokens(F.col("m"), overhead=4, margin=8).alias("tokens"))


@query(
    """WITH q AS (SELECT id, '{"max_tokens": ' || size || ', "seed": null, "stop": ["###", "\\"' || prompt_mode || '"]}' AS s, name, model_id, prompt_mode FROM [grid] g)
SELECT id, left(sha256('{"messages": [{"content": "' || name || '", "role": "user"}], "model": "' || model_id || '", "sampling": ' || s || ', "template": "cot@' || prompt_mode || '"}'), 16) AS fingerprint, left(sha256(s), 12) AS signature FROM q"""
)
def request_identity(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of whole requests, and signatures of their sampling alone."""
    sampling = StructType([StructField("stop", ArrayType(StringType())), StructField("max_tokens", LongType()), StructField("seed", LongType())])
    message = StructType([StructField("role", StringType()), StructField("content", StringType())])
    whole = StructType([StructField("template", StringType()), StructField("model", StringType()), StructField("messages", ArrayType(message)), StructField("sampling", sampling)])
    g = fixture(spark, d, "grid")
    drawn = F.struct(F.array(F.lit("###"), F.concat(F.lit('"'), "prompt_mode")).alias("stop"), F.col("size").cast("long").alias("max_tokens"), F.lit(None).cast("long").alias("seed"))
    asked = F.struct(F.concat(F.lit("cot@"), "prompt_mode").alias("template"), F.col("model_id").alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("name").alias("content"))).alias("messages"), drawn.alias("sampling"))
    g = g.select("id", asked.alias("q"))
    return g.select("id", shapes.payload_hash(F.col("q"), whole).alias("fingerprint"), shapes.payload_hash(F.col("q.sampling"), sampling, 12).alias("signature"))


@query(
    """SELECT id, 'max_tokens=' || CASE WHEN id % 2 = 0 THEN 100 ELSE size END || ',top_k=' || id || ',top_p=1' AS merged,
  array_to_string(list_sort(list_distinct(list_filter([CASE WHEN size % 2 = 0 THEN model_id END, CASE WHEN size % 3 = 0 THEN 'a' END, CASE WHEN size % 3 = 0 THEN 'a' END], lambda x: x IS NOT NULL))), ',') AS failed FROM [grid] g"""
)
def merged_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Sampling maps merged; families whose judge failed."""
    g = fixture(spark, d, "grid")
    one = F.create_map(F.lit("max_tokens"), F.col("size").cast("string"), F.lit("top_p"), F.lit("1"))
    two = F.create_map(F.lit("max_tokens"), F.when(F.col("id") % 2 == 0, F.lit("100")), F.lit("top_k"), F.col("id").cast("string"))
    errors = F.array(F.concat("model_id", F.when(F.col("size") % 2 == 0, F.lit(":judge_failed x")).otherwise(":late")), F.when(F.col("size") % 3 == 0, F.lit("a:judge_failed")).otherwise("b:ok"), F.when(F.col("size") % 3 == 0, F.lit("a:judge_failed again")).otherwise("c"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(shapes.merged_sampling(one, two))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return g.select("id", shown.alias("merged"), F.array_join(shapes.failed_families(errors), ",").alias("failed"))


@query("SELECT item, count(*) FILTER (prediction = last) AS n_matches, count(*) AS n_turns FROM (SELECT *, last_value(prediction) OVER (PARTITION BY item ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM [items] i) q GROUP BY item")
def final_matches(spark: SparkSession, d: str) -> DataFrame:
    """Turns, in order, whose prediction is the episode's last."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", "prediction"))), lambda x: F.concat(F.lit("The "), x["prediction"], F.lit("!")))
    g = fixture(spark, d, "items").groupBy("item").agg(said.alias("p"))
    return g.select("item", F.size(F.array_compact(shapes.matches_final(F.col("p")))).cast("bigint").alias("n_matches"), F.size("p").cast("bigint").alias("n_turns"))


@query(
    """SELECT id, (id % 3 > 0)::INT::DOUBLE AS given, CASE WHEN id % 3 > 0 THEN (mode LIKE '%URGENT%' OR mode LIKE '%HIGH%')::INT::DOUBLE END AS match, CASE WHEN status = 'ok' THEN mode WHEN id % 2 = 0 THEN task ELSE mode END AS judged FROM [replies] r"""
)
def provisional_answers(spark: SparkSession, d: str) -> DataFrame:
    r = fixture(spark, d, "replies")
    p = shapes.provisional(F.when(F.col("id") % 3 > 0, F.col("mode")).otherwise(" "), F.array(F.lit("Urgent"), F.lit("high!")))
    forced = shapes.forced_answer(F.col("status") == "ok", F.col("mode"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "task")).otherwise(F.lit("  ")))
    return r.select("id", p["given"].alias("given"), p["match"].alias("match"), forced.alias("judged"))


@query(
    """SELECT id, id % 4 > 0 AS misplaced, CASE CAST(id % 3 AS INT) WHEN 0 THEN '<think>t</think><answer>' || task || '</answer>' WHEN 1 THEN '<answer>' || task || '</answer>' ELSE '' END AS content,
  CASE CAST(id % 3 AS INT) WHEN 0 THEN 'before' WHEN 1 THEN 'only <answer>x</answer> then' ELSE 'nothing' END AS reasoning, CASE WHEN id % 3 = 2 THEN NULL WHEN finish_reason = 'length' THEN 'truncated' ELSE 'ok' END AS status,
  CASE CAST(id % 3 AS INT) WHEN 0 THEN 'think' WHEN 1 THEN 'answer' ELSE 'none' END AS how, '<answer>' || task || '</answer>' AS tagged FROM [replies] r"""
)
def repaired_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies that stand in the reasoning channel, split into both; answers put in tags."""
    whole = F.when(F.col("id") % 3 == 0, F.concat(F.lit("before <think>t</think><answer>"), "task", F.lit("</answer>"))).when(F.col("id") % 3 == 1, F.concat(F.lit("only <answer>x</answer> then <answer>"), "task", F.lit("</answer>"))).otherwise("nothing")
    r = fixture(spark, d, "replies").select("id", "task", F.when(F.col("id") % 4 == 0, F.lit("here")).alias("was"), whole.alias("whole"), "finish_reason")
    fixed = shapes.repaired_channels(F.col("whole"), F.col("finish_reason"))
    return r.select("id", shapes.misplaced(F.col("was"), F.col("whole")).alias("misplaced"), *[fixed[c].alias(c) for c in ("content", "reasoning", "status", "how")], shapes.tagged_answer(F.col("task")).alias("tagged"))


@query("SELECT id, 'alone=alone;exam.' || model_id || '=' || 'size,price;history=' || prompt_mode AS findings FROM [grid] g")
def parent_findings(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(F.concat(F.lit("exam."), "model_id", F.lit(".size")), F.concat(F.lit("history."), "prompt_mode"), F.lit("alone"), F.concat(F.lit("exam."), "model_id", F.lit(".price")))
    shown = F.array_join(F.transform(shapes.parent_findings(keys), lambda s: F.concat(s["parent"], F.lit("="), F.array_join(s["leaves"], ","))), ";")
    return fixture(spark, d, "grid").select("id", shown.alias("findings"))


@query(
    """SELECT id, CASE WHEN size > 2 THEN 'w1 w2 [... ' || (size - 2) || ' more words omitted]' ELSE array_to_string(list_transform(range(1, size::BIGINT + 1), lambda i: 'w' || i), ' ') END AS words, CASE WHEN length(name) > 8 THEN left(name, 8) || '...[clipped]' ELSE name END AS clipped,
  CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.0 END AS variant_hit, name || '|' || kind AS forms, '1. ' || name || chr(10) || '2. ' || kind AS numbered, 'one two three ' || size AS statements,
  name || chr(10) || chr(10) || kind AS tidy, CASE WHEN id % 2 = 0 THEN name ELSE '' END AS as_list, id % 3 > 0 AS grounded FROM [grid] g"""
)
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    n, name, kind = F.col("size").cast("string"), F.col("name"), F.col("kind")
    counted = F.array_join(F.transform(F.sequence(F.lit(1), F.col("size").cast("int")), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    said = F.when(F.col("id") % 2 == 0, F.lit("the pod-memory stress")).otherwise("pod memory")
    span = F.when(F.col("id") % 3 == 0, F.lit("five quite other words here")).when(F.col("id") % 3 == 1, F.concat(F.lit("**"), name, F.lit("**"))).otherwise(F.lit("fever  since YESTERDAY evening"))
    return fixture(spark, d, "grid").select(
        "id", text.clip_words(counted, 2).alias("words"), text.clip(name, 8).alias("clipped"), text.any_contains(said, text.label_variants(F.lit("Pod_memory_stress"))).cast("double").alias("placeholder"),
        F.when(F.col("id") % 2 == 0, text.any_contains(said, text.label_variants(F.lit("Pod_Memory")))).otherwise(text.any_contains(said, text.label_variants(F.lit("disk_io")))).alias("variant_hit"),
        F.array_join(text.parenthetical_forms(F.concat(name, F.lit(" ("), kind, F.lit(")"))), "|").alias("forms"), text.numbered_list(F.array(name, kind)).alias("numbered"),
        F.array_join(text.split_statements(F.concat(F.lit("1. too short 2) one two three "), n)), "|").alias("statements"), text.normalize_whitespace(F.concat(F.lit(" "), name, F.lit("\n\n\n\n"), kind, F.lit("  "))).alias("tidy"),
        F.array_join(text.as_list(F.when(F.col("id") % 2 == 0, name)), "|").alias("as_list"), text.grounded(span, F.concat(name, F.lit(" has fever since yesterday evening"))).alias("grounded"),
    ).drop("placeholder")


@query(
    """SELECT id, CASE WHEN id % 2 = 0 THEN 'last ' || name ELSE name || ' end' END AS turn, 'a=' || name || ';b=' || size AS options, size || ',' || (size + 1) AS premises,
  CASE CAST(id % 3 AS INT) WHEN 0 THEN '(x**' || size || ') - (y)' WHEN 1 THEN 'x' ELSE '' END AS expression, CASE WHEN id % 2 = 0 THEN 'price' ELSE 'vital signs,age' END AS keys FROM [grid] g"""
)
def extraction_helpers(spark: SparkSession, d: str) -> DataFrame:
    n, name, even = F.col("size").cast("string"), F.col("name"), F.col("id") % 2 == 0
    reply = F.when(even, F.concat(F.lit("<answer>one</answer> <answer> last "), name, F.lit(" </answer> bye"))).otherwise(F.concat(F.lit("first\n\n"), name, F.lit(" end\n  ")))
    line = F.when(F.col("id") % 3 == 0, F.concat(F.lit("\n x^"), n, F.lit(" = y"))).when(F.col("id") % 3 == 1, F.lit("x = 0")).otherwise("")
    asked = F.when(even, F.lit("look at 'price' and 'unknown'")).otherwise("the age and the VITAL SIGNS")
    proof = F.concat(F.lit("sent"), n, F.lit(" & sent"), (F.col("size") + 1).cast("string"), F.lit(" -> sent99"))
    return fixture(spark, d, "grid").select(
        "id", extract.turn_prediction(reply).alias("turn"), F.array_join(F.transform(extract.option_list(F.concat(F.lit("(a) "), name, F.lit(" (b) "), n)), lambda o: F.concat_ws("=", o["label"], o["text"])), ";").alias("options"),
        F.array_join(extract.premise_ids(proof).cast("array<string>"), ",").alias("premises"), extract.clean_expression(line).alias("expression"), F.array_join(extract.known_keys(asked, F.array(F.lit("age"), F.lit("price"), F.lit("vital signs"))), ",").alias("keys"),
    )


@query(
    """SELECT id, CASE CAST(id % 4 AS INT) WHEN 0 THEN 'ask' WHEN 1 THEN 'test' WHEN 2 THEN 'ask' ELSE '' END AS action, CASE CAST(id % 4 AS INT) WHEN 0 THEN name WHEN 1 THEN '{"n": ' || size || '}' WHEN 2 THEN lower(kind) ELSE 'hm ' || size END AS query, id % 4 < 3 AS parsed,
  CASE WHEN id % 4 < 2 THEN 1 ELSE 0 END AS n_objects FROM [grid] g"""
)
def action_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Actions as strict JSON, as JSON within prose, as a name and the rest of its line, and none."""
    n, name, kind, k = F.col("size").cast("string"), F.col("name"), F.col("kind"), F.col("id") % 4
    reply = F.when(k == 0, F.concat(F.lit('{"action": " ASK ", "query": "'), name, F.lit('"}'))).when(k == 1, F.concat(F.lit('Well:\n```json\n{"action_type": "test", "content": {"n": '), n, F.lit("}}\n```"))).when(k == 2, F.concat(F.lit("I ask: "), kind)).otherwise(F.concat(F.lit("hm "), n))
    g = fixture(spark, d, "grid").select("id", reply.alias("reply")).withColumn("a", actions.parse_action(F.col("reply"), ("ask", "test")))
    return g.select("id", "a.action", "a.query", "a.parsed", F.size(actions.json_objects(F.col("reply"))).alias("n_objects"))


@query(
    """SELECT id, '1:' || name || ' has a fever;|2:and a long cough' AS findings, 'Entities in the incident window:' || chr(10) || '- ' || name || ' (svc)' || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || 'Call/dependency edges:' || chr(10) || '- ' || name || ' -> db' ELSE '' END AS topology,
  '[1] ' || left(name, 6) || chr(10) || '[2] ' || left(kind, 6) AS context, CASE CAST(id % 3 AS INT) WHEN 0 THEN 'Pain? left arm' WHEN 1 THEN 'Pain? yes' END AS evidence FROM [grid] g"""
)
def case_texts(spark: SparkSession, d: str) -> DataFrame:
    name, kind = F.col("name"), F.col("kind")
    facts = actions.findings(F.concat(F.lit("Short. "), name, F.lit(" has a fever; - and a long cough\nno")))
    nodes = F.array(F.struct(name.alias("name"), F.lit("svc").alias("type")))
    calls = F.filter(F.array(F.struct(F.when(F.col("id") % 2 == 0, name).alias("source"), F.lit("db").alias("target"))), lambda e: e["source"].isNotNull())
    token = F.when(F.col("id") % 3 == 0, F.lit("E1_@_V2")).when(F.col("id") % 3 == 1, F.lit("E1")).otherwise("E9")
    shown = F.array_join(F.transform(facts, lambda s: F.concat_ws(":", s["key"], s["text"])), "|")
    return fixture(spark, d, "grid").select(
        "id", shown.alias("findings"), actions.topology_text(nodes, calls).alias("topology"), actions.context_text(F.array(name, kind), 2, 6).alias("context"),
        actions.evidence_line(token, F.create_map(F.lit("E1"), F.lit("Pain?")), F.create_map(F.lit("V2"), F.lit("left arm"))).alias("evidence"),
    )


@query(
    """SELECT id, CASE WHEN id % 3 > 0 THEN size::BIGINT END AS int_value, CASE WHEN id % 3 < 2 THEN size / 2.0 END AS number_value, CASE WHEN size % 4 < 2 THEN (size % 4)::INTEGER END AS binary_value,
  round((size % 3 > 0)::INT / 2.0 + (size % 2 > 0)::INT / 2.0, 9)::DOUBLE AS share, CASE WHEN id % 2 = 0 THEN (size % 2 = 0)::INT / 2.0 + 0.5 ELSE 0.0 END AS agreement FROM [grid] g"""
)
def scalar_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Values under their contracts, shares of steps, agreement of lists."""
    n = F.col("size")
    odd = F.array((n % 3).cast("double"), (n % 2).cast("double"))
    same = F.when(F.col("id") % 2 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))
    return fixture(spark, d, "grid").select(
        "id", validators.nonnegative_int(F.when(F.col("id") % 3 > 0, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit(".5")))).alias("int_value"),
        validators.nonnegative_number(F.when(F.col("id") % 3 < 2, (n / 2).cast("string")).otherwise("-1")).alias("number_value"), validators.binary((n % 4).cast("string")).alias("binary_value"),
        F.round(stats.share_of_steps(odd, F.size(odd)), 9).alias("share"), stats.list_agreement(same, F.array(F.lit(1), (n % 2).cast("int"))).alias("agreement"),
    )


# ---------------------------------------------------------------- loads


@query("SELECT item, (pos - 1)::INTEGER AS position, prediction AS text, qty, cnt AS n_train FROM (SELECT *, count(*) OVER (PARTITION BY item) AS cnt FROM [items] i) q WHERE qty <= 40")
def exploded_questions(spark: SparkSession, d: str) -> DataFrame:
    """Documents of questions to a row a question; those without text go, and what the questions share is carried."""
    i = fixture(spark, d, "items")
    nested = F.transform(F.array_sort(F.collect_list(F.struct("pos", "prediction", "qty"))), lambda x: F.struct(F.when(x["qty"] <= 40, x["prediction"]).otherwise("").alias("text"), x["qty"].alias("qty")))
    return loads.exploded(i.groupBy("item").agg(nested.alias("questions"), F.count("*").alias("n_train")), "questions", ["item", "n_train"], ("text",))


@query(
    """WITH p AS (SELECT n_name AS name, n_nationkey::BIGINT AS id, 'nation' AS source FROM nation UNION ALL SELECT r_name, r_regionkey::BIGINT, 'region' FROM region UNION ALL SELECT n_name, n_nationkey::BIGINT + 100, 'again' FROM nation)
SELECT name, id, source FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source, id) AS rn FROM p) q WHERE rn = 1"""
)
def pooled_first(spark: SparkSession, d: str) -> DataFrame:
    """Sources pooled under a tag, and of equal items the first."""
    nation = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("id"))
    region = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("bigint").alias("id"))
    return loads.first_of(loads.pooled({"nation": nation, "region": region, "again": nation.withColumn("id", F.col("id") + 100)}), ["name"], ["source", "id"])


@query(
    """SELECT s_suppkey, n_nationkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, n_name) AS name, n_regionkey FROM (SELECT *, s_nationkey AS n_nationkey FROM supplier) s LEFT JOIN (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 20) n USING (n_nationkey)
WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0)"""
)
def kept_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose key is among kept rows, with the metadata of that key; the task's own value wins."""
    tasks = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    kept = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("n_nationkey"))
    known = table(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("name"), "n_regionkey")
    return loads.with_metadata(loads.kept_by(tasks, kept, "n_nationkey"), known, "n_nationkey")


@query(
    """WITH t AS (SELECT item, count(*) AS n, min(prediction) FILTER (pos = 2) AS second FROM [items] i WHERE item % 3 = 0 GROUP BY item)
SELECT o_orderkey AS item, coalesce(n, 0) AS n_docs, second FROM orders LEFT JOIN t ON item = o_orderkey WHERE o_orderpriority <> '5-LOW'"""
)
def topic_context(spark: SparkSession, d: str) -> DataFrame:
    """Items with their topic's documents, and one document by its id; items that make no sample go."""
    topics = fixture(spark, d, "items").where("item % 3 = 0").groupBy("item").agg(F.collect_list(F.struct("pos", "prediction")).alias("docs"))
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("observation"))
    rows = loads.with_context(loads.built(items, F.col("observation")), topics, "item")
    return rows.select("item", F.size("docs").cast("bigint").alias("n_docs"), loads.row_of(F.col("docs"), "pos", F.lit(2))["prediction"].alias("second"))


@query("SELECT array_to_string(list_sort(list(DISTINCT prediction)), ',') AS vocabulary FROM [items] i")
def failure_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    nested = fixture(spark, d, "items").groupBy("item").agg(F.collect_list(F.struct("prediction")).alias("f"))
    return loads.vocabulary(nested, "f", "prediction").select(F.array_join("vocabulary", ",").alias("vocabulary"))


@query(
    """WITH q AS (SELECT id, list_distinct([trim(name), model_id, kind, 'other']) AS p FROM [grid] g),
  h AS (SELECT id, u, sha256('salt|' || id || '|' || u) AS h FROM (SELECT id, unnest(p) AS u FROM q) x)
SELECT id, CASE WHEN id % 4 = 0 THEN 'a b|c' WHEN id % 4 = 1 THEN '' ELSE string_agg(u, '|' ORDER BY h) END AS options FROM h GROUP BY id"""
)
def candidate_sets(spark: SparkSession, d: str) -> DataFrame:
    """Listed candidates, else gold and negatives in an order fixed by the key; too few make none."""
    listed = F.when(F.col("id") % 4 == 0, F.array(F.lit("a   b"), F.lit(" "), F.lit("c")))
    gold = F.when(F.col("id") % 4 != 1, F.concat(F.lit(" "), "name")).otherwise("")
    found = loads.candidates(listed, gold, F.array("model_id", "kind", F.lit("other"), F.lit("other")), F.col("id").cast("string"), "salt")
    return fixture(spark, d, "grid").select("id", F.array_join(found, "|").alias("options"))


@query(
    """WITH f AS (SELECT dataset_id AS stem, CASE WHEN model_id = 'alpha' THEN 'source' ELSE 'target' END AS side, list_position(['test', 'dev'], split) AS pl, split, name || '-' || id AS path FROM (SELECT *, CASE WHEN size < 15 THEN 'test' WHEN size < 30 THEN 'dev' ELSE 'train' END AS split FROM [grid] g) x)
SELECT stem, min(CASE WHEN pl > 0 THEN pl ELSE 3 END || '|' || path) FILTER (side = 'source') AS source, min(CASE WHEN pl > 0 THEN pl ELSE 3 END || '|' || path) FILTER (side = 'target') AS target FROM f GROUP BY stem HAVING count(*) FILTER (side = 'source') > 0 AND count(*) FILTER (side = 'target') > 0"""
)
def paired_files(spark: SparkSession, d: str) -> DataFrame:
    """Source and target files by stem, the preferred split first; the place of the split stands before the path."""
    split = F.when(F.col("size") < 15, "test").when(F.col("size") < 30, "dev").otherwise("train")
    place = F.when(split == "test", "1|").when(split == "dev", "2|").otherwise("3|")
    files = fixture(spark, d, "grid").select(F.col("dataset_id").alias("stem"), F.when(F.col("model_id") == "alpha", "source").otherwise("target").alias("side"), split.alias("split"), F.concat(place, "name", F.lit("-"), F.col("id").cast("string")).alias("path"))
    return loads.paired_files(files, ["test", "dev"])


@query("SELECT item, prediction AS label, qty AS amount FROM [items] i")
def columns_as_rows(spark: SparkSession, d: str) -> DataFrame:
    """Columnar JSON to example rows."""
    i = fixture(spark, d, "items").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("pos", "prediction", "qty"))).alias("s"))
    columns = i.select("item", F.transform("s", lambda x: x["prediction"]).alias("label"), F.transform("s", lambda x: x["qty"]).alias("amount"))
    return loads.columns_as_rows(columns, ["item"], ["label", "amount"])


@query("SELECT item, id, rank FROM (SELECT item, id, row_number() OVER (PARTITION BY item ORDER BY CASE kind WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, id)::INTEGER AS rank FROM [log] l) q WHERE rank <= 3")
def evidence_slice(spark: SparkSession, d: str) -> DataFrame:
    return loads.evidence_slice(fixture(spark, d, "log"), ["item"], "kind", "id", ["error", "click"], 3).select("item", "id", "rank")


# ---------------------------------------------------------------- expansion and frames


@query(
    """SELECT id || '#r' || r || '#bov' || o || '#sc' || v AS sample_id, id || '#r' || r AS group_id, id::VARCHAR AS repeat_of, CASE o WHEN 0 THEN 'A' ELSE 'B' END AS label
FROM [grid] g, (SELECT unnest([0, 1]) AS r) x, (SELECT unnest([0, 1]) AS o) y, (SELECT unnest([0, 1]) AS v) z"""
)
def expand_for_modes(spark: SparkSession, d: str) -> DataFrame:
    """Repeats, options and votes multiply; votes stay in the group of their item."""
    g = fixture(spark, d, "grid").select(F.col("id").cast("string").alias("sample_id"), F.array(F.lit("A"), F.lit("B")).alias("labels"), F.array("name", "kind").alias("options"))
    return frames.for_modes(g, repeats=2, per_option=True, votes=2).select("sample_id", "group_id", "repeat_of", F.col("bov_label").alias("label"))


@query("SELECT id || '#sc' || v AS sample_id, id::VARCHAR AS group_id, v AS vote_index FROM [grid] g, (SELECT unnest([0, 1, 2]) AS v) z")
def expand_votes(spark: SparkSession, d: str) -> DataFrame:
    return frames.for_modes(fixture(spark, d, "grid").select(F.col("id").cast("string").alias("sample_id")), votes=3).select("sample_id", "group_id", "vote_index")


@query("SELECT id, level, CASE level WHEN 'name' THEN name ELSE kind END AS text FROM [grid] g, (SELECT unnest(['name', 'kind']) AS level) x WHERE level = 'name' OR id % 3 > 0")
def information_levels(spark: SparkSession, d: str) -> DataFrame:
    return expand.levels(fixture(spark, d, "grid").select("id", "name", F.when(F.col("id") % 3 > 0, F.col("kind")).otherwise(" ").alias("kind")), "id", ["name", "kind"])


@query(
    """SELECT task, mode, count(*) AS n_planned, count(*) FILTER (status IN ('ok', 'empty', 'truncated')) AS n_scored, count(*) FILTER (status = 'error') AS n_error, 0::BIGINT AS n_skipped,
  round(round_even(avg(price) FILTER (status IN ('ok', 'empty', 'truncated')), 4), 2)::DOUBLE AS primary_value FROM [replies] r GROUP BY task, mode"""
)
def tasks_frame(spark: SparkSession, d: str) -> DataFrame:
    return frames.tasks_frame(fixture(spark, d, "replies"), ["task", "mode"], "price").withColumn("primary_value", F.round("primary_value", 2))


@query("SELECT dataset_id, arg_min(name, id) AS name, arg_min(kind, id) AS kind FROM [grid] g WHERE id % 5 > 0 GROUP BY dataset_id")
def datasets_frame(spark: SparkSession, d: str) -> DataFrame:
    """The first documentation of each dataset."""
    g = fixture(spark, d, "grid").withColumns({c: F.when(F.col("id") % 5 > 0, F.col(c)) for c in ("name", "kind")})
    return frames.dimension(g, "dataset_id", "id", ["name", "kind"])


@query(
    """SELECT item, pos, score AS metric_score, CASE WHEN item % 2 = 0 THEN qty END AS metric_qty, '["' || prediction || '"]' AS steps, CASE WHEN pos > 2 THEN pos::DOUBLE END AS steps_taken, (CASE WHEN item % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN pos > 2 THEN 1 ELSE 0 END)::INTEGER AS n_details FROM [items] i"""
)
def sample_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Wide rows of a sparse map, with interaction steps where turns were taken; what is no column counts as details."""
    m = F.map_filter(F.create_map(F.lit("score"), F.col("score").cast("double"), F.lit("qty"), F.when(F.col("item") % 2 == 0, F.col("qty").cast("double"))), lambda k, v: v.isNotNull())
    i = fixture(spark, d, "items").select("item", "pos", frames.with_interaction_steps(m, F.when(F.col("pos") > 2, "interactive").otherwise("static"), F.col("pos")).alias("metrics"), F.array("prediction").alias("steps"))
    _, rest = frames.projected(F.col("metrics"), ["score"])
    sheet = frames.sample_sheet(i.withColumn("n_details", F.size(rest)), ["item", "pos", "n_details"], ["score", "qty", "interaction_steps"], ["steps"])
    return sheet.withColumnsRenamed({"metric.score": "metric_score", "metric.qty": "metric_qty", "metric.interaction_steps": "steps_taken"})


@query(
    """SELECT dataset_id, round(avg(price) FILTER (model_id = 'alpha'), 6) AS alpha, round(avg(price) FILTER (model_id = 'beta'), 6) AS beta, round(list_avg(list_filter([avg(price) FILTER (model_id = 'alpha'), avg(price) FILTER (model_id = 'beta')], lambda x: x IS NOT NULL)), 6) AS mean
FROM [grid] g WHERE model_id <> 'gamma' GROUP BY dataset_id"""
)
def accuracy_heat_map(spark: SparkSession, d: str) -> DataFrame:
    out = frames.heat_map(fixture(spark, d, "grid").where("model_id <> 'gamma'"), "dataset_id", "model_id", "price", ["alpha", "beta"])
    return out.select("dataset_id", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "mean")])


@query(
    """SELECT kind, round(avg(value) FILTER (correct), 3) AS "right", round(avg(value) FILTER (NOT correct), 3) AS wrong, round(avg(value) FILTER (correct) - avg(value) FILTER (NOT correct), 3) AS gap,
  round(avg(correct::INT), 9) AS accuracy, round(avg(turn), 9) AS turns FROM [log] l GROUP BY kind"""
)
def outcome_gap(spark: SparkSession, d: str) -> DataFrame:
    """Relevance where right and where wrong, beside accuracy and turns."""
    rows = fixture(spark, d, "log").withColumn("hit", F.col("correct").cast("int"))
    gap = frames.outcome_gap(rows, "kind", "value", "correct").select("kind", *[F.round(c, 3).alias(c) for c in ("right", "wrong", "gap")])
    return gap.join(frames.efficiency(rows, "kind", accuracy="hit", turns="turn").select("kind", F.round("accuracy", 9).alias("accuracy"), F.round("turns", 9).alias("turns")), "kind")


@query(
    """WITH e AS (SELECT item, (min(qty) FILTER (pos = 1) > 25)::INTEGER AS first, bool_or(ok) AS ok FROM [items] i GROUP BY item), k AS (SELECT first, avg(ok::INT) AS p, count(*) AS n FROM e GROUP BY first)
SELECT first, round(p, 9) AS accuracy, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS high FROM k"""
)
def first_element(spark: SparkSession, d: str) -> DataFrame:
    """Does the first step being relevant tell of the outcome."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("pos", "qty"))), lambda x: (x["qty"] > 25).cast("int"))
    rows = fixture(spark, d, "items").groupBy("item").agg(steps.alias("steps"), F.max("ok").alias("ok"))
    return frames.first_element(rows, "steps", "ok", []).select("first", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "low", "high")])


@query(
    """WITH s AS (SELECT DISTINCT task, mode FROM [replies] r), m AS (SELECT task, mode, avg(price) AS value FROM [replies] r WHERE status IN ('ok', 'truncated', 'empty') AND id % 7 = 0 GROUP BY 1, 2) SELECT task, mode, round(value, 4) AS value FROM s LEFT JOIN m USING (task, mode)"""
)
def rescored_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scores of tasks worked out again from the records that are there."""
    r = fixture(spark, d, "replies")
    summary = r.select("task", "mode").distinct().withColumn("value", F.lit(-1.0))
    return frames.rescored(summary, r.where("id % 7 = 0"), ["task", "mode"], "price").withColumn("value", F.round("value", 4))


@query(
    """WITH s AS (SELECT kind, item, max(ok) FILTER (j = 'A') AS a, max(ok) FILTER (j = 'B') AS b, max(ok) FILTER (j = 'C') AS c FROM (SELECT kind, item, chr((65 + turn % 4)::INTEGER) AS j, correct::INTEGER AS ok FROM [log] l) x GROUP BY kind, item)
SELECT kind, count(*) AS n, round(avg((a = b)::INT), 9) AS "AB", round(avg((a = c)::INT), 9) AS "AC", round(avg((b = c)::INT), 9) AS "BC" FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY kind"""
)
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    calls = fixture(spark, d, "log").select("kind", "item", F.char(65 + F.col("turn") % 4).alias("judge"), F.col("correct").cast("int").alias("ok"))
    out = frames.agreement(calls, ["kind", "item"], "judge", "ok")
    return out.select("kind", "n", *[F.round(c, 9).alias(c) for c in ("AB", "AC", "BC")])


@query(
    """WITH c AS (SELECT content, max(id) AS id FROM [replies] r WHERE id % 2 = 0 GROUP BY content) SELECT task, count(*) AS n, count(c.content) AS hits, round(count(c.content)::DOUBLE / count(*), 9) AS coverage FROM [replies] r LEFT JOIN c USING (content) GROUP BY task"""
)
def cache_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = fixture(spark, d, "replies")
    return frames.cache_coverage(r, r.where("id % 2 = 0"), "content", ["task"]).withColumn("coverage", F.round("coverage", 9))


@query("WITH c AS (SELECT content, arg_max(status, id) AS verdict FROM [replies] r WHERE id % 2 = 0 GROUP BY content) SELECT id, verdict FROM [replies] r LEFT JOIN c USING (content)")
def judge_cache(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts found by the hash of what was asked; of several stored, the last."""
    r = fixture(spark, d, "replies")
    stored = r.where("id % 2 = 0").select("content", F.col("status").alias("verdict"), F.col("id").alias("seq"))
    return frames.cached(r.select("id", "content"), stored, "content", "verdict").select("id", "verdict")


@query("SELECT o_orderkey AS item, coalesce(l.qty, o_totalprice) AS qty, coalesce(l.p, o_orderstatus) AS p FROM orders LEFT JOIN (SELECT item, arg_max(qty, pos) AS qty, arg_max(prediction, pos) AS p FROM [items] i WHERE item % 2 = 0 GROUP BY item) l ON l.item = o_orderkey")
def latest_round(spark: SparkSession, d: str) -> DataFrame:
    """Records with the values of their latest round in the log, else their own."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_totalprice").cast("double").alias("qty"), F.col("o_orderstatus").alias("p"))
    log = fixture(spark, d, "items").where("item % 2 = 0").select("item", "pos", F.col("qty").cast("double").alias("qty"), F.col("prediction").alias("p"))
    return frames.latest_round(o, log, "item", "pos", ["qty", "p"])


@query("SELECT id, CASE model_id WHEN 'alpha' THEN price WHEN 'beta' THEN size END::DOUBLE AS correct FROM [grid] g WHERE id % 6 > 0")
def sample_facts(spark: SparkSession, d: str) -> DataFrame:
    """Records with their task's primary metric; reduced ones are left out."""
    g = fixture(spark, d, "grid").select("id", "model_id", F.when(F.col("id") % 3 > 0, F.lit(False)).otherwise(F.col("id") % 6 == 0).alias("reduced"), F.create_map(F.lit("price"), F.col("price").cast("double"), F.lit("size"), F.col("size").cast("double")).alias("metrics"))
    primary = F.when(F.col("model_id") == "alpha", "price").when(F.col("model_id") == "beta", "size").otherwise("none")
    return frames.sample_facts(g, g.select("model_id", primary.alias("primary_metric")), ["model_id"]).select("id", "correct")


@query(
    """WITH s AS (SELECT dataset_id, CASE WHEN size > 40 THEN 'selection' ELSE 'generation' END AS task_kind, avg(correct) AS coverage FROM [grid] g GROUP BY 1, 2)
SELECT dataset_id, task_kind, coverage < 0.5 AS partial, CASE WHEN count(*) OVER (PARTITION BY dataset_id) > 1 THEN dataset_id || CASE task_kind WHEN 'selection' THEN ' (sel)' ELSE ' (gen)' END ELSE dataset_id END AS task FROM s"""
)
def summary_flags(spark: SparkSession, d: str) -> DataFrame:
    s = fixture(spark, d, "grid").groupBy("dataset_id", F.when(F.col("size") > 40, "selection").otherwise("generation").alias("task_kind")).agg(F.avg("correct").alias("coverage"))
    return frames.sorted_summary(frames.summary_flags(s, 0.5).withColumn("model_id", F.lit("m")).withColumn("template_mode", F.col("task_kind"))).select("dataset_id", "task_kind", "partial", "task")


@query(
    """SELECT id, size % 2 = 0 AS changed, CASE WHEN size % 3 = 0 THEN 'b_x=2' ELSE 'a_x=1,b_x=2' END AS merged, 'score' AS stripped FROM [grid] g"""
)
def judged_updates(spark: SparkSession, d: str) -> DataFrame:
    """Families that ran again replace their metrics; reasoning metrics taken out; did a record change."""
    old = F.create_map(F.lit("a_x"), F.lit("1"), F.lit("b_x"), F.lit("1"))
    ran = F.when(F.col("size") % 3 == 0, F.array(F.lit("a_"), F.lit("b_"))).otherwise(F.array(F.lit("b_")))
    merged = records.replace_families(old, F.create_map(F.lit("b_x"), F.lit("2")), ran)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    g = fixture(spark, d, "grid").withColumns({"old_v": F.lit(None).cast("int"), "new_v": F.when(F.col("size") % 2 == 0, 1)})
    stripped = F.array_join(F.map_keys(records.strip_prefix(F.create_map(F.lit("score"), F.lit(1.0), F.lit("reasoning_x"), F.lit(1.0)))), ",")
    return g.select("id", records.changed(g, ["v"]).alias("changed"), shown.alias("merged"), stripped.alias("stripped"))


@query("SELECT id, item, ((row_number() OVER (PARTITION BY item ORDER BY id) - 1) // 4)::BIGINT AS chunk FROM [log] l WHERE id % 3 > 0")
def owed_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "log").select("id", "item")
    return records.owed_jobs(rows, rows.where("id % 3 = 0"), ["id"], "item", ["id"], 4).select("id", "item", F.col("chunk").cast("bigint").alias("chunk"))


@query("SELECT item, metric, CASE metric WHEN 'qty' THEN qty ELSE score END::DOUBLE AS value FROM (SELECT item, avg(qty) AS qty, max(score) AS score FROM [items] i GROUP BY item) q, (SELECT unnest(['qty', 'score']) AS metric) m")
def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    from verdigris.operators.aggregate import long_metrics as long

    per = fixture(spark, d, "items").groupBy("item").agg(F.avg("qty").cast("double").alias("qty"), F.max("score").cast("double").alias("score"))
    return long(per, ["item"], ["qty", "score"]).select("item", "metric", "value")


# ---------------------------------------------------------------- datasets


@query(
    """WITH q AS (SELECT list_distinct([(size % 5)::BIGINT, (size % 3)::BIGINT]) AS p, list_distinct([floor(price)::BIGINT % 5, 2]) AS g, id % 6 > 0 AS read FROM [grid] g),
  s AS (SELECT read, len(list_intersect(p, g)) AS o, len(p) AS np, len(g) AS ng FROM q),
  m AS (SELECT 'premise_set_match' AS metric, CASE WHEN read AND o = np AND o = ng THEN 1.0 ELSE 0.0 END AS v FROM s UNION ALL SELECT 'premise_f1', CASE WHEN read THEN 2.0 * o / (np + ng) ELSE 0.0 END FROM s UNION ALL SELECT 'premise_count_match', (np = ng)::INT::DOUBLE FROM s WHERE read)
SELECT metric, round(avg(v), 9) AS value, count(*) AS n FROM m GROUP BY metric"""
)
def dataset_number_set(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers of the answer as a set; a reply without any counts, but not as a wrong count."""
    said = F.when(F.col("id") % 6 > 0, F.concat(F.lit("I think 77. Answer: "), (F.col("size") % 5).cast("string"), F.lit(" and "), (F.col("size") % 3).cast("string"))).otherwise("Answer: none of them")
    rows = spread(fixture(spark, d, "grid")).select(said.alias("content"), F.array((F.col("price").cast("int") % 5).cast("string"), F.lit("2")).alias("gold_labels"))
    plan = PLANS["uniadilr_hgc"]
    return plan.aggregate(plan.score(rows)).select("metric", F.round("value", 9).alias("value"), "n")


@query(
    """WITH q AS (SELECT list_distinct(list_filter([CASE WHEN size % 2 = 0 THEN 'A' END, CASE WHEN size % 3 = 0 THEN 'C' END], lambda x: x IS NOT NULL)) AS p, CASE WHEN id % 2 = 0 THEN ['A', 'C'] ELSE ['A'] END AS g FROM [grid] g),
  s AS (SELECT len(list_intersect(p, g)) AS o, len(p) AS np, len(g) AS ng FROM q),
  m AS (SELECT 'exact_set' AS metric, (o = np AND o = ng)::INT::DOUBLE AS v FROM s UNION ALL SELECT 'set_f1', CASE WHEN np = 0 THEN 0.0 ELSE 2.0 * o / (np + ng) END FROM s UNION ALL SELECT 'set_precision', CASE WHEN np = 0 THEN 0.0 ELSE o::DOUBLE / np END FROM s
    UNION ALL SELECT 'set_recall', o::DOUBLE / ng FROM s UNION ALL SELECT 'n_selected', np::DOUBLE FROM s)
SELECT metric, round(avg(v), 9) AS value, count(*) AS n FROM m GROUP BY metric"""
)
def dataset_multi_selection(spark: SparkSession, d: str) -> DataFrame:
    """Sets of letters read from the answer line; an explicit none is an empty set."""
    chosen = F.array_compact(F.array(F.when(F.col("size") % 2 == 0, F.lit("A")), F.when(F.col("size") % 3 == 0, F.lit("(c)"))))
    said = F.concat(F.lit("B looked likely. Answer: "), F.when(F.size(chosen) > 0, F.array_join(chosen, ", ")).otherwise("none"))
    rows = spread(fixture(spark, d, "grid")).select(said.alias("content"), F.when(F.col("id") % 2 == 0, F.array(F.lit("A"), F.lit("C"))).otherwise(F.array(F.lit("A"))).alias("gold_labels"))
    plan = PLANS["aer"]
    return plan.aggregate(plan.score(rows)).select("metric", F.round("value", 9).alias("value"), "n")


@query(
    """WITH s AS (SELECT dataset_id, (id % 3 = 0)::INT::DOUBLE AS strict, (id % 3 < 2)::INT::DOUBLE AS lenient FROM [grid] g)
SELECT dataset_id, 'root_cause_match' AS metric, round(avg(strict), 9) AS value, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT dataset_id, 'root_cause_match_lenient', round(avg(lenient), 9), count(*) FROM s GROUP BY 1"""
)
def dataset_contained(spark: SparkSession, d: str) -> DataFrame:
    """A gold label in the answer, or anywhere in the reply; its spellings count."""
    said = F.when(F.col("id") % 3 == 0, F.lit("Answer: the Pod Memory leak")).when(F.col("id") % 3 == 1, F.lit("maybe pod-memory. Answer: disk")).otherwise("Answer: disk")
    rows = fixture(spark, d, "grid").select("dataset_id", said.alias("content"), F.lit("pod_memory").alias("gold"))
    plan = PLANS["aiops2025"]
    return plan.aggregate(plan.score(rows), ("dataset_id",)).select("dataset_id", "metric", F.round("value", 9).alias("value"), "n")


@query(
    """WITH s AS (SELECT CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b_c' END AS st, id % 3 = 0 AS eq, id % 3 < 2 AS con FROM [grid] g),
  m AS (SELECT 'match' AS metric, con::INT::DOUBLE AS v FROM s UNION ALL SELECT 'exact_match', eq::INT::DOUBLE FROM s UNION ALL SELECT 'token_f1', CASE WHEN eq THEN 1.0 WHEN con THEN 0.8 ELSE 0.0 END FROM s UNION ALL SELECT 'rouge_l', CASE WHEN eq THEN 1.0 WHEN con THEN 2.44 * 2 / 3 / (1 + 1.44 * 2 / 3) ELSE 0.0 END FROM s UNION ALL SELECT 'exact_match_' || st, eq::INT::DOUBLE FROM s)
SELECT metric, round(avg(v), 9) AS value, count(*) AS n FROM m GROUP BY metric"""
)
def dataset_free_text(spark: SparkSession, d: str) -> DataFrame:
    """Answers equal to the gold text, holding it, or neither, with a stratum."""
    said = F.when(F.col("id") % 3 == 0, F.lit("Answer: The Red  Fox!")).when(F.col("id") % 3 == 1, F.lit("Answer: a red fox, surely")).otherwise("Answer: blue")
    rows = spread(fixture(spark, d, "grid")).select(said.alias("content"), F.lit("red fox").alias("gold"), F.lit(None).cast("array<string>").alias("accepted"), F.when(F.col("id") % 2 == 0, "a").otherwise("B c").alias("subset"))
    plan = PLANS["abductionrules"]
    return plan.aggregate(plan.score(rows)).select("metric", F.round("value", 9).alias("value"), "n")
