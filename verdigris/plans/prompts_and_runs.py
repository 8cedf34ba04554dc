"""Queries of prompts, judges' replies, notation, folds of groups, stored runs, disclosure, documents, and all datasets' plans at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import judging, notation, prompts
from verdigris.operators import episodes, folds, retrieval
from verdigris.plans import datasets, reports
from verdigris.plans.registry import fixture, query, spread, table


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- prompts

OPTIONS = "CASE WHEN size % 7 = 0 THEN [] ELSE [name, kind, 'neither'] END"


@query(
    f"""WITH q AS (SELECT *, {OPTIONS} AS options, CASE CAST(size % 3 AS INT) WHEN 0 THEN 'SCS' WHEN 1 THEN 'MCS' ELSE 'BOV' END AS sel FROM [grid] g),
  s AS (SELECT *, len(options) > 0 AS has_options, CASE WHEN id % 2 = 0 THEN ['A', 'B', 'C'] ELSE ['1', '2', '3'] END AS labels FROM q)
SELECT id, CASE WHEN size % 5 > 0 THEN 'You judge ' || dataset_id || '.' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN prompt_mode = 'io' THEN {quoted(prompts.DIRECT)} WHEN has_options AND sel = 'BOV' THEN {quoted(prompts.STEPS.format(prompts.ONE))} ELSE {quoted(prompts.STEPS.format(prompts.MANY))} END
    || chr(10) || chr(10) || CASE WHEN prompt_mode = 'io' THEN {quoted(prompts.ANSWER_ONLY)} ELSE {quoted(prompts.THINK_FIRST)} END AS system,
  'Observation:' || chr(10) || kind || chr(10) || chr(10) || CASE WHEN id % 4 > 0 THEN '' WHEN has_options AND sel = 'BOV' THEN 'The question being asked of the candidates:' || chr(10) || 'Why?' || chr(10) || chr(10) ELSE 'Question: Why?' || chr(10) || chr(10) END
    || CASE WHEN size % 2 = 0 THEN 'Requirements:' || chr(10) || '- one line' || chr(10) || '- no ' || model_id || chr(10) || chr(10) ELSE '' END
    || CASE WHEN NOT has_options THEN '' WHEN sel = 'BOV' THEN 'Hypothesis under consideration:' || chr(10) || name || chr(10) || chr(10)
      ELSE 'Candidate hypotheses:' || chr(10) || labels[1] || '. ' || name || chr(10) || labels[2] || '. ' || kind || chr(10) || labels[3] || '. neither' || chr(10) || chr(10) END
    || CASE WHEN NOT has_options THEN 'Give your answer.' WHEN sel = 'BOV' THEN replace({quoted(prompts.YES_OR_NO)}, chr(123) || chr(125), CASE WHEN id % 4 = 0 THEN 'answers that question' ELSE 'explains the observation' END)
      WHEN sel = 'MCS' THEN replace({quoted(prompts.SEVERAL)}, chr(123) || chr(125), CASE WHEN id % 2 = 0 THEN 'letters' ELSE 'numbers' END)
      ELSE replace({quoted(prompts.EXACTLY_ONE)}, chr(123) || chr(125), labels[1] || ', ' || labels[2] || ' or ' || labels[3]) END AS user,
  CASE WHEN NOT has_options THEN 'free_form' WHEN sel = 'BOV' THEN 'binary' WHEN sel = 'MCS' THEN 'multi_label' ELSE 'single_label' END AS style
FROM s"""
)
def static_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Requests of every prompt and selection mode, with and without options, questions, demands and letters."""
    words = "array<string>"
    options = F.when(F.col("size") % 7 == 0, F.array().cast(words)).otherwise(F.array("name", "kind", F.lit("neither")))
    selection = F.when(F.col("size") % 3 == 0, "SCS").when(F.col("size") % 3 == 1, "MCS").otherwise("BOV")
    parts = {
        "system": F.when(F.col("size") % 5 > 0, F.concat(F.lit("You judge "), "dataset_id", F.lit("."))), "observation": F.col("kind"), "question": F.when(F.col("id") % 4 == 0, "Why?"),
        "requirements": F.when(F.col("size") % 2 == 0, F.array(F.lit("one line"), F.concat(F.lit("no "), "model_id"))), "options": options, "labels": F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, "ABC"))),
    }
    g = fixture(spark, d, "grid").withColumns({"m": prompts.static_messages(parts, F.col("prompt_mode"), selection), "style": prompts.answer_style(selection, options)})
    return g.select("id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user"), "style")


@query(
    f"""SELECT id, CASE WHEN size % 3 = 0 THEN 1 ELSE 2 END AS n, 'Background:' || chr(10) || name || chr(10) || chr(10) || 'Task: find it' || chr(10) || chr(10)
    || CASE WHEN size % 2 = 0 THEN 'Available actions:' || chr(10) || '- ask: about ' || kind || chr(10) || '- stop: end' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN prompt_mode = 'io' THEN {quoted(prompts.DIRECT)} ELSE {quoted(prompts.STEPS.format(prompts.MANY))} END || chr(10) || chr(10) || 'One action a turn.' AS user FROM [grid] g"""
)
def protocol_prompts(spark: SparkSession, d: str) -> DataFrame:
    action = lambda name, what: F.struct(F.lit(name).alias("name"), what.alias("what"))
    actions = F.when(F.col("size") % 2 == 0, F.array(action("ask", F.concat(F.lit("about "), "kind")), action("stop", F.lit("end"))))
    parts = {"system": F.when(F.col("size") % 3 > 0, F.col("dataset_id")).otherwise("  "), "context": F.col("name"), "instructions": F.lit("find it"), "actions": actions, "output_format": F.lit("One action a turn.\n")}
    g = fixture(spark, d, "grid").withColumn("m", prompts.protocol_messages(parts, F.col("prompt_mode")))
    return g.select("id", F.size("m").alias("n"), F.try_element_at("m", F.lit(-1))["content"].alias("user"))


@query("""SELECT id, CASE WHEN size % 2 = 0 THEN 2 ELSE 1 END AS n, 'Case ' || id || ': ' || name || ', ' || size || ' at the most.' AS last FROM [grid] g""")
def rendered_templates(spark: SparkSession, d: str) -> DataFrame:
    """Messages with places for fields; one that renders to nothing is left out."""
    template = [{"role": "system", "content": " {{ rule }} "}, {"role": "user", "content": "Case {{id}}: {{ name }}, {{size}} at the most.{{ note }}\n"}]
    fields = {"rule": F.when(F.col("size") % 2 == 0, F.col("kind")), "id": F.col("id"), "name": F.col("name"), "size": F.col("size")}
    g = fixture(spark, d, "grid").withColumn("m", prompts.rendered(template, fields, required=("id",), optional=("note",)))
    return g.select("id", F.size("m").alias("n"), F.try_element_at("m", F.lit(-1))["content"].alias("last"))


@query(
    """SELECT id, CASE WHEN size % 2 = 0 THEN 'Options:' || chr(10) || '1. ' || name || ' (first)' || chr(10) || '2. ' || kind || CASE WHEN size % 4 = 0 THEN chr(10) || '3. ' || upper(model_id) ELSE '' END || chr(10)
    ELSE CASE WHEN size % 3 = 0 THEN 'A third of ' || size || '.' ELSE 'Neither.' END || chr(10) END || 'Mode ' || CASE WHEN prompt_mode IN ('cot', 'other') AND NOT (size = 7) THEN 'reasons' ELSE 'answers' END || '; n=' || size AS user FROM [grid] g"""
)
def templates_with_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A loop over an array, with conditions inside it and around it."""
    body = """{# options, if there are any #}
    {% if options %}
Options:
    {% for o in options %}
{{ loop.index }}. {% if o.loud %}{{ o.name | upper }}{% else %}{{ o.name }}{% endif %}{% if loop.first %} (first){% endif %}

    {% endfor %}
    {% elif third %}
A third of {{ size }}.
    {% else %}
Neither.
    {% endif %}
Mode {% if mode in ways and not size == 7 %}reasons{% else %}answers{% endif %}; n={{ size }}"""
    option = lambda c, loud: F.struct(F.col(c).alias("name"), F.lit(loud).alias("loud"))
    options = F.when(F.col("size") % 4 == 0, F.array(option("name", False), option("kind", False), option("model_id", True))).when(F.col("size") % 2 == 0, F.array(option("name", False), option("kind", False)))
    fields = {"options": options, "third": F.col("size") % 3 == 0, "size": F.col("size"), "mode": F.col("prompt_mode"), "ways": F.array(F.lit("cot"), F.lit("other"))}
    g = fixture(spark, d, "grid").withColumn("m", prompts.rendered([{"role": "user", "content": body}], fields))
    return g.select("id", F.col("m")[0]["content"].alias("user"))


# ---------------------------------------------------------------- judges and notation


@query(
    """SELECT id, CASE WHEN id % 6 IN (0, 1, 2) THEN size END AS k, CASE WHEN id % 6 IN (0, 1, 2) THEN name END AS first FROM [grid] g"""
)
def judge_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects in fences, in prose after an echoed example, and behind a stray brace; wrong types, missing fields and prose alone give none."""
    body = F.concat(F.lit('{"steps": ["'), "name", F.lit('", " b "], "k": '), F.col("size").cast("string"), F.lit("}"))
    said = (
        F.when(F.col("id") % 6 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("id") % 6 == 1, F.concat(F.lit('As in {"steps": ["x"], "k": 0}: '), body, F.lit(" I think")))
        .when(F.col("id") % 6 == 2, F.concat(F.lit("a stray { then "), body)).when(F.col("id") % 6 == 3, F.lit('{"steps": 42, "k": 1}')).when(F.col("id") % 6 == 4, F.lit('{"steps": ["a"]}')).otherwise("steps: none")
    )
    g = fixture(spark, d, "grid").withColumn("o", judging.verdict_object(said, {"steps": "list_of_strings", "k": "nonnegative_integer"}))
    return g.select("id", F.get_json_object("o", "$.k").cast("int").alias("k"), F.get_json_object("o", "$.steps[0]").alias("first"))


@query(
    """SELECT id, CASE CAST(id % 5 AS INT) WHEN 0 THEN '((' || size || ')/(x))' WHEN 1 THEN '((((' || size || ')**0.5) a)/(b))' WHEN 2 THEN 'alpha_1 * x**2' WHEN 3 THEN 'atan(pi*' || size || ')' ELSE 'lambda_ + t_prime' END AS plain FROM [grid] g"""
)
def math_notation(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("size").cast("string")
    said = (
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("$y = \\frac{"), n, F.lit("}{x}$."))).when(F.col("id") % 5 == 1, F.concat(F.lit("\\dfrac{\\sqrt{"), n, F.lit("} a}{b}")))
        .when(F.col("id") % 5 == 2, F.lit("`α₁ · x²`")).when(F.col("id") % 5 == 3, F.concat(F.lit("np.arctan(\\pi\\cdot"), n, F.lit("))"))).otherwise("\\lambda + t'")
    )
    return spread(fixture(spark, d, "grid")).select("id", notation.plain_math(said).alias("plain"))


@query("""SELECT id, 'a,' || model_id AS variables, CASE WHEN size % 2 = 0 THEN 'x - ' || size || '|y' ELSE '' END AS equations, 's*m' AS units FROM [grid] g""")
def system_files(spark: SparkSession, d: str) -> DataFrame:
    equations = F.when(F.col("size") % 2 == 0, F.concat(F.lit("\n x - "), F.col("size").cast("string"), F.lit("\n\ny"))).otherwise("")
    said = F.concat(F.lit("lost\nVariables: ['a', '"), "model_id", F.lit("']\nEquations:"), equations, F.lit("\nUnits of measure: lost\nlost too\nUnits of Measure of Equations:\ns*m\n"))
    g = spread(fixture(spark, d, "grid")).withColumn("s", notation.system_sections(said))
    return g.select("id", *[F.array_join(F.col("s")[k], sep).alias(name) for k, sep, name in (("variables", ",", "variables"), ("equations", "|", "equations"), ("units_equations", "|", "units"))])


# ---------------------------------------------------------------- folds of groups


@query(
    """WITH m AS (SELECT item, count(*) AS n, list(prediction || pos ORDER BY pos) FILTER (ok) AS sel, avg(ok::INT) AS rate FROM [items] i WHERE item % 3 > 0 GROUP BY item), s AS (SELECT *, coalesce(sel, []) AS got FROM m),
  f AS (SELECT *, len(list_intersect(got, ['N1', 'N2'])) AS o FROM s)
SELECT item::VARCHAR AS sample_id, CASE WHEN len(got) = 0 THEN 'none' ELSE array_to_string(got, ', ') END AS prediction, (o = 2 AND len(got) = 2)::INT::DOUBLE AS score, true AS reduced, n AS n_members, CASE WHEN len(got) = 0 THEN 0.0 ELSE round(2.0 * o / (len(got) + 2), 9) END AS set_f1, round(rate, 9) AS bov_yes_rate FROM f
UNION ALL SELECT item || '#' || pos, prediction, score::DOUBLE, false, 1, NULL, NULL FROM [items] i WHERE item % 3 = 0"""
)
def reduced_options(spark: SparkSession, d: str) -> DataFrame:
    """Items asked option by option, folded into a set that the scorer of sets scores; other rows pass."""
    i = fixture(spark, d, "items")
    group = F.when(F.col("item") % 3 > 0, F.col("item").cast("string")).otherwise("")
    rows = i.select(F.concat_ws("#", "item", "pos").alias("sample_id"), group.alias("group_id"), "pos", "prediction", F.col("parsed").alias("parse_ok"), F.col("score").cast("double").alias("score"), F.col("ok").alias("yes"), F.col("pos").alias("bov_index"), F.concat("prediction", F.col("pos").cast("string")).alias("bov_label"), F.array(F.lit("N1"), F.lit("N2")).alias("gold_labels"))
    out = folds.reduce_groups(rows, "io", "BOV")
    return out.withColumns({c: F.round(c, 9) for c in ("set_f1", "bov_yes_rate")})


@query(
    """WITH v AS (SELECT item, prediction, count(*) AS n, min(pos) AS first, arg_min(score, pos) AS score, parsed FROM [items] i GROUP BY item, prediction, parsed),
  w AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY parsed DESC, CASE WHEN parsed THEN n ELSE 0 END DESC, first) AS r, sum(n) OVER (PARTITION BY item) AS members FROM v)
SELECT item::VARCHAR AS sample_id, prediction, score::DOUBLE AS score, true AS reduced, members::BIGINT AS n_members FROM w WHERE r = 1"""
)
def reduced_votes(spark: SparkSession, d: str) -> DataFrame:
    i = fixture(spark, d, "items")
    rows = i.select(F.concat_ws("#", "item", "pos").alias("sample_id"), F.col("item").cast("string").alias("group_id"), "pos", "prediction", F.col("parsed").alias("parse_ok"), "score")
    return folds.reduce_groups(rows, "self-consistency", "n/a").select("sample_id", "prediction", "score", "reduced", "n_members")


# ---------------------------------------------------------------- stored runs and episodes


@query(
    """WITH s AS (SELECT o_orderkey // 3 AS sample, o_orderkey AS k FROM orders WHERE o_orderkey % 4 < 3), l AS (SELECT sample, max(k) AS k FROM s GROUP BY sample)
SELECT 's' || sample AS sample_id, 'user' AS role, 'ask ' || k AS content FROM l UNION ALL SELECT 't' || sample, 'user', 'other' FROM (SELECT DISTINCT o_orderkey // 3 AS sample FROM orders WHERE o_orderkey % 4 = 0)"""
)
def stored_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Batches, single requests and broken payloads; the last of several counts."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 3).cast("string").alias("s"))
    own = F.concat(F.lit('{"content": "ask '), F.col("k").cast("string"), F.lit('"}'))
    batch = F.concat(F.lit('{"request": {"sample_ids": ["s'), "s", F.lit('", "t'), "s", F.lit('"], "messages": [['), own, F.lit('], [{"role": "user", "content": "other"}]]}}'))
    single = F.concat(F.lit('{"request": {"sample_ids": ["s'), "s", F.lit('"], "messages": [['), own, F.lit("]]}}"))
    alone = F.concat(F.lit('{"request": {"sample_ids": ["s'), "s", F.lit('"], "messages": ['), own, F.lit(', {"role": "assistant", "content": "x"}]}}'))
    body = F.when(F.col("k") % 4 == 0, batch).when(F.col("k") % 4 == 1, single).when(F.col("k") % 4 == 2, alone).otherwise('{"request": {"sample_ids": ["s1", "s2"], "messages": [')
    out = episodes.stored_conversations(o.select(F.lpad(F.col("k").cast("string"), 12, "0").alias("path"), body.alias("body")))
    return out.select("sample_id", F.col("messages")[0]["role"].alias("role"), F.col("messages")[0]["content"].alias("content"))


@query("SELECT r AS recover, h AS hops, i::INTEGER AS index, left(sha256('7::' || r || '::' || h || '::' || i), 16) AS item_seed FROM (SELECT DISTINCT kind AS r, size % 4 + 1 AS h FROM [grid] g), range(40) t(i)")
def synthetic_grid(spark: SparkSession, d: str) -> DataFrame:
    return episodes.synthetic_grid(fixture(spark, d, "grid").select(F.col("kind").alias("recover"), (F.col("size") % 4 + 1).alias("hops")), 40, "7")


@query(
    """WITH c AS (SELECT item AS episode, prediction AS category, unnest(['p' || pos, 'p' || pos || '.x', 'p' || pos || '.y', 'p' || pos || '.y.z']) AS key FROM [items] i),
  a AS (SELECT item AS episode, pos AS turn, prediction AS category, ['p' || (pos - 1) || '.x', 'p' || pos || '.x', 'none'] AS keys FROM [items] i),
  w AS (SELECT DISTINCT a.episode, a.turn, a.category, regexp_replace(w.key, '\\.[^.]*$', '') AS parent FROM (SELECT *, unnest(keys) AS key FROM a) w JOIN a USING (episode, turn) JOIN c ON c.episode = w.episode AND c.category = w.category AND c.key = w.key),
  s AS (SELECT DISTINCT w.episode, w.turn, w.category, c.key FROM w JOIN c ON c.episode = w.episode AND c.category = w.category AND (c.key = w.parent OR (starts_with(c.key, w.parent || '.') AND NOT contains(substr(c.key, length(w.parent) + 2), '.')))),
  f AS (SELECT *, turn = min(turn) OVER (PARTITION BY episode, category, key) AS fresh FROM s),
  t AS (SELECT episode, turn, array_to_string(list_sort(list(DISTINCT key)), ',') AS shown, count(*) FILTER (fresh) AS fresh FROM f GROUP BY 1, 2)
SELECT a.episode, a.turn, coalesce(shown, '') AS shown, coalesce(fresh, 0) AS fresh, sum(coalesce(fresh, 0)) OVER (PARTITION BY a.episode ORDER BY a.turn)::BIGINT AS n_revealed FROM a LEFT JOIN t USING (episode, turn)"""
)
def disclosed_findings(spark: SparkSession, d: str) -> DataFrame:
    """What each turn's request disclosed of its case, and how much of it was new."""
    i = fixture(spark, d, "items").select(F.col("item").alias("episode"), F.col("pos").alias("turn"), F.col("prediction").alias("category"))
    p = lambda n: F.concat(F.lit("p"), n.cast("string"))
    here, before = p(F.col("turn")), p(F.col("turn") - 1)
    case = i.select("episode", "category", F.explode(F.array(here, *[F.concat(here, F.lit(s)) for s in (".x", ".y", ".y.z")])).alias("key"))
    asks = i.withColumn("keys", F.array(F.concat(before, F.lit(".x")), F.concat(here, F.lit(".x")), F.lit("none")))
    return episodes.disclosed(asks, case).withColumn("shown", F.array_join("shown", ","))


@query(
    """WITH e AS (SELECT item, list(prediction ORDER BY pos) AS p, list(pos ORDER BY pos) AS ps FROM [items] i GROUP BY item)
SELECT item, array_to_string(list_transform(range(len(p)), lambda k: CASE WHEN k % 3 = 0 AND item % 2 = 0 THEN '1' ELSE '0' END), ',') AS correct,
  array_to_string(list_transform(range(len(p)), lambda k: CASE WHEN k = 1 AND item % 2 = 0 THEN '0' WHEN p[k + 1] = p[-1] THEN '1' ELSE '-' END), ',') AS matches, (len(p) - CASE WHEN item % 2 = 0 THEN len(p) ELSE 0 END)::INTEGER AS missing FROM e"""
)
def turn_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Gold verdicts on all turns of even items, and a final verdict on their second."""
    i = fixture(spark, d, "items")
    e = i.groupBy(F.col("item").alias("sample_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prediction"))), lambda x: x["prediction"]).alias("predictions"))
    even = i.where("item % 2 = 0").select(F.col("item").alias("sample_id"), (F.col("pos") - 1).alias("at"))
    verdicts = even.select("sample_id", F.lit("gold").alias("asks"), "at", (F.col("at") % 3 == 0).alias("positive")).unionByName(even.where("at = 1").select("sample_id", F.lit("final").alias("asks"), "at", F.lit(False).alias("positive")))
    out = episodes.turn_verdicts(e, verdicts)
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",", "-")
    return out.select(F.col("sample_id").alias("item"), shown("turn_correct").alias("correct"), shown("turn_matches_final").alias("matches"), F.col("turn_verdicts_missing").alias("missing"))


@query("""SELECT CASE WHEN size > 40 THEN 'long' ELSE 'short' END AS filter, id, price, left(name, 20) || CASE WHEN size % 2 = 0 THEN ' | ' || kind || ' | c' ELSE '' END AS first_steps FROM [grid] g WHERE size > 40 OR size < 5""")
def hit_frame(spark: SparkSession, d: str) -> DataFrame:
    g = fixture(spark, d, "grid").withColumn("reasoning_steps", F.when(F.col("size") % 2 == 0, F.array("name", "kind", F.lit("c"), F.lit("d"))).otherwise(F.array("name")))
    hits = g.where("size > 40 OR size < 5").select(F.when(F.col("size") > 40, "long").otherwise("short").alias("filter"), "id")
    return episodes.hits_frame(g, hits, "id", ["price"], width=20)


@query()
def bm25_within_records(spark: SparkSession, d: str) -> DataFrame:
    """For each item the three best of its own documents by stemmed terms without stop words; statistics are the whole inventory's."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    n = items.count()
    numbered = items.select("item_id", "text").withColumn("k", F.pmod("item_id", F.lit(max(n, 1))))
    own = docs.select("doc_id", F.pmod("doc_id", F.lit(max(n, 1))).alias("k")).join(numbered.select("item_id", "k"), "k").select("item_id", "doc_id")
    return retrieval.bm25_topk(items, docs, "item_id", "doc_id", "text", 3, stop=retrieval.STOP_WORDS, stem=True, allowed=own).withColumn("score", F.round("score", 7))


# ---------------------------------------------------------------- documents


@query(
    r"""WITH m AS (SELECT dataset_id, round(avg(price) FILTER (model_id = 'alpha') / 100, 1)::DOUBLE AS a, round(avg(price) FILTER (model_id = 'beta') / 100, 1)::DOUBLE AS b FROM [grid] g GROUP BY dataset_id), t AS (SELECT *, greatest(a, b) AS top, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END AS mean FROM m)
SELECT dataset_id, dataset_id || ' & ' || CASE WHEN a IS NULL THEN '--' WHEN a = top THEN '\textbf' || chr(123) || printf('%.1f', a) || '}' ELSE printf('%.1f', a) END || ' & ' || CASE WHEN b IS NULL THEN '--' WHEN b = top THEN '\textbf' || chr(123) || printf('%.1f', b) || '}' ELSE printf('%.1f', b) END
  || '$_' || chr(123) || '\pm0.5}$ & ' || CASE WHEN mean IS NULL THEN '--' ELSE printf('%.1f', mean) END || ' \\' AS line FROM t WHERE b IS NOT NULL"""
)
def latex_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a results table: the best in bold, an error beside one column, the row's mean."""
    g = fixture(spark, d, "grid")
    wide = g.groupBy("dataset_id").agg(*[F.round(F.avg(F.when(F.col("model_id") == m, F.col("price"))) / 100, 1).alias(n) for m, n in (("alpha", "a"), ("beta", "b"))]).where("b IS NOT NULL").withColumn("e", F.lit(0.5))
    return reports.latex_rows(wide, ["dataset_id"], ["a", "b"], {"b": "e"})


@query(
    """SELECT dataset_id, '# ' || dataset_id || chr(10) || chr(10) || '* **n**: ' || count(*) || chr(10) || chr(10) || '## Metrics' || chr(10) || chr(10) || CASE WHEN max(size) < 20 THEN '_No metrics were produced._' ELSE '| metric | value |' || chr(10) || '|---|---|' || chr(10) || '| `lo` | ' || (min(size)::DOUBLE) || ' |' || chr(10) || '| `top`'
  || ' **(primary)**' || ' | ' || (max(size)::DOUBLE) || ' |' END AS document FROM [grid] g GROUP BY dataset_id"""
)
def task_documents(spark: SparkSession, d: str) -> DataFrame:
    facts = fixture(spark, d, "grid").groupBy("dataset_id").agg(F.count("*").alias("n"), F.max("size").cast("double").alias("top"), F.min("size").cast("double").alias("lo"), F.lit("top").alias("primary_metric"))
    metrics = facts.where("top >= 20").unpivot(["dataset_id"], ["top", "lo"], "metric", "value")
    return reports.task_documents(metrics, facts, ["dataset_id"], ["n"])


# ---------------------------------------------------------------- all datasets

NAMES = sorted(datasets.PLANS)
FAMILY = {name: plan.scorer.__name__ for name, plan in datasets.PLANS.items()}
STRATA = {"variant": ("original", "mirrored"), "popularity": ("head", "longtail"), "level": ("100", "50")}
OTHER = ("a", "B c")


def _labels(name: str) -> tuple[str, str]:
    return STRATA.get(name, OTHER)


def _slug(label: str) -> str:
    return label.lower().replace(" ", "_")


_PLANS = ", ".join(f"({k}, '{n}', '{datasets.PLANS[n].primary}', '{FAMILY[n]}')" for k, n in enumerate(NAMES))
_STRATA = ", ".join(f"('{n}', '{_slug(_labels(s)[0])}', '{_slug(_labels(s)[1])}')" for n in NAMES for s in datasets.PLANS[n].strata)
_GAPS = ", ".join(f"('{n}', '{g}', '{a}', '{b}')" for n in NAMES for g, (a, b) in datasets.PLANS[n].gaps.items())
_BALANCED = ", ".join(f"('{n}', '{g}', '{prefix}')" for n in NAMES for g, prefix in datasets.PLANS[n].balanced.items())


@query(
    f"""WITH p(k, dataset_id, prim, family) AS (VALUES {_PLANS}), st(dataset_id, one, two) AS (VALUES {_STRATA}), gaps(dataset_id, name, a, b) AS (VALUES {_GAPS}), bal(dataset_id, name, prefix) AS (VALUES {_BALANCED}),
  r AS (SELECT o_orderkey AS id, p.dataset_id, prim, family, o_orderkey % 3 = 0 AS hit, o_orderkey // 44 % 2 = 0 AS one, CASE WHEN o_orderkey % 2 = 0 THEN least(o_orderkey % 60 / 40.0, 1.0) ELSE (o_orderkey % 3 = 0)::INT::DOUBLE END AS verdict FROM orders JOIN p ON p.k = o_orderkey % {len(NAMES)}),
  v AS (SELECT *, CASE family WHEN 'judged' THEN verdict WHEN 'multi_selection' THEN CASE WHEN hit THEN 1.0 ELSE 2.0 / 3 END ELSE hit::INT::DOUBLE END AS v FROM r),
  m AS (SELECT dataset_id, prim AS metric, one, v FROM v
    UNION ALL SELECT dataset_id, metric, one, v FROM (SELECT DISTINCT v.id, v.dataset_id, prim || '_' || CASE WHEN v.one THEN st.one ELSE st.two END AS metric, v.one, v.v FROM v JOIN st USING (dataset_id)) q
    UNION ALL SELECT dataset_id, prim || '_lenient', one, 1.0 FROM v WHERE family = 'contained'
    UNION ALL SELECT dataset_id, 'premise_f1', one, CASE WHEN hit THEN 1.0 ELSE 2.0 / 3 END FROM v WHERE family = 'number_set' UNION ALL SELECT dataset_id, 'premise_count_match', one, hit::INT::DOUBLE FROM v WHERE family = 'number_set'
    UNION ALL SELECT dataset_id, x, one, hit::INT::DOUBLE FROM v, (SELECT unnest(['match', 'exact_match', 'token_f1', 'rouge_l']) AS x) WHERE family = 'free_text' AND x <> prim
    UNION ALL SELECT dataset_id, 'exact_set', one, hit::INT::DOUBLE FROM v WHERE family = 'multi_selection' UNION ALL SELECT dataset_id, 'set_precision', one, 1.0 FROM v WHERE family = 'multi_selection'
    UNION ALL SELECT dataset_id, 'set_recall', one, CASE WHEN hit THEN 1.0 ELSE 0.5 END FROM v WHERE family = 'multi_selection' UNION ALL SELECT dataset_id, 'n_selected', one, CASE WHEN hit THEN 2.0 ELSE 1.0 END FROM v WHERE family = 'multi_selection'),
  means AS (SELECT dataset_id, metric, avg(v) AS value, count(*) AS n FROM m GROUP BY 1, 2),
  derived AS (SELECT g.dataset_id, g.name, x.value - y.value AS value, x.n + y.n AS n FROM gaps g JOIN means x ON x.dataset_id = g.dataset_id AND x.metric = g.a JOIN means y ON y.dataset_id = g.dataset_id AND y.metric = g.b
    UNION ALL SELECT b.dataset_id, b.name, avg(value), sum(n)::BIGINT FROM bal b JOIN means ON means.dataset_id = b.dataset_id AND starts_with(metric, prefix) GROUP BY 1, 2)
SELECT dataset_id, metric, round(value, 9) AS value, n FROM (SELECT * FROM means UNION ALL SELECT * FROM derived) q"""
)
def library_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every dataset's plan over a table of all their replies: scores, strata, gaps and balanced means."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, F.try_element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int")).alias("dataset_id"))
    hit, one = k % 3 == 0, F.floor(k / 44) % 2 == 0
    family = lambda name: F.col("dataset_id").isin(*[n for n in NAMES if FAMILY[n] == name])
    said = lambda yes, no: F.when(hit, yes).otherwise(no)
    content = (
        F.when(family("selection"), said("Answer: B", "Answer: C")).when(family("multi_selection"), said("Answer: A, C", "Answer: A")).when(family("number_set"), said("Answer: 3 7", "Answer: 3"))
        .when(family("contained"), said("Answer: pod memory", "pod-memory? Answer: disk")).when(family("free_text"), said("Answer: Red fox", "Answer: blue")).otherwise("Answer: x")
    )
    gold = F.when(family("selection"), "b ").when(family("contained"), "pod_memory").otherwise("red fox")
    labels = F.when(family("number_set"), F.array(F.lit("3"), F.lit("7"))).otherwise(F.array(F.lit("A"), F.lit("C")))
    names = sorted({s for p in datasets.PLANS.values() for s in p.strata})
    strata = F.create_map(*[x for s in names for x in (F.lit(s), F.when(one, _labels(s)[0]).otherwise(_labels(s)[1]))])
    rows = rows.select(
        "dataset_id", content.alias("content"), gold.alias("gold"), labels.alias("gold_labels"), F.lit(None).cast("array<string>").alias("accepted"), strata.alias("strata"),
        F.when(hit, "yes").otherwise("no").alias("verdict_label"), F.when(k % 2 == 0, k % 60 / 40).alias("verdict_score"),
    )
    return datasets.aggregate_library(datasets.score_library(rows)).select("dataset_id", "metric", F.round("value", 9).alias("value"), "n")
