"""Queries of scalar functions: normalisation, matching, extraction, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import extract, stats, text, validators
from verdigris.plans.registry import fixture, query, spread, table

NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+', ' ', 'g'))"
WORDS = "list_filter(string_split(" + NORM + ", ' '), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))"


def norm(x: str) -> str:
    return NORM.format(x=x)


def words(x: str) -> str:
    return WORDS.format(x=x)


def _sql(template: str, **parts: str) -> str:
    for name, value in parts.items():
        template = template.replace(f"<{name}>", value)
    return template


@query(_sql("SELECT id, md5(<np>) AS norm, length(<np>) AS n FROM [pairs] q", np=norm("coalesce(p, '')")))
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """All documents, marks folded."""
    n = text.normalize_text(F.col("p"))
    return fixture(spark, d, "pairs").select("id", F.md5(n).alias("norm"), F.length(n).cast("bigint").alias("n"))


@query(_sql("SELECT id, md5(coalesce(list_aggregate(<wp>, 'string_agg', ' '), '')) AS norm, len(<wp>) AS n FROM [pairs] q", wp=words("coalesce(p, '')")))
def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    """All documents, marks folded; one without a word has an empty answer."""
    w = text.tokens(F.col("p"))
    return fixture(spark, d, "pairs").select("id", F.md5(F.array_join(w, " ")).alias("norm"), F.size(w).cast("bigint").alias("n"))


@query()
def normalize_text_folded(spark: SparkSession, d: str) -> DataFrame:
    """The full form over all documents; marks are folded in an Arrow function, so there is no SQL for it."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"), full=True)).alias("norm"))


@query(
    _sql(
        """SELECT id, (<a> = <b>)::DOUBLE AS exact, (contains(<a>, <b>) AND <b> <> '')::DOUBLE AS contains
FROM (SELECT id, name || ' the ' || kind AS p, CASE WHEN id % 3 = 0 THEN 'A ' || upper(name) || '-' || kind ELSE name END AS r FROM [grid] g) q""",
        a="coalesce(list_aggregate(" + words("p") + ", 'string_agg', ' '), '')",
        b="coalesce(list_aggregate(" + words("r") + ", 'string_agg', ' '), '')",
    )
)
def exact_and_contains_match(spark: SparkSession, d: str) -> DataFrame:
    g = fixture(spark, d, "grid").selectExpr("id", "name || ' the ' || kind AS p", "CASE WHEN id % 3 = 0 THEN 'A ' || upper(name) || '-' || kind ELSE name END AS r")
    return g.select("id", text.exact_match(F.col("p"), F.col("r"), True).alias("exact"), text.contains_match(F.col("p"), F.col("r"), True).alias("contains"))


@query(
    _sql(
        """WITH q AS (SELECT id, <wp> AS p, <wr> AS r FROM [pairs] q),
     c AS (SELECT id, t, sum(a) AS a, sum(b) AS b FROM (SELECT id, unnest(p) AS t, 1 AS a, 0 AS b FROM q UNION ALL SELECT id, unnest(r), 0, 1 FROM q) GROUP BY id, t),
     o AS (SELECT id, sum(least(a, b))::DOUBLE AS o, sum(a)::DOUBLE AS np, sum(b)::DOUBLE AS nr FROM c GROUP BY id)
SELECT id, CASE WHEN o IS NULL THEN 1.0 WHEN np = 0 OR nr = 0 THEN (np = nr)::DOUBLE WHEN o = 0 THEN 0.0 ELSE round(o / np, 9) END AS "precision",
       CASE WHEN o IS NULL THEN 1.0 WHEN np = 0 OR nr = 0 THEN (np = nr)::DOUBLE WHEN o = 0 THEN 0.0 ELSE round(o / nr, 9) END AS recall,
       CASE WHEN o IS NULL THEN 1.0 WHEN np = 0 OR nr = 0 THEN (np = nr)::DOUBLE WHEN o = 0 THEN 0.0 ELSE round(2 * (o / np) * (o / nr) / (o / np + o / nr), 9) END AS f1 FROM q LEFT JOIN o USING (id)""",
        wp=words("coalesce(p, '')"),
        wr=words("coalesce(r, '')"),
    )
)
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    """All documents, marks folded; a pair without a word on either side scores 1."""
    q = fixture(spark, d, "pairs")
    return q.select("id").join(_token_f1(q, ascii_only=False), "id", "left").fillna(1.0)


def _token_f1(q: DataFrame, ascii_only: bool) -> DataFrame:
    """Both texts lie in one row, so their words are counted there and nothing is shuffled."""
    prf = q.select("id", text.token_prf(F.col("p"), F.col("r"), ascii_only).alias("prf"))
    return prf.select("id", *[F.round(F.col("prf")[c], 9).alias(c) for c in ("precision", "recall", "f1")])


@query()
def rouge_and_bleu(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-L and BLEU of short answers; no SQL, as both walk tables of words."""
    g = spread(fixture(spark, d, "grid")).select("id", F.concat_ws(" ", "name", "kind", "dataset_id").alias("p"), F.concat_ws(" ", "name", "dataset_id").alias("r"))
    return g.select("id", text.rouge_l(F.col("p"), F.col("r"), ascii_only=True).alias("rouge"), F.round(text.bleu(F.col("p"), F.col("r"), ascii_only=True), 9).alias("bleu")).select("id", F.round("rouge.f", 9).alias("rouge_f"), "bleu")


SETS = """SELECT l_orderkey AS id, list_distinct(list(l_returnflag)) AS p, list_distinct(list(l_linestatus || '') FILTER (l_quantity > 10)) AS q,
                 list_distinct(list(CASE WHEN l_quantity > 25 THEN l_returnflag ELSE l_linestatus END)) AS g FROM lineitem GROUP BY 1"""


@query(
    f"""SELECT id, CASE WHEN len(list_distinct(list_concat(p, g))) = 0 THEN 1.0 ELSE round(len(list_intersect(p, g))::DOUBLE / len(list_distinct(list_concat(p, g))), 9) END AS jaccard,
       round(len(list_intersect(p, g))::DOUBLE / len(p), 9) AS "precision", round(len(list_intersect(p, g))::DOUBLE / len(g), 9) AS recall,
       CASE WHEN len(list_intersect(p, g)) = 0 THEN 0.0 ELSE round(2.0 * len(list_intersect(p, g)) / (len(p) + len(g)), 9) END AS f1 FROM ({SETS})"""
)
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("p"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))).alias("g"))
    prf = text.set_prf(F.col("p"), F.col("g"))
    return g.select("id", F.round(text.jaccard(F.col("p"), F.col("g")), 9).alias("jaccard"), *[F.round(prf[c], 9).alias(c) for c in ("precision", "recall", "f1")])


SPAN = r"""trim(regexp_replace(trim(regexp_replace(trim(CASE WHEN strpos(lower(c), 'answer:') > 0 THEN trim(regexp_replace(trim(regexp_replace(c, '(?is)^.*answer:', '')), '^:+', '')) ELSE c END), '^`+|`+$', '', 'g')), '^\*+|\*+$', '', 'g'))"""


@query(f"SELECT id, {SPAN} AS span FROM (SELECT id, trim(content) AS c FROM [replies] r) q")
def answer_span(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "replies").select("id", extract.answer_span(F.col("content"), prefix="Answer:").alias("span"))


@query(
    f"""SELECT id, upper(coalesce(nullif(regexp_extract(span, '(?i)^\\(?\\[?([A-E])\\)?\\]?\\s*[).:,-]?\\s*', 1), ''), nullif(regexp_extract(trim(content), '(?i)^\\(?\\[?([A-E])\\)?\\]?\\s*[).:,-]?\\s*', 1), ''),
  regexp_extract_all(content, '(?i)(?:answer|choice|option|label|select(?:ed)?)\\D{{0,20}}?\\b([A-E])\\b', 1)[-1],
  regexp_extract_all(content, '(?:^|[^A-Za-z0-9])\\(?([A-E])\\)?(?:$|[^A-Za-z0-9])', 1)[-1])) AS label
FROM (SELECT id, content, {SPAN} AS span FROM (SELECT id, content, trim(content) AS c FROM [replies] r) q)"""
)
def choice_label(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "replies").select("id", extract.choice_label(F.col("content"), ("A", "B", "C", "D", "E"), prefix="Answer:").alias("label"))


@query(
    """SELECT id, CASE WHEN k IN (0, 1) THEN x WHEN k = 2 THEN CASE WHEN x = 'A' THEN 'A' ELSE 'A,' || x END WHEN k = 3 THEN CASE WHEN x = 'C' THEN 'C' ELSE x || ',C' END WHEN k = 4 THEN '' WHEN k = 10 THEN 'B,D' END AS labels, k IN (5, 6, 7, 8, 9, 11) AS unreadable
FROM (SELECT id, id % 12 AS k, chr(CAST(65 + id % 5 AS INT)) AS x FROM [replies] r) q"""
)
def choice_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label sets of the answer line; null where unreadable.  The SQL goes by how the replies were made."""
    found = extract.choice_labels(F.col("content"), ("A", "B", "C", "D", "E"), prefix="Answer:")
    return fixture(spark, d, "replies").select("id", F.array_join(found, ",").alias("labels"), found.isNull().alias("unreadable"))


@query(r"SELECT id, try_cast(replace(nullif(regexp_extract(content, '-?\d[\d,]*\.?\d*(?:[eE][-+]?\d+)?', 0), ''), ',', '') AS DOUBLE) AS n FROM [replies] r")
def first_number(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "replies").select("id", extract.first_number(F.col("content")).alias("n"))


FIRST = rf"""regexp_replace(string_split_regex(lower(regexp_replace(trim(CASE WHEN {SPAN} = '' THEN right(c, 120) ELSE {SPAN} END), '^[*_`"'' .]+|[*_`"'' .]+$', '', 'g')), '\s+')[1], '^[.,;:!]+|[.,;:!]+$', '', 'g')"""


@query(
    f"""SELECT id, coalesce(w IN ('yes', 'true', 'correct', 'affirmative'), false) AS yes,
  coalesce(w IN ('yes', 'true', 'correct', 'affirmative', 'no', 'false', 'incorrect', 'negative'), false) AS parsed
FROM (SELECT id, {FIRST} AS w FROM (SELECT id, trim(content) AS c FROM [replies] r) q)"""
)
def yes_no_parse(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return fixture(spark, d, "replies").select("id", extract.said_yes(c).alias("yes"), extract.parsed_yes_or_no(c).alias("parsed"))


@query(
    """SELECT id, CASE WHEN trim(content) = '' THEN 'empty_reply' WHEN finish_reason = 'length' AND NOT contains(lower(content), '</answer>') THEN 'cut_off_before_answering' END AS reason
FROM [replies] r"""
)
def missing_answer(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "replies").select("id", extract.missing_answer(F.col("content"), F.col("finish_reason")).alias("reason"))


@query(
    r"""SELECT id, CASE WHEN id % 2 = 0 AND NOT (NOT contains(c, '<think>') AND reasoning <> '')
    THEN regexp_full_match(c, '(?s)<think>.*?</think>\s*<answer>.*?</answer>') AND len(string_split(c, '<answer>')) = 2 AND len(string_split(c, '<think>')) = 2
    ELSE regexp_full_match(c, '(?s)<answer>.*?</answer>') AND len(string_split(c, '<answer>')) = 2 AND NOT contains(c, '<think>') END AS complies
FROM (SELECT id, trim(content) AS c, reasoning FROM [replies] r) q"""
)
def format_compliance(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "replies").select("id", extract.format_compliance(F.col("content"), F.col("reasoning"), F.col("id") % 2 == 0).alias("complies"))


CLEANED = r"""regexp_replace(regexp_replace({x}, '(?s)<answer>.*?</answer>', '', 'g'), '(?i)</?\s*(?:think|answer|reasoning_chain|reasoning_trace)\s*>', '', 'g')"""


@query(
    f"""WITH t AS (SELECT id, contains(content, '<think>') AS tagged,
    trim({CLEANED.format(x="CASE WHEN contains(content, '<think>') THEN regexp_extract(content, '(?s)<think>[[:space:]]*(.*?)[[:space:]]*(?:</think>|$)', 1) ELSE '' END")}) AS v,
    trim({CLEANED.format(x="reasoning")}) AS n, trim({CLEANED.format(x="content")}) AS p FROM [replies] r),
  u AS (SELECT id, CASE WHEN regexp_matches(v, '\\w') THEN v ELSE '' END AS v, CASE WHEN regexp_matches(n, '\\w') THEN n ELSE '' END AS n, CASE WHEN NOT tagged AND regexp_matches(p, '\\w') THEN p ELSE '' END AS p FROM t)
SELECT id, CASE WHEN v <> '' THEN v WHEN n <> '' THEN n ELSE p END AS trace,
  CASE WHEN v <> '' THEN 'visible_cot' WHEN n <> '' THEN 'native_reasoning' WHEN p <> '' THEN 'untagged_prose' ELSE 'none' END AS source FROM u"""
)
def reasoning_trace(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, d, "replies").select("id", extract.reasoning_trace(F.col("content"), F.col("reasoning")).alias("t"))
    return rows.select("id", F.col("t.text").alias("trace"), F.col("t.source").alias("source"))


@query(
    r"""WITH t AS (SELECT id, 'Verdict: ' || CASE WHEN correct = 1 THEN 'Yes' ELSE 'no' END || ' Score: ' || CASE WHEN id % 5 = 0 THEN '1' || size ELSE (size % 11)::VARCHAR END AS c FROM [grid] g),
  s AS (SELECT id, lower(regexp_extract(c, '(?i)(?:verdict|label)\s*[:=]\s*\**\s*([A-Za-z_]+)', 1)) AS l, regexp_extract(c, '(?i)score\s*[:=]\s*(-?\d+)', 1)::DOUBLE AS s FROM t)
SELECT id, CASE WHEN s BETWEEN 0 AND 10 THEN l END AS label, CASE WHEN s BETWEEN 0 AND 10 THEN round(s / 10, 9) END AS score FROM s"""
)
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Verdict: "), F.when(F.col("correct") == 1, "Yes").otherwise("no"), F.lit(" Score: "), F.when(F.col("id") % 5 == 0, F.concat(F.lit("1"), F.col("size").cast("string"))).otherwise((F.col("size") % 11).cast("string")))
    v = extract.verdict(said, top=10)
    return fixture(spark, d, "grid").select("id", v["label"].alias("label"), F.round(v["score"], 9).alias("score"))


@query(
    """SELECT id, coalesce((CASE WHEN b = 0 THEN abs(a) <= 0.05 ELSE abs(a - b) / abs(b) <= 0.05 END), false)::DOUBLE AS matches,
  CASE WHEN a IS NULL THEN 1.0 ELSE round(power(least(1.0, greatest(0.0, a / 100)) - (id % 2), 2), 9) END AS brier
FROM (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE size::DOUBLE END AS a, (CASE WHEN id % 11 = 0 THEN 0 ELSE size + id % 3 END)::DOUBLE AS b FROM [grid] g)"""
)
def numeric_match(spark: SparkSession, d: str) -> DataFrame:
    g = fixture(spark, d, "grid").selectExpr("id", "CASE WHEN id % 7 = 0 THEN 'n/a' ELSE CAST(size AS STRING) END AS a", "CASE WHEN id % 11 = 0 THEN 0 ELSE size + id % 3 END AS b")
    p = (F.col("a").try_cast("double") / 100).cast("string")
    return g.select("id", stats.numeric_match(F.col("a"), F.col("b").cast("string")).alias("matches"), F.round(stats.brier(p, F.col("id") % 2), 9).alias("brier"))


@query(
    """SELECT item AS id, (list_contains(r[1:3], 'R'))::DOUBLE AS hits_at_3, CASE WHEN list_position(r, 'R') > 0 THEN round(1.0 / list_position(r, 'R'), 9) ELSE 0.0 END AS mrr
FROM (SELECT item, list(prediction ORDER BY pos) AS r FROM [items] i GROUP BY item)"""
)
def ranked_hits(spark: SparkSession, d: str) -> DataFrame:
    r = fixture(spark, d, "items").groupBy(F.col("item").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prediction"))), lambda x: x["prediction"]).alias("r"))
    return r.select("id", stats.hits_at_k(F.col("r"), F.lit("R"), 3).alias("hits_at_3"), F.round(stats.reciprocal_rank(F.col("r"), F.lit("R")), 9).alias("mrr"))


@query("SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE floor(length(text) / 3.6)::BIGINT + 1 END AS tokens FROM conversations")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", stats.token_estimate(F.col("text")).alias("tokens"))


@query(
    """SELECT id, greatest(512, floor(price)::BIGINT // 512 * 512) AS quantized, greatest(1, least(greatest(512, least(32000, w)::BIGINT // 512 * 512), 32000, greatest(w, 1)))::BIGINT AS budget
FROM (SELECT *, 4096 - size * 80 - floor(64 + 0.05 * size * 80)::BIGINT AS w FROM [grid] g)""".replace("", "")
)
def output_budget(spark: SparkSession, d: str) -> DataFrame:
    g = fixture(spark, d, "grid")
    return g.select("id", stats.quantize(F.floor("price")).alias("quantized"), stats.output_budget(F.lit(32_000), F.lit(4096), F.col("size") * 80).alias("budget"))


@query("SELECT id, left(regexp_replace(name || '-' || kind || '-' || dataset_id, '[^A-Za-z0-9._-]+', '_', 'g'), 120) AS stable_id, left(sha256(name), 16) AS stable_hash FROM [grid] g")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "grid").select("id", text.stable_id(F.col("name"), F.col("kind"), F.col("dataset_id")).alias("stable_id"), text.stable_hash(F.col("name")).alias("stable_hash"))


@query(
    """SELECT id, len(v) = n AND len(list_filter(v, lambda x: x NOT IN (0, 1))) = 0 AS is_binary, len(v) = n AND len(list_filter(v, lambda x: x NOT IN (-1, 0, 1))) = 0 AS is_ternary,
  len(v) = n AND len(list_filter(v, lambda x: x NOT IN (0, 0.5, 1))) = 0 AS is_directional, len(v) = n AND len(list_filter(v, lambda x: x < 0)) = 0 AS is_int_list
FROM (SELECT item AS id, list(((qty::INT % 4) - 1)::DOUBLE ORDER BY pos) AS v, CASE WHEN item % 9 = 0 THEN 3 ELSE count(*) END AS n FROM [items] i GROUP BY item)"""
)
def list_contracts(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list(F.struct("pos", "qty"))), lambda x: (x["qty"].cast("int") % 4 - 1).cast("double"))
    r = fixture(spark, d, "items").groupBy(F.col("item").alias("id")).agg(v.alias("v"), F.count("*").alias("c")).withColumn("n", F.when(F.col("id") % 9 == 0, 3).otherwise(F.col("c")))
    names = {"is_binary": "binary_list", "is_ternary": "ternary_list", "is_directional": "directionality_list", "is_int_list": "int_list"}
    return r.select("id", *[validators.satisfies(F.col("v"), F.lit(contract), F.col("n")).alias(name) for name, contract in names.items()])


@query("SELECT doc_id, array_to_string(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2), lambda w: left(w, 4))), ' ') IS NOT NULL AS ok, len(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2), lambda w: left(w, 4)))) AS n_tokens FROM documents")
def evidence_tokens(spark: SparkSession, d: str) -> DataFrame:
    from verdigris.operators.retrieval import evidence_tokens as tokens

    return table(spark, d, "documents").select("doc_id", F.lit(True).alias("ok"), F.size(tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query(
    """SELECT id, CASE WHEN s = 200 THEN 'ok' WHEN s = 429 THEN 'rate_limit' WHEN s IN (401, 403) THEN 'auth' WHEN s = 404 THEN 'invalid_request' WHEN b = 0 THEN 'context_length' WHEN s IN (400, 422) THEN 'invalid_request'
  WHEN s IN (408, 409, 425, 500, 504, 530) OR b = 1 THEN 'transient' ELSE 'unknown' END AS error_class
FROM (SELECT id, id % 4 AS b, list_value(200, 400, 401, 403, 404, 408, 409, 418, 422, 425, 429, 500, 504, 530)[1 + size % 14] AS s FROM [grid] g) q"""
)
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*[F.lit(s) for s in (200, 400, 401, 403, 404, 408, 409, 418, 422, 425, 429, 500, 504, 530)])
    g = fixture(spark, d, "grid").withColumn("s", F.element_at(codes, (F.col("size") % 14 + 1).cast("int")))
    body = F.when(F.col("id") % 4 == 0, F.lit("Please reduce the LENGTH")).when(F.col("id") % 4 == 1, F.lit("<h1>Bad Gateway</h1>")).when(F.col("id") % 4 == 2, F.lit("no"))
    return g.select("id", extract.error_class(F.col("s"), body).alias("error_class"))


@query("SELECT id, round(least(120.0, CASE WHEN limited THEN 20.0 ELSE 2.0 END * power(2, a - 1)), 9)::DOUBLE AS wait_s, round(least(120.0, CASE WHEN limited THEN 20.0 ELSE 2.0 END * power(2, a - 1)) * (0.7 + 0.6 * draw), 9)::DOUBLE AS wait_with_jitter_s FROM (SELECT id, 1 + size % 8 AS a, id % 3 = 0 AS limited, (id % 11) / 10.0 AS draw FROM [grid] g) q")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    attempt, error = F.col("size") % 8 + 1, F.when(F.col("id") % 3 == 0, "rate_limit").otherwise("transient")
    return fixture(spark, d, "grid").select("id", F.round(stats.backoff(attempt, error), 9).alias("wait_s"), F.round(stats.backoff(attempt, error, (F.col("id") % 11) / 10), 9).alias("wait_with_jitter_s"))
