"""The queries of this subpackage: op<N>_<name> applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.bpe import encode_documents
from verdigris.llm import licences, mixing, quality, toxicity
from verdigris.llm.centroids import cluster
from verdigris.llm.chat import perspectives
from verdigris.llm.common import held_out, table
from verdigris.llm.exact_dedup import exact_groups
from verdigris.llm.line_dedup import line_dedup
from verdigris.llm.ngram_join import ngram_components
from verdigris.llm.rolling import event_seconds, rolling_features
from verdigris.llm.token_counts import token_counts
from verdigris.llm.topk import exact_topk


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text they decode to."""
    coded = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renderings of every dialogue, with the masks as text: begin-end, and so on."""
    seen = perspectives(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["begin"].cast("string"), m["end"].cast("string"))), ",")
    return seen.select("conv_id", "speaker", "n_turns", "rendered", masks.alias("masks"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: paragraphs, those with a licence, the families found and the confirmed ones."""
    docs = table(spark, sf_dir, "documents")
    found = licences.licence_paragraphs(docs, licences.learn(docs))
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["family"]))), ",")
    sure = F.filter("hits", lambda h: h["confirmed"])
    return found.select("doc_id", "n_paragraphs", F.size("hits").cast("long").alias("n_licence"), names(F.col("hits")).alias("families"), names(sure).alias("confirmed"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", toxicity.rejected(F.col("score")).alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)


def op13_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rolling_features(table(spark, sf_dir, "documents"), event_seconds(F.col("doc_id")), F.char_length("text"), (600, 43200))
    names = {"sum_value": "sum_chars", "n_kinds": "n_langs", "rank_0": "median_chars", "rank_1": "high_chars"}
    return found.withColumnsRenamed(names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe_round_trip, op2_chat_perspectives, op3_exact_dedup, op4_source_mix, op5_ngram_join, op6_licences, op7_toxicity, op8_quality, op9_line_dedup, op10_exact_topk, op11_token_counts, op12_centroid_clusters, op13_rolling_windows)
}
ORACLES: dict[str, str] = {
    "op5_ngram_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
                  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
     n AS (SELECT doc_id, len(s) AS n FROM s),
     e AS (SELECT doc_id, unnest(s) AS e FROM s),
     i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.e = y.e AND x.doc_id <> y.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
     r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT doc_id, n AS n_shingles, min(reached) AS component_id FROM r JOIN n USING (doc_id) GROUP BY 1, 2
""",
    "op2_chat_perspectives": """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<\\|im_') AS text FROM conversations WHERE conv_id IS NOT NULL),
     s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
     p AS (SELECT t.*, s.speaker, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END
                  || chr(10) || text || '<|im_end|>' || chr(10) AS part FROM t JOIN s USING (conv_id)),
     o AS (SELECT *, row_number() OVER w AS no, sum(length(part)) OVER (w ROWS UNBOUNDED PRECEDING) AS past FROM p
           WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, speaker, count(*) AS n_turns, string_agg(part, '' ORDER BY no) AS rendered,
       coalesce(string_agg((past - 11 - length(text))::BIGINT || '-' || (past - 1)::BIGINT, ',' ORDER BY no) FILTER (role = speaker), '') AS masks
FROM o GROUP BY conv_id, speaker
""",
    "op10_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op12_centroid_clusters": """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),
     a0 AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c FROM (SELECT v.vec_id, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - k.e[i]) * (v.e[i] - k.e[i])))::BIGINT AS d FROM v, c0 k) GROUP BY 1),
     m0 AS (SELECT c, list(floor(s / n)::BIGINT ORDER BY i) AS e FROM (SELECT a.c, i, sum(v.e[i]) AS s, count(*) AS n FROM v JOIN a0 a USING (vec_id), range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
     c1 AS MATERIALIZED (SELECT k.c, coalesce(m.e, k.e) AS e FROM c0 k LEFT JOIN m0 m USING (c)),
     a1 AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c FROM (SELECT v.vec_id, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - k.e[i]) * (v.e[i] - k.e[i])))::BIGINT AS d FROM v, c1 k) GROUP BY 1),
     m1 AS (SELECT c, list(floor(s / n)::BIGINT ORDER BY i) AS e FROM (SELECT a.c, i, sum(v.e[i]) AS s, count(*) AS n FROM v JOIN a1 a USING (vec_id), range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
     c2 AS MATERIALIZED (SELECT k.c, coalesce(m.e, k.e) AS e FROM c1 k LEFT JOIN m1 m USING (c)),
     a2 AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c FROM (SELECT v.vec_id, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - k.e[i]) * (v.e[i] - k.e[i])))::BIGINT AS d FROM v, c2 k) GROUP BY 1),
     m2 AS (SELECT c, list(floor(s / n)::BIGINT ORDER BY i) AS e FROM (SELECT a.c, i, sum(v.e[i]) AS s, count(*) AS n FROM v JOIN a2 a USING (vec_id), range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
     c3 AS MATERIALIZED (SELECT k.c, coalesce(m.e, k.e) AS e FROM c2 k LEFT JOIN m2 m USING (c)),
     f AS (SELECT vec_id, min((d, c)) AS b FROM (SELECT v.vec_id, k.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - k.e[i]) * (v.e[i] - k.e[i])))::BIGINT AS d FROM v, c3 k) GROUP BY 1)
SELECT vec_id, k.c::INTEGER AS cluster, b[1] AS distance, sum(b[1]) OVER (PARTITION BY k.c)::BIGINT AS cluster_inertia, sum(b[1]) OVER ()::BIGINT AS inertia, sha256(list_aggregate(k.e, 'string_agg', ',')) AS centroid_sha256
FROM f JOIN c3 k ON k.c = b[2]
""",
    # crc32 bit by bit: an element of the list is a byte to be mixed in, or -1 for a shift
    "op13_rolling_windows": """
WITH h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                  lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) AS h FROM documents),
     t AS (SELECT doc_id, source, lang, length(text)::BIGINT AS n, 60 * floor((doc_id + h % 10000) / 6.0)::BIGINT AS event_s FROM h),
     w AS (SELECT *, unnest([600, 43200]::BIGINT[]) AS window_s FROM t),
     f AS (SELECT d.doc_id, d.window_s, d.event_s, count(o.doc_id) AS n_events, coalesce(sum(o.n), 0)::BIGINT AS sum_chars, count(DISTINCT o.lang) AS n_langs,
                  list_sort(list(o.n) FILTER (o.n IS NOT NULL)) AS s
           FROM w d LEFT JOIN t o ON o.source IS NOT DISTINCT FROM d.source AND o.event_s >= d.event_s - d.window_s AND o.event_s < d.event_s GROUP BY 1, 2, 3)
SELECT doc_id, window_s, event_s, n_events, sum_chars, n_langs, s[(len(s) + 1) // 2] AS median_chars, s[(9 * len(s) + 9) // 10] AS high_chars FROM f
""",
    "op3_exact_dedup": """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g
  ON coalesce(d.text, '') = g.t
""",
}
