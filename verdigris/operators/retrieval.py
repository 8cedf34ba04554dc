"""Lexical retrieval: BM25 over an inventory, and search of evidence by word overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.stem import stem_words
from verdigris.plans.session import durable

# Function words, and the words that the items of a questionnaire share.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now would could ever feel felt any anything""".split()
)


def terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-cased runs of ASCII letters and digits without stop words; not stemmed."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


#: Terms of queries, or words with their stems, that are broadcast at the most; with more, Spark picks the joins.
FEW = 1_000_000
#: Pairs of query and document that a task scores.
PAIRS = 2_000_000


def bm25_topk(queries: DataFrame, inventory: DataFrame, query_id: str, doc_id: str, text: str, k: int, threshold: float = 0.0, k1: float = 1.5, b: float = 0.75, stop: tuple[str, ...] = (), stem: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents by BM25 over distinct query terms, normalised by the query's ceiling.

    Statistics are those of the whole inventory.  Its texts are dealt out by
    document once, so that terms are counted and documents scored where they
    lie; only terms that queries have are counted, and no more than k documents
    of each query leave a task.  With `stem`, terms are stemmed, each distinct
    word of the inventory once.  `allowed` (query_id, doc_id) says which
    documents a query may find: those of one record, for instance.
    """
    split = lambda c: stem_words(terms(c, stop)) if stem else terms(c, stop)
    asked = queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(split(F.col(text)))).alias("t"))
    n, (n_asked, n_queries) = inventory.count(), asked.agg(F.count("*"), F.count_distinct("q")).first()
    small = lambda df, size=n_asked: F.broadcast(df) if size <= FEW else df
    tasks = max(inventory.sparkSession.sparkContext.defaultParallelism, -(-n * max(n_queries, 1) // PAIRS))
    lies = inventory.select(F.col(doc_id).alias("d"), F.col(text).alias("x")).repartition(tasks, "d").select("d", terms(F.col("x"), stop).alias("ws"))
    words = lies.withColumn("len", F.sum(F.size("ws")).over(Window.partitionBy("d"))).select("d", "len", F.explode("ws").alias("w"))
    wanted = small(asked.select("t").distinct())
    if stem:
        # kept, as the join's filter would go down to where words still repeat, and the stemmer with it
        distinct = durable(words.select("w").distinct())
        named = durable(distinct.select("w", stem_words(F.array("w"))[0].alias("t")).join(wanted, "t"))
        found = words.join(small(named, named.count()), "w")
    else:
        found = words.withColumnRenamed("w", "t").join(wanted, "t", "left_semi")
    tf = found.groupBy("d", "len", "t").agg(F.count("*").alias("f"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    stats = lies.agg((F.sum(F.size("ws")) / F.lit(max(n, 1))).alias("avg"))
    idf = df.crossJoin(F.broadcast(stats)).select("t", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"), "avg")
    known = small(asked.join(idf, "t").withColumn("top", F.sum("idf").over(Window.partitionBy("q"))))
    if allowed is None:
        met = tf.where("d IS NOT NULL").join(known, "t")
    else:
        # a document meets the queries that may find it before its terms meet theirs
        pairs = allowed.select(F.col(query_id).alias("q"), F.col(doc_id).alias("d")).repartition(tasks, "d").distinct()
        met = tf.join(pairs, "d").join(known, ["q", "t"])
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg"))
    hits = met.groupBy("q", "d").agg(F.sum(F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + norm)).alias("s"), F.max("top").alias("top"))
    scored = hits.select("q", "d", (F.col("s") / F.col("top")).alias("score")).where(F.col("score") >= threshold)
    # rounded, so that the order of a sum doesn't decide between documents of equal score
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "d"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("d").alias(doc_id), "score", "rank")


def evidence_tokens(text: Column, stop: tuple[str, ...] = (), fold: int = 4) -> Column:
    """Words of more than two letters without stop words, folded to their first letters, as a set."""
    return F.array_distinct(F.transform(F.filter(terms(text, stop), lambda w: F.length(w) > 2), lambda w: F.left(w, F.lit(fold))))


def evidence_topk(df: DataFrame, query: str, key: str, value: str, group: list[str], k: int = 6, least: float = 0.5, cap: int = 4, stop: tuple[str, ...] = ()) -> DataFrame:
    """Findings of an item that a request names by key, or less surely by content, best first."""
    wanted = evidence_tokens(F.col(query), stop)
    by_key = evidence_tokens(F.regexp_replace(F.col(key), "[._]", " "), stop)
    on_key, on_value = F.size(F.array_intersect(wanted, by_key)), F.size(F.array_intersect(wanted, evidence_tokens(F.col(value), stop)))
    weight = F.when((on_key > 0) | (F.size(by_key) == 0), 1.0).otherwise(0.5)
    coverage = F.when(on_key > 0, on_key).otherwise(on_value) / F.nullif(F.least(F.size(wanted), F.lit(cap)), F.lit(0))
    rows = df.withColumn("score", weight * coverage).where((coverage > 0) & (coverage >= least))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def best_match(asks: DataFrame, cache: DataFrame, tool: str = "tool", args: str = "args") -> DataFrame:
    """Each ask with a cached result: of the same tool and arguments, else of the same tool with the most shared arguments.

    asks: ask_id, tool, args; cache: key_no, tool, args, result.  A call that
    asks for something must share a value; the first of equals wins.
    """
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    left = asks.select("ask_id", tool, low(F.col(args)).alias("wa"))
    right = cache.select("key_no", tool, low(F.col(args)).alias("ha"), "result")
    pairs = left.join(right, tool)
    shared = F.size(F.array_intersect("wa", "ha"))
    exact = F.array_sort("wa") == F.array_sort("ha")
    pairs = pairs.withColumn("exact", exact).withColumn("score", shared - 0.01 * F.abs(F.size("wa") - F.size("ha"))).where(exact | (shared > 0) | (F.size("wa") == 0))
    best = pairs.groupBy("ask_id").agg(F.max_by(F.struct("key_no", "result", "exact"), F.struct("exact", "score", -F.col("key_no"))).alias("b"))
    return asks.join(best, "ask_id", "left").select(*asks.columns, "b.key_no", "b.result", "b.exact")
