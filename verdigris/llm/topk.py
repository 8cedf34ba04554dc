"""Exact top-k search by inner product, pruned block by block.

Vectors are whole numbers.  Candidates lie in ranges of ids, cut into blocks;
a block keeps the largest and smallest value of each term (component).  For a
query, the sum over its terms of the better of the two products bounds every
score in the block.  Blocks are scored through their forward index, the matrix
of their vectors, in order of that bound, until the bounds fall below the
query's kth score.  A first pass over a bounded draw of candidates gives each
query a score that its kth can't be below, which every range starts from.
Ranges of candidates meet blocks of queries in tasks of bounded size, and the
winners of the ranges are merged by query.
"""

from __future__ import annotations

import heapq
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a range, and queries of a block, at the most.
RANGE, QUERIES = 32_768, 16_384
#: Ranges at the least, if they have as many candidates as a block twice; and candidates of the first pass, about.
RANGES, SEEDS = 16, 2_048
#: Candidates of a block.
BLOCK = 128
#: Scores and bounds below this are exact in double precision.
EXACT = float(1 << 53)


def whole_vector(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null if the vector, or a component, is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k first of their query, by score and then by id, in order of query."""
    order = np.lexsort((ids, -score, query))
    at = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - at < k]


def _search_integers(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[list, list, list]:
    """The same in Python's integers, for components beyond what doubles hold; a query at a time."""
    rows = [[int(x) for x in v] for v in c]
    out: tuple[list, list, list] = ([], [], [])
    for own, v in zip(query_ids, q, strict=True):
        v = [int(x) for x in v]
        best = heapq.nsmallest(k, ((-sum(map(operator.mul, v, r)), i) for r, i in zip(rows, ids.tolist(), strict=True) if i != own))
        for x, y in zip(out, zip(*((own, i, -s) for s, i in best), strict=True), strict=False):
            x.extend(y)
    return out


def search_range(query_ids: np.ndarray, queries: list, ids: np.ndarray, vectors: list, k: int, block: int = BLOCK, least: np.ndarray | None = None, counter: list | None = None) -> tuple:
    """The k best (query_id, vec_id, score) of each query in one range, ties to the smaller id.

    A candidate with the query's own id takes no part.  `least` holds scores
    that the kth of a query is known to reach; what lies below it may be left
    out.  The number of products taken is added to `counter`.
    """
    dims = max([1, *map(len, queries), *map(len, vectors)])
    order = np.argsort(ids, kind="stable")
    ids, c, q = ids[order], _matrix([vectors[i] for i in order], dims), _matrix(queries, dims)
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * dims >= EXACT:
        return _search_integers(query_ids, q, ids, c, k)
    cuts = range(0, len(ids), block)
    high = np.array([c[a : a + block].max(0) for a in cuts])
    low = np.array([c[a : a + block].min(0) for a in cuts])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    sequence = np.argsort(-bounds, 1, kind="stable")
    kth = np.full(len(q), -np.inf) if least is None else least.astype(float)
    best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    left = np.arange(len(q))
    for turn in range(len(high)):
        left = left[bounds[left, sequence[left, turn]] >= kth[left]]
        if not len(left):
            break
        wanted = sequence[left, turn]
        by_block = np.argsort(wanted, kind="stable")
        got = [best]
        for who in np.split(left[by_block], np.flatnonzero(np.diff(wanted[by_block])) + 1):
            b = sequence[who[0], turn] * block
            part = ids[b : b + block]
            scores = q[who] @ c[b : b + block].T
            if counter is not None:
                counter.append(scores.size)
            i, j = np.nonzero(scores >= kth[who, None])
            i, j, scores = who[i], part[j], scores[i, j]
            other = j != query_ids[i]
            got.append((i[other], scores[other], j[other]))
        found = [np.concatenate(x) for x in zip(*got, strict=True)]
        if len(found[0]) > len(best[0]):
            keep = _first(*found, k)
            best = tuple(x[keep] for x in found)
            # the last of a query with k rows
            at = np.searchsorted(best[0], np.arange(len(q) + 1))
            full = np.flatnonzero(np.diff(at) == k)
            kth[full] = np.maximum(kth[full], best[1][at[full + 1] - 1])
    return query_ids[best[0]], best[2], best[1].astype(np.int64)


def exact_topk(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Each query's k best other rows by inner product: query_id, rank, vec_id, score.

    Vectors are made whole by floor(scale * x).  Rows with a null id, a null
    vector, or a component that is null or not finite take no part.  A vector
    that is shorter than another counts as ending in zeros.  Ties go to the
    smaller id.  A row never answers a query of its own id; of rows that repeat
    an id as queries, each answers and is answered as one of them.  Scores must
    fit 64 bits.  An empty table, or one without queries, gives no rows.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_vector(F.col(f"`{vector}`"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL")
    n, n_queries = (int(x or 0) for x in rows.agg(F.count("*"), F.count_if("q")).first())
    ranges = max(1, -(-n // min(RANGE, max(2 * BLOCK, n // RANGES))))
    blocks = max(1, -(-n_queries // QUERIES))
    spread = F.xxhash64("id")
    candidates = rows.select("id", "v", F.lit(False).alias("q"), F.lit(None).cast("double").alias("least"), F.pmod(spread, F.lit(ranges)).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    queries = rows.where("q").select("id", "v", "q", F.pmod(F.shiftrightunsigned(spread, 32), F.lit(blocks)).cast("int").alias("b"))

    def run(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            asks = pdf["q"].to_numpy(bool)
            ids, v = pdf["id"].to_numpy(), pdf["v"].tolist()
            asked, there = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(asked) or not len(there):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            least = pdf["least"].to_numpy(float)[asked]
            a, b, c = search_range(ids[asked], [v[i] for i in asked], ids[there], [v[i] for i in there], k, least=np.where(np.isnan(least), -np.inf, least))
            found = pd.DataFrame({"query_id": a, "vec_id": b, "score": c}).astype("int64")
            # of the first pass the kth scores count
            return found.groupby("query_id", as_index=False).agg(vec_id=("vec_id", "count"), score=("score", "min")) if last else found

        return run

    kind = "query_id bigint, vec_id bigint, score bigint"
    seeds = -(-n // SEEDS) * 4
    if n > 4 * SEEDS:
        drawn = candidates.where(F.pmod(F.xxhash64("id", F.lit("seed")), F.lit(seeds)) < 4)
        first = drawn.unionByName(queries.withColumn("r", F.lit(0).cast("long")).withColumn("least", F.lit(None).cast("double"))).withColumn("r", F.lit(0))
        first = first.groupBy("r", "b").applyInPandas(run(True), kind).where(F.col("vec_id") == k)
        # repeated ids answer as one: the least of their scores holds for each
        first = first.groupBy(F.col("query_id").alias("id")).agg((F.min("score").cast("double")).alias("least"))
        queries = queries.join(first, "id", "left")
    else:
        queries = queries.withColumn("least", F.lit(None).cast("double"))
    queries = queries.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))))

    found = candidates.unionByName(queries).groupBy("r", "b").applyInPandas(run(False), kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
