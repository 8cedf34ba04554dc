"""Where queries and their SQL are registered, and the fixtures that they run on."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.plans.session import tasks_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = plain(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(sql: str) -> str:
    """The SQL with fixtures spelled out and tables by name."""
    for name, body in FIXTURES.items():
        sql = sql.replace(f"[{name}]", f"({body})")
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A reference-shaped table derived from the driver's tables."""
    sql = FIXTURES[name]
    tables = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))}
    for t, key in DEALT.get(name, {}).items():
        # by the key of the fixture's window, where the session's own number of tasks would let each grow with the table
        tasks = tasks_for(spark, tables[t].count())
        if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
            tables[t] = tables[t].repartition(tasks, key)
    return spark.sql(sql, **tables)


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """The rows over all tasks, ahead of work that is costly in each row: a narrow table lies in a few file splits, whatever the number of its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(key))


#: Tables of fixtures that number rows within a key, and that key.
DEALT = {"items": {"lineitem": "l_orderkey"}}

#: SQL that both engines read, tables in braces.
FIXTURES = {
    # repeats of an item: an order's lines
    "items": """
SELECT l_orderkey AS item, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS pos,
       l_returnflag AS prediction, l_discount AS score, l_quantity AS qty, l_linestatus = 'F' AS ok, l_returnflag <> 'N' AS parsed
FROM {lineitem}""",
    # replies in every shape that the parsers know
    "replies": """
SELECT o_orderkey AS id, o_orderstatus AS task, o_orderpriority AS mode, o_totalprice AS price,
       CASE CAST(o_orderkey % 12 AS INT)
         WHEN 0 THEN '<think>It rests on ' || o_orderpriority || '</think><answer>' || chr(CAST(65 + o_orderkey % 5 AS INT)) || '</answer>'
         WHEN 1 THEN 'Answer: (' || chr(CAST(65 + o_orderkey % 5 AS INT)) || ')'
         WHEN 2 THEN 'I first thought A. The answer is ' || chr(CAST(65 + o_orderkey % 5 AS INT)) || '.'
         WHEN 3 THEN '**Answer: ' || chr(CAST(97 + o_orderkey % 5 AS INT)) || ', C**'
         WHEN 4 THEN 'Answer: none'
         WHEN 5 THEN '  '
         WHEN 6 THEN '<answer>Yes, it is.</answer>'
         WHEN 7 THEN 'Some thoughts. Answer: No.'
         WHEN 8 THEN 'Answer: yes'
         WHEN 9 THEN 'costs 1,234.5 or -3 maybe'
         WHEN 10 THEN '<think>.</think><answer>B and D</answer>'
         ELSE '<think>still at work on ' || o_orderpriority END AS content,
       CASE WHEN o_orderkey % 5 = 0 THEN 'native thoughts' ELSE '' END AS reasoning,
       CASE WHEN o_orderkey % 12 = 11 THEN 'length' ELSE 'stop' END AS finish_reason,
       CASE WHEN o_orderkey % 12 = 5 THEN 'empty' WHEN o_orderkey % 12 = 11 THEN 'truncated' WHEN o_orderkey % 97 = 0 THEN 'error' ELSE 'ok' END AS status
FROM {orders}""",
    # a model x dataset grid with a mode
    "grid": """
SELECT p_brand AS dataset_id, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS model_id,
       CASE WHEN p_partkey % 2 = 0 THEN 'io' ELSE 'cot' END AS prompt_mode, p_type AS kind, p_partkey AS id, p_name AS name,
       p_size AS size, p_retailprice AS price, CAST(p_size % 2 = 1 AS INT) AS correct
FROM {part}""",
    # an event log with values that are missing now and then
    "log": """
SELECT event_id AS id, user_id AS item, event_type AS kind, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v,
       value, event_id % 3 = 0 AS correct, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS turn
FROM {events}""",
    # every document with an item, whatever their number
    "pairs": """
SELECT d.doc_id AS id, d.text AS p, b.text AS r FROM {documents} d CROSS JOIN (SELECT count(*) AS n FROM {benchmark}) c
JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS k FROM {benchmark}) b ON (d.doc_id % c.n + c.n) % c.n = b.k""",
}
