"""Exact features of rolling windows by blocks as wide as the window.

Time is cut into blocks of the window's width W.  The window [t - W, t) of a
time t in block b is then a suffix of block b - 1 and a prefix of block b, so
two persistent trees give all windows of a block: one takes the rows of b in
order of time, the other those of b - 1 backwards, and each row leaves a
version.  Both split values at the same places, one bit a level, so a rank is
selected by going down one version of either tree at once: the weights of the
two left children are added, and the rank says which way to go.

A task holds whole blocks of a source, of which it needs the rows of two.
Blocks with more rows than LIGHT go down the tree by five levels a stage
instead: rows are summed up to (time, next five bits), which no block has more
than 32 W of, and each rank moves on to the child that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import cut

#: (time, value) of a block and the one before that are held in a task at once, at the most; and about as many are worked on together.
LIGHT, TOGETHER = 200_000, 50_000
#: Levels of the tree that a heavy block goes down a stage, and all levels: values are below 2 ** 35.
STEP, DEPTH = 5, 35
#: What a row sent to a task is: a row of the block, a row of the block before, a rank to be selected, a change in the number of kinds.
NOW, BEFORE, RANK, CHANGE = range(4)
KEY = ["w", "source", "none", "block", "prefix"]
SENT = "w long, source string, none boolean, block long, prefix long, what int, at long, value long, n long, total long, which int"


def event_seconds(doc_id: Column) -> Column:
    """A row's time: 60 * floor((id + crc32(id) mod 10000) / 6), in whole numbers."""
    at = doc_id.cast("long") + F.crc32(doc_id.cast("string").cast("binary")) % 10000
    return ((at - F.pmod(at, F.lit(6))) * 10).cast("long")


class Tree:
    """A persistent tree over groups of values: version i is what the rows up to i of its group hold.

    Rows come group by group, in the order in which they are put in.  A level
    splits the nodes by a bit of the value; version i has new nodes on the path
    of its value alone and shares all others: its other child is that of the
    last version that put a value there.
    """

    def __init__(self, group: np.ndarray, value: np.ndarray, weight: np.ndarray):
        self.value, self.weight = value, weight
        n = len(value)
        self.order, self.node = np.arange(n), np.cumsum(np.append(True, group[1:] != group[:-1])[:n]) - 1
        self.first = np.searchsorted(self.node, self.node)
        self.sums = self._sums()

    def _sums(self) -> np.ndarray:
        """The weight of each version's node on its own path."""
        run = np.concatenate([[0], np.cumsum(self.weight[self.order])])
        out = np.zeros(len(self.order) + 1, np.int64)
        out[self.order] = run[1:] - run[self.first]
        return out  # version -1 stands last and weighs nothing

    def split(self, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """Go one level down: the left and right child of each version's node, as versions; sums are then those of the children."""
        n = len(self.order)
        side = self.value[self.order] >> bit & 1
        at = np.arange(n)
        child = []
        for which in (0, 1):
            last = np.maximum.accumulate(np.where(side == which, at, -1)) if n else at
            found = np.full(n + 1, -1)
            found[self.order] = np.where(last >= self.first, self.order[last], -1)
            child.append(found)
        key = self.node * 2 + side
        turn = np.argsort(key, kind="stable")
        self.order, key = self.order[turn], key[turn]
        self.node = np.cumsum(np.append(True, key[1:] != key[:-1])[:n]) - 1
        self.first = np.searchsorted(self.node, self.node)
        self.sums = self._sums()
        return child[0], child[1]


def select(trees: list[Tree], versions: list[np.ndarray], rank: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of each rank (from 1) in the union of a version of either tree, and the rank left among equal values."""
    value, rank = np.zeros(len(rank), np.int64), rank.copy()
    for bit in range(bits - 1, -1, -1):
        ways = [tree.split(bit) for tree in trees]
        left = sum(tree.sums[way[0][v]] for tree, way, v in zip(trees, ways, versions, strict=True))
        right = rank > left
        rank -= np.where(right, left, 0)
        versions = [np.where(right, way[1][v], way[0][v]) for way, v in zip(ways, versions, strict=True)]
        value = value << 1 | right
    return value, rank


class Group:
    """The rows of some (source, block), and where each time's versions are."""

    def __init__(self, group: np.ndarray, width: np.ndarray, what: np.ndarray, at: np.ndarray, value: np.ndarray, n: np.ndarray):
        self.wide = int(width.max(initial=0)) + 2
        self.sides = []
        for side in (NOW, BEFORE):
            rows = np.flatnonzero(what == side)
            # offsets grow in the order in which the tree takes the rows
            off = at[rows] if side == NOW else width[rows] - 1 - at[rows]
            key = group[rows] * self.wide + off
            turn = np.argsort(key, kind="stable")
            self.sides.append((key[turn], rows[turn]))
        self.group, self.value, self.n = group, value, n

    def ends(self, group: np.ndarray, width: np.ndarray, q: np.ndarray, side: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of each group begin in sorted keys, and end that lie in the window of offset q: before q, or from q on in the block before."""
        begin = np.searchsorted(key, group * self.wide, "left")
        end = np.searchsorted(key, group * self.wide + (q if side == NOW else width - q), "left")
        return begin, end

    def totals(self, group: np.ndarray, width: np.ndarray, q: np.ndarray, *of: np.ndarray) -> list[np.ndarray]:
        """Sums of some numbers of the rows over the window of each (group, offset)."""
        out = [np.zeros(len(q), np.int64) for _ in of]
        for side, (key, rows) in enumerate(self.sides):
            begin, end = self.ends(group, width, q, side, key)
            for k, each in enumerate(of):
                run = np.concatenate([[0], np.cumsum(each[rows])])
                out[k] += run[end] - run[begin]
        return out

    def trees(self, group: np.ndarray, width: np.ndarray, q: np.ndarray) -> tuple[list[Tree], list[np.ndarray]]:
        """A tree of either side over the rows that have a value, and the version of each (group, offset) in it."""
        trees, versions = [], []
        for side, (key, rows) in enumerate(self.sides):
            known = self.value[rows] >= 0
            key, rows = key[known], rows[known]
            begin, end = self.ends(group, width, q, side, key)
            trees.append(Tree(self.group[rows], self.value[rows], self.n[rows]))
            versions.append(np.where(end > begin, end - 1, -1))
        return trees, versions


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups, of about TOGETHER rows or one group, and the number of each row's group."""
    held, rows = [], 0

    def numbered(table: pa.Table) -> np.ndarray:
        columns = [table.column(c).combine_chunks() for c in KEY]
        codes = [c.dictionary_encode().indices.to_numpy() if c.type == pa.string() else c.to_numpy(zero_copy_only=False) for c in columns]
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in codes:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new) - 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            table = pa.Table.from_batches(held)
            number = numbered(table)
            last = int(np.searchsorted(number, number[-1]))
            if last:
                yield table.slice(0, last), number[:last]
            held, rows = table.slice(last).combine_chunks().to_batches(), len(table) - last
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).fill_null(-1).to_numpy() for c in names]


def _grouped(rows: DataFrame, run, schema: str) -> DataFrame:
    """Whole groups to tasks, sorted.  Ranges of a hash give a large group a task of its own and send the driver a bounded sample of numbers."""
    dealt = rows.withColumn("__h", F.xxhash64(*KEY)).repartitionByRange("__h")
    return dealt.sortWithinPartitions("__h", *KEY).drop("__h").mapInArrow(run, schema)


def _kinds(number: np.ndarray, what: np.ndarray, at: np.ndarray, n: np.ndarray, group: np.ndarray, q: np.ndarray, wide: int) -> np.ndarray:
    """Distinct kinds in the window of each (group, offset): the changes up to there."""
    rows = np.flatnonzero(what == CHANGE)
    key = number[rows] * wide + at[rows]
    turn = np.argsort(key, kind="stable")
    key, run = key[turn], np.concatenate([[0], np.cumsum(n[rows][turn])])
    return run[np.searchsorted(key, group * wide + q, "right")] - run[np.searchsorted(key, group * wide, "left")]


def _features(ranks: list[tuple[int, int]], selecting: bool):
    """Of each time in a group's block: rows, total, kinds and known values of its window, and, if asked for, the values of the ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in _whole_groups(batches):
            width, what, at, value, n, total = _columns(table, "w", "what", "at", "value", "n", "total")
            own = Group(number, width, what, at, value, n)
            now = np.flatnonzero(what == NOW)
            _, pick = np.unique(number[now] * own.wide + at[now], return_index=True)
            pick = now[pick]
            group, w, q = number[pick], width[pick], at[pick]
            count, sums, known = own.totals(group, w, q, n, total, np.where(value >= 0, n, 0))
            kinds = _kinds(number, what, at, n, group, q, own.wide)
            found = [np.full(len(q), -1) for _ in ranks]
            if selecting and len(q):
                some = np.flatnonzero(known > 0)
                trees, versions = own.trees(group[some], w[some], q[some])
                m = known[some]
                rank = np.concatenate([(m * a + b - 1) // b for a, b in ranks])
                bits = max(1, int(value.max()).bit_length())
                values, _ = select(trees, [np.tile(v, len(ranks)) for v in versions], rank, bits)
                for k in range(len(ranks)):
                    found[k][some] = values[k * len(some) : (k + 1) * len(some)]
            keys = table.select(["w", "source", "none", "block"]).take(pa.array(pick))
            arrays = [keys.column(c).combine_chunks() for c in keys.column_names] + [pa.array(x) for x in (q, count, sums, kinds, known)]
            arrays += [pa.array(x, mask=x < 0) for x in found]
            yield pa.RecordBatch.from_arrays(arrays, ["w", "source", "none", "block", "at", "n_events", "total", "kinds", "known", *[f"r{k}" for k in range(len(ranks))]])

    return run


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take each rank STEP levels down its node of a heavy block."""
    for table, number in _whole_groups(batches):
        width, what, at, value, n, which, prefix = _columns(table, "w", "what", "at", "value", "n", "which", "prefix")
        own = Group(number, width, what, at, value, n)
        asked = np.flatnonzero(what == RANK)
        if not len(asked):
            continue
        trees, versions = own.trees(number[asked], width[asked], at[asked])
        digit, rank = select(trees, versions, n[asked], STEP)
        keys = table.select(["w", "source", "none", "block"]).take(pa.array(asked))
        arrays = [keys.column(c).combine_chunks() for c in keys.column_names]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(prefix[asked] << STEP | digit), pa.array(at[asked]), pa.array(rank), pa.array(which[asked], pa.int32())], ["w", "source", "none", "block", "prefix", "at", "n", "which"])


def _sent(rows: DataFrame, what: int | None, **given: Column) -> DataFrame:
    """Rows in the shape that tasks read; what is not given is null, a prefix 0."""
    given = {"prefix": F.lit(0), "what": F.col("what") if what is None else F.lit(what)} | given
    columns = [part.rsplit(" ", 1) for part in SENT.split(", ")]
    return rows.select(*[given.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns])


def _changes(base: DataFrame) -> DataFrame:
    """By source and block, the offsets at which the number of distinct kinds in the window changes.

    A kind last seen at p in the block before and first seen at c in this one
    counts up to offset p and after c: from the start to the end if c <= p.
    """
    per = base.where("kind IS NOT NULL").groupBy("w", "source", "none", "block", "kind").agg(F.min("at").alias("c"), F.max("at").alias("p"))
    now = per.select("w", "source", "none", "block", "kind", "c", F.lit(None).cast("long").alias("p"))
    before = per.select("w", "source", "none", (F.col("block") + 1).alias("block"), "kind", F.lit(None).cast("long").alias("c"), "p")
    both = now.unionByName(before).groupBy("w", "source", "none", "block", "kind").agg(F.min("c").alias("c"), F.max("p").alias("p"))
    step = lambda at, n: F.struct(at.cast("long").alias("at"), F.lit(n).cast("long").alias("n"))
    c, p = F.col("c"), F.col("p")
    steps = F.when(c.isNull(), F.array(step(F.lit(0), 1), step(p + 1, -1))).when(p.isNull(), F.array(step(c + 1, 1)))
    steps = steps.when(c <= p, F.array(step(F.lit(0), 1))).otherwise(F.array(step(F.lit(0), 1), step(p + 1, -1), step(c + 1, 1)))
    return both.select("w", "source", "none", "block", F.inline(steps)).groupBy("w", "source", "none", "block", "at").agg(F.sum("n").alias("n")).where("n <> 0")


def _heavy(points: DataFrame, changes: DataFrame, ranks: list[tuple[int, int]]) -> DataFrame:
    """The features of heavy blocks, level by level."""
    sides = ["w", "source", "none", "block", "what", "at"]
    # a row for each offset, with and without a value: no more than 4 W a block
    sums = points.groupBy(*sides, F.when(F.col("value").isNotNull(), 0).alias("value")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    schema = "w long, source string, none boolean, block long, at long, n_events long, total long, kinds long, known long, " + ", ".join(f"r{k} long" for k in range(len(ranks)))
    whole = cut(_grouped(_sent(sums, None).unionByName(_sent(changes, CHANGE)), _features(ranks, False), schema).drop(*[f"r{k}" for k in range(len(ranks))]))
    asked = F.array(*[F.struct(F.lit(k).alias("which"), F.expr(f"(known * {a} + {b - 1}) div {b}").alias("n")) for k, (a, b) in enumerate(ranks)])
    queries = whole.where("known > 0").select("w", "source", "none", "block", "at", F.lit(0).cast("long").alias("prefix"), F.inline(asked))
    known = points.where("value IS NOT NULL")
    for shift in range(DEPTH - STEP, -1, -STEP):
        node, digit = F.shiftright("value", shift + STEP), F.shiftright("value", shift) % (1 << STEP)
        rows = known.groupBy(*sides, node.alias("prefix"), digit.alias("value")).agg(F.sum("n").alias("n"))
        queries = cut(_grouped(_sent(rows, None, prefix=F.col("prefix")).unionByName(_sent(queries, RANK, prefix=F.col("prefix"))), _descend, "w long, source string, none boolean, block long, prefix long, at long, n long, which int"))
    found = queries.groupBy("w", "source", "none", "block", "at").agg(*[F.max(F.when(F.col("which") == k, F.col("prefix"))).alias(f"r{k}") for k in range(len(ranks))])
    return whole.join(found, ["w", "source", "none", "block", "at"], "left")


def rolling_features(df: DataFrame, time: Column, value: Column, windows: tuple[int, ...], source: str = "source", kind: str = "lang", id_col: str = "doc_id", ranks: tuple[tuple[int, int], ...] = ((1, 2), (9, 10))) -> DataFrame:
    """For each row and each width W of `windows`, features of the rows of its source with time - W <= theirs < time.

    Returns id_col, window_s, event_s, n_events (all rows), sum_value, n_kinds
    (distinct non-null kinds) and rank_0, rank_1, ...: of the m non-null values
    in ascending order, repeats kept, number ceil(m * a / b) for each (a, b) of
    `ranks`; null if m is 0.  Times and values are whole numbers, values from 0
    to 2^35 - 1.  A null source is a source; sources are told apart as text.  A
    null value counts as a row without one.  A row without a time lies in no
    window, and its own windows are empty (event_s null).  Ties: rows of one
    time are in none of each other's windows and have the same features.
    Repeated rows count as often as they stand and are returned as often; other
    columns are left out.  An empty table gives no rows.

    What moves are (source, time, value) with counts, without texts.  A group of
    rows that shares a source and a block is held in one task only up to LIGHT
    rows; larger ones go down the tree stage by stage.
    """
    rows = df.select(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"), F.col(f"`{source}`").isNull().alias("none"), value.cast("long").alias("value"), F.col(f"`{kind}`").cast("string").alias("kind"), F.col(f"`{id_col}`").alias("id"), time.cast("long").alias("time"))
    wide = F.explode(F.array(*[F.lit(w).cast("long") for w in windows])).alias("w")
    block = ((F.col("time") - F.pmod("time", "w")) / F.col("w")).cast("long").alias("block")
    at = F.pmod("time", "w").alias("at")
    timed = rows.where("time IS NOT NULL")
    counted = cut(timed.groupBy("source", "none", "time", "value").agg(F.count("*").alias("n")))
    now = counted.select("*", wide).select("w", "source", "none", block, at, "value", "n", (F.coalesce("value", F.lit(0)) * F.col("n")).alias("total"))
    points = now.withColumn("what", F.lit(NOW)).unionByName(now.withColumn("what", F.lit(BEFORE)).withColumn("block", F.col("block") + 1))
    changes = _changes(timed.select("source", "none", "kind", "time", wide).select("w", "source", "none", "kind", block, at))
    group = ["w", "source", "none", "block"]
    heavy = cut(points.groupBy(*group).agg(F.count("*").alias("rows")).where(F.col("rows") > LIGHT).drop("rows"))
    ranks = list(ranks)
    schema = "w long, source string, none boolean, block long, at long, n_events long, total long, kinds long, known long, " + ", ".join(f"r{k} long" for k in range(len(ranks)))
    some = heavy.count() > 0
    few = lambda x: x.join(heavy, group, "left_anti") if some else x
    found = _grouped(_sent(few(points), None).unionByName(_sent(few(changes), CHANGE)), _features(ranks, True), schema)
    if some:
        found = found.unionByName(_heavy(points.join(heavy, group, "left_semi"), changes.join(heavy, group, "left_semi"), ranks))
    found = found.select("w", "source", "none", (F.col("block") * F.col("w") + F.col("at")).alias("time"), "n_events", "total", "kinds", *[f"r{k}" for k in range(len(ranks))])
    asked = rows.select("id", "source", "none", "time", wide)
    joined = asked.join(found, ["w", "source", "none", "time"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(F.col("id").alias(id_col), F.col("w").alias("window_s"), F.col("time").alias("event_s"), zero("n_events").alias("n_events"), zero("total").alias("sum_value"), zero("kinds").alias("n_kinds"), *[F.col(f"r{k}").alias(f"rank_{k}") for k in range(len(ranks))])
