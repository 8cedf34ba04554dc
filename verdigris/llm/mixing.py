"""Mixing sources to target weights along a low-discrepancy schedule.

Slot k has the point frac(k * golden ratio), which falls into the share of one
source; the slots of a source are ranked, and its slot of rank r takes block r
of the source's shuffled text, block 0 again after the last.  Blocks of a
source have equal numbers of words, so a block may begin or end inside a
document.  Everything is DataFrame operations; ranks and positions come from
prefix sums in two levels, so no task has to see a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import WORD, cut, one_of_each, unused

#: Slots of the whole schedule, about; and blocks of a source at the least, if it has as many words.
SLOTS, LEAST_BLOCKS = 1 << 17, 1 << 11
#: Times that a document is repeated at the most.
MOST = 3
#: Documents, or slots, that one step of a prefix sum covers, about.
STEP = 2_000
#: Sources whose totals are broadcast at the most; with more, Spark picks the join.
FEW_SOURCES = 50_000
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_col: str, text: str, seed: int) -> Column:
    """The place of a row in its source's shuffled order."""
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text}`"))


def weights_in_turn(df: DataFrame, source: str, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The distinct sources by code point, null last, with the weights in turn."""
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    return df.select(source).distinct().select(source, F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).alias("weight"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Adds `target` to a row per source with `source_size` and `weight`.

    The sum of all sizes is shared by weight.  Shares stop at `most` times the
    source's size and the excess is shared again by weight, until none is
    above: that is a water level L with shares min(weight * L, cap), found from
    running sums of the caps in order of cap / weight.
    """
    cap = F.col("source_size") * most
    order = Window.orderBy(cap / F.col("weight"), "__n")
    every = Window.partitionBy()
    rows = sizes.withColumn("__capped", F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("__free", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("__level", (F.sum("source_size").over(every) - F.col("__capped")) / F.col("__free"))
    fits = F.when(F.col("weight") * F.col("__level") <= cap, F.struct(cap / F.col("weight"), "__n", "__level"))
    level = F.min(fits).over(every)["__level"]
    return rows.withColumn("target", F.coalesce(F.least(F.col("weight") * level, cap.cast("double")), F.lit(0.0))).drop("__capped", "__free", "__level")


def _steps(n: int) -> int:
    return max(1, -(-n // STEP))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """What the mix takes from each row.

    Returns id_col, source (as `source`), size, source_size, target, taken,
    first_slot (the first slot of the schedule with words of the row, null if
    none is taken) and row_hash (of id and text): a row for each row of the input.  size is the number of words, 0 for a null
    text; null is a source of its own.  No row is taken more than MOST times
    its size; rows without words have taken 0.  Rows are shuffled by a hash of
    id and text, so reruns agree; repeated rows tie and count one by one.
    Other columns are left out.  An empty table gives no rows.
    """
    rows = df.select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`").cast("string")).alias("size"),
        row_hash(id_col, text, seed).alias("__hash"),
    )
    rows = cut(rows)  # a few numbers per document; the texts are read once
    turns = weights_in_turn(rows, "source", weights)
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"))
    sizes = totals.join(turns, totals["source"].eqNullSafe(turns["source"])).select(totals["source"], "source_size", "__rows", "weight")
    sizes = sizes.withColumn("__n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    wanted = targets(sizes)
    whole = F.sum("source_size").over(Window.partitionBy())
    blocks = F.least(F.col("source_size"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") * SLOTS / F.greatest(whole, F.lit(1)))))
    wanted = wanted.withColumn("__blocks", blocks).withColumn("__slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("__blocks") / F.col("source_size")).otherwise(0.0))
    wanted = wanted.withColumn("__till", F.sum("__slots").over(Window.orderBy("__n")))
    wanted = cut(wanted)  # a row per source

    n_rows, n_slots, n_sources = (int(x or 0) for x in wanted.agg(F.sum("__rows"), F.ceil(F.sum("__slots")), F.count("*")).first())
    if n_sources <= FEW_SOURCES:
        wanted = F.broadcast(wanted)
    taken = _blocks_taken(wanted, n_slots, max(1, n_sources))
    placed = _placed(rows, wanted, n_rows)

    # the blocks that a document's words lie in: words first .. last of the source, both within 0 .. source_size - 1
    lies = placed.withColumn("__b", F.explode_outer(F.when(F.col("size") > 0, F.sequence(_block_of(F.col("__from")), _block_of(F.col("__from") + F.col("size") - 1)))))
    parts = lies.join(taken, ["__n", "__b"], "left")
    begins, ends = _begin_of(F.col("__b")), _begin_of(F.col("__b") + 1)
    words = F.least(ends, F.col("__from") + F.col("size")) - F.greatest(begins, F.col("__from"))
    summed = parts.groupBy("__n", "__step", "__at").agg(
        F.first("__id").alias(id_col), F.first("source").alias("source"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum(F.coalesce(words * F.col("__times"), F.lit(0))).cast("long").alias("taken"), F.min("__slot").alias("first_slot"), F.first("__hash").alias("row_hash"),
    )
    return summed.select(id_col, "source", "size", "source_size", "target", "taken", "first_slot", "row_hash")


def _begin_of(block: Column) -> Column:
    """First word of a block: blocks differ by one word at the most."""
    return _div(block * F.col("source_size"), F.col("__blocks"))


def _block_of(word: Column) -> Column:
    """The block with the word: the last whose first word is not after it."""
    return _div(word * F.col("__blocks") + F.col("__blocks") - 1, F.col("source_size"))


def _div(a: Column, b: Column) -> Column:
    """Whole part of a division of whole numbers, exact beyond the 53 bits of a double."""
    return F.call_function("div", a, b)


def _blocks_taken(wanted: DataFrame, n_slots: int, n_cells: int) -> DataFrame:
    """How often the schedule takes each block, and where first: __n, __b, __times, __slot."""
    spark = wanted.sparkSession
    shares = wanted.select("__n", "__blocks", F.coalesce(F.lag("__till").over(Window.orderBy("__n")), F.lit(0.0)).alias("__since"), "__till", F.max("__till").over(Window.partitionBy()).alias("__all")).where("__till > __since")
    slots = spark.range(n_slots).withColumn("__point", (F.col("id") * GOLDEN) % 1.0)
    point = F.col("__point") * F.col("__all")
    # a share lies in each cell that it reaches into, a point in one: with a cell a source, a point meets two shares or so
    cell = lambda x: F.least(F.floor(x / F.col("__all") * n_cells), F.lit(n_cells - 1))
    lies = shares.withColumn("__cell", F.explode(F.sequence(cell(F.col("__since")), cell(F.col("__till")))))
    slots = slots.crossJoin(F.broadcast(shares.select("__all").limit(1))).withColumn("__cell", cell(point)).drop("__all").join(lies, "__cell")
    slots = slots.where((point >= F.col("__since")) & (point < F.col("__till"))).select("id", "__n", "__blocks", _div(F.col("id"), F.lit(STEP * 4)).alias("__step"))
    per = slots.groupBy("__n", "__step").agg(F.count("*").alias("__many"))
    per = per.withColumn("__past", F.coalesce(F.sum("__many").over(Window.partitionBy("__n").orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("__n", "__step").orderBy("id")) - 1
    ranked = slots.withColumn("__in", rank).join(per.drop("__many"), ["__n", "__step"]).withColumn("__rank", F.col("__in") + F.col("__past"))
    return ranked.where(F.col("__rank") < MOST * F.col("__blocks")).groupBy("__n", (F.col("__rank") % F.col("__blocks")).alias("__b")).agg(F.count("*").alias("__times"), F.min("id").alias("__slot"))


def _placed(rows: DataFrame, wanted: DataFrame, n_rows: int) -> DataFrame:
    """The rows of each source in shuffled order, with the number of words before each: __from."""
    steps = _steps(n_rows)
    known = wanted.select(F.col("source").alias("__source"), "__n", "source_size", "target", "__blocks")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__step", F.pmod(F.shiftrightunsigned("__hash", 20), F.lit(steps)))
    rows = rows.withColumn("__upper", _div(F.col("__step"), F.lit(max(1, int(steps**0.5)))))
    low = rows.groupBy("__n", "__upper", "__step").agg(F.sum("size").alias("__size"))
    high = low.groupBy("__n", "__upper").agg(F.sum("__size").alias("__size"))
    before = lambda keys, by: F.coalesce(F.sum("__size").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = high.withColumn("__high", before(["__n"], "__upper")).drop("__size")
    low = low.withColumn("__low", before(["__n", "__upper"], "__step")).drop("__size")
    past = low.join(high, ["__n", "__upper"]).select("__n", "__step", (F.col("__low") + F.col("__high")).alias("__past"))
    order = Window.partitionBy("__n", "__step").orderBy("__hash", "__id", "size")
    rows = rows.withColumn("__at", F.row_number().over(order)).withColumn("__in", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(past, ["__n", "__step"]).withColumn("__from", F.col("__in") + F.col("__past"))


def mixed(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The rows as often as the mix takes them: taken / size times, rounded; all columns.

    The schedule takes whole rounds of a source and one more in part, so only
    the document at that part's end is ever rounded.  A document is an id and a
    text in a source: each text of a repeated id is taken as often as the mix
    takes that text.  Rows that repeat all three are one document that is taken
    as often as they are together, with the other columns of the row whose hash
    of all columns is the least.  Rows without words are not taken.  An empty
    table gives no rows.
    """
    own, its, times, many, copy = unused(df, "__row", "__source", "__often", "__many", "__copy")
    taken = mix(df, id_col, text, source, weights, seed).where("size > 0")
    often = taken.groupBy(F.col("row_hash").alias(its), F.col("source").alias(own)).agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias(times), F.count("*").alias(many))
    often = cut(often.where(F.col(times) > 0))
    match = (row_hash(id_col, text, seed) == F.col(its)) & F.col(f"`{source}`").eqNullSafe(F.col(own))
    rows = df.join(often.where(F.col(many) == 1), match)
    several = often.where(F.col(many) > 1)
    if several.limit(1).count():
        rows = rows.unionByName(one_of_each(df.join(several, match), its, own))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in df.columns])
