"""Line dedup by winnowing over line hashes.  DataFrame functions only.

A fingerprint is the hash of the least stretch of lines from a line on that has
PRINT_WORDS words.  A window is the least stretch of lines that has MIN_WORDS
words, counted on from a line or back from it; of the fingerprints that lie in
it the least is chosen, of equal ones the first.  The choice depends on the
window's own lines alone, so two copies of a run of MIN_WORDS words have chosen
the same fingerprint at the same place.

Chosen positions are joined first: a window whose fingerprint no other position
in the corpus has chosen is repeated nowhere.  The others are extended from
the fingerprint both ways to their whole window, which meets the first place in
the corpus of the same window; the windows at other places are deleted, and
overlapping ones make up the later repeated run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import WORD, cut, unused

MIN_WORDS, PRINT_WORDS = 50, 25
#: Lines that are looked at together for the end of a stretch.
STEP = 8


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _lines(text: Column) -> Column:
    """Of the lines that are not blank: two hashes, words, and the place in the text."""
    row = lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("w"), i.alias("r"))
    return F.filter(F.transform(F.split(text, "\n", -1), row), lambda s: s["w"] > 0)


def _stretches(s: Column, min_words: int, print_words: int, way: int) -> Column:
    """From each line on the least stretch with min_words words: words w, hashes h and g, lines n; and of its start with print_words words the hash f and lines m."""
    state = lambda w, h, g, n, f, m: F.struct(w.alias("w"), h.alias("h"), g.alias("g"), n.alias("n"), f.alias("f"), m.alias("m"))

    def add(a: Column, x: Column) -> Column:
        h, small = F.xxhash64(a["h"], x["h"]), a["w"] < print_words
        more = state(a["w"] + x["w"], h, F.xxhash64(a["g"], x["g"]), a["n"] + 1, F.when(small, h).otherwise(a["f"]), F.when(small, a["n"] + 1).otherwise(a["m"]))
        return F.when(a["w"] >= min_words, a).otherwise(more)

    seed = F.lit(way).cast("long")
    start = state(F.lit(0), seed, seed, F.lit(0), seed, F.lit(0))
    # every line has a word
    steps = F.sequence(F.lit(0), F.lit(max(min_words - 1, 0) // STEP))
    return F.transform(s, lambda _, i: F.aggregate(steps, start, lambda a, k: F.when(a["w"] >= min_words, a).otherwise(F.aggregate(F.slice(s, i + 1 + STEP * k, STEP), a, add))))


def _windows(text: Column, min_words: int, print_words: int) -> Column:
    """The windows of a text: hashes h and g, first and last line, and the chosen fingerprint f with its place i."""

    def chosen(ends: Column, begin: Column, n: Column) -> Column:
        """The least fingerprint inside n lines from `begin` on."""
        own = F.transform(F.slice(ends, begin + 1, n), lambda y, k: F.when((y["w"] >= print_words) & (k + y["m"] <= n), F.struct(y["f"].alias("f"), (begin + k).alias("i"))))
        return F.array_min(F.filter(own, lambda y: y.isNotNull()))

    def made(s: Column, ends: Column, begin: Column, x: Column) -> Column:
        return _let(chosen(ends, begin, x["n"]), lambda c: F.struct(x["h"].alias("h"), x["g"].alias("g"), F.get(s, begin)["r"].alias("since"), F.get(s, begin + x["n"] - 1)["r"].alias("till"), c["f"].alias("f"), c["i"].alias("i")))

    def on(s: Column, ends: Column) -> Column:
        whole = F.transform(ends, lambda x, i: F.when(x["w"] >= min_words, made(s, ends, i, x)))
        return F.filter(whole, lambda x: x.isNotNull())

    def back(s: Column, ends: Column) -> Column:
        # those that are no less when counted on are the same stretches, and stand there
        less = lambda x, b: (x["w"] >= min_words) & (x["w"] - F.get(s, b)["w"] >= min_words)
        at = lambda j: F.size(s) - 1 - j
        whole = _let(F.reverse(s), lambda r: F.transform(_stretches(r, min_words, print_words, -1), lambda x, j: F.when(less(x, at(j)), made(s, ends, at(j) - x["n"] + 1, x))))
        return F.filter(whole, lambda x: x.isNotNull())

    return _let(_lines(text), lambda s: _let(_stretches(s, min_words, print_words, 1), lambda ends: F.concat(on(s, ends), back(s, ends))))


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, print_words: int = PRINT_WORDS) -> DataFrame:
    """id, t, since, till: the first and last line (from 0) of each later repeated run of the text with the hash t; runs of a text do not meet."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("t"), _windows(whole, min_words, print_words).alias("s"))
    found = cut(rows.where(F.size("s") > 0))
    chosen = found.select(F.inline(F.array_distinct(F.transform("s", lambda x: F.struct(x["f"].alias("f"), x["i"].alias("i"))))))
    shared = chosen.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    near = cut(found.select("id", "t", F.inline("s")).join(shared, "f", "left_semi").select("h", "g", F.struct("id", "t", "since").alias("at"), "till"))
    first = near.groupBy("h", "g").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = near.join(first, ["h", "g"]).where(F.col("at") != F.col("first")).select("at.id", "at.t", "at.since", "till")
    order = Window.partitionBy("id", "t").orderBy("since", "till")
    apart = F.coalesce(F.col("since") > F.max("till").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = later.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("id", "t", "run").agg(F.min("since").alias("since"), F.max("till").alias("till")).drop("run")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with later repeated runs of lines deleted from `text`, and n_lines, n_deleted.

    Of equal runs the one at the smallest (id, line) stays; a run has at least
    min_words words.  Lines are told apart by two 64-bit hashes; blank lines
    neither make nor break a run, and stay.  A null or empty text, and a row
    with a null id, stays as it is.  Rows that repeat an id and a text lose the
    same lines; texts that share an id go by their hash.  Columns named n_lines
    or n_deleted are replaced.  An empty table gives no rows.
    """
    kept = df.drop("n_lines", "n_deleted")
    own, its, gone = unused(kept, "__id", "__t", "__gone")
    runs = repeated_runs(df, id_col, text, min_words, max(1, min_words // 2)).groupBy(F.col("id").alias(own), F.col("t").alias(its)).agg(F.sort_array(F.collect_list(F.struct("since", "till"))).alias(gone))
    rows = kept.join(runs, (kept[id_col] == runs[own]) & (F.xxhash64(kept[text].cast("string")) == runs[its]), "left")
    wordy = lambda x: F.rlike(x, F.lit(WORD))
    count = lambda lines: F.size(F.filter(lines, wordy)).cast("long")
    split = F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n", -1)

    def left(lines: Column) -> Column:
        """What stands between the runs, and the blank lines in them."""
        end = lambda k: F.when(k > 0, F.get(gone, k - 1)["till"] + 1).otherwise(0)
        parts = F.transform(gone, lambda run, k: F.concat(F.slice(lines, end(k) + 1, run["since"] - end(k)), F.filter(F.slice(lines, run["since"] + 1, run["till"] - run["since"] + 1), lambda x: ~wordy(x))))
        tail = F.element_at(gone, -1)["till"] + 1
        return F.concat(F.flatten(parts), F.slice(lines, tail + 1, F.greatest(F.size(lines) - tail, F.lit(0))))

    done = _let(split, lambda lines: F.when(F.col(gone).isNull(), F.struct(count(lines).alias("n"), count(lines).alias("left"), F.lit(None).cast("string").alias("text"))).otherwise(
        _let(left(lines), lambda rest: F.struct(count(lines).alias("n"), count(rest).alias("left"), F.array_join(rest, "\n").alias("text")))))
    (new,) = unused(rows, "__done")
    rows = rows.withColumn(new, done)
    values = {c: F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(F.col(new)["text"]).alias(c) if c == text else F.col(f"`{c}`") for c in kept.columns}
    return rows.select(*values.values(), F.col(new)["n"].alias("n_lines"), (F.col(new)["n"] - F.col(new)["left"]).alias("n_deleted"))
