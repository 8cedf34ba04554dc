"""String normalisation and matching as Column expressions."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Fixed values.
ARTICLES = ("a", "an", "the")
EMPTY_SELECTION = ("none", "nothing", "no option", "no options", "n/a", "-")
PUNCTUATION = "[!-/:-@\\[-`{-~]"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out a single time, however often f names it: Spark shares nothing between expressions with lambdas."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


@F.pandas_udf(StringType())
def fold_marks(values: pd.Series) -> pd.Series:
    """NFKD without combining marks, in full; Spark has no built-in for it, and it cannot stand inside a higher-order function."""
    return values.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)), na_action="ignore")


@lru_cache(1)
def _fold_table() -> tuple[str, str]:
    """Characters whose NFKD form without marks is one other character, and the marks, which go."""
    plain, marks = {}, []
    for k in [*range(0x80, 0xD800), *range(0xF900, 0x10000)]:
        c = chr(k)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(folded) == 1 and folded != c:
            plain[c] = folded
    return "".join([*plain, *marks]), "".join(plain.values())


def normalize_text(x: Column, ascii_only: bool = False, full: bool = False) -> Column:
    """Lower case, marks dropped, punctuation to blanks, blanks collapsed; null gives an empty string.

    Marks go by a table that stays inside the JVM and leaves characters alone
    that decompose to several (ligatures, fractions); `full` folds those too,
    in an Arrow function; ascii_only folds none.
    """
    body = _text(x) if ascii_only else fold_marks(_text(x)) if full else F.translate(_text(x), *_fold_table())
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(body), PUNCTUATION, " "), "\\s+", " "))


def tokens(x: Column, ascii_only: bool = False) -> Column:
    """Words of the normalised text, without articles."""
    return F.filter(F.split(normalize_text(x, ascii_only), " "), lambda t: (t != "") & ~t.isin(*ARTICLES))


def normalize_answer(x: Column, ascii_only: bool = False) -> Column:
    return F.array_join(tokens(x, ascii_only), " ")


def exact_match(a: Column, b: Column, ascii_only: bool = False) -> Column:
    return (normalize_answer(a, ascii_only) == normalize_answer(b, ascii_only)).cast("double")


def any_exact_match(a: Column, many: Column, ascii_only: bool = False) -> Column:
    """1 if any of the references matches; an empty or null list gives 0."""
    own = normalize_answer(a, ascii_only)
    return F.coalesce(F.exists(many, lambda r: normalize_answer(r, ascii_only) == own), F.lit(False)).cast("double")


def contains_match(a: Column, b: Column, ascii_only: bool = False) -> Column:
    """1 if the normalised reference is a substring of the normalised prediction; an empty reference gives 0."""
    ref = normalize_answer(b, ascii_only)
    return ((ref != "") & F.contains(normalize_answer(a, ascii_only), ref)).cast("double")


def _numbered(words: Column) -> Column:
    """Words with their occurrence number, so that set functions count repeats."""
    ordered = F.array_sort(words)
    return F.transform(ordered, lambda t, i: F.concat(t, F.lit("\u0001"), (i - F.array_position(ordered, t).cast("int")).cast("string")))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of words; for short texts."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def token_prf(a: Column, b: Column, ascii_only: bool = False) -> Column:
    """Struct of precision, recall and f1 over bags of words; both empty gives 1, one empty 0.  Linear in the words of a row, and nothing is shuffled."""
    return once(_bags(tokens(a, ascii_only), tokens(b, ascii_only)), lambda n: prf_of_counts(n["both"], n["a"], n["b"]))


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("both", "a", "b")]))
def _bags(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Words that two bags share, and those of either; whole texts, a batch of rows at a time."""
    shared = [sum((Counter(x) & Counter(y)).values()) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"both": shared, "a": [len(x) for x in a], "b": [len(x) for x in b]}, dtype="int32")


def prf_of_counts(both: Column, n_pred: Column, n_ref: Column) -> Column:
    precision, recall = both / F.nullif(n_pred, F.lit(0)), both / F.nullif(n_ref, F.lit(0))
    empty = (n_pred == 0) | (n_ref == 0)
    even = (n_pred == n_ref).cast("double")
    f1 = F.when(both == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    part = lambda x: F.when(empty, even).when(both == 0, 0.0).otherwise(x)
    return F.struct(part(precision).alias("precision"), part(recall).alias("recall"), part(f1).alias("f1"))


def set_prf(pred: Column, gold: Column) -> Column:
    """Struct of precision, recall and f1 over sets; both empty gives 1, one empty 0."""
    sets = F.struct(F.array_distinct(pred).alias("p"), F.array_distinct(gold).alias("g"))
    sizes = once(sets, lambda s: F.struct(F.size(F.array_intersect(s["p"], s["g"])).alias("both"), F.size(s["p"]).alias("p"), F.size(s["g"]).alias("g")))
    return once(sizes, lambda n: prf_of_counts(n["both"], n["p"], n["g"]))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one number, in which a 0 stands where the length grows."""
    places: dict[str, int] = {}
    for k, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << k
    whole = (1 << len(b)) - 1
    row = whole
    for word in a:
        hit = row & places.get(word, 0)
        row = (row + hit | row - hit) & whole
    return len(b) - row.bit_count()


@F.pandas_udf(IntegerType())
def _lcs_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("both", "a", "b")]))
def _lcs_bags(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Length of the longest common subsequence, and the words of either side."""
    return pd.DataFrame({"both": [_lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], "a": a.map(len), "b": b.map(len)}, dtype="int32")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of words, 64 cells of the table at a time; null if either is."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(_lcs_lengths(a, b))


def rouge_l(a: Column, b: Column, beta: float = 1.2, ascii_only: bool = False) -> Column:
    """Struct of precision, recall and f from the longest common subsequence of words; an empty side gives 0."""

    def scores(n: Column) -> Column:
        precision, recall = n["both"] / F.nullif(n["a"], F.lit(0)), n["both"] / F.nullif(n["b"], F.lit(0))
        f = (1 + beta * beta) * precision * recall / F.nullif(recall + beta * beta * precision, F.lit(0.0))
        part = lambda x: F.coalesce(F.when(n["both"] > 0, x), F.lit(0.0))
        return F.struct(part(precision).alias("precision"), part(recall).alias("recall"), part(f).alias("f"))

    return once(_lcs_bags(tokens(a, ascii_only), tokens(b, ascii_only)), scores)


@lru_cache(None)
def _gram_bags(max_n: int) -> Callable[[Column, Column], Column]:
    kind = StructType([StructField("both", ArrayType(IntegerType())), StructField("a", IntegerType()), StructField("b", IntegerType())])

    @F.pandas_udf(kind)
    def bags(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        """Runs of 1 to max_n words that two texts share, repeats counted, and the words of either."""
        grams = lambda x, n: Counter(zip(*[x[k:] for k in range(n)], strict=False))
        shared = [[sum((grams(x, n) & grams(y, n)).values()) for n in range(1, max_n + 1)] for x, y in zip(map(list, a), map(list, b), strict=True)]
        return pd.DataFrame({"both": shared, "a": a.map(len).astype("int32"), "b": b.map(len).astype("int32")})

    return bags


def bleu(a: Column, b: Column, max_n: int = 4, ascii_only: bool = False) -> Column:
    """Sentence BLEU with add-one smoothing; orders longer than the prediction are skipped, an empty side gives 0."""

    def score(m: Column) -> Column:
        total, used = F.lit(0.0), F.lit(0)
        for n in range(1, max_n + 1):
            there = m["a"] >= n
            total = total + F.when(there, F.log((m["both"][n - 1] + 1.0) / (m["a"] - n + 2.0))).otherwise(0.0)
            used = used + there.cast("int")
        brevity = F.exp(F.least(F.lit(0.0), 1 - m["b"] / F.nullif(m["a"], F.lit(0))))
        return F.when((m["a"] == 0) | (m["b"] == 0), 0.0).otherwise(F.exp(total / F.nullif(used, F.lit(0))) * brevity)

    return once(_gram_bags(max_n)(tokens(a, ascii_only), tokens(b, ascii_only)), score)


def normalize_whitespace(x: Column) -> Column:
    """Three or more line ends become two, runs of blanks one."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def as_list(x: Column) -> Column:
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x.cast("string")))


def letter_labels(n: Column, start: str = "A") -> Column:
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.char(i + ord(start))))


def number_labels(n: Column) -> Column:
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: i.cast("string")))


def stable_id(*parts: Column) -> Column:
    """Parts that are not empty joined by '-', unsafe runs to '_', 120 characters at the most."""
    joined = F.concat_ws("-", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])
    return F.left(F.regexp_replace(joined, "[^A-Za-z0-9._-]+", "_"), F.lit(120))


def stable_hash(x: Column, length: int = 16) -> Column:
    return F.left(F.sha2(x, 256), F.lit(length))


def clip_words(x: Column, limit: int) -> Column:
    """The first words, and how many were left out."""
    words = F.filter(F.split(_text(x), "\\s+"), lambda w: w != "")
    more = F.size(words) - limit
    return F.when(more <= 0, x).otherwise(F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit(" [... "), more.cast("string"), F.lit(" more words omitted]")))


def clip(x: Column, limit: int, marker: str = "...[clipped]") -> Column:
    return F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(limit)), F.lit(marker))).otherwise(x)


def label_variants(x: Column) -> Column:
    """A label with underscores as they are, as hyphens and as blanks."""
    low = F.lower(_text(x))
    return F.array_distinct(F.array(low, F.replace(low, F.lit("_"), F.lit("-")), F.replace(F.replace(low, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))))


def any_contains(x: Column, variants: Column) -> Column:
    return F.coalesce(F.exists(variants, lambda v: F.contains(F.lower(x), F.lower(v))), F.lit(False)).cast("double")


def parenthetical_forms(x: Column) -> Column:
    """What stands before the first '(' and between it and the last ')'."""
    inner = F.regexp_extract(x, "^([^(]*)\\((.*)\\)", 2)
    outer = F.regexp_extract(x, "^([^(]*)\\(", 1)
    return F.filter(F.transform(F.array(outer, inner), lambda v: F.trim(v)), lambda v: v != "")


def numbered_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def split_statements(x: Column, least: int = 4, most: int = 12) -> Column:
    """Pieces between numbers like '3.' or '3)', of at least `least` words, the first `most`."""
    pieces = F.transform(F.split(_text(x), "(?:^|\\s)\\d+[.)]\\s+"), lambda p: F.trim(p))
    return F.slice(F.filter(pieces, lambda p: F.size(F.filter(F.split(p, "\\s+"), lambda w: w != "")) >= least), 1, most)


def grounded(span: Column, source: Column, share: float = 0.8) -> Column:
    """Is a span in its source: as a substring, or with 80 % of its word 4-grams; of fewer than four words, all of them.  ASCII folding."""
    fold = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(_text(x)), "[*_`#]", ""), "\\s+", " "))
    s, t = fold(span), fold(source)
    words, there = F.split(s, " "), F.split(t, " ")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 3, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 4), " "))
    mine, its = grams(words), grams(there)
    few = F.forall(words, lambda w: F.array_contains(there, w))
    many = F.size(F.filter(mine, lambda g: F.array_contains(its, g))) >= share * F.size(mine)
    return (s != "") & (F.contains(t, s) | F.when(F.size(words) < 4, few).otherwise(many))
