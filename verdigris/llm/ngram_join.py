"""Jaccard self-join on sets of word n-grams, by rare-first prefixes.

Each document's set is ordered by how often its shingles occur in the corpus,
rarest first.  Two sets with a high Jaccard similarity must share a shingle in
their prefixes (the smaller one in its shorter prefix), so prefixes are joined;
the join itself filters by length, by position (what may follow a first shared
shingle there) and by suffix (a Hamming bound from parities per hash range),
and each pair that is left is verified once, exactly, from the two texts.

Equal sets form a class and one member stands for it.  A prefix group does not
emit all its pairs: its members are first held against one hub each, again with
other hubs while many pairs would be left, and pairs that are already known to
be in one component take no part in the full join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from verdigris.llm.common import cut, one_of_each, text_batches, unused
from verdigris.llm.components import components
from verdigris.llm.words import Texts, U, join_hashes, mix, slices, strings

#: Counters of the corpus-wide frequency sketch, and pieces that it is summed in.
COUNTERS, PIECES = 1 << 18, 64
#: Columns of the suffix filter: the parity of the shingle counts in 64 hash ranges each, a bit a range.
PARITY = tuple(f"p{k}" for k in range(8))
#: Pairs that are broadcast to fetch texts for verification at the most; beyond, texts are joined by a shuffle.
FEW_PAIRS = 150_000
#: Rows with an equal in the table that are broadcast to leave them out at the most.
FEW_EQUALS = 150_000
#: Comparisons to a posted row that the join of all pairs may cost; while it would cost more, groups are held against another hub.
WORK = 64
#: Bytes and pairs of texts that are verified together (one pair at the least).
PAIR_BYTES, PAIRS = 1 << 22, 64


def _grams(t: Texts, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of each `size` words in sequence."""
    words = t.word_hashes(salt)
    return words, join_hashes(*[words[k : len(words) - size + 1 + k] for k in range(size)]) if len(words) >= size else words[:0]


def _short(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text with few words."""
    return mix(join_hashes(*[words[k : k + 1] for k in range(len(words))]) + U(len(words)))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than size make one shingle, none make none."""
    t = Texts(column)
    words, grams = _grams(t, size, 0)
    out = []
    for k in range(t.n):
        a, b = t.first[k], t.first[k + 1]
        if b - a >= size:
            got = np.sort(grams[a : b - size + 1])
            keep = np.ones(len(got), bool)
            keep[1:] = got[1:] != got[:-1]
            out.append(got[keep])
        else:
            out.append(_short(words[a:b]) if b > a else words[:0])
    return out


def shingle_sets_twice(column: pa.Array, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same with a second hash of each shingle, in the order of the first."""
    t = Texts(column)
    (words, grams), (words2, grams2) = _grams(t, size, 0), _grams(t, size, 1)
    out = []
    for k in range(t.n):
        a, b = t.first[k], t.first[k + 1]
        if b - a >= size:
            got = grams[a : b - size + 1]
            order = np.argsort(got)
            got = got[order]
            keep = np.ones(len(got), bool)
            keep[1:] = got[1:] != got[:-1]
            out.append((got[keep], grams2[a + order[keep]]))
        elif b > a:
            out.append((_short(words[a:b]), _short(words2[a:b])))
        else:
            out.append((words[:0], words[:0]))
    return out


def exact_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as numbers that are equal, within this column, only for equal words."""
    t = Texts(column)
    words = t.word_numbers()
    n, kinds = len(words), int(words.max(initial=0)) + 1
    grams = words[: max(n - size + 1, 0)]
    for k in range(1, size if len(grams) else 0):
        # numbered anew after each word, so that they stay below the number of words
        grams = pa.array(grams * kinds + words[k : n - size + 1 + k]).dictionary_encode().indices.to_numpy().astype(np.int64)
    short: dict[tuple, int] = {}
    out = []
    for k in range(t.n):
        a, b = t.first[k], t.first[k + 1]
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(words[a:b].tolist()), len(short))] if b > a else [], np.int64))
    return out


def _texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    # ids are 64-bit numbers, or decimals where a key needs more
    own = F.col(f"`{id_col}`")
    own = own if isinstance(df.schema[id_col].dataType, DecimalType) else own.cast("long")
    return df.select(own.alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def _kind(texts: DataFrame) -> str:
    return texts.schema["id"].dataType.simpleString()


def frequency_sketch(texts: DataFrame, size: int) -> np.ndarray:
    """How often shingles fall on each of COUNTERS counters, over all texts.

    Tasks count for themselves; their counts are summed piece by piece in two
    steps.  What reaches the driver has the same size for any corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salt = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            column = strings(batch.column(0))
            for a, b in slices(column):
                for s in shingle_sets(column.slice(a, b - a), size):
                    salt ^= int(s[0]) if len(s) else 0
                    total += np.bincount((s & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS) if len(s) > COUNTERS // 8 else 0
                    if len(s) <= COUNTERS // 8:
                        np.add.at(total, (s & U(COUNTERS - 1)).astype(np.int64), 1)
        parts = total.reshape(PIECES, -1)
        packed = [zlib.compress(p.astype("<i8").tobytes(), 1) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([salt % 64] * PIECES, pa.int32()), pa.array(packed, pa.binary())], ["piece", "salt", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["counts"])
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "salt": pdf["salt"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "piece int, salt int, counts binary"
    found = texts.select("text").mapInArrow(count, kind).groupBy("piece", "salt").applyInPandas(add, kind).groupBy("piece").applyInPandas(add, kind).collect()
    out = np.zeros((PIECES, COUNTERS // PIECES), np.int64)
    for row in found:
        out[row["piece"]] = np.frombuffer(zlib.decompress(bytes(row["counts"])), "<i8")
    return out.ravel()


def _prefixes(texts: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """Each document's set in short: its size, a 128-bit fingerprint, its prefix in rare-first order, parities."""
    # 16 bits of a float keep the order of any count; below them stands the hash itself
    sent = texts.sparkSession.sparkContext.broadcast((sketch.astype(np.float32).view(np.uint32) >> 16).astype(np.uint16))
    bits = 64 * len(PARITY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value.astype(U) << U(48)
        for batch in batches:
            column = strings(batch.column(1))
            for a, b in slices(column):
                sets = shingle_sets_twice(column.slice(a, b - a), size)
                first, second, prefix, odd, last = [], [], [], [], []
                for s, s2 in sets:
                    first.append(np.sum(mix(s ^ U(0xA5A5A5A5A5A5A5A5))).view(np.int64))
                    second.append(np.sum(mix(s2 + U(0x0F0F0F0F0F0F0F0F))).view(np.int64))
                    n = len(s)
                    take = n - -(-percent * n // 100) + 1 if n else 0
                    key = rank[(s & U(COUNTERS - 1)).astype(np.int64)] | s >> U(16)
                    order = np.argsort(key, kind="stable")[:take]
                    prefix.append(s[order].view(np.int64))
                    last.append(int(key[order[-1]]) >> 32 if n else 0)
                    odd.append(np.packbits(np.bincount((s >> U(55)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view("<i8"))
                parity = np.array(odd, np.int64).reshape(-1, len(PARITY))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([len(s) for s, _ in sets], pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                        pa.array(prefix, pa.list_(pa.int64())), pa.array(last, pa.int64()), *[pa.array(parity[:, k]) for k in range(len(PARITY))],
                    ],
                    ["id", "n", "f1", "f2", "prefix", "last", *PARITY],
                )

    return texts.mapInArrow(run, f"id {_kind(texts)}, n bigint, f1 bigint, f2 bigint, prefix array<bigint>, last bigint" + "".join(f", {c} bigint" for c in PARITY))


def _least_overlap(percent: int) -> Column:
    """The overlap that a pair with sizes na and nb must have."""
    return F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))


def _rest(percent: int) -> Column:
    """What of a set of n shingles lies after its prefix."""
    return F.ceil(F.col("n") * percent / 100) - 1


def _short_prefix(percent: int) -> Column:
    """As much of a set's prefix as it must share with a set that is no smaller."""
    return F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1


def _may_link(percent: int) -> Column:
    """Length filter."""
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _may_overlap(percent: int) -> Column:
    """Position filter on the first shingle that two sets share in rare-first order.

    o counts what of a set may follow from there: the rest after the prefix,
    and the prefix shingles from this place on that some other prefix has.  All
    of a prefix that ends first lies within the other's prefix or nowhere in the
    other set, so the bound that comes from that prefix holds.  At a later
    shared shingle the bound may fail; at the first it holds for all that link.
    """
    bound = F.when(F.col("la") < F.col("lb"), F.col("oa")).when(F.col("lb") < F.col("la"), F.col("ob")).otherwise(F.greatest("oa", "ob"))
    return bound >= _least_overlap(percent)


def _suffix_may(percent: int) -> Column:
    """Suffix filter: where parities of counts differ, the sets differ by one shingle at the least."""
    apart = F.lit(0)
    for c in PARITY:
        apart = apart + F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b")))
    return F.col("na") + F.col("nb") - apart >= 2 * _least_overlap(percent)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, from the words of their texts."""
    pairs = cut(pairs.select("a", "b"))
    n = pairs.count()
    if n == 0:
        return pairs
    if n <= FEW_PAIRS:
        one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(F.broadcast(pairs), "a")
        two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        both = one.join(two, "b").select("a", "b", "ta", "tb")
    else:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = texts.join(ids, "id", "left_semi")
        both = pairs.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.cumsum(sum(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3)))
            at = 0
            while at < batch.num_rows:
                before = weight[at - 1] if at else 0
                end = min(at + PAIRS, max(at + 1, int(np.searchsorted(weight, before + PAIR_BYTES, "right"))))
                part = batch.slice(at, end - at)
                one, two = part.column(2).to_pylist(), part.column(3).to_pylist()
                known = dict.fromkeys([*one, *two])
                known = dict(zip(known, exact_sets(pa.array(list(known), pa.string()), size), strict=True))
                keep = []
                for x, y in zip(one, two, strict=True):
                    x, y = known[x], known[y]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(len(x)) and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep))
                at = end

    return both.mapInArrow(run, f"a {_kind(texts)}, b {_kind(texts)}").distinct()


def _against_hubs(posted: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Of each row of prefix groups the pair (a, b) that shares most with a hub of its groups, if filters let it pass.

    Members of a group are kept apart by length; the hub of each part is the
    member with the largest share of prefix shingles that others have too.
    """
    band = F.floor(F.log("n") / -np.log(percent / 100)) if percent < 100 else F.col("n")
    names = (("n", "n"), ("o", "o"), ("last", "l"), ("component", "k"))
    banded = posted.withColumn("band", band)
    draw = F.struct((F.col("all") / F.col("n")).alias("share"), (-F.col("id")).alias("low"), "id", *[c for c, _ in names])
    hubs = banded.groupBy("token", "band").agg(F.max(draw).alias("hub"), F.count("*").alias("__many")).where("__many > 1")
    hubs = hubs.select("token", "band", F.col("hub.id").alias("b"), *[F.col(f"hub.{c}").alias(f"{short}b") for c, short in names])
    near = banded.select("token", "band", F.col("id").alias("a"), *[F.col(c).alias(f"{short}a") for c, short in names]).join(hubs, ["token", "band"])
    near = near.where((F.col("ka") != F.col("kb")) & _may_link(percent)).groupBy("a", "b").agg(F.count("*").alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max(_may_overlap(percent)).alias("may"))
    best = near.where("may").groupBy("a").agg(F.max(F.struct("c", "b", "na", "nb")).alias("x")).select("a", "x.b", "x.na", "x.nb")
    odd = lambda x: heads.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in PARITY])
    return best.join(odd("a"), "a").join(odd("b"), "b").where(_suffix_may(percent)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def ngram_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Each row's set size and component: id_col, n_shingles, component_id.

    A set holds the distinct shingles of `size` words of the whole text, with
    A-Z lower-cased; fewer words make one shingle; a text without words, empty
    or null has an empty set, links with nothing and is its own component.
    Sets link when 100 * intersection >= percent * union.  component_id is the
    smallest id that links reach, the row's own included.  Rows with a null id
    link only with their equals.  Ids are keys: where rows repeat an id, the
    links of each count for all of them.  Other columns are left out; an empty
    table gives no rows.  Pairs are verified by the bytes of their words; equal
sets are found by 128-bit fingerprints, and a set's shingles are counted by
64-bit hashes.
    """
    text_batches(df.sparkSession)
    texts = _texts(df, id_col, text)
    sketch = frequency_sketch(texts, size)
    sets = cut(_prefixes(texts, sketch, size, percent))
    some = sets.where("n > 0")
    classes = cut(some.groupBy("f1", "f2", "n").agg(F.min("id").alias("rid")))
    # one row stands for each class; the others are few enough to be sent, or meet their class by a shuffle
    equals = some.groupBy("f1", "f2", "n").agg(F.count("*").alias("__many")).where("__many > 1").select("f1", "f2", "n")
    others = cut(some.select("id", "f1", "f2", "n").join(equals, ["f1", "f2", "n"]).join(classes, ["f1", "f2", "n"]).where(~F.col("id").eqNullSafe(F.col("rid"))).select("id", "f1", "f2").distinct())
    heads = some.where("id IS NOT NULL").join(F.broadcast(others) if others.count() <= FEW_EQUALS else others, ["id", "f1", "f2"], "left_anti")

    posted = heads.select("id", F.posexplode("prefix").alias("pos", "token"))
    often = posted.groupBy("token").agg(F.count("*").alias("__many")).where("__many > 1").select("token")
    posted = posted.join(often, "token", "left_semi")
    posted = posted.withColumn("all", F.count("*").over(Window.partitionBy("id"))).withColumn("s", F.count("*").over(Window.partitionBy("id").orderBy(F.desc("pos"))))
    posted = posted.join(heads.select("id", "n", "last"), "id")
    posted = cut(posted.select("token", "id", "n", (_rest(percent) + F.col("s")).alias("o"), "last", "all", (F.col("pos") < _short_prefix(percent)).alias("short")))

    # groups against hubs, for as long as that halves the cost of the join of all pairs
    links = found = before = None
    rows = posted.count()
    while True:
        known = posted.withColumn("component", F.col("id")) if found is None else posted.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        counts = known.groupBy("token", "component").agg(F.count("*").alias("__many"), F.max("short").alias("short"))
        mixed = counts.groupBy("token").agg(F.max(F.struct("__many", "component")).alias("top"), F.sum("__many").alias("__all"), F.count("*").alias("__kinds"), F.max("short").alias("short")).where("__kinds > 1 AND short")
        mixed = cut(mixed.select("token", F.col("top.component").alias("main"), ((F.col("__all") - F.col("top.__many")) * F.col("__all")).alias("work")))
        known = known.join(mixed.drop("work"), "token").withColumn("main", F.col("component") == F.col("main"))
        work = mixed.agg(F.sum("work")).first()[0] or 0
        if found is not None and (work <= WORK * rows or 2 * work > before):
            break
        before = work
        better = cut(_verified(_against_hubs(known if found is None else known.where("NOT main"), heads, percent), texts, size, percent))
        links = better if links is None else links.unionByName(better)
        found = cut(components(links).withColumnRenamed("node", "id"))

    # all pairs of a prefix group whose components differ: its commonest component is held only against the others
    names = (("n", "n"), ("o", "o"), ("last", "l"), *[(c, c) for c in PARITY])
    known = cut(known.join(heads.select("id", *PARITY), "id").select("token", "id", "short", *[c for c, _ in names], "component", "main"))
    sides = lambda x: [F.col(c).alias(f"{short}{x}") for c, short in (("id", ""), ("component", "k"), ("short", "short"), *names)]
    one, two = known.where("NOT main").select("token", *sides("a")), known.select("token", *sides("b"), "main")
    smaller = F.when(F.struct("na", "a") < F.struct("nb", "b"), F.col("shorta")).otherwise(F.col("shortb"))
    once = F.col("main") | (F.col("a") < F.col("b"))
    pairs = one.join(two, "token").where((F.col("ka") != F.col("kb")) & once & smaller & _may_link(percent) & _may_overlap(percent) & _suffix_may(percent))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    good = _verified(pairs, texts, size, percent)
    found = components(links.unionByName(good)).withColumnRenamed("node", "rid")

    classes = classes.join(found, "rid", "left").select("f1", "f2", "n", F.coalesce("component", "rid").alias("component_id"))
    linked = some.join(classes, ["f1", "f2", "n"]).select("id", "n", "component_id")
    alone = sets.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, with all their columns: of each component of similar texts the one with the smallest id.

    A null id is never another's copy, so its row stays.  Where rows repeat an
    id, each text of it is a document of its own, told apart by 60 bits of its
    sha256, which also say which of an id's own similar texts is the smallest;
    of rows that repeat both id and text one stays, the one whose hash of all
    columns is the least.  An empty table gives no rows.
    """
    own = F.col(f"`{id_col}`")
    again = df.where(own.isNotNull()).groupBy(own.alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    if not again.limit(1).count():
        found = ngram_components(df, id_col, text, size, percent)
        goes = found.where(F.col(id_col) != F.col("component_id")).select(id_col)
        return df.join(goes, id_col, "left_anti").select(*df.columns)
    (key,) = unused(df, "__key")
    part = F.conv(F.substring(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256), 1, 15), 16, 10)
    # a 64-bit id and 60 bits behind it
    keyed = df.withColumn(key, (own.cast("decimal(19,0)") * F.lit(10**18 * 2).cast("decimal(19,0)") + part.cast("decimal(19,0)")).cast("decimal(38,0)"))
    found = ngram_components(keyed, key, text, size, percent)
    left = keyed.join(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), key, "left_anti").select(*keyed.columns)
    repeated = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    once = left.join(repeated, key, "left_anti").select(*keyed.columns)
    return once.unionByName(one_of_each(left.join(repeated, key, "left_semi").select(*keyed.columns), key)).drop(key)
