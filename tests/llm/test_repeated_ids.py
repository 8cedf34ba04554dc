"""Ids that stand for several texts lose none of them, stage by stage; the mix against a plain walk along its schedule."""

from __future__ import annotations

import bisect
import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import exact_dedup, mixing, ngram_join

DOC = "doc_id long, text string, lang string, source string, n_chars long"
A = " ".join(f"a{k}" for k in range(60))
U = " ".join(f"u{k}" for k in range(40))


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOC)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


ROWS = [
    (3, A, "en", "s"), (5, U, "en", "s"), (5, A + " more", "en", "s"), (7, A + " x", "de", "s"), (7, "all alone", "en", "s"),
    (7, "all alone", "fr", "s"), (None, A, "en", "t"), (None, U + " y", "en", None), (8, None, "en", "s"), (8, "", "en", "s"), (-(1 << 63), "least of all", "en", "s"), ((1 << 63) - 1, U, "en", "s"), ((1 << 63) - 1, "most", "en", "s"),
]


def test_similar_texts_of_repeated_ids(spark):
    got = ngram_join.drop_similar(docs(spark, *ROWS))
    assert got.columns == docs(spark).columns
    want = [(3, A), (5, U), (7, "all alone"), (None, A), (None, U + " y"), (-(1 << 63), "least of all"), ((1 << 63) - 1, "most")]
    found = pairs(got)
    assert [p for p in found if p[0] != 8] == sorted(want, key=repr)
    assert len([p for p in found if p[0] == 8]) == 1 and pairs(got) == pairs(ngram_join.drop_similar(docs(spark, *reversed(ROWS)).repartition(3)))
    unique = [r for k, r in enumerate(ROWS) if k in (0, 1, 3, 6)]
    assert pairs(ngram_join.drop_similar(docs(spark, *unique))) == sorted([(3, A), (5, U), (None, A)], key=repr)
    assert ngram_join.drop_similar(docs(spark)).count() == 0


def test_one_of_rows_that_repeat_id_and_text(spark):
    """The same one on each run, however the rows are dealt."""
    rows = [(1, "x", lang, s) for lang in ("en", "de", "fr") for s in ("a", None, "b")] * 2
    for drop in (exact_dedup.drop_copies, ngram_join.drop_similar):
        kept = [drop(docs(spark, *order).repartition(n)).collect() for order, n in ((rows, 1), (rows[::-1], 4))]
        assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_mixed_counts_each_text_of_an_id(spark):
    rows = [(1, "a b c d", "en", "small"), (1, " ".join(f"w{k}" for k in range(900)), "en", "large"), *[(10 + k, f"x{k} " * 20, "en", "large") for k in range(40)], (2, "p q", "en", "small"), (2, "p q", "en", "small"), (None, "n n", "en", None), (None, "m", "en", None)]
    df = docs(spark, *rows)
    taken = mixing.mix(df).where("size > 0").groupBy("row_hash", "source").agg(F.sum(F.round(F.col("taken") / F.col("size"))).alias("n")).collect()
    known = {(r["h"], r["source"]): (r["doc_id"], r["text"], r["source"]) for r in df.select("*", mixing.row_hash("doc_id", "text", 7).alias("h")).collect()}
    want = collections.Counter({known[r["row_hash"], r["source"]]: int(r["n"]) for r in taken if r["n"]})
    got = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(df).collect())
    assert got == want and got[1, "a b c d", "small"] == 3 and got[1, rows[1][1], "large"] <= 1


def plain_walk(rows):
    """taken and first slot of each row of a source order, slot by slot."""
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    total = sum(r["size"] for r in rows)
    of = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["row_hash"], r["doc_id"], r["size"])) for s in sources}
    size = {s: of[s][0]["source_size"] for s in sources}
    blocks = {s: min(size[s], max(mixing.LEAST_BLOCKS, math.ceil(size[s] * mixing.SLOTS / total))) for s in sources}
    till = np.cumsum([of[s][0]["target"] * blocks[s] / size[s] if size[s] else 0.0 for s in sources])
    rank, times, first = collections.Counter(), collections.Counter(), {}
    for slot in range(math.ceil(till[-1])):
        k = bisect.bisect_right(till, slot * mixing.GOLDEN % 1.0 * till[-1])
        s = sources[k]
        if rank[s] < mixing.MOST * blocks[s]:
            b = rank[s] % blocks[s]
            times[s, b] += 1
            first.setdefault((s, b), slot)
        rank[s] += 1
    out = {}
    for s in sources:
        at = 0
        for r in of[s]:
            own = [(w * blocks[s] + blocks[s] - 1) // size[s] for w in range(at, at + r["size"])]
            at += r["size"]
            seen = [first[s, b] for b in own if (s, b) in first]
            out[r["doc_id"]] = (sum(times[s, b] for b in own), min(seen, default=None))
    return out


@pytest.mark.parametrize(("slots", "least", "few"), [(1 << 17, 1 << 11, 50_000), (400, 16, 50_000), (400, 16, 0)])
def test_mix_as_a_plain_walk(spark, slots, least, few, monkeypatch):
    """Each document's share and first slot; also with few slots, and where sources are too many to be broadcast."""
    for name, value in (("SLOTS", slots), ("LEAST_BLOCKS", least), ("FEW_SOURCES", few)):
        monkeypatch.setattr(mixing, name, value)
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 30))), "en", ["hot", "hot", "hot", "b", None, "c"][int(rng.integers(6))]) for k in range(150)]
    got = mixing.mix(docs(spark, *rows)).collect()
    assert {r["doc_id"]: (r["taken"], r["first_slot"]) for r in got} == plain_walk(got)


def test_five_stages_keep_every_text(spark, small):
    """Repeated ids with different texts through all stages; the stages' own decisions by brute force on this table."""
    import corpus_pipeline

    own = [f"{w} " * 7 + f"end{k}" for k, w in enumerate(("red", "green", "blue", "grey", "pink", "black"))]
    rows = [(k // 2, t, "en", "s") for k, t in enumerate(own)] + [(0, own[5], "en", "s"), (0, own[5], "en", "s"), (9, own[0] + " extra end words here", "en", "s"), (50, A, "en", "s"), (50, A + " z", "en", "s")]
    stages = dict(corpus_pipeline.STAGES)
    at = stages["toxicity"](spark, docs(spark, *rows), small)
    assert pairs(at) == sorted(((i, t) for i, t, _, _ in rows), key=repr)
    at = stages["exact_dedup"](spark, at, small)
    assert pairs(at) == sorted([*((k // 2, t) for k, t in enumerate(own)), (9, rows[8][1]), (50, A), (50, A + " z")], key=repr)
    at = stages["ngram_join"](spark, at, small)
    left = pairs(at)
    assert set(own) <= {t for _, t in left} and len([i for i, _ in left if i == 50]) == 1
    mixed = stages["mixing"](spark, at, small)
    assert collections.Counter(pairs(mixed)) == collections.Counter(left)  # one source: each text as often as it stands
    coded = stages["bpe"](spark, mixed, small)
    assert sorted(r["doc_id"] for r in coded.collect()) == sorted(i for i, _ in left)
