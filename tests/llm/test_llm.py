"""Each operator on edge rows, and against a brute-force version."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigris.llm import bpe, chat, components, exact_dedup, licences, line_dedup, mixing, ngram_join, quality, queries, topk, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, hits string, size string, n_tokens string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}" for k in range(30_000))


def docs(spark, *rows):
    """Documents with extra columns whose names clash with what operators add."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "q") for i, t, s in rows], DOC)


def edge(spark):
    return docs(spark, (1, "one two three\nfour", "a"), (2, None, "b"), (3, "", None), (4, " \n\t", "a"), (5, LONG, "b"), (6, "one two three\nfour", "a"), (None, "lost", None), (7, "日本 é ü", "a"))


@pytest.fixture(scope="module")
def real(small):
    return duckdb.connect().sql(f"select doc_id, text from '{small}/documents.parquet' order by 1").fetchall()


# ------------------------------------------------------------------ 1


@pytest.fixture(scope="module")
def automaton():
    return bpe.compile_tokenizer(queries.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_as_the_library(automaton, library, real):
    odd = ["", " ", "a  b", "\n \n x", "it's I'LL 've", "aaaaaaaa" * 9, "<|endoftext|>x<|endoftext|>", "日本語 テスト", "🙂👩‍👩‍👧", "é    x", "\x1c\x1d a", "12 345.6", " lead", "trail ", "\u0085b"]
    rng = np.random.default_rng(3)
    odd += ["".join(rng.choice(list("ab\n 'st\té.1"), 30)) for _ in range(300)]
    odd += ["".join(rng.choice(list("ab \u3000é\t日<"), 30)) for _ in range(300)] + ["a" * 9000, "\n", "x ", " x", "a\u3000 b", "a \u3000b", "x\n\n", "y\n\n\nz\t\tq", "\n\n\n", "\n\nk", "l\r\n\r\n"]
    texts = [*odd, *[t or "" for _, t in real]]
    ids, first = automaton.encode_all(pa.array(texts))
    back = automaton.decode_all(ids, first).to_pylist()
    for k, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[first[k] : first[k + 1]].tolist() == want == automaton.encode(text).tolist()
        assert back[k] == automaton.decode(np.array(want, "<u4")) == library.decode(want, skip_special_tokens=False) == text
    broken = np.array([library.encode("é").ids[0], *library.encode("日").ids], "<u4")[[0, -1]]
    assert automaton.decode_all(broken, np.array([0, 1, 2])).to_pylist() == [automaton.decode(broken[:1]), automaton.decode(broken[1:])]


def test_bpe_tables_that_fill_up(automaton, library, real, monkeypatch):
    """With little room tables start anew, and nothing else changes."""
    monkeypatch.setattr(bpe, "MEMO", 50)
    small = bpe.compile_tokenizer(queries.tokenizer_path())
    for _, text in real[:20]:
        assert small.encode(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_bpe_edges(spark):
    got = {r["doc_id"]: r for r in bpe.encode_documents(edge(spark), queries.tokenizer_path()).collect()}
    assert got[2]["n_tokens"] == 0 and got[2]["decoded"] == "" and bytes(got[2]["ids"]) == b""
    assert got[5]["decoded"] == LONG and got[None]["decoded"] == "lost" and bytes(got[1]["ids"]) == bytes(got[6]["ids"])
    assert bpe.encode_documents(docs(spark), queries.tokenizer_path()).count() == 0


# ------------------------------------------------------------------ 2


def test_perspectives(spark):
    df = spark.createDataFrame([(1, 0, "system", "s", 9), (1, 1, "ann", "hi <|im_end|>", 9), (1, 2, "bob", None, 9), (1, 2, "bob", None, 9), (1, 3, None, "?", 9), (None, 0, "ann", "lost", 9), (2, 0, "system", "alone", 9)], "conv_id int, turn int, role string, text string, masks int")
    got = {r["speaker"]: r for r in chat.perspectives(df).collect()}
    assert set(got) == {"ann", "bob", "unknown"}
    assert got["ann"]["n_turns"] == 5
    for name, r in got.items():
        said = [r["rendered"][m["begin"] : m["end"]] for m in r["masks"]]
        assert said == {"ann": ["hi <\\|im_end|><|im_end|>"], "bob": ["<|im_end|>"] * 2, "unknown": ["?<|im_end|>"]}[name]
    assert got["bob"]["rendered"].startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>user name=ann\n")
    assert chat.perspectives(df.limit(0)).count() == 0


def test_perspectives_of_very_long_turns(spark):
    df = spark.createDataFrame([(1, 0, "ann", LONG), (1, 1, "bob", LONG + "!"), (1, 2, "ann", "x")], "conv_id int, turn int, role string, text string")
    got = {r["speaker"]: r for r in chat.perspectives(df).collect()}
    said = {who: [r["rendered"][m["begin"] : m["end"]] for m in r["masks"]] for who, r in got.items()}
    assert said == {"ann": [LONG + "<|im_end|>", "x<|im_end|>"], "bob": [LONG + "!<|im_end|>"]}


# ------------------------------------------------------------------ 3


@pytest.mark.parametrize(("weak", "few"), [(False, 500_000), (True, 500_000), (False, 0), (True, 0)])
def test_exact_groups(spark, real, weak, few, monkeypatch):
    """Also where hashes collide: a hash of four bits leaves it to the comparison of bytes."""
    monkeypatch.setattr(exact_dedup, "FEW", few)
    rows = [(i, t, "s") for i, t in real] + [(10_000 + k, t, "s") for k, (_, t) in enumerate(real[:50])] + [(20_000, None, "s"), (20_001, "", "s")]
    extra = {"content_hash": lambda c: F.substring(F.md5(c), 1, 1)} if weak else {}
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs(spark, *rows), keep="max", **extra).collect()}
    groups: dict[str, list[int]] = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for text, members in groups.items():
        for i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(members), len(members), i == max(members), hashlib.sha256(text.encode()).hexdigest())


def test_exact_edges(spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(edge(spark)).collect()}
    assert got[6]["keep_id"] == 1 and got[3]["keep_id"] == 2 and got[None]["kept"] and got[None]["keep_id"] is None
    twice = edge(spark).unionByName(edge(spark))
    kept = exact_dedup.drop_copies(twice)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 7] and kept.columns == twice.columns
    assert exact_dedup.exact_groups(docs(spark)).count() == 0


def test_drop_copies_by_id_and_text(spark):
    rows = [(None, "lost", "a"), (None, "found", "a"), (None, "found", "b"), (None, "has one", "a"), (1, "has one", "a"), (2, "p", "a"), (2, "q", "a"), (3, "q", "a"), (2, "r", "a"), (4, None, "a"), (4, "", "a")]
    for keep, q in (("min", 2), ("max", 3)):
        got = exact_dedup.drop_copies(docs(spark, *rows), keep=keep).collect()
        want = [(None, "lost"), (None, "found"), (1, "has one"), (2, "p"), (q, "q"), (2, "r"), (4, "")]
        assert sorted(((r["doc_id"], r["text"] or "") for r in got), key=repr) == sorted(want, key=repr)


OWN = ["__id", "__text", "__hash", "__sha256", "__kept", "__gone", "__t", "__often", "__copy", "__label"]


def test_columns_named_like_the_operators_own(spark):
    """A table may hold any name that an operator uses inside."""
    df = edge(spark)
    for c in OWN:
        df = df.withColumn(c, F.lit(f"user's {c}"))
    y = spark.createDataFrame([(1, 0, 1), (6, 1, 0), (5, 1, 1)], "doc_id long, toxic int, quality int").withColumn("__id", F.lit(3)).withColumn("__label", F.lit(3))
    found = [exact_dedup.drop_copies(df), line_dedup.line_dedup(df), mixing.mixed(df), toxicity.score_toxicity(df, toxicity.learn(df, y)), quality.score_quality(df, quality.learn(df, y))]
    for got in found:
        rows = got.collect()
        assert rows and all(r[c] == f"user's {c}" for r in rows for c in OWN)
    assert exact_dedup.exact_groups(df).count() == mixing.mix(df).count() == ngram_join.ngram_components(df).count() == 8


# ------------------------------------------------------------------ 4


def shared_out(sizes: dict, weights: dict) -> dict:
    """Targets by sharing again and again."""
    total, capped = sum(sizes.values()), set()
    while True:
        left, weight = total - sum(3 * sizes[s] for s in capped), sum(weights[s] for s in sizes if s not in capped)
        out = {s: 3 * sizes[s] if s in capped else left * weights[s] / weight for s in sizes}
        more = {s for s in sizes if s not in capped and out[s] > 3 * sizes[s]}
        if not more:
            return out
        capped |= more


def test_mix(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 60))), ["hot", "b", "tiny", None, "c"][int(rng.choice(5, p=[0.6, 0.2, 0.02, 0.08, 0.1]))]) for k in range(900)]
    rows += [(900, None, "b"), (901, LONG, "hot")]
    df = docs(spark, *rows)
    got = mixing.mix(df).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(902))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    sizes = {s: sum(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in names}
    want = shared_out(sizes, {s: k % 3 + 1 for k, s in enumerate(names)})
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"] for r in mine)
        assert sum(r["taken"] for r in mine) == pytest.approx(want[s], rel=0.02, abs=3)
    again = mixing.mix(df.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}


def test_mix_many_sources(spark):
    """More sources than slots of a cell: each still gets near its target."""
    rows = [(k, " ".join(["w"] * (3 + k % 7)), f"s{k % 300:03}") for k in range(1500)]
    got = mixing.mix(docs(spark, *rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 300 and all(abs(r["taken"] - r["target"]) <= 3 for r in got)


def test_mix_edges(spark):
    got = {r["doc_id"]: r for r in mixing.mix(edge(spark)).collect()}
    assert len(got) == 8 and got[2]["taken"] == got[4]["taken"] == 0 and all(r["taken"] <= 3 * r["size"] for r in got.values())
    assert mixing.mix(docs(spark)).count() == 0
    assert mixing.mix(docs(spark, (1, None, "a"), (2, "", None))).agg(F.sum("taken")).first()[0] == 0
    twice = docs(spark, (1, "a b", "s"), (1, "a b", "s"), (2, "c", "t"))
    assert mixing.mix(twice).count() == 3
    assert mixing.mixed(twice).columns == twice.columns


# ------------------------------------------------------------------ 5


def linked(rows, size, percent):
    """Sets and components by comparing all pairs."""
    low = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent", "limits"), [(3, 90, {}), (5, 80, {}), (5, 80, {"FEW_PAIRS": 0, "FEW_EQUALS": 0, "WORK": 0, "PAIR_BYTES": 1})])
def test_ngram_components(spark, real, size, percent, limits, monkeypatch):
    """With each limit on either side of what is there."""
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(size)
    base = (real[0][1] or "").split(" ")[:300]
    rows = list(real)
    for k in range(120):  # near copies with more and more changed words
        words = list(base)
        for at in rng.integers(0, len(words), k // 6):
            words[at] = f"x{rng.integers(1e9)}"
        rows.append((5_000 + k, " ".join(words)))
    rows += [(9_000, "Two Words"), (9_001, "two  words"), (9_002, None), (9_003, ""), (9_004, LONG), (9_005, LONG + " more")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs(spark, *[(i, t, "s") for i, t in rows]), size=size, percent=percent).collect()}
    assert got == linked(rows, size, percent)


def thue_morse(n):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_ngram_words_that_fool_polynomials(spark):
    one, two = thue_morse(2048)
    rows = [(1, one), (2, two), (3, f"{one} x y z"), (4, f"{two} x y z"), (5, " ".join([one, two] * 9)), (6, " ".join([two, one] * 9))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs(spark, *[(i, t, "s") for i, t in rows]), size=3, percent=90).collect()}
    assert got == linked(rows, 3, 90)
    sets = ngram_join.exact_sets(pa.array([one, two, "A b", "a  B", "a", "", f"{one} {two} {one} {two}"]), 3)
    assert len({s.tobytes() for s in sets}) == 6 and sets[2].tolist() == sets[3].tolist() and [len(s) for s in sets] == [1, 1, 1, 1, 1, 0, 2]


def test_ngram_candidates_grow_in_proportion(spark, monkeypatch):
    """Near copies of one text that are too far apart to link: few of their pairs are verified."""
    counted = []
    verify = ngram_join._verified

    def counting(pairs, *rest):
        counted.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counting)
    rng, made = np.random.default_rng(8), {}
    base = [f"b{k}" for k in range(400)]
    for many in (60, 300):
        rows = []
        for k in range(many):
            words = list(base)
            for at in rng.choice(400, 10, replace=False):
                words[at] = f"n{k}_{at}"
            rows.append((k, " ".join(words)))
        counted.clear()
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs(spark, *[(i, t, "s") for i, t in rows]), size=3, percent=90).collect()}
        assert got == linked(rows, 3, 90)
        made[many] = sum(counted)
    assert made[300] <= 5 * max(made[60], 60)


def test_ngram_edges(spark):
    twice = edge(spark).unionByName(edge(spark))
    got = ngram_join.ngram_components(twice).collect()
    assert len(got) == 16 and {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (6, 1), (2, 2), (3, 3), (4, 4), (5, 5), (7, 7), (None, None)}
    assert ngram_join.ngram_components(docs(spark)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


# ------------------------------------------------------------------ 6


def test_licences(spark):
    model = licences.fit([f"plain words number {k} about nothing at all" for k in range(60)])
    assert model["recall"] > 0.85 and model["passed"] < 0.1
    everyday = [*licences.EVERYDAY[1::2], "The committee may modify, merge or publish copies of the report.", "A copy of the notice hangs above the door, and all conditions are met."]
    got = [h for hits in licences.scan(pa.array(everyday), model) for h in hits]
    assert len(got) <= 3 and not any(h["confirmed"] for h in got)
    texts = ["Some prose.\nReleased under the MIT License.\nMore prose here.", "permission is HEREBY granted, free of charge, to any person obtaining a copy of this software", "nothing to see", None, "", "Licensed under the Apache License, Version 2.0.\n\nLicensed under CC BY-NC 4.0."]
    got = {r["doc_id"]: r for r in licences.licence_paragraphs(docs(spark, *[(k, t, "s") for k, t in enumerate(texts)]), model).collect()}
    assert [(h["line"], h["family"], h["confirmed"]) for h in got[0]["hits"]] == [(1, "MIT", True)]
    assert got[1]["hits"][0]["family"] == "MIT" and got[2]["hits"] == [] and got[3]["hits"] == [] and got[3]["n_paragraphs"] == 0
    assert [(h["line"], h["family"]) for h in got[5]["hits"]] == [(0, "Apache-2.0"), (2, "CC-BY-NC")] and got[5]["n_paragraphs"] == 2
    assert licences.licence_paragraphs(docs(spark), model).count() == 0
    assert len(licences.licence_paragraphs(edge(spark), licences.learn(edge(spark))).collect()) == 8


def test_licences_that_tie(spark):
    """Under a model that knows nothing of families, the first one is named, and only its templates confirm."""
    zero = {"weights": np.zeros((1 << licences.BITS, len(licences.FAMILIES)), np.float32), "bias": np.zeros(len(licences.FAMILIES)), "limit": 0.5, "templates": licences._templates()}
    hits = licences.scan(pa.array(["Released under the MIT License.\nLicensed under the Mozilla Public License, version 2.0."]), zero)[0]
    assert [(h["family"], h["confirmed"]) for h in hits] == [(licences.FAMILIES[1], True), (licences.FAMILIES[1], False)]


# ------------------------------------------------------------------ 7, 8


@pytest.mark.parametrize(("module", "name", "limit"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_held_out(spark, module, name, limit):
    where = "/root/testdata/sf0.1"
    d, y = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    score = module.score_toxicity if name == "toxic" else module.score_quality
    got = score(d.join(y, "doc_id").select("doc_id", "text", name), module.learn(d, y)).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(r["score"] >= limit) == bool(r[name]) for r in held]
    assert len(held) > 300 and np.mean(right) > 0.95
    assert np.mean([r["score"] < limit for r in held if not r[name]]) > 0.95


def test_scores_edges(spark):
    y = spark.createDataFrame([(1, 0, 1), (6, 1, 0), (5, None, 1), (None, 1, 1), (6, 0, 0)], "doc_id long, toxic int, quality int")
    for module, score in ((toxicity, toxicity.score_toxicity), (quality, quality.score_quality)):
        for labels in (y, y.limit(0)):
            got = score(edge(spark), module.learn(edge(spark), labels))
            assert got.count() == 8 and got.columns == [*[c for c in DOC.replace(" long", "").replace(" string", "").split(", ") if c != "score"], "score"]
            assert all(0 <= r["score"] <= 1 for r in got.collect())
        assert score(docs(spark), module.learn(docs(spark), y)).count() == 0


def test_trees_are_walked_as_they_were_grown():
    texts = pa.array([f"{'AB! ' * k} word {k}." for k in range(1, 200)])
    labels, ids = np.array([k > 90 for k in range(1, 200)], np.int32), np.arange(199)
    scores = quality.scorer(quality.fit([texts], labels, ids))(texts)
    assert ((scores > 0.5) == labels.astype(bool)).mean() > 0.97


def plain_ftrl(texts, labels, ids, alpha, beta, l1, l2):
    """FTRL-proximal a coordinate at a time, in dictionaries, over every bucket that enough rows have."""
    part = toxicity.Texts(pa.array(texts), ~toxicity.LETTER)
    row, cell = toxicity.features(part)
    sets = [sorted(set(cell[row == k].tolist())) for k in range(len(texts))]
    held = {}
    for s in sets:
        for b in s:
            held[b] = held.get(b, 0) + 1
    z, n, bias = {}, {}, 1 << toxicity.BITS

    def weight(b):
        free = 0.0 if b == bias else l1
        at = z.get(b, 0.0)
        return 0.0 if abs(at) <= free else (np.sign(at) * free - at) / ((beta + np.sqrt(n.get(b, 0.0))) / alpha + l2)

    for _ in range(toxicity.EPOCHS):
        for k in sorted(range(len(texts)), key=lambda k: ids[k] * 2654435761 % (1 << 32)):
            here = [b for b in sets[k] if held[b] >= toxicity.LEAST_ROWS] + [bias]
            w = {b: weight(b) for b in here}
            g = 1 / (1 + np.exp(-np.clip(sum(w.values()), -35, 35))) - labels[k]
            for b in here:
                z[b] = z.get(b, 0.0) + g - (np.sqrt(n.get(b, 0.0) + g * g) - np.sqrt(n.get(b, 0.0))) / alpha * w[b]
                n[b] = n.get(b, 0.0) + g * g
    return {b: w for b in z if (w := weight(b))}


def test_toxicity_weights_are_those_of_plain_ftrl(real):
    texts = [t or "" for _, t in real[:80]]
    labels, ids = np.array([k % 3 == 0 for k in range(80)], np.int32), np.arange(80) * 7
    for l1 in (4.0, 0.5):
        model = toxicity.fit([pa.array(texts)], labels, ids, l1=l1)
        size = len(model) // 8
        got = dict(zip(np.frombuffer(model[: 4 * size], "<i4").tolist(), np.frombuffer(model[4 * size :], "<f4").tolist(), strict=True))
        want = plain_ftrl(texts, labels, ids, 2.0, 1.0, l1, 0.01)
        assert set(got) == set(want) and all(got[b] == pytest.approx(want[b], rel=1e-4, abs=1e-6) for b in want)


def test_quality_scores_are_those_of_a_walk_by_hand(real):
    texts = [t or "" for _, t in real[:150]]
    labels, ids = np.array([len(t) > 1500 for t in texts], np.int32), np.arange(150)
    model = quality.fit([pa.array(texts)], labels, ids)
    spec, x = quality.json.loads(model), quality.statistics(pa.array(texts))
    assert spec["trees"]
    for row, got in zip(x, quality.scorer(model)(pa.array(texts)), strict=True):
        margin = spec["base"]
        for feature, limit, value in spec["trees"]:
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            margin += value[node - len(feature)]
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -35, 35))), abs=1e-9)


# ------------------------------------------------------------------ 9


def deleted_lines(rows):
    """Lines in later runs of 50 words or more that equal an earlier run, by trying every place."""
    kept = {i: [(k, x, len(WORD.findall(x))) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)] for i, t in rows}
    places: dict[str, list] = {}
    gone = {i: set() for i in kept}
    for i, _ in sorted(rows):
        mine = kept[i]
        for a in range(len(mine)):
            for j, b in places.get(mine[a][1], []):
                n = 0
                while a + n < len(mine) and b + n < len(kept[j]) and mine[a + n][1] == kept[j][b + n][1]:
                    n += 1
                if sum(x[2] for x in mine[a : a + n]) >= 50:
                    gone[i] |= {x[0] for x in mine[a : a + n]}
            places.setdefault(mine[a][1], []).append((i, a))
    return gone


def test_line_dedup(spark, real):
    passage = [" ".join(f"p{k}_{j}" for j in range(22)) for k in range(3)]
    rows = [*real, (7_000, "\n".join(["start", *passage, "end"])), (7_001, "\n".join(["other", "", *passage, "", "tail"])), (7_002, " ".join(passage)), (7_003, "x\n" + " ".join(passage)), (7_004, "short line\nshort line"), (7_005, "\n".join([passage[0] * 3] * 40))]
    want = deleted_lines(rows)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(spark, *[(i, t, "s") for i, t in rows])).collect()}
    for i, text in rows:
        left = "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in want[i])
        assert (got[i]["text"], got[i]["n_deleted"]) == (left, len(want[i]))
    assert got[7_001]["n_deleted"] == 3 and got[7_003]["text"] == "x" and got[7_004]["n_deleted"] == 0


def test_line_passages_whose_lines_also_stand_alone(spark):
    """Every line of the passage stands earlier in a document of its own, among other lines."""
    passage = [" ".join(f"q{k}_{j}" for j in range(22)) for k in range(3)]
    alone = [(k + 1, f"before {k}\n{x}\nafter {k}") for k, x in enumerate(passage)]
    mixed = [(4, "\n".join([passage[2], "x y", passage[0], passage[1]])), (5, "\n".join([passage[1], passage[2]]))]
    short = [" ".join(f"r{j}" for j in range(60)), "tail of it"]
    rows = [*alone, *mixed, (10, "\n".join(["a", *passage, "b"])), (11, "\n".join([passage[1], "c", *passage, "d"])), (12, "\n".join([*short, "e"])), (13, "\n".join(["f", *short]))]
    want = deleted_lines(rows)
    got = {r["doc_id"]: r["n_deleted"] for r in line_dedup.line_dedup(docs(spark, *[(i, t, "s") for i, t in rows])).collect()}
    assert got == {i: len(x) for i, x in want.items()} and got[11] == 3 and got[13] == 2


def test_line_runs_as_by_every_place(spark):
    """Few lines in many orders."""
    rng = np.random.default_rng(9)
    lines = [" ".join(f"l{k}_{j}" for j in range(n)) for k, n in enumerate([1, 2, 7, 12, 16, 20, 25, 30, 48, 49, 50, 75])] + [""]
    rows = [(k, "\n".join(rng.choice(lines, int(rng.integers(0, 30))))) for k in range(150)]
    want = deleted_lines(rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs(spark, *[(i, t, "s") for i, t in rows])).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}


def test_line_texts_that_share_an_id(spark):
    passage = [" ".join(f"s{k}_{j}" for j in range(26)) for k in range(2)]
    rows = [(1, "\n".join(["a", *passage])), (2, "\n".join([*passage, "b"])), (2, "\n".join(["only here", "c", *passage])), (2, "\n".join(["only here", "c", *passage]))]
    got = sorted(tuple(r) for r in line_dedup.line_dedup(docs(spark, *[(i, t, "s") for i, t in rows])).select("doc_id", "text", "n_deleted").collect())
    assert got == [(1, rows[0][1], 0), (2, "b", 2), (2, "only here\nc", 2), (2, "only here\nc", 2)]


def test_line_edges(spark):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(edge(spark)).collect()}
    assert len(got) == 8 and got[2]["text"] is None and got[4]["text"] == " \n\t" and all(r["n_deleted"] == 0 for r in got.values())
    assert line_dedup.line_dedup(docs(spark)).count() == 0
    assert line_dedup.line_dedup(edge(spark).unionByName(edge(spark))).count() == 16


# ------------------------------------------------------------------ 10


def test_topk(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in rng.normal(size=8).round(1)]) for k in range(700)] + [(700, vectors_of_one := [0.5] * 8), (701, vectors_of_one), (702, None), (703, [1.0, None]), (704, [float("inf")]), (705, [float("nan")]), (720, [1.0]), (740, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got: dict[int, list] = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in whole if i % 20 == 0}
    for q, found in got.items():
        scores = sorted(((sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q), key=lambda x: (-x[0], x[1]))[:20]
        assert found == [(i, s) for s, i in scores]
    few = spark.createDataFrame([(0, [1.0]), (1, [1e18])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.exact_topk(few.withColumn("embedding", F.transform("embedding", lambda x: x)), F.col("vec_id") == 0, scale=1.0).collect()] == [(0, 1, 1, 10**18)]
    assert topk.exact_topk(df.limit(0), F.lit(True)).count() == 0


def test_pruning_skips_blocks_and_keeps_what_counts():
    rng = np.random.default_rng(2)
    c = rng.integers(-50, 50, (1000, 6)).astype(float)
    c[:200] *= 9
    ids, q = np.arange(1000), c[::50]
    scores = q @ c.T
    want = [sorted(((-scores[n][j], j) for j in range(1000) if j != qid))[:5] for n, qid in enumerate(ids[::50])]
    kth = np.array([-x[-1][0] for x in want])
    taken = []
    for least in (None, np.full(20, -np.inf), kth):
        counter: list[int] = []
        got = topk.search_range(ids[::50], list(q), ids, list(c), 5, block=16, least=least, counter=counter)
        for n, qid in enumerate(ids[::50]):
            assert [(v, s) for a, v, s in zip(*got) if a == qid] == [(j, int(-s)) for s, j in want[n]]
        taken.append(sum(counter))
    assert taken[0] == taken[1] < 20 * 1000 * 0.3 and taken[2] <= taken[0]
    # a range without winners: what is known of the kth scores spares nearly all of it
    alone, known = [], []
    topk.search_range(ids[::50], list(q), ids[200:], list(c[200:]), 5, block=16, counter=alone)
    topk.search_range(ids[::50], list(q), ids[200:], list(c[200:]), 5, block=16, least=kth, counter=known)
    assert sum(known) < sum(alone) / 2


def test_topk_by_several_blocks_and_a_first_pass(spark, monkeypatch):
    for name, value in {"SEEDS": 40, "QUERIES": 16, "RANGE": 128, "BLOCK": 16}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    v = rng.integers(-9, 9, (600, 5))
    df = spark.createDataFrame([(k, [float(x) / 64 for x in row]) for k, row in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: [(i, -s) for s, i in sorted((-int(v[q] @ v[i]), i) for i in range(600) if i != q)[:7]] for q in range(0, 600, 20)}


# ------------------------------------------------------------------ queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def test_pipeline(spark, small):
    import corpus_pipeline

    at = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = at.columns, [at.count()]
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, small)
        sizes.append(at.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "bpe"]
    assert sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5]
    assert corpus_pipeline.run(spark, small).count() == sizes[5]
    empty = docs(spark).select(*columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge(spark).select(*columns), small).count() > 0, name
