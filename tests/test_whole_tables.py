"""The queries that cover documents with any character, by brute force on a few rows and by count on the small tables."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter

import pytest

from verdigris.plans.catalogue import QUERIES

DOCS = [(0, "Die Größe der Brücke, 12 Meter"), (1, "El niño y la niña"), (2, "the bridge, the BRIDGE"), (3, "¿Qué?"), (4, None), (5, "the"), (6, "crème brûlée a la niña"), (-1, "größe"), (8, "bridge 12")]
ITEMS = [(10, "the size (Grosse) of die Brucke"), (11, "nina y niño"), (17, "A bridge"), (40, "an")]


@pytest.fixture
def few(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def norm(x):
    body = "".join(c if len(f := "".join(y for y in unicodedata.normalize("NFKD", c) if not unicodedata.combining(y))) > 1 else f for c in x or "")
    return " ".join(re.sub("[!-/:-@\\[-`{-~]", " ", body.lower()).split())


def words(x):
    return [w for w in norm(x).split() if w not in ("a", "an", "the")]


def test_normalised(spark, few):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert {tuple(r) for r in QUERIES["normalize_text"](spark, few).collect()} == {(i, md5(norm(t)), len(norm(t))) for i, t in DOCS}
    assert {tuple(r) for r in QUERIES["normalize_answer"](spark, few).collect()} == {(i, md5(" ".join(words(t))), len(words(t))) for i, t in DOCS}


def test_token_f1(spark, few):
    want = {}
    for i, t in DOCS:
        p, r = words(t), words(ITEMS[i % len(ITEMS)][1])
        both = sum((Counter(p) & Counter(r)).values())
        want[i] = (float(p == r),) * 3 if not p or not r else (both / len(p), both / len(r), 2 * both / (len(p) + len(r)))
    got = {r["id"]: (r["precision"], r["recall"], r["f1"]) for r in QUERIES["token_f1"](spark, few).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-8) for i in want)


def test_bm25(spark, few):
    terms = lambda x: re.findall("[a-z0-9]+", (x or "").lower())
    docs = {i: Counter(terms(t)) for i, t in DOCS}
    n, avg = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    idf = {t: math.log((n - k + 0.5) / (k + 0.5) + 1) for t, k in df.items()}
    want = set()
    for item, text in ITEMS:
        known = [t for t in set(terms(text)) if t in idf]
        hits = [(-round(sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for t in known) / sum(idf[t] for t in known), 7), i) for i, c in docs.items() if any(t in c for t in known)]
        want |= {(item, i, -s, k + 1) for k, (s, i) in enumerate(sorted(hits)[:3])}
    got = {tuple(r) for r in QUERIES["bm25_topk"](spark, few).collect()}
    assert got == want and any(not dict(DOCS)[i].isascii() for _, i, _, _ in got)


@pytest.mark.parametrize("name", ["normalize_text", "normalize_answer", "token_f1"])
def test_every_document(spark, small, name):
    assert QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()
