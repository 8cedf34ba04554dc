"""Token counts against the library, and the proof behind the shortcut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from verdigris.llm import queries, token_counts

LONG = " ".join(f"w{k % 977}" for k in range(30_000))


@pytest.fixture(scope="module")
def counter():
    return token_counts.token_counter(queries.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def counts(library, texts):
    return [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_as_the_library(spark, small, library):
    rows = token_counts.token_counts(spark.read.parquet(f"{small}/documents.parquet"), queries.tokenizer_path(), keep=("doc_id", "text")).collect()
    want = counts(library, [r["text"] for r in rows])
    assert [r["n_tokens"] for r in rows] == want and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert all(r["n_bytes"] == len((r["text"] or "").encode()) and 0 <= r["n_shortcut"] <= r["n_tokens"] for r in rows)
    assert sum(r["n_shortcut"] for r in rows) > 0.1 * sum(want)


@pytest.mark.parametrize("short", [48, 5, 0])
def test_odd_texts(counter, library, short, monkeypatch):
    """Words merged together and words merged by a heap count alike."""
    monkeypatch.setattr(token_counts, "SHORT", short)
    rng = np.random.default_rng(3)
    odd = ["", " ", "a  b", "it's I'LL 've", "a" * 9000, "ab" * 5000, "<|endoftext|>x<|endoftext|>", "<|endoftext|>", "日本語 テスト", "🙂👩‍👩‍👧", "\u0085b", " " * 300, LONG, "l\r\n\r\n", "a　 b"]
    odd += ["".join(rng.choice(list("ab 　é\t日<tion"), 130)) for _ in range(200)]
    odd += ["".join(rng.choice(list("etaoinshr"), int(n))) for n in rng.integers(1, 100, 300)]
    assert counter.count_all(pa.array(odd))[0].tolist() == counts(library, odd)


def test_proof_is_of_the_merges(counter):
    """A string whose parts never meet is in the vocabulary, but not proven."""
    vocab = {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}
    small = token_counts.TokenCounter(vocab, [("b", "c"), ("a", "b"), ("ab", "c")], [])
    assert sorted(small.alone.to_pylist()) == [b"a", b"ab", b"b", b"bc", b"c"]
    got = small.count_all(pa.array(["abc", "ab", "abcab"]))
    assert [x.tolist() for x in got] == [[2, 1, 3], [0, 1, 0]]
    # each proven string of the real vocabulary is one token, whichever way it is merged
    some = counter.alone.to_pylist()[::997]
    assert all(counter._merged_by_heap([counter.single[b] for b in w]) == 1 for w in some)


def test_edges(spark):
    schema = "doc_id long, text string, n_tokens string, n_bytes string, __text string"
    rows = [(1, "one two", "x", "y", "z"), (1, "one two", "x", "y", "z"), (2, None, "x", "y", "z"), (3, "", None, None, None), (None, "é", "x", "y", "z"), (5, LONG, "x", "y", "z")]
    got = token_counts.token_counts(spark.createDataFrame(rows, schema), queries.tokenizer_path()).collect()
    assert sorted(tuple(r)[:4] for r in got if r["doc_id"] in (1, 2, 3)) == [(1, 7, 2, False), (1, 7, 2, False), (2, 0, 0, False), (3, 0, 0, False)]
    by = {r["doc_id"]: r for r in got}
    assert by[None]["n_bytes"] == 2 and by[5]["over_limit"] and len(got) == 6
    assert token_counts.token_counts(spark.createDataFrame([], schema), queries.tokenizer_path()).collect() == []
