"""Token counts by the whole-token shortcut.

Before any text is read, each string of the vocabulary is run through the
merges: those that end as one token are proven to encode alone.  A pre-token
that is one of them counts as one token, without a merge; only the rest are
merged, each distinct one once a batch.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.bpe import byte_letters, bytes_of, pre_tokens, spans
from verdigris.llm.common import text_batches, unused
from verdigris.llm.words import slices, strings

NEVER = 1 << 60
#: Bytes of the words that are merged together; a longer word takes a heap by itself.
SHORT = 48


class TokenCounter:
    """A byte-level vocabulary's merges, and the strings that are proven to be one token."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: list[str]):
        letters = byte_letters()
        self.specials = specials
        self.single = [0] * 256
        for c, b in letters.items():
            self.single[b] = vocab.get(c, -1 - b)
        known = [(a, b) for a, b in merges if a in vocab and b in vocab and a + b in vocab]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(known)}
        self.whole = np.array([vocab[a + b] for a, b in known], np.int64)
        keys = np.array([u << 32 | v for u, v in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        names = pa.array([bytes(letters[c] for c in name) for name in vocab if name and all(c in letters for c in name)], pa.binary())
        self.alone = names.filter(pa.array(self.merged(names) == 1))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or NEVER."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NEVER) if len(self.pairs) else np.full(len(key), NEVER)

    def merged(self, words: pa.Array) -> np.ndarray:
        """How many tokens the merges leave of each word (binary, without nulls).

        In each word the pair of the lowest rank is merged, of equal ranks the
        leftmost, until none is left; all words take a step together.
        """
        raw, begin = bytes_of(words)
        size = np.diff(begin)
        out = np.zeros(len(size), np.int64)
        for k in np.flatnonzero(size > SHORT).tolist():
            out[k] = self._merged_by_heap([self.single[b] for b in raw[begin[k] : begin[k + 1]].tolist()])
        who = np.flatnonzero((size > 0) & (size <= SHORT))
        size = size[who]
        ids = np.array(self.single, np.int64)[raw[spans(begin[:-1][who], size)]]
        start = np.cumsum(size) - size
        rank = self._ranks(ids, np.append(ids[1:], 0))
        rank[start + size - 1] = NEVER
        while len(who):
            least = np.minimum.reduceat(rank, start)
            done = least == NEVER
            out[who[done]] = size[done]
            if done.any():
                stay = np.repeat(~done, size)
                ids, rank, who, size, least = ids[stay], rank[stay], who[~done], size[~done], least[~done]
                start = np.cumsum(size) - size
                if not len(who):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            word = np.searchsorted(start, hit, "right")
            hit = hit[np.concatenate([[True], word[1:] != word[:-1]])]
            ids[hit] = self.whole[least]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            ids, rank = ids[stay], rank[stay]
            hit -= np.arange(len(hit))  # a piece has gone from each word before
            size = size - 1
            start = np.cumsum(size) - size
            end = hit == start + size - 1
            rank[hit] = np.where(end, NEVER, self._ranks(ids[hit], ids[np.minimum(hit + 1, len(ids) - 1)]))
            back = hit[hit > start] - 1
            rank[back] = self._ranks(ids[back], ids[back + 1])
        return out

    def _merged_by_heap(self, ids: list[int]) -> int:
        """The same in n log n steps: pieces are linked, and a candidate that no longer stands is passed over."""
        n, rank_of = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if (rank := rank_of(p)) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] is None or j >= n or rank_of((ids[k], ids[j])) != rank:
                continue
            ids[k], ids[j], after[k] = int(self.whole[rank]), None, after[j]
            left -= 1
            if after[j] < n:
                before[after[j]] = k
                if (got := rank_of((ids[k], ids[after[j]]))) is not None:
                    heapq.heappush(heap, (got, k))
            if before[k] >= 0 and (got := rank_of((ids[before[k]], ids[k]))) is not None:
                heapq.heappush(heap, (got, before[k]))
        return left

    def count_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text (a string column without nulls): its tokens, and how many of them the shortcut gave."""
        kinds, words, first = pre_tokens(texts, self.specials)
        whole = pc.is_in(kinds, value_set=self.alone).to_numpy(zero_copy_only=False).astype(bool)
        count = np.ones(len(kinds) + len(self.specials), np.int64)  # special tokens stand behind the words
        rest = np.flatnonzero(~whole)
        count[rest] = self.merged(kinds.take(pa.array(rest)))
        of = lambda each: np.diff(np.concatenate([[0], np.cumsum(each[words])])[first])
        return of(count), of(np.append(whole, [False] * len(self.specials)).astype(np.int64))


@functools.lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    """Read a byte-level vocabulary file on the driver and prove its whole tokens; the work is that of the vocabulary, not of the data."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return TokenCounter(model["vocab"], merges, [t["content"] for t in spec.get("added_tokens", []) if t.get("special")])


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """The columns `keep`, n_bytes, n_tokens, over_limit (more than `limit` tokens) and n_shortcut, for each row.

    n_shortcut says how many tokens came from whole pre-tokens without a merge.
    A null text counts as empty: no bytes and no tokens.  A special token's
    string in a text is that token.  Rows stay as they are, repeated ones and
    null ids too; other columns are left out, so none can clash.  A very long
    text, or a very long word in one, is counted whole.  An empty table gives no
    rows.  Nothing is shuffled; what is sent to the tasks is the vocabulary.
    """
    text_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(token_counter(tokenizer))  # bounded by the vocabulary
    (own,) = unused(df, "__text")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias(own))
    names = rows.drop(own).columns
    schema = rows.drop(own).schema.add("n_tokens", "long").add("over_limit", "boolean").add("n_shortcut", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = sent.value
        for batch in batches:
            texts = strings(batch.column(len(names)))
            for a, b in slices(texts, 1 << 22):
                tokens, short = counter.count_all(texts.slice(a, b - a))
                columns = [c.slice(a, b - a) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens), pa.array(tokens > limit), pa.array(short)], [*names, "n_tokens", "over_limit", "n_shortcut"])

    return rows.mapInArrow(run, schema)
