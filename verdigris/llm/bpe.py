"""Byte-pair encoding and decoding by a tokenization automaton.

The merges are compiled, one gadget each and in order, into a deterministic
automaton whose arcs are tokens and whose state is the token just read.  The
gadget of merge (u, v) -> w adds the arc w and cuts the arc v after u for as
long as both are free, that is until a later merge takes u into the token on
its left or v into the token on its right.  The paths that survive all cuts
are exactly the canonical tokenizations, so each string, and each prefix of one,
has one path.

For reading bytes that automaton is determinised: a state holds the arcs that
are being read, each with the token before it, and the one token that ends
here.  A transition is worked out when it is first needed and from then on
taken from the table, as the states for all words have no useful bound.  The
token that ends at each byte gives the path, from the end back; nothing is ever
tried twice.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import text_batches
from verdigris.llm.words import slices, strings

#: Fixed value: how byte-level vocabularies cut text into words.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
#: A lone space between two words always starts a piece, so text may be cut before it.
LONE_SPACE = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
#: A space next to other white space, on either side.
WIDE = re.compile(r" \s"), re.compile("[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
NEVER = 1 << 60
NODE_BITS = 24
NODE = (1 << NODE_BITS) - 1
#: How the pattern sees the bytes of a piece: white space, letters, digits, what needs the pattern itself, and all else.
GAP, WORDY, DIGIT, UNSURE, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(9, 14), *range(28, 33)]] = GAP
KIND[[*range(65, 91), *range(97, 123)]] = WORDY
KIND[48:58] = DIGIT
KIND[[39, *range(28, 32), *range(128, 256)]] = UNSURE
#: Tokens whose labels are looked up together.
LOOKS = 1 << 20
#: Bytes of the words that are read together; longer ones are read by themselves.
TOGETHER = 48
#: States kept in a worker's table, about.
MEMO = 300_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Compiled merges: byte transitions, arc labels, cuts and what absorbs each token."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]):
        letters = byte_letters()
        self.labels: list[bytes] = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for name, k in vocab.items():
            self.labels[k] = bytes(letters[c] for c in name)
        self.specials = specials
        for name, k in specials.items():
            self.labels[k] = name.encode()
        self.cuts: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        live = {k for name, k in vocab.items() if len(name) == 1}
        for rank, (a, b) in enumerate(merges):
            if a in vocab and b in vocab and a + b in vocab:
                self._gadget(rank, vocab[a], vocab[b], vocab[a + b], live)
        self._transitions(live)
        self.longest = max(map(len, self.labels))
        self._fresh()

    def _gadget(self, rank: int, u: int, v: int, w: int, live: set[int]) -> None:
        """Add merge (u, v) -> w.  Arc w comes to life if nothing has cut u v before."""
        self.cuts[u, v] = rank
        if w not in self.parts and u in live and v in live:
            if self._cut_at(u, v) == rank:
                self.parts[w] = (u, v, rank)
                live.add(w)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of a token while it grows, each with the rank that ends it."""
        out = [(token, NEVER)]
        while (got := self.parts.get(out[-1][0])) is not None:
            out.append((got[side], got[2]))
        return out[::-1]

    def _cut_at(self, s: int, x: int) -> int:
        """The rank of the first merge across the border of s and x, or NEVER."""
        left, right = self._edge(s, 1), self._edge(x, 0)
        i = j = 0
        while True:
            (u, till_u), (v, till_v) = left[i], right[j]
            rank = self.cuts.get((u, v), NEVER)
            if rank < till_u and rank <= till_v and rank < NEVER:
                return rank
            if till_u == till_v == NEVER:
                return NEVER
            i, j = i + (till_u <= till_v), j + (till_v <= till_u)

    def _transitions(self, live: set[int]) -> None:
        """Bytes of the arcs: (node << 8 | byte) -> node; the arc that ends at a node; which nodes go on."""
        self.step: dict[int, int] = {}
        self.arc: list[int] = [-1]
        for k in sorted(live):
            node = 0
            for b in self.labels[k]:
                key = node << 8 | b
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(self.arc)
                    self.arc.append(-1)
            self.arc[node] = k
        self.goes_on = {key >> 8 for key in self.step}
        self.sizes = np.array([len(x) for x in self.labels], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.labels), np.uint8)

    def _fresh(self) -> None:
        self._open: dict[int, bool] = {}
        self._states()

    def _states(self) -> None:
        """Start the table anew: state 0 has read nothing."""
        self._next: dict[int, int] = {}
        # an arc that is being read: the token before it, plus one, and the node reached
        self._arcs: list[tuple[int, ...]] = [(0,)]
        self._known = {self._arcs[0]: 0}
        self._ends: list[int] = [-1]
        self._new: list[int] = []
        self._keys, self._to, self._end = np.zeros(0, np.int64), np.zeros(0, np.int64), np.array(self._ends, np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_open", "_next", "_arcs", "_known", "_ends", "_new", "_keys", "_to", "_end")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def _allowed(self, before: int, token: int) -> bool:
        got = self._open.get(key := before << 20 | token)
        if got is None:
            if len(self._open) >= 5 * MEMO:
                self._open.clear()
            got = self._open[key] = self._cut_at(before, token) == NEVER
        return got

    def _transition(self, state: int, byte: int) -> int:
        """Add the transition of a state on a byte to the table."""
        arcs, end = [], -1
        for packed in self._arcs[state]:
            node = self.step.get((packed & NODE) << 8 | byte)
            if node is not None:
                before, token = (packed >> NODE_BITS) - 1, self.arc[node]
                if token >= 0 and end < 0 and (before < 0 or self._allowed(before, token)):
                    end = token
                if node in self.goes_on:
                    arcs.append(packed & ~NODE | node)
        arcs.append(end + 1 << NODE_BITS)
        key = tuple(arcs)
        to = self._known.get(key)
        if to is None:
            to = self._known[key] = len(self._arcs)
            self._arcs.append(key)
            self._ends.append(end)
        self._next[state << 8 | byte] = to
        self._new.append(state << 8 | byte)
        return to

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """The next states of (state << 8 | byte)."""
        at = np.searchsorted(self._keys, keys)
        missing = keys[np.append(self._keys, -1)[at] != keys]
        if not len(missing):
            return self._to[at]
        for key in np.unique(missing).tolist():
            if key not in self._next:
                self._transition(key >> 8, key & 255)
        new = np.sort(np.array(self._new, np.int64))
        at = np.searchsorted(self._keys, new)
        self._to = np.insert(self._to, at, [self._next[k] for k in new.tolist()])
        self._keys = np.insert(self._keys, at, new)
        self._end = np.append(self._end, np.array(self._ends[len(self._end) :], np.int64))
        self._new.clear()
        return self._to[np.searchsorted(self._keys, keys)]

    def encode_word(self, word: bytes) -> list[int]:
        """The one path of uncut arcs over a word."""
        known, ends, state, last = self._next, self._ends, 0, []
        for b in word:
            to = known.get(state << 8 | b)
            state = self._transition(state, b) if to is None else to
            last.append(ends[state])
        path, at = [], len(word)
        while at:
            path.append(last[at - 1])
            at -= len(self.labels[path[-1]])
        return path[::-1]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The paths over all words, one after another, and their lengths: all words read a byte at a time, together."""
        if len(self._arcs) > MEMO:
            self._states()
        raw, begin = bytes_of(words)
        begin, size = begin[:-1], np.diff(begin)
        far = np.flatnonzero(size > TOGETHER)
        order = np.argsort(-np.where(size > TOGETHER, 0, size), kind="stable")
        length, at, state = size[order], begin[order], np.zeros(len(words), np.int64)
        length[size[order] > TOGETHER] = 0
        last = np.zeros(len(raw), np.int64)
        for k in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -k))
            state[:n] = self._look_up(state[:n] << 8 | raw[at[:n] + k].astype(np.int64))
            last[at[:n] + k] = self._end[state[:n]]
        # back from the end of each word
        left, end = order[: np.searchsorted(-length, 0)], None
        end, steps = begin[left] + size[left], []
        while len(left):
            token = last[end - 1]
            steps.append((left, token))
            end = end - self.sizes[token]
            on = end > begin[left]
            left, end = left[on], end[on]
        paths = {int(k): self.encode_word(raw[begin[k] : begin[k] + size[k]].tobytes()) for k in far}
        count = np.zeros(len(words), np.int64)
        for who, _ in steps:
            count[who] += 1
        count[far] = [len(paths[k]) for k in far.tolist()]
        first = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), "<u4")
        for k, (who, token) in enumerate(steps):
            ids[first[who] + count[who] - 1 - k] = token
        for k, path in paths.items():
            ids[first[k] : first[k] + len(path)] = path
        return ids, count

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a string column without nulls) in sequence, and where each text's begin; each distinct word is read once."""
        kinds, words, first = pre_tokens(texts, list(self.specials))
        ids, count = self.encode_words(kinds)
        # special tokens stand behind the words, the last one first
        ids, count = np.append(ids, list(self.specials.values())[::-1]).astype("<u4"), np.append(count, [1] * len(self.specials)).astype(np.int64)
        begin = np.cumsum(count) - count
        past = np.concatenate([[0], np.cumsum(count[words])])
        return ids[spans(begin[words], count[words])], past[first]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: np.ndarray) -> str:
        return self.letters[spans(self.starts[ids], self.sizes[ids])].tobytes().decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The texts whose ids begin where `first` says."""
        parts = (ids[k : k + LOOKS] for k in range(0, len(ids), LOOKS))
        letters = np.concatenate([np.zeros(0, np.uint8), *[self.letters[spans(self.starts[x], self.sizes[x])] for x in parts]])
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[first]
        try:
            letters.tobytes().decode()
            whole = not ((letters[at[at < len(letters)]] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(letters)])
        return pa.array([letters[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)], pa.string())


def _binary(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each row begins."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def _words_of_pieces(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of pieces that begin with their only space, if they have one; and how many each piece has.

    Where a piece holds an apostrophe or other than ASCII, the pattern cuts it.
    Elsewhere a word ends where the kind of byte changes, but for the space in
    front; of white space before something else, the last byte stands alone.
    """
    raw, begin = bytes_of(pieces)
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    kind = KIND[raw]
    starts = np.zeros(len(raw) + 1, bool)
    starts[1:-1] = (kind[1:] != kind[:-1]) & (raw[:-1] != 32)
    last = np.zeros(len(raw), bool)
    last[begin[1:] - 1] = True
    starts[:-1][(kind == GAP) & (raw != 32) & ~last & np.append(kind[1:] != GAP, False)] = True
    starts[begin] = True
    unsure = np.unique(np.searchsorted(begin, np.flatnonzero(kind == UNSURE), "right") - 1)
    inside = spans(begin[unsure], np.diff(begin)[unsure])
    starts[inside] = False
    for k in unsure.tolist():
        at = begin[k]
        for w in SPLIT.findall(raw[begin[k] : begin[k + 1]].tobytes().decode()):
            starts[at] = True
            at += len(w.encode())
    at = np.flatnonzero(starts)
    return _binary(raw, at), np.diff(np.searchsorted(at, begin))


def special_marks(specials: list[str]) -> re.Pattern:
    """Splits at special tokens' strings and keeps them; longer ones first."""
    return re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")" if specials else "$^")


def words_of(text: str) -> list[bytes]:
    """The words of a text without special tokens, which may be cut before each lone space."""
    return [w.encode() for n, part in enumerate(LONE_SPACE.split(text)) if n or part for w in SPLIT.findall(" " * (n > 0) + part)]


def pre_tokens(texts: pa.Array, specials: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts (a string column without nulls), the texts as numbers of words in sequence (special token k is -1 - k), and where each text's begin."""
    special = {name: -1 - k for k, name in enumerate(specials)}
    marks = special_marks(specials)
    plain, odd, loose = [], {}, []
    for n, text in enumerate(texts.to_pylist()):
        marked = any(name in text for name in special)
        if marked or any(w.search(text) for w in WIDE):
            odd[n] = []
            for part in marks.split(text) if marked else [text]:
                found = [] if part in special else words_of(part)
                odd[n] += [special[part]] if part in special else range(len(loose), len(loose) + len(found))
                loose += found
        plain.append(b"" if n in odd else text.encode())
    raw = np.frombuffer(b"".join(plain), np.uint8)
    sizes = np.array([len(x) for x in plain], np.int64)
    row = np.cumsum(sizes) - sizes
    # no white space meets in these, so each space begins a piece
    begins = np.union1d(np.flatnonzero(raw == 32), row[sizes > 0])
    pieces = _binary(raw, np.append(begins, len(raw))).dictionary_encode()
    at, (cut, many) = pieces.indices.to_numpy(), _words_of_pieces(pieces.dictionary)
    kinds = pa.concat_arrays([cut, pa.array(loose, pa.binary())]).dictionary_encode()
    number = kinds.indices.to_numpy().astype(np.int64)
    words = number[spans((np.cumsum(many) - many)[at], many[at])]
    past = np.concatenate([[0], np.cumsum(many[at])])
    first = past[np.searchsorted(begins, np.append(row, len(raw)))]
    if odd:
        own = lambda x: np.where(x < 0, x, np.append(number, 0)[np.where(x < 0, 0, x + len(cut))])
        parts = [own(np.array(odd[n], np.int64)) if n in odd else words[first[n] : first[n + 1]] for n in range(len(plain))]
        words, first = np.concatenate([words[:0], *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return kinds.dictionary, words, first


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on for each length, in sequence."""
    return np.arange(int(length.sum())) + np.repeat(start - np.cumsum(length) + length, length)


def compile_tokenizer(path: str) -> Automaton:
    """Read a byte-level vocabulary file on the driver; its size is that of the vocabulary, not of the data."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")})


def encode_documents(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """Encode every whole text, and decode it again.

    Returns the columns `keep`, n_tokens, ids (binary, little-endian unsigned
    32-bit) and, if asked for, decoded.  A null text counts as empty: no ids and
    an empty text.  A special token's string in a text becomes that token.
    Rows stay as they are, repeated ones too; other columns are left out, so
    none can clash.  A very long text is encoded whole, by itself.  An empty
    table gives no rows.
    """
    text_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(compile_tokenizer(tokenizer))  # bounded by the vocabulary
    rows = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for batch in batches:
            texts = strings(batch.column(len(keep)))
            for a, b in slices(texts, 1 << 22):
                ids, first = automaton.encode_all(texts.slice(a, b - a))
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                out = [*[c.slice(a, b - a) for c in batch.columns[: len(keep)]], pa.array(np.diff(first), pa.int64()), packed]
                names = [*keep, "n_tokens", "ids"]
                if decoded:
                    out.append(automaton.decode_all(ids, first))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, f"{kept}, n_tokens bigint, ids binary" + ", decoded string" * decoded)
