"""Words of a batch of texts and their 64-bit hashes, vectorised over the batch's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Letters, digits and all bytes of longer characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers, and those of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        for k, base in enumerate((_BASE, _BACK)):
            out = np.empty(size, U)
            out[0] = 1
            have = 1
            while have < size:
                more = min(have, size - have)
                out[have : have + more] = out[:more] * U(int(out[have - 1]) * int(base) & (1 << 64) - 1)
                have += more
            _powers[k] = out
    return _powers[0], _powers[1]


#: (place, byte) pairs whose numbers stand in a table; those of places further on are worked out.
_PLACES = 64 << 8
_tables: dict[int, np.ndarray] = {}


def _place_values(at: np.ndarray, salt: int) -> np.ndarray:
    return mix(mix(at * U(0x9E3779B97F4A7C15) + U(salt)) + at)


def _places(salt: int) -> np.ndarray:
    if salt not in _tables:
        _tables[salt] = _place_values(np.arange(_PLACES).astype(U), salt)
    return _tables[salt]


def slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes at the most, one row at the least."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


class Texts:
    """Bytes, words and hashes of some rows of a string column without nulls."""

    def __init__(self, column: pa.Array, apart: np.ndarray = SPACE, lower: bool = True):
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.n, self.offsets, self.raw = n, offsets - offsets[0], raw
        self.data = LOWER[raw] if lower else raw
        inside = ~apart[raw]
        start, end = inside.copy(), inside.copy()
        if len(raw):
            start[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            first = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
            last = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
            start[first], end[last] = inside[first], inside[last]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.inside = inside
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        # rows without text share an offset with the next row; the last of them holds the word
        self.first = np.searchsorted(self.doc, np.arange(n + 1))

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        found = (total[self.end] - total[self.start]) * down[self.start]
        return mix(found ^ ((self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93)))


    def word_hashes(self, salt: int) -> np.ndarray:
        """A hash of each word: the sum of a random number for each of its (place, byte).

        The numbers of two places have nothing to do with each other, so no
        rearrangement of bytes leaves the sum as it is, as in a polynomial.
        """
        if not len(self.start):
            return np.zeros(0, U)
        lengths = self.end - self.start
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        at = place << 8 | self.data[self.inside]
        values = _places(salt)[np.minimum(at, _PLACES - 1)]
        far = np.flatnonzero(at >= _PLACES)
        if len(far):
            values[far] = _place_values(at[far].astype(U), salt)
        return mix(np.add.reduceat(values, first) ^ lengths.astype(U) * U(0xD6E8FEB86659FD93))

    def word_numbers(self) -> np.ndarray:
        """A number for each word: two have the same only if their bytes are the same."""
        lengths = self.end - self.start
        offsets = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        data = pa.py_buffer(np.ascontiguousarray(self.data[self.inside]))
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), data])
        return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def join_hashes(*parts: np.ndarray) -> np.ndarray:
    """One hash of a sequence of hashes."""
    out = np.full(len(parts[0]), 0x51_7CC1B727220A95, U)
    for p in parts:
        out = mix(out * U(0x2545F4914F6CDD1D) + p)
    return out


def strings(column: pa.Array) -> pa.Array:
    """The column with 32-bit offsets and without nulls."""
    column = column.cast(pa.string()) if column.type != pa.string() else column
    return column.fill_null("") if column.null_count else column
