"""Vectorised word, shingle and line arithmetic over Arrow string batches.

Everything works on the UTF-8 bytes of many texts laid end to end, so the cost is a few numpy passes a byte and no
Python object per word. Words are maximal runs of bytes outside the white space set (space, 0x09 to 0x0D); UTF-8
continuation and lead bytes are never in that set, so byte words equal code point words.

Segment hashes come from one prefix sum: with P[i] = sum of byte[j] * B**j for j < i (modulo 2**64), the segment [s, e)
has the position-free value (P[e] - P[s]) * B**-s, which a finaliser then mixes with the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# An odd 64-bit base of the prefix sum, and the multipliers of the 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; grown on demand and kept for the worker's life."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser: each output bit depends on each input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(33)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(33)
    return x


def seeded(i: int) -> np.uint64:
    """The i-th of a fixed sequence of odd 64-bit multipliers."""
    return np.uint64(int(mix(np.array([(i + 1) * BASE & (1 << 64) - 1], np.uint64))[0]) | 1)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the len(col) + 1 offsets; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(col: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text is a range by itself, never cut."""
    if not len(col):
        return
    col = col.fill_null("") if col.null_count else col
    size = np.asarray(pc.binary_length(col), np.int64)
    end = np.cumsum(size)
    at = 0
    while at < len(size):
        before = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, before + most, "right")))
        yield at, to
        at = to


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(up[:-1] * data, out=out[1:])
    return out


def segment_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte segment, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    value = (prefix[end] - prefix[start]) * down[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(MIX_1))


class Texts:
    """The words of a batch of texts. `lower` maps A-Z to a-z first."""

    def __init__(self, col: pa.Array, lower: bool = False) -> None:
        self.raw, self.off = column_bytes(col)
        self.data = _LOWER[self.raw] if lower else self.raw
        n = len(self.data)
        space = _SPACE[self.data]
        self.space = space
        first = np.zeros(n + 1, bool)
        first[self.off] = True
        inside = ~space
        prev = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            prev[0], prev[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            self.start = np.flatnonzero(inside & (~prev | first[:-1]))
            self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: words of text d are word_off[d] to word_off[d + 1]
        self.word_off = np.searchsorted(self.start, self.off)
        self.n_words = np.diff(self.word_off)
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.off) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def segment_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte segment, equal for equal bytes wherever they stand."""
        if self._prefix is None:
            self._prefix = prefix_sums(self.data)
        return segment_hash(self._prefix, start, end)

    def word_hash(self) -> np.ndarray:
        return self.segment_hash(self.start, self.end)

    def sum_by_text(self, flag: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array for each text."""
        return spans_sum(flag, self.off)


def spans_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def shingle_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, across texts too; shingle i starts at word i."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += words[j : j + n] * seeded(j)
    return mix(out)


def shingle_starts(word_off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a whole shingle fits inside its text, and the offsets of each text in that list."""
    fits = np.maximum(np.diff(word_off) - width + 1, 0)
    off = np.concatenate([[0], np.cumsum(fits)])
    at = np.arange(off[-1]) + np.repeat(word_off[:-1] - off[:-1], fits)
    return at, off


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal elsewhere in the array."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def later_copies(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal before them in the array."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def runs_of(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and text of the maximal runs of bytes that are inside, which texts (offsets off) cut."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the segments end to end, and their offsets."""
    off = np.concatenate([[0], np.cumsum(end - start)])
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], end - start)
    return data[at], off


def strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """An Arrow array of the UTF-8 segments between the offsets."""
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
