"""Near-duplicate passages by compact windows.

A text of n shingles (runs of five words) has a min-hash for every one of its O(n * n) passages, but few distinct ones:
in the Cartesian tree over the shingles' hash values, node c with subtree [l, r] is the minimum of exactly the passages
[i, j] with l <= i <= c <= j <= r. That triple is a compact window. Windows shorter than the least passage are never
needed, and their nodes need not be visited: a node's subtree has LEAST shingles or more if and only if it is the minimum
of some run of LEAST shingles. About 2 n / LEAST windows a hash function remain.

1. Windows: for each of FUNCTIONS hash functions a row (key, text, place, context key); the key is function and minimum.
   The context is the window's shingles, _SIDE at most to either side of the centre: every passage of LEAST to
   2 LEAST - 1 shingles with that minimum lies in it, and any longer one has such a part. Copies of a text are one text.
2. Keys that two different texts share go on. A task that sees a key in two texts knows as much itself: two rows stand
   for it in the shuffle by key, the others are dealt evenly, so no key fills a task.
3. Nodes: rows of one key with equal contexts are one node, whatever number of texts has them, by an aggregation that
   combines first. Only one context a node is moved, and none where a key has one node.
4. Verification, pair by pair: two contexts of a key are linked where passages of LEAST shingles or more around their
   centres have a Jaccard similarity of SIMILARITY or more, each at its own length. Pairs that codes cannot make alike are
   told apart by these; the others are compared until each node's first link and the components of all links are known. A
   node's first link is that with the first node in the order of context keys; it gets the span of that link, and of the
   links that are the first of other nodes.
5. Keys with more than TILE nodes are dealt out in tiles with some LEADERS of the key in each, the first in order, and
   verified tile by tile. Classes that share a leader are one. Nodes outside the key's largest class, and those that are
   linked to no leader, meet every tile of it, and each is compared with every row there: no class and no first link is
   missed, and the result is the same whatever TILE is.
6. Spans of a text that overlap are merged, and every document with that text gets them.

A pair of passages at similarity J has none of the FUNCTIONS minima in common with probability (1 - J) ** FUNCTIONS:
under two in a thousand at 0.8, never for equal passages. Those that meet under a key are all compared, or told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import discard, located, written
from .textkernel import Texts, mix, powers, seeded, shingle_hash, shingle_starts, slices

SHINGLE = 5
#: Words of the least passage, and shingles of it.
LEAST_WORDS = 50
LEAST = LEAST_WORDS - SHINGLE + 1
SIMILARITY = 0.8
FUNCTIONS = 4
#: Nodes of a key that are verified together, and those among them that stand in each of a larger key's tiles.
TILE = 4096
LEADERS = 32
SLICE = 512 << 10
PLACE_BITS = 24

_SIDE = 2 * LEAST - 2
_WIDE = 2 * _SIDE + 1
#: c of n shingles in common give SIMILARITY to a passage as long if c / (2 n - c) >= SIMILARITY, so if _GAIN c >= _COST n.
_GAIN, _COST = 9, 8
assert abs(_COST / (2 * _GAIN - _COST) - SIMILARITY) < 1e-9
#: Shingles that a pair of passages has in common at least.
_COMMON = -(-_COST * LEAST // _GAIN)
#: Codes of one that the other has at least, where may_be_alike() is true.
_HELD = -(-4 * LEAST // 5)

_CONTEXT = "key long, part long, ck long, lo long, hi long, least long, context binary"
_CONTEXT_NAMES = [x.split()[0] for x in _CONTEXT.split(", ")]
_VERDICT = "key long, ck long, start int, stop int, similarity double, least long"
_VERDICT_NAMES = [x.split()[0] for x in _VERDICT.split(", ")]
#: A node's first link in a part (null: none): the other node and the passage there; begin and end of equal contexts of several texts.
_EDGE = f"{_VERDICT}, first long, from int, to int, begin int, end int"
_EDGE_NAMES = [x.split()[0] for x in _EDGE.split(", ")]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of its minimum, the leftmost of equals; by doubling."""
    # The place is packed into the low bits; longer input goes in overlapping runs.
    most = 1 << PLACE_BITS
    if len(values) > most:
        step = most - width + 1
        return np.concatenate([sliding_argmin(values[i : i + most], width) + i for i in range(0, len(values) - width + 1, step)])
    bits = np.uint64(PLACE_BITS)
    least = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    w = 1
    while 2 * w <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < width:
        least = np.minimum(least[: len(values) - width + 1], least[width - w :][: len(values) - width + 1])
    return (least & np.uint64(most - 1)).astype(np.int64)


def cartesian_subtrees(values: list[int]) -> tuple[list[int], list[int]]:
    """Nearest neighbours on either side that are less (-1 and len if none), by the stack that builds a Cartesian tree."""
    left, right, stack = [-1] * len(values), [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1] if values[stack[-1]] < v else left[stack[-1]]
        stack.append(i)
    return left, right


def _thinned(c: np.ndarray, value: np.ndarray, start: np.ndarray, begins: np.ndarray, least: int) -> np.ndarray:
    """Which of the minima c (ascending) are nodes: of equal ones, so many that each run of `least` values has one.

    start is the first run that c is the leftmost minimum of, begins tells where a text does. Runs that follow each other
    with equal minima are a chain. Its first run takes the last of its minima, the first run without that does so again.
    """
    head = begins | np.append(True, value[1:] != value[:-1])
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(c)) - 1
    keep = np.zeros(len(c), bool)
    reach = start[at] + least - 1
    while len(last):
        now = np.minimum(np.searchsorted(c, reach, "right") - 1, last)
        keep[now] = True
        # what lies behind is the leftmost of a run without this one
        more = now < last
        reach, last = c[now[more]] + least, last[more]
    return keep


def compact_windows(values: np.ndarray, off: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, l, c, r), both ends included, of all compact windows of at least `least` shingles.

    values are the hash values of all texts end to end, off their offsets. Only minima of runs of `least` values are
    nodes of the tree; the nearest smaller neighbour of such a minimum is one too, so the subtree's ends are right.
    Where a value comes again and again (repeated words), not each is a node, but each run has a minimum that is: any of
    them may stand for its passages, and windows go on over equal values to either side.
    """
    fits = np.maximum(np.diff(off) - least + 1, 0)
    if not fits.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none
    who = np.repeat(np.arange(len(fits)), fits)
    start = np.arange(len(who)) + np.repeat(off[:-1] - (np.cumsum(fits) - fits), fits)
    c = sliding_argmin(values, least)[start]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (who[1:] != who[:-1])
    c, text, start = c[new], who[new], start[new]
    keep = _thinned(c, values[c] >> np.uint64(24), start, np.append(True, text[1:] != text[:-1]), least)
    c, text = c[keep], text[keep]
    # One tree for each text: between texts stands a value below all others.
    first = np.ones(len(c), bool)
    first[1:] = text[1:] != text[:-1]
    at = np.arange(len(c)) + np.cumsum(first)
    nodes = np.full(at[-1] + 2, -1, np.int64)
    nodes[at] = (values[c] >> np.uint64(24)).astype(np.int64)
    from_left, from_right = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    from_left[at], from_right[at] = c + 1, c - 1
    from_left[at[first] - 1] = off[text[first]]
    ends = np.append(np.flatnonzero(first)[1:] - 1, len(c) - 1)
    from_right[at[ends] + 1] = off[text[ends] + 1] - 1
    left, right = cartesian_subtrees(nodes.tolist())
    return text, from_left[np.array(left)[at]], c, from_right[np.array(right)[at]]


def _values(grams: np.ndarray, function: int) -> np.ndarray:
    return mix(grams * seeded(100 + function))


def _shingles(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, texts end to end, and their offsets."""
    at, off = shingle_starts(t.word_off, SHINGLE)
    return (shingle_hash(t.word_hash(), SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)), off


def window_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, key, place, context key) of all windows of all functions.

    place is 2**14 * centre + 128 * left + right: how far the window goes to either side of the centre, _SIDE at most.
    Windows with equal context keys have the same shingles at the same distances from their centres.
    """
    grams, off = _shingles(Texts(col))
    up, down = powers(len(grams) + 1)
    prefix = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(grams * up[:-1], out=prefix[1:])
    found = []
    for f in range(FUNCTIONS):
        v = _values(grams, f)
        row, left, c, right = compact_windows(v, off)
        left, right = np.minimum(c - left, _SIDE), np.minimum(right - c, _SIDE)
        begin = c - left
        within = (prefix[c + right + 1] - prefix[begin]) * down[begin]
        ck = mix(within + (128 * left + right + 1).astype(np.uint64) * seeded(99)).view(np.int64)
        found.append((row, mix(v[c] + np.uint64(f)).view(np.int64), (c - off[row]) << 14 | 128 * left + right, ck))
    return tuple(np.concatenate(x) for x in zip(*found))


def known_shared(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which rows need not be looked at for the key to be known as shared: all but one of each of two texts, if it has two."""
    order = np.lexsort((text, key))
    k, t = key[order], text[order]
    new_key = np.append(True, k[1:] != k[:-1])[: len(k)]
    new_text = np.append(True, t[1:] != t[:-1])[: len(t)] | new_key
    nth = np.cumsum(new_text)
    begin = np.flatnonzero(new_key)
    size = np.diff(np.append(begin, len(k)))
    nth_in_key = nth - np.repeat(nth[begin], size)
    several = np.repeat(np.maximum.reduceat(nth_in_key, begin) > 0, size) if len(k) else np.zeros(0, bool)
    out = np.zeros(len(k), bool)
    out[order] = several & ~(new_text & (nth_in_key < 2))
    return out


def _windows(docs: DataFrame) -> DataFrame:
    """(deal, alt, tkey, place, ck): the key is alt where that is not null, and known to be shared; else it is deal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            # a copy of a text of this task adds nothing
            b = b.filter(pa.array([k not in seen and not seen.add(k) for k in b.column(0).to_pylist()], pa.bool_()))
            for i, j in slices(b.column(1), SLICE):
                part = b.slice(i, j - i)
                row, key, place, ck = window_rows(part.column(1))
                tkey = part.column(0).to_numpy()[row]
                known = known_shared(key, tkey)
                even = mix(key.view(np.uint64) + mix(tkey.view(np.uint64) ^ place.view(np.uint64))).view(np.int64)
                arrays = [pa.array(np.where(known, even, key)), pa.array(key, mask=~known), pa.array(tkey), pa.array(place), pa.array(ck)]
                yield pa.RecordBatch.from_arrays(arrays, ["deal", "alt", "tkey", "place", "ck"])

    return docs.mapInArrow(run, "deal long, alt long, tkey long, place long, ck long")


def _contexts(joined: DataFrame) -> DataFrame:
    """Rows (text, n: list of nodes key, ck, place, lo, hi, least, part) -> a row a node with its context, as 32-bit codes, 0 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.arange(-_SIDE, _SIDE + 1)
        for b in batches:
            for i, j in slices(b.column(0), SLICE):
                part = b.slice(i, j - i)
                grams, off = _shingles(Texts(part.column(0)))
                code = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                nodes = part.column(1)
                row = np.repeat(np.arange(len(part)), np.diff(nodes.offsets.to_numpy()))
                flat = dict(zip(["key", "ck", "place", "lo", "hi", "least", "part"], nodes.flatten().flatten()))
                for at in range(0, len(row), 4096):
                    one = {k: v.slice(at, 4096) for k, v in flat.items()}
                    place, own = one.pop("place").to_numpy(), row[at : at + 4096]
                    centre, left, right = place >> 14, place >> 7 & 127, place & 127
                    inside = (step >= -left[:, None]) & (step <= right[:, None])
                    context = np.zeros(inside.shape, np.uint32)
                    context[inside] = code[((off[own] + centre)[:, None] + step)[inside]]
                    yield pa.RecordBatch.from_arrays([*(one[k] for k in _CONTEXT_NAMES[:-1]), _packed(context)], _CONTEXT_NAMES)

    return joined.mapInArrow(run, _CONTEXT)


def _packed(codes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(4 * _WIDE), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())


def longest_runs(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each row's longest run of LEAST or more around the centre with _GAIN * held >= _COST * length; 0, 0 if none."""
    start, stop = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
    for at in range(0, len(held), 1024):
        h = held[at : at + 1024]
        score = np.zeros((len(h), _WIDE + 1), np.int16)
        np.cumsum(h * np.int16(_GAIN) - np.int16(_COST), 1, out=score[:, 1:], dtype=np.int16)
        ends = np.ascontiguousarray(score[:, : _SIDE : -1])
        good = ends[:, None, :] >= score[:, : _SIDE + 1, None]
        last = good.argmax(2)
        length = np.where(np.take_along_axis(good, last[:, :, None], 2)[:, :, 0], _WIDE - last - np.arange(_SIDE + 1), 0)
        best = length.argmax(1)
        size = length[np.arange(len(h)), best]
        start[at : at + 1024], stop[at : at + 1024] = np.where(size >= LEAST, best, 0), np.where(size >= LEAST, best + size, 0)
    return start, stop


#: For each beginning the first end of a run of LEAST or more around the centre.
_FIRST_END = np.maximum(_SIDE + 1, np.arange(_SIDE + 1) + LEAST)


def _best_run(held: np.ndarray, gain: int, cost: int) -> np.ndarray:
    """The greatest gain * held - cost * length of each row's runs of LEAST or more around the centre."""
    score = np.zeros((len(held), _WIDE + 1), np.int16)
    np.cumsum(np.where(held, np.int16(gain - cost), np.int16(-cost)), 1, out=score[:, 1:], dtype=np.int16)
    best = np.maximum.accumulate(score[:, : _SIDE : -1], 1)[:, _WIDE - _FIRST_END]
    return (best - score[:, : _SIDE + 1]).max(1) if len(held) else np.zeros(0, np.int16)


def may_be_alike(held: np.ndarray) -> np.ndarray:
    """False for rows that have no passage around the centre which could reach SIMILARITY with these in common and no more.

    Of c in common, in n here and LEAST or more there: c / (n + LEAST - c) >= SIMILARITY, so 9 c - 4 n >= 4 LEAST.
    """
    return _best_run(held, 9, 4) >= 4 * LEAST


def has_run(held: np.ndarray) -> np.ndarray:
    """Which rows have a run as longest_runs() seeks; of two passages that reach SIMILARITY, the shorter one has."""
    return _best_run(held, _GAIN, _COST) >= 0


def held_by_others(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, more_than: int = 0, group: np.ndarray | None = None) -> np.ndarray:
    """Which codes (0 is none) stand in a row of the group with another label too, and in more than so many rows; rows have labels lo and hi."""
    there = codes != 0
    width = there.sum(1)
    flat = codes[there]
    if group is not None:
        flat = flat | np.repeat(group.astype(np.uint64) << np.uint64(32), width)
    out = np.zeros(codes.shape, bool)
    if not len(flat):
        return out
    order = np.argsort(flat)
    edge = _edges(flat[order])
    least = np.minimum.reduceat(np.repeat(lo, width)[order], edge)
    most = np.maximum.reduceat(np.repeat(hi, width)[order], edge)
    size = np.diff(np.append(edge, len(flat)))
    held = np.empty(len(flat), bool)
    held[order] = np.repeat((least != most) & (size > more_than), size)
    out[there] = held
    return out


#: Places from the centre outwards, and how far out each place stands in that order.
_OUTWARDS = np.argsort(np.abs(np.arange(_WIDE) - _SIDE), kind="stable")
_RANK = np.argsort(_OUTWARDS).astype(np.uint64)


def _places_in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each code of b's rows its place in the same row of a, -1 if it has none; of several places the one nearest to the centre."""
    n = len(a)
    line = np.arange(n, dtype=np.uint64)[:, None] << np.uint64(40)
    flat = (np.sort(a.astype(np.uint64) << np.uint64(8) | _RANK, 1) | line).ravel()
    sought = (b.astype(np.uint64) << np.uint64(8) | line).ravel()
    at = flat[np.minimum(np.searchsorted(flat, sought), len(flat) - 1)] if len(flat) else flat
    return np.where((at >> np.uint64(8) == sought >> np.uint64(8)) & (b.ravel() != 0), _OUTWARDS[(at & np.uint64(255)).astype(np.int64)], -1).reshape(b.shape)


def _distinct(codes: np.ndarray) -> np.ndarray:
    """The number of distinct codes of each row, 0 not counted."""
    codes = np.sort(codes, 1)
    return ((codes[:, 1:] != codes[:, :-1]) & (codes[:, 1:] != 0)).sum(1) + (codes[:, 0] != 0)


def _trim(both: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    """Ends that the other lacks go, as far as the passage stays long enough."""
    first, last = both.argmax(1), _WIDE - both[:, ::-1].argmax(1)
    long = both.any(1) & (hi - lo > LEAST) & (last - first >= LEAST)
    lo[long], hi[long] = first[long], last[long]


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts a against b, row by row -> (start, stop) in a, (start, stop) in b, similarity: passages around the centres.

    Rows whose passages do not reach SIMILARITY have similarity 0. Of two passages that do, the shorter one (or both) has
    a run by its own length; where the other has none, it is what holds the run's shingles.
    """
    out = [np.zeros(len(a), np.int64) for _ in range(4)] + [np.zeros(len(a))]
    in_a = _places_in(a, b)
    some = np.flatnonzero(may_be_alike(in_a >= 0))
    in_b = _places_in(b[some], a[some])
    both = may_be_alike(in_b >= 0)
    both[both] = has_run(in_b[both] >= 0) | has_run(in_a[some[both]] >= 0)
    some, in_b = some[both], in_b[both]
    for x, v in zip(out, _passages(in_b, in_a[some], a[some], b[some])):
        x[some] = v
    return tuple(out)


def _passages(in_b: np.ndarray, in_a: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """alike() by the places in the other of the codes of either.

    Passages in which codes repeat may be similar by other measures: see _repetitive().
    """
    (a0, a1), (b0, b1) = longest_runs(in_b >= 0), longest_runs(in_a >= 0)
    place = np.arange(_WIDE)
    out_a, out_b = (a1 == 0) & (b1 > 0), (b1 == 0) & (a1 > 0)
    for who, there, lo, hi, from0, from1 in ((out_a, in_a, a0, a1, b0, b1), (out_b, in_b, b0, b1, a0, a1)):
        seen = (there[who] >= 0) & (place >= from0[who, None]) & (place < from1[who, None])
        lo[who] = np.where(seen, there[who], _WIDE).min(1)
        hi[who] = np.where(seen, there[who], -1).max(1) + 1
    within = lambda x, lo, hi: (x >= lo[:, None]) & (x < hi[:, None])
    both_a = within(place, a0, a1) & within(in_b, b0, b1)
    both_b = within(place, b0, b1) & within(in_a, a0, a1)
    _trim(both_a, a0, a1)
    _trim(both_b, b0, b1)
    common = np.minimum(both_a.sum(1), both_b.sum(1))
    size = np.maximum(a1 - a0, LEAST) + np.maximum(b1 - b0, LEAST)
    similarity = common / np.maximum(size - common, 1)
    similarity[(a1 == 0) | (b1 == 0)] = 0
    unsure = np.flatnonzero((similarity < SIMILARITY - 1e-9) & (a1 - a0 >= LEAST) & (b1 - b0 >= LEAST))
    for at in range(0, len(unsure), 1024):
        x = unsure[at : at + 1024]
        x = x[_repeats(a[x], a0[x], a1[x]) | _repeats(b[x], b0[x], b1[x])]
        a0[x], a1[x], b0[x], b1[x], similarity[x] = _repetitive(a[x], b[x], a0[x], a1[x], b0[x], b1[x], similarity[x])
    return a0, a1, b0, b1, np.where(similarity >= SIMILARITY - 1e-9, similarity, 0.0)


def _within(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The codes from lo to hi of each row, 0 elsewhere."""
    place = np.arange(_WIDE)
    return np.where((place >= lo[:, None]) & (place < hi[:, None]), codes, 0)


def _repeats(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    own = _within(codes, lo, hi)
    return _distinct(own) < (own != 0).sum(1)


def _repetitive(a: np.ndarray, b: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """_passages() again, from its results, for passages in which codes repeat: whichever of these is most similar.

    The passages by their sets of codes; and, as numbers of shingles, the shorter one with a part of the longer one that is
    as long, holds the centre and has most shingles in common, the first or last such part.
    """
    best = [x.copy() for x in ends]
    a0, a1, b0, b1 = ends[:4]
    own, other = _within(a, a0, a1), _within(b, b0, b1)
    union = _distinct(np.concatenate([own, other], 1))
    best[4] = np.maximum(best[4], (_distinct(own) + _distinct(other) - union) / np.maximum(union, 1))
    first = np.arange(_SIDE + 1)
    swap = (a1 - a0 > b1 - b0)[:, None]
    short, long = np.where(swap, other, own), np.where(swap, own, other)
    n, lo, hi = np.minimum(a1 - a0, b1 - b0)[:, None], np.where(swap[:, 0], a0, b0)[:, None], np.where(swap[:, 0], a1, b1)[:, None]
    count = np.zeros((len(a), _WIDE + 1), np.int64)
    np.cumsum(_places_in(short, long) >= 0, 1, out=count[:, 1:])
    fits = (first >= lo) & (first + n <= hi) & (first + n > _SIDE)
    held = np.where(fits, np.take_along_axis(count, np.minimum(first + n, _WIDE), 1) - count[:, : _SIDE + 1], -1)
    for at in (held.argmax(1), _SIDE - held[:, ::-1].argmax(1)):
        to = at + n[:, 0]
        part = _within(long, at, to)
        common = np.minimum((_places_in(short, part) >= 0).sum(1), (_places_in(part, short) >= 0).sum(1))
        similarity = common / np.maximum(2 * n[:, 0] - common, 1)
        more = fits.any(1) & (similarity > best[4])
        best[4][more] = similarity[more]
        for k, mine in ((0, swap[:, 0]), (2, ~swap[:, 0])):
            # the side that is not cut keeps its ends
            best[k][more], best[k + 1][more] = np.where(mine, at, ends[k])[more], np.where(mine, to, ends[k + 1])[more]
    return best


def _level(held: np.ndarray) -> tuple[np.ndarray, ...]:
    """alike() where the codes that are held stand at the same places in both."""
    start, stop = longest_runs(held)
    place = np.arange(_WIDE)
    held = held & (place >= start[:, None]) & (place < stop[:, None])
    _trim(held, start, stop)
    c = held.sum(1)
    return start, stop, start, stop, c / np.maximum(2 * np.maximum(stop - start, LEAST) - c, 1)


class Contexts:
    """Contexts that are compared with each other; lo and hi are the least and greatest text of each."""

    def __init__(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.codes, self.lo, self.hi = codes, lo, hi

    def links(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which of the pairs are linked, and for these (start, stop) in i, (start, stop) in j, similarity."""
        own = ~((self.lo[i] == self.hi[i]) & (self.lo[j] == self.hi[j]) & (self.lo[i] == self.lo[j]))
        out = [np.zeros(len(i), t) for t in (np.int64,) * 4 + (float,)]
        # Place by place first: what is alike without shifts is alike.
        same = np.zeros(len(i), np.int64)
        for at in range(0, len(i), 4096):
            to = slice(at, at + 4096)
            same[to] = ((self.codes[i[to]] == self.codes[j[to]]) & (self.codes[i[to]] != 0)).sum(1)
        close = np.flatnonzero(own & (same >= _COMMON))
        for at in range(0, len(close), 4096):
            x = close[at : at + 4096]
            held = (self.codes[i[x]] == self.codes[j[x]]) & (self.codes[i[x]] != 0)
            for k, v in enumerate(_level(held)):
                out[k][x] = v
        far = np.flatnonzero(own & (out[4] == 0))
        for at in range(0, len(far), 1024):
            x = far[at : at + 1024]
            for k, v in enumerate(alike(self.codes[i[x]], self.codes[j[x]])):
                out[k][x] = v
        found = np.flatnonzero(out[4])
        return found, *(x[found] for x in out)


class Forest:
    """Components of the links within groups of contexts, each context's first link, and the span of the links found.

    The first link is that with the first of the rows linked to a context. Rows of a group are in the order of their
    context keys, so it does not depend on what is compared together.
    """

    def __init__(self, contexts: Contexts) -> None:
        n = len(contexts.codes)
        self.contexts = contexts
        self.start, self.stop, self.similarity, self.root = np.full(n, _WIDE), np.zeros(n, np.int64), np.zeros(n), np.arange(n)
        self.first = np.full(n, n)
        # of the first link: start, stop here, start, stop there, similarity
        self.of_first = [np.zeros(n, t) for t in (np.int64,) * 4 + (float,)]
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, i: np.ndarray, j: np.ndarray, *link: np.ndarray) -> None:
        """Links of rows i with rows j: (start, stop) in i, (start, stop) in j, similarity."""
        s0, s1, t0, t1, sim = link
        self.links.append((i, j))
        mine, other = np.concatenate([i, j]), np.concatenate([j, i])
        both = [np.concatenate(x) for x in ((s0, t0), (s1, t1), (t0, s0), (t1, s1), (sim, sim))]
        np.minimum.at(self.start, mine, both[0])
        np.maximum.at(self.stop, mine, both[1])
        np.maximum.at(self.similarity, mine, both[4])
        less = np.flatnonzero(other < self.first[mine])
        less = less[np.lexsort((other[less], mine[less]))]
        less = less[_edges(mine[less])] if len(less) else less
        self.first[mine[less]] = other[less]
        for x, v in zip(self.of_first, both):
            x[mine[less]] = v[less]

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compare the pairs and take in their links."""
        which, *link = self.contexts.links(i, j)
        if len(which):
            self.take(i[which], j[which], *link)

    def join(self) -> None:
        """Roots of the components of all links taken in."""
        if not self.links:
            return
        i, j = (np.concatenate(x) for x in zip(*self.links))
        self.links = []
        while True:
            a, b = self.root[i], self.root[j]
            if (a == b).all():
                return
            low = np.minimum(a, b)
            # the root of a root goes down with it
            for x in (a, b):
                np.minimum.at(self.root, x, low)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stop and similarity of each context: of its first link, and of those that are the first of others."""
        n = len(self.first)
        has = np.flatnonzero(self.first < n)
        to = self.first[has]
        s0, s1, t0, t1, sim = self.of_first
        start, stop, similarity = np.where(self.first < n, s0, _WIDE), s1.copy(), sim.copy()
        np.minimum.at(start, to, t0[has])
        np.maximum.at(stop, to, t1[has])
        np.maximum.at(similarity, to, sim[has])
        return np.where(stop > 0, start, 0), stop, similarity

    def link_one(self, x: int, ys: np.ndarray, in_x: np.ndarray, own: np.ndarray, level: np.ndarray) -> np.ndarray:
        """link() of one row with others, whose codes have the places in_x in it.

        own[p] is the place at which its p-th code is looked up; level tells what stands at the same place in both.
        """
        c = self.contexts
        there = in_x >= 0
        some = np.flatnonzero(there.sum(1) >= _HELD)
        some = some[may_be_alike(there[some])]
        if c.lo[x] == c.hi[x]:
            some = some[(c.lo[ys[some]] != c.hi[ys[some]]) | (c.lo[ys[some]] != c.lo[x])]
        if not len(some):
            return some
        in_x, there = in_x[some], there[some]
        # of several places the nearest to the centre, which comes last
        line, place = np.nonzero(there[:, _OUTWARDS[::-1]])
        place = _OUTWARDS[::-1][place]
        in_y = np.full(in_x.shape, -1, np.int16)
        in_y[line, in_x[line, place]] = place
        in_y = np.where(own >= 0, in_y[:, own], np.int16(-1))
        may = may_be_alike(in_y >= 0)
        may[may] = has_run(there[may]) | has_run(in_y[may] >= 0)
        some, in_x, in_y = some[may], in_x[may], in_y[may]
        if not len(some):
            return some
        level = level[some]
        flat = has_run(level)
        found = [np.empty(len(some), t) for t in (np.int64,) * 4 + (float,)]
        for k, v in enumerate(_level(level[flat])):
            found[k][flat] = v
        rest = ~flat
        rest[flat] = found[4][flat] < SIMILARITY
        if rest.any():
            y = ys[some[rest]]
            for k, v in enumerate(_passages(in_y[rest], in_x[rest], np.broadcast_to(c.codes[x], (len(y), _WIDE)), c.codes[y])):
                found[k][rest] = v
        x0, x1, y0, y1, sim = found
        good = sim > 0
        if good.any():
            y = ys[some[good]]
            self.take(np.full(len(y), x), y, *(v[good] for v in found))
        return some[good]

    def search(self, group: np.ndarray, rows: np.ndarray) -> None:
        """rows (of groups `group`, sorted by them), all groups at once, each row in turn against those that follow.

        A row without a link is compared with all of them, one with a link with those that have none, so that the first
        link of each is found. What is left are pairs of linked rows of unlike components.
        """
        if not len(rows):
            return
        n = len(self.first)
        edge = _edges(group)
        size = np.diff(np.append(edge, len(group)))
        for t in range(int(size.max()) - 1):
            more = size > t + 1
            lead, follow = edge[more] + t, size[more] - t - 1
            i = np.repeat(lead, follow)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(follow) - follow, follow)
            i, j = rows[i], rows[j]
            open_ = (self.first[i] == n) | (self.first[j] == n)
            self.link(i[open_], j[open_])
        self.join()
        stay = np.flatnonzero(self.first[rows] < n)
        root, g = self.root[rows[stay]], group[stay]
        several = np.flatnonzero(np.repeat(*_several(root, g))) if len(stay) else stay
        if not len(several):
            return
        stay, root, g = stay[several], root[several], g[several]
        held = held_by_others(self.contexts.codes[rows[stay]], root, root, 0, g)
        stay = stay[may_be_alike(held)]
        i, j = _pairs(group[stay])
        i, j = rows[stay[i]], rows[stay[j]]
        # compared already, if the one before had no link in its turn or the other had none then
        new = (self.root[i] != self.root[j]) & (self.first[i] < i) & (self.first[j] < i)
        self.link(i[new], j[new])
        self.join()

    def search_alone(self, rows: np.ndarray, alone: np.ndarray) -> None:
        """One group: the rows that are alone against all others of it, each with every one; the others are not compared."""
        c = self.contexts
        stay = may_be_alike(held_by_others(c.codes[rows], c.lo[rows], c.hi[rows]))
        rows, alone = rows[stay], alone[stay]
        # The rows that are alone come last, so a pair of them is compared once.
        order = np.argsort(alone, kind="stable")
        rows, alone = rows[order], alone[order]
        linked = self._by_code(rows)
        for x in np.flatnonzero(alone).tolist():
            linked(x, np.arange(x))
            if len(self.links) >= 256:
                self.join()
        self.join()

    def _by_code(self, rows: np.ndarray):
        """A function (x, ys) -> which of rows[ys] are linked to rows[x]: link_one() with codes as numbers from 0.

        Linked rows have _COMMON codes in common or more. Leaving out a row's most frequent codes, fewer than that, the rest
        has to have what is missing; the rows that have so many of the rest are found by the rows of each code.
        """
        codes = self.contexts.codes[rows]
        numbers, number = np.unique(codes, return_inverse=True)
        number, at_hand = number.reshape(codes.shape).astype(np.int32), np.full(len(numbers), -1, np.int16)
        line, place = np.nonzero(codes)
        order = np.argsort(number[line, place], kind="stable")
        holders = line[order]
        begin = np.searchsorted(number[line, place][order], np.arange(len(numbers) + 1))

        def may_share(x: int) -> np.ndarray:
            own, times = np.unique(number[x][codes[x] != 0], return_counts=True)
            size = begin[own + 1] - begin[own]
            # The most frequent codes first; those that are few anyway need not be left out.
            by_size = np.argsort(-size, kind="stable")
            left_out = by_size[(np.cumsum(times[by_size]) < _COMMON) & (size[by_size] > len(rows) // 16)]
            rest = np.ones(len(own), bool)
            rest[left_out] = False
            need = _COMMON - int(times[left_out].sum())
            at = [holders[begin[k] : begin[k + 1]] for k in own[rest]]
            if not at:
                return np.zeros(len(rows), bool)
            return np.bincount(np.concatenate(at), np.repeat(times[rest], size[rest]), len(rows)) >= need

        def linked(x: int, ys: np.ndarray) -> np.ndarray:
            found = [np.zeros(0, np.int64)]
            near = np.arange(len(ys)) if len(ys) <= _SMALL else np.flatnonzero(may_share(x)[ys])
            if not len(near):
                return found[0]
            there = _OUTWARDS[::-1][codes[x][_OUTWARDS[::-1]] != 0]
            at_hand[number[x, there]] = there
            own = np.where(codes[x] != 0, at_hand[number[x]], -1)
            for at in range(0, len(near), 1024):
                some = near[at : at + 1024]
                y = ys[some]
                found.append(some[self.link_one(rows[x], rows[y], at_hand[number[y]], own, (number[y] == number[x]) & (codes[x] != 0))])
            at_hand[number[x, there]] = -1
            return np.concatenate(found)

        linked.number = number
        return linked

    def search_large(self, rows: np.ndarray) -> None:
        """One group of many rows.

        First go the rows that could not be alike even to one text with the codes of all others. Then the first links, as
        search() does. Then their components, the stars, are joined: a row can only be linked to another star's row if
        it could be alike to the codes of all other stars together, and then either by codes that many rows have alone,
        or by one that few have, which leads to its partners.
        """
        c = self.contexts
        while len(rows) > 1:
            stay = may_be_alike(held_by_others(c.codes[rows], c.lo[rows], c.hi[rows]))
            if stay.all():
                break
            rows = rows[stay]
        if len(rows) < 2:
            return
        codes = c.codes[rows]
        linked = self._by_code(rows)
        number = linked.number
        numbers = np.arange(int(number.max()) + 1)

        bare = np.ones(len(rows), bool)
        for x in range(len(rows) - 1):
            rest = np.arange(x + 1, len(rows)) if bare[x] else x + 1 + np.flatnonzero(bare[x + 1 :])
            if not len(rest):
                break
            which = rest[linked(x, rest)]
            bare[which] = False
            bare[x] &= not len(which)
        self.join()
        root = self.root[rows]
        open_ = may_be_alike(held_by_others(codes, root, root))
        _, star, size = np.unique(root, return_inverse=True, return_counts=True)
        if len(size) < 2 or not open_.any():
            return
        common = held_by_others(codes, root, root, _FEW)
        common = may_be_alike(common) & has_run(common)
        big = int(np.flatnonzero(star == size.argmax())[0])
        # The open rows that have each code.
        line, place = np.nonzero(np.where(open_[:, None], codes, 0))
        order = np.argsort(number[line, place], kind="stable")
        by_line = line[order]
        begin = np.searchsorted(number[line, place][order], np.arange(len(numbers) + 1))
        all_open = np.flatnonzero(open_)
        for x in np.flatnonzero(open_ & (star != star[big])).tolist():
            # What has come to the largest star needs no more: the other stars' rows will ask for it.
            if star[x] == star[big]:
                continue
            own = number[x][codes[x] != 0]
            if common[x]:
                near = all_open
            else:
                few = own[begin[own + 1] - begin[own] <= _FEW]
                near = np.unique(np.concatenate([by_line[begin[k] : begin[k + 1]] for k in few])) if len(few) else all_open[:0]
            near = near[np.argsort(star[near] != star[big], kind="stable")]
            at, step = 0, 32
            while at < len(near) and star[x] != star[big]:
                y, at, step = near[at : at + step], at + step, min(2 * step, 2048)
                y = y[star[y] != star[x]]
                which = linked(x, y)
                for other in np.unique(star[y[which]]):
                    star[star == other] = star[x]
        for one in np.unique(star):
            self.root[rows[star == one]] = rows[star == one][0]


#: Groups up to this size are searched together, pair by pair; codes that more rows have do not lead to partners.
_SMALL = 64
_FEW = 48


def searched(group: np.ndarray, contexts: Contexts, alone: np.ndarray | None = None) -> Forest:
    """Contexts sorted by group: components of the links within each group, and first links.

    alone: only the links of these rows are sought.
    """
    out = Forest(contexts)
    if len(group) and alone is not None:
        edge = np.append(_edges(group), len(group))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            out.search_alone(np.arange(a, b), alone[a:b])
    elif len(group):
        edge = _edges(group)
        size = np.diff(np.append(edge, len(group)))
        small = np.flatnonzero(np.repeat(size <= _SMALL, size))
        small = small[may_be_alike(held_by_others(contexts.codes[small], contexts.lo[small], contexts.hi[small], 0, group[small]))]
        out.search(group[small], small)
        for a, n in zip(edge[size > _SMALL].tolist(), size[size > _SMALL].tolist()):
            out.search_large(np.arange(a, a + n))
    return out


def forest(group: np.ndarray, contexts: Contexts, alone: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """searched() -> (start, stop, similarity, root), the spans over all links that were found.

    Rows without a link have 0, 0, 0 and themselves.
    """
    out = searched(group, contexts, alone)
    out.start[out.stop == 0] = 0
    return out.start, out.stop, out.similarity, out.root


def _several(root: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted groups, which have several roots, and their sizes."""
    edge = _edges(group)
    return np.minimum.reduceat(root, edge) < np.maximum.reduceat(root, edge), np.diff(np.append(edge, len(group)))


def _pairs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i before j) within sorted groups."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = _edges(group)
    size = np.diff(np.append(edge, len(group)))
    follow = np.repeat(edge + size, size) - np.arange(len(group)) - 1
    i = np.repeat(np.arange(len(group)), follow)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(follow) - follow, follow)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.append(0, np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1)


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows of _CONTEXT sorted by (key, part) -> their columns, whole groups together, about TILE rows at a time."""
    rest: list[np.ndarray] | None = None
    for whole in batches:
        for at in range(0, whole.num_rows, TILE):
            b = whole.slice(at, TILE)
            cols = [b.column(k).to_numpy() for k in range(6)]
            cols.append(np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint32).reshape(-1, _WIDE))
            cols += [b.column(k).to_numpy(zero_copy_only=False) for k in range(7, b.num_columns)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            # the last group may go on in the next batch; groups are bounded
            last = int(_edges(cols[0], cols[1])[-1])
            rest = [x[last:] for x in cols]
            if last:
                yield [x[:last] for x in cols]
    if rest is not None:
        yield rest


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of _CONTEXT, and `alone` if only links of such rows are sought, sorted by (key, part, ck) -> key, ck, forest, several, whole, least: of each node whether
    it has several texts of its own, where its context begins and ends, the least document of its component."""
    for key, part, ck, lo, hi, least, codes, *alone in _sorted_groups(batches):
        edge = _edges(key, part)
        group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(key))))
        found = searched(group, Contexts(codes, lo, hi), *alone)
        valid = codes != 0
        lowest = least.copy()
        np.minimum.at(lowest, found.root, least)
        yield key, ck, found, lo != hi, (valid.argmax(1), _WIDE - valid[:, ::-1].argmax(1)), lowest[found.root]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _CONTEXT, whole keys, sorted by (key, part, ck) -> a verdict for each node that has a partner there, or several texts of its own.

    start and stop are in shingles from the centre; least is the least document of the node's component. The span is that
    of its first link, and of those that are the first of others; equal contexts of several texts are all of it.
    """
    for key, ck, found, several, (begin, end), least in _searched(batches):
        start, stop, similarity = found.spans()
        start, stop, similarity = np.where(several, begin, start), np.where(several, end, stop), np.where(several, 1.0, similarity)
        out = stop > 0
        arrays = [key, ck, (start - _SIDE).astype(np.int32), (stop - _SIDE).astype(np.int32), similarity, least]
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in arrays], _VERDICT_NAMES)


def _first_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_verified() for parts of keys: each node's first link in the part, the other's side beside it."""
    for key, ck, found, several, (begin, end), least in _searched(batches):
        linked = found.first < len(ck)
        out = linked | several
        s0, s1, t0, t1, similarity = found.of_first
        place = lambda x, there: pa.array((x[out] - _SIDE).astype(np.int32), mask=~there[out])
        plain = lambda x: pa.array(x[out], mask=~linked[out])
        first = ck[np.where(linked, found.first, 0)]
        arrays = [pa.array(key[out]), pa.array(ck[out]), place(s0, linked), place(s1, linked), plain(similarity), pa.array(least[out]), plain(first)]
        arrays += [place(t0, linked), place(t1, linked), place(begin, several), place(end, several)]
        yield pa.RecordBatch.from_arrays(arrays, _EDGE_NAMES)


_EITHER = f"{_CONTEXT.replace('part', 'size')}, start int, stop int, similarity double"


def _verified_or_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_verified() for parts from 0 on; rows of other parts come out as they are, with size for part."""
    names = [x.split()[0] for x in _EITHER.split(", ")]
    types = {"context": pa.binary(), "start": pa.int32(), "stop": pa.int32(), "similarity": pa.float64()}

    def filled(n: int, of: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([of[c] if c in of else pa.nulls(n, types.get(c, pa.int64())) for c in names], names)

    def small() -> Iterator[pa.RecordBatch]:
        for b in batches:
            large = np.asarray(b.column("part")) < 0
            if large.any():
                kept.append(b.filter(pa.array(large)))
            yield b.filter(pa.array(~large)).select(_CONTEXT_NAMES)

    kept: list[pa.RecordBatch] = []
    for v in _verified(b for b in small() if b.num_rows):
        yield filled(v.num_rows, dict(zip(v.schema.names, v.columns)))
        while kept:
            k = kept.pop()
            yield filled(k.num_rows, {c: k.column(c) for c in names if c in k.schema.names})
    for k in kept:
        yield filled(k.num_rows, {c: k.column(c) for c in names if c in k.schema.names})


def _dealt(contexts: DataFrame) -> DataFrame:
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(n, "key", "part").sortWithinPartitions("key", "part", "ck").mapInArrow(_first_links, _EDGE)


def _summed(verdicts: DataFrame) -> DataFrame:
    """One verdict a node."""
    return verdicts.groupBy("key", "ck").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("similarity").alias("similarity"), F.min("least").alias("least"))


def _one_class(verdicts: list[DataFrame]) -> list[DataFrame]:
    """The verdicts with the least document of their whole class: classes of a key that have a node in common are one."""
    every = verdicts[0]
    for v in verdicts[1:]:
        every = every.unionByName(v)
    low = every.groupBy("key", "ck").agg(F.min("least").alias("low"))
    pair = lambda c: F.struct("key", F.col(c).alias("least"))
    links = every.join(low, ["key", "ck"]).where("low < least").select(pair("low").alias("a"), pair("least").alias("b")).distinct()
    found = components(links)
    names = written(found.where("node <> root").select(F.col("node.key").alias("key"), F.col("node.least").alias("least"), F.col("root.least").alias("whole")), "passage-classes")
    return [v.join(names, ["key", "least"], "left").withColumn("least", F.coalesce("whole", "least")).select(*_VERDICT_NAMES) for v in verdicts]


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lo, hi, context) -> a row for each distinct code of each context."""
    for whole in batches:
        for at in range(0, whole.num_rows, TILE):
            b = whole.slice(at, TILE)
            codes = np.sort(np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).reshape(-1, _WIDE), 1)
            new = codes != 0
            new[:, 1:] &= codes[:, 1:] != codes[:, :-1]
            line = pa.array(np.nonzero(new)[0])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(line) for k in range(3)), pa.array(codes[new].view(np.int32))], ["key", "lo", "hi", "code"])


def _with_partners(rows: DataFrame) -> DataFrame:
    """Contexts without those that could not be alike even to one text with the codes of all others of their key.

    Codes that only one text of the key has go back to that text, so this grows with the rows, and not with their pairs.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                b = whole.slice(at, TILE)
                codes = np.frombuffer(b"".join(b.column("context").to_pylist()), np.uint32).reshape(-1, _WIDE)
                lists = b.column("bare")
                line = np.arange(len(b), dtype=np.uint64) << np.uint64(32)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                bare = np.repeat(line, size) | lists.flatten().to_numpy().view(np.uint32)
                held = (codes != 0) & ~np.isin(line[:, None] | codes, bare)
                yield b.filter(pa.array(may_be_alike(held))).select(names)

    codes = rows.select("key", "lo", "hi", "context").mapInArrow(_codes, "key long, lo long, hi long, code int")
    bare = codes.groupBy("key", "code").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi").groupBy("key", "lo").agg(F.collect_list("code").alias("bare"))
    return rows.join(bare, ["key", "lo"], "left").select(*names, "bare").mapInArrow(run, rows.schema)


def _resolved(edges: list[DataFrame]) -> DataFrame:
    """First links in parts -> verdicts: the span of a node's first link in all parts, and of those that are the first of others, with each class it has."""
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    last = F.coalesce("first", F.lit((1 << 63) - 1))
    one = every.groupBy("key", "ck").agg(F.min_by(F.struct("start", "stop", "similarity", "first", "from", "to", "begin", "end"), last).alias("e")).select("key", "ck", "e.*")
    side = lambda ck, start, stop, *whole: F.struct(F.col(ck).alias("ck"), F.col(start).alias("start"), F.col(stop).alias("stop"), *(x.cast("int").alias(n) for x, n in zip(whole, ("begin", "end"))))
    sides = F.array(side("ck", "start", "stop", F.col("begin"), F.col("end")), side("first", "from", "to", F.lit(None), F.lit(None)))
    spans = one.select("key", "similarity", F.explode(sides).alias("s")).where("s.ck is not null").groupBy("key", "s.ck")
    own = F.max("s.begin")
    spans = spans.agg(F.coalesce(own, F.min("s.start")).alias("start"), F.coalesce(F.max("s.end"), F.max("s.stop")).alias("stop"), F.when(own.isNotNull(), 1.0).otherwise(F.max("similarity")).alias("similarity"))
    return every.select("key", "ck", "least").distinct().join(spans, ["key", "ck"]).select(*_VERDICT_NAMES)


def _verified_apart(hot: DataFrame, level: int = 0, levels: int = 0, tile: int = TILE, leaders: int = LEADERS) -> list[DataFrame]:
    """Verdicts (written tables) of the nodes of keys with more than `tile` of them: rows of _CONTEXT (written), part the number of nodes.

    The same as those of _verified() for a whole key. level and levels have no effect: keys are not refined any more.
    """
    # A leader's share of the context keys, the first in order, is such that a key has about so many, whatever its size.
    drawn = lambda ck: F.col(ck).cast("double") < F.least(F.lit(1.0), F.lit(float(leaders)) / F.col("part")) * F.lit(2.0**64) - F.lit(2.0**63)
    n_tiles = F.ceil(F.col("part") / tile).cast("long")
    dealt = hot.withColumn("tile", F.when(drawn("ck"), F.sequence(F.lit(0).cast("long"), n_tiles - 1)).otherwise(F.array(F.pmod(F.xxhash64("ck"), n_tiles))))
    names = [c for c in _CONTEXT_NAMES if c != "part"]
    found = [written(_dealt(dealt.select(*names, F.explode("tile").alias("part")).select(*_CONTEXT_NAMES)), "passage-tiles")]
    # A link between tiles that is not yet known has an end outside its key's largest class, or changes no class; and it
    # is no node's first, if that is a leader.
    classes = written(_one_class(found)[0].select("key", "ck", "least").distinct(), "passage-tile-classes")
    size = classes.groupBy("key", "least").agg(F.count(F.lit(1)).alias("n"))
    largest = size.groupBy("key").agg(F.max_by("least", F.struct("n", -F.col("least"))).alias("least"))
    parts = hot.select("key", "ck", "part")
    led = found[0].select("key", "ck", "first").join(parts, ["key", "ck"]).where(drawn("ck") | drawn("first")).select("key", "ck").distinct()
    done = classes.join(largest, ["key", "least"], "left_semi").join(led, ["key", "ck"], "left_semi")
    left = written(parts.join(done, ["key", "ck"], "left_anti").select("key", "ck"), "passage-left")
    if not left.isEmpty():
        # Every tile against every tile of those left. Where most are left, the key is a phrase in passages that are mostly
        # unlike: what has no partner goes first.
        sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        flags = hot.join(sizes, "key").join(left.withColumn("alone", F.lit(True)), ["key", "ck"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
        every_row = written(flags, "passage-left-keys")
        loose = 2 * F.col("m") > F.col("part")
        asked = _with_partners(every_row.where(loose).drop("m", "part")).unionByName(every_row.where(~loose).drop("m", "part"))
        asked = asked_rows = written(asked, "passage-asked")
        sizes = written(asked.groupBy("key").agg(F.count(F.lit(1)).alias("part"), F.count_if("alone").alias("m")).where("m > 0"), "passage-asked-sizes")
        asked = asked.join(sizes, "key")
        m_tiles = F.ceil(F.col("m") / tile).cast("long")
        every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        own = lambda n: F.pmod(F.xxhash64("ck", F.lit(-1)), n)
        others = F.when(F.col("alone"), F.array_remove(every(m_tiles), own(m_tiles))).otherwise(every(m_tiles))
        rows = asked.where("alone").withColumns({"i": F.array(own(m_tiles)), "j": every(n_tiles)})
        # where a node that is left stands itself, it does not stand in its tile once more
        beside = asked.withColumns({"i": others, "j": F.array(F.pmod(F.xxhash64("ck"), n_tiles)), "alone": F.lit(False)})
        pairs = rows.unionByName(beside).withColumn("i", F.explode("i")).withColumn("j", F.explode("j")).withColumn("part", F.col("i") * n_tiles + F.col("j"))
        found.append(written(_dealt(pairs.select(*_CONTEXT_NAMES, "alone")), "passage-pairs"))
        discard(every_row, asked_rows, sizes)
    out = written(_resolved(found), "passage-apart")
    discard(left, classes, *found)
    return [out]


def repeated(keyed: DataFrame, once: DataFrame, tile: int = TILE, leaders: int = LEADERS) -> DataFrame:
    """Passages that other texts repeat: tkey, start, stop, class_id, similarity; spans overlap.

    keyed has tkey, text, _file, _row for every document, once the least doc_id of each text that is long enough and where
    one row with that text is. tile and leaders do not change the result.
    """
    spark = keyed.sparkSession
    whole = Window.partitionBy("deal")
    rows = _windows(keyed.select("tkey", "text")).withColumns({"lo": F.min("tkey").over(whole), "hi": F.max("tkey").over(whole)})
    rows = rows.where("alt is not null or lo <> hi").select(F.coalesce("alt", "deal").alias("key"), "ck", "tkey", "place")
    shared = written(rows.join(once.select("tkey", "least"), "tkey"), "passage-shared")
    # Rows of a node differ in nothing that is read of its first one's place: the contexts are equal.
    firsts = [F.first(c).alias(f"at_{c}") for c in ("tkey", "place")]
    nodes = written(shared.groupBy("key", "ck").agg(F.min("tkey").alias("lo"), F.max("tkey").alias("hi"), F.min(F.coalesce("least", F.lit(_NULL))).alias("least"), *firsts), "passage-nodes")
    sizes = written(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("part")).where("part > 1"), "passage-sizes")
    alone = nodes.where("lo <> hi").join(sizes, "key", "left_anti")
    reach = F.col("at_place").bitwiseAND(F.lit(16383).cast("long"))
    alone = alone.select("key", "ck", (-F.shiftright(reach, 7)).cast("int").alias("start"), (F.pmod(reach, F.lit(128)) + 1).cast("int").alias("stop"), F.lit(1.0).alias("similarity"), "least")

    def contexts(keys: DataFrame) -> DataFrame:
        # A text has a node for each window at most.
        listed = nodes.join(keys, "key").groupBy(F.col("at_tkey").alias("tkey")).agg(F.collect_list(F.struct("key", "ck", F.col("at_place").alias("place"), "lo", "hi", "least", "part")).alias("n"))
        placed = listed.join(once.select("tkey", "at._file", "at._row"), "tkey").select("_file", "_row", "n")
        return _contexts(keyed.select("_file", "_row", "text").join(placed, ["_file", "_row"]).select("text", "n"))

    # The texts are read and moved once for all keys: contexts of keys with more nodes, dealt evenly, come out as they are.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col("part") > tile, -1 - F.pmod(F.xxhash64("ck"), F.ceil(F.col("part") / tile).cast("long"))).otherwise(F.col("part"))
    dealt = contexts(sizes).withColumn("size", F.col("part")).withColumn("part", spread).repartition(n, "key", "part").sortWithinPartitions("key", "part", "ck")
    either = written(dealt.mapInArrow(_verified_or_kept, _EITHER), "passage-verdicts")
    verdicts, apart = [either], []
    hot = sizes.where(F.col("part") > tile)
    if not hot.isEmpty():
        crowded = either.where("context is not null").withColumnRenamed("size", "part").select(*_CONTEXT_NAMES)
        apart = _verified_apart(crowded, 0, 0, tile, leaders)
        verdicts += apart
    every = alone
    for v in [either.where("context is null").select(*_VERDICT_NAMES), *(_one_class(apart) if apart else [])]:
        every = every.unionByName(v)
    centre = F.shiftright("place", 14)
    # Written, both sides of the join are plain shuffles, which Spark can split where a passage has very many rows.
    one = written(_summed(every), "passage-summed")
    spans = shared.join(one.withColumnRenamed("least", "class_id"), ["key", "ck"])
    spans = spans.select("tkey", (centre + F.col("start")).cast("int").alias("start"), (centre + F.col("stop") + SHINGLE - 1).cast("int").alias("stop"), F.nullif("class_id", F.lit(_NULL)).alias("class_id"), "similarity")
    out = written(spans.groupBy("tkey", "start", "stop").agg(F.min("class_id").alias("class_id"), F.max("similarity").alias("similarity")), "passage-spans")
    discard(shared, nodes, sizes, one, *verdicts)
    return out


#: Stands for a document without an id among the least documents, so that any id is less.
_NULL = (1 << 63) - 1


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """doc_id, start_word, end_word, n_words, class_id, similarity: the passages of each document that others repeat.

    A passage has at least LEAST_WORDS words and is similar, by SIMILARITY or more, to a passage of another document;
    start is included, end is not. class_id is the smallest doc_id among the texts that such links under one min-hash
    connect with it, itself included; similarity is the greatest that was found. Overlapping passages are one. Copies of a
    whole text are one text for the search and get the same rows; a text that has copies and enough words is a passage as
    a whole. Passages repeated only inside one text are not reported. Null, empty and shorter texts have none; very long
    texts are read whole; rows with a null id take part and are reported with a null id; repeated rows count as copies;
    other columns are not read, whatever their names; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = located(docs, id_col, text_col)
    keyed = rows.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), "_file", "_row").withColumn("tkey", F.xxhash64("text"))
    index = written(keyed.select("doc_id", "tkey", "_file", "_row", F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).alias("words")), "passage-index")
    copies = index.groupBy("tkey").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), F.min(F.struct("_file", "_row")).alias("at")).where(F.col("words") >= LEAST_WORDS)
    once = written(copies, "passage-texts")
    sides = repeated(keyed, once, tile)
    whole = once.where("n > 1").select("tkey", F.lit(0).alias("start"), F.col("words").cast("int").alias("stop"), F.col("least").alias("class_id"), F.lit(1.0).alias("similarity"))
    spans = sides.unionByName(whole)
    by = Window.partitionBy("tkey").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by))
    merged = islands.groupBy("tkey", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("class_id").alias("class_id"), F.max("similarity").alias("similarity"))
    return index.select("doc_id", "tkey").join(merged, "tkey").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "class_id", F.round("similarity", 6).alias("similarity"))
