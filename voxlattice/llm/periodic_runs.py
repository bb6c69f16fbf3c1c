"""Periodic runs of words: the Stoye-Gusfield algorithm on the suffix tree of each text.

A text is a sequence of words. Its suffix tree is held as the suffix array with the longest common prefixes of neighbours;
an inner node is an interval of the array, split in two (nodes of more children by several splits of one depth). At a node
of depth d two leaves i and i + d on different sides are a branching tandem repeat: d words come twice from i on, and the
word after them breaks the period. Only the leaves of each split's smaller side are visited, so a leaf is visited a
logarithmic number of times. All repeats of a run come from its branching one by rotating to the left, so the run is what
the rotation covers; repeats of one end whose period is a multiple of a shorter one's are merged into its run.

Before that, words that cannot be in any run are left out: in a run of at least EXPONENT periods every word comes as often,
so a stretch is cut at its rarer words, again and again, and short stretches go. This loses nothing and leaves little of
ordinary text; it may stop early. Everything is done by numpy for a slice of texts at a time, and a text is
never divided; the suffix array of a slice is that of each stretch by itself, as no symbol stands in two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import Texts, mix, slices, strings

#: A run has at least so many words, and so many periods.
LEAST = 6
EXPONENT = 4
SLICE = 2 << 20
_PEELS = 8

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def stretches(word: np.ndarray, text: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that may be in a run, and the number of the stretch of consecutive words of one text that each is in."""
    at, group = np.arange(len(word)), text.astype(np.int64)
    for _ in range(_PEELS):
        before = len(at)
        _, which, count = np.unique(word[at] ^ mix(group.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        keep = count[which] >= exponent
        at, group = at[keep], group[keep]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(group) != 0)
        group = np.cumsum(new) - 1
        long = np.bincount(group)[group] >= least if len(at) else new
        at, group = at[long], group[long]
        if len(at) == before:
            break
    return at, group


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, rank and common prefixes of the suffixes: prefixes[k] is that of the suffixes at places k - 1 and k.

    Prefix doubling: the rank of a suffix is the first place of its group, and a round sorts only groups of several. The
    ranks of every round are kept, four bytes a suffix, and tell the common prefixes from the longest power down.
    """
    n = len(symbols)
    _, dense, count = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[dense]
    rounds = [rank.astype(np.int32)]
    active = np.flatnonzero(count[dense] > 1)
    step = 1
    while len(active):
        beyond = active + step
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        own = rank[active]
        index = np.arange(len(active))
        group = np.ones(len(active), bool)
        group[1:] = own[1:] != own[:-1]
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        first = np.maximum.accumulate(np.where(group, index, 0))
        start = np.maximum.accumulate(np.where(part, index, 0))
        rank = rank.copy()
        rank[active] = own + (start - first)
        sizes = np.bincount(np.cumsum(part) - 1)
        active = np.sort(active[sizes[np.cumsum(part) - 1] > 1])
        rounds.append(rank.astype(np.int32))
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    i, j = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for level in range(len(rounds) - 2, -1, -1):
        inside = (i < n) & (j < n)
        same = inside & (rounds[level][np.minimum(i, n - 1)] == rounds[level][np.minimum(j, n - 1)])
        size = same.astype(np.int64) << level
        common[1:] += size
        i += size
        j += size
    return order, rank, common


def splits(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place k the interval [low, high) of the node that splits between k - 1 and k; of equal depths the first is above."""
    n = len(common)
    low, high = np.zeros(n, np.int64), np.full(n, n, np.int64)
    depth = common.tolist()
    left, right = [0] * n, [n] * n
    stack: list[int] = []
    for k in range(1, n):
        d = depth[k]
        while stack and depth[stack[-1]] > d:
            right[stack.pop()] = k
        left[k] = stack[-1] if stack else 0
        stack.append(k)
    low[:], high[:] = left, right
    return low, high


def branching_repeats(symbols: np.ndarray, most: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Start i and period d of all branching tandem repeats."""
    if len(symbols) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, rank, common = suffix_array(symbols)
    n = len(order)
    low, high = splits(common)
    node = np.flatnonzero(common > 0)
    low, high, depth = low[node], high[node], common[node]
    small_left = node - low <= high - node
    a, b = np.where(small_left, low, node), np.where(small_left, node, high)
    other_a, other_b = np.where(small_left, node, low), np.where(small_left, high, node)
    size = b - a
    total = np.cumsum(size)
    starts, periods = [], []
    at = 0
    while at < len(node):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        k = np.repeat(np.arange(at, to), size[at:to])
        offset = np.arange(len(k)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
        leaf, d = order[a[k] + offset], depth[k]
        for shift, first in ((d, leaf), (-d, leaf - d)):
            met = leaf + shift
            place = rank[np.clip(met, 0, n - 1)]
            hit = (met >= 0) & (met < n) & (place >= other_a[k]) & (place < other_b[k])
            starts.append(first[hit])
            periods.append(d[hit])
        at = to
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(periods or none)


def rotations(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each repeat can be rotated to the left: equal symbols before start and before start + period."""
    out = np.zeros(len(start), np.int64)
    active, block = np.arange(len(start)), 8
    while len(active):
        back = start[active, None] - 1 - out[active, None] - np.arange(block)
        same = (back >= 0) & (symbols[np.maximum(back, 0)] == symbols[np.maximum(back, 0) + period[active, None]])
        broken = ~same.all(1)
        out[active] += np.where(broken, same.argmin(1), block)
        active = active[~broken]
        block = max(8, min(block * 2, (1 << 21) // max(1, len(active))))
    return out


def maximal_runs(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of the maximal runs, by start and period."""
    start, period = branching_repeats(symbols)
    end = start + 2 * period
    found = []
    while len(end):
        order = np.lexsort((period, end))
        start, period, end = start[order], period[order], end[order]
        first = np.ones(len(end), bool)
        first[1:] = end[1:] != end[:-1]
        s, q, e = start[first], period[first], end[first]
        s = s - rotations(symbols, s, q)
        found.append((s, e - s, q))
        # What else ends there: a multiple of the period that the run holds twice is the same run.
        which = np.cumsum(first) - 1
        rest = ~first & ~((period % q[which] == 0) & (start >= s[which]))
        start, period, end = start[rest], period[rest], end[rest]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    s, n, q = (np.concatenate(x) for x in zip(*found))
    fine = n >= np.maximum(least, exponent * q)
    s, n, q = s[fine], n[fine], q[fine]
    order = np.lexsort((q, s))
    return s[order], n[order], q[order]


def runs_of_words(word: np.ndarray, text: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start (in the whole array), length and period of the runs of words (64-bit hashes) of one or more texts."""
    at, group = stretches(word, text, least, exponent)
    if not len(at):
        return at, at, at
    _, own = np.unique(word[at], return_inverse=True)
    s, n, q = maximal_runs(group * (own.max() + 1) + own, least, exponent)
    return at[s], n, q


def joined(t: Texts, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    start, end, text = t.start[keep], t.end[keep], t.text_of_word()[keep]
    space = np.zeros(len(start), np.int64)
    space[1:] = text[1:] == text[:-1]
    size = end - start
    out_off = np.concatenate([[0], np.cumsum(size + space)])
    src = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    dst = np.arange(size.sum()) + np.repeat(out_off[:-1] + space - (np.cumsum(size) - size), size)
    out = np.full(out_off[-1], 0x20, np.uint8)
    out[dst] = t.data[src]
    return strings(out, out_off[np.searchsorted(text, np.arange(len(t) + 1))])


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: one row per document.

    collapsed holds the words that are in no run after its first period, joined by one space. Null and empty texts have no
    words and no runs; repeated rows repeat; null ids stay; other columns are not read; an empty table gives no rows. A very
    long text is searched whole, in some 60 bytes of memory a byte, and 200 a word that may be in a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                part = b.slice(i, j - i)
                t = Texts(part.column(1))
                text = t.text_of_word()
                s, n, q = runs_of_words(t.word_hash(), text, least, exponent)
                cover = np.zeros(len(text) + 1, np.int64)
                np.add.at(cover, s + q, 1)
                np.add.at(cover, s + n, -1)
                of = text[s] if len(s) else s
                order = np.lexsort((q, s, of))
                s, n, q, of = s[order], n[order], q[order], of[order]
                run = pa.StructArray.from_arrays([pa.array(s - t.word_off[of]), pa.array(n), pa.array(q)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(t) + 1)), pa.int32()), run)
                kept = joined(t, np.cumsum(cover)[:-1] == 0).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(t.n_words.astype(np.int64)), runs, kept], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, RUNS)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (the first of equals, then the shortest period), and hashes of runs and collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        (-F.col("best.n")).alias("length"),
        "best.period",
        F.floor(F.lit(1000) * -F.col("best.n") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def made_periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: of a tenth of the documents the words from some place on repeat the first of them.

    With h the crc32 of the id and g = h div 10: if 10 divides h and there are n > 0 words, the words from g mod n on have
    period 1 + (n - g mod n) div (3 + g mod 8). A document without an id stays as it is.
    """
    text, h = F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"h": h, "words": F.when(h % 10 == 0, F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))})
    changed = rows.withColumns({"n": F.size("words").cast("long"), "g": F.expr("h div 10")}).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int(ceil((n - a) / p)))), 1, int(n - a)))")
    return changed.select("doc_id", F.when(F.coalesce(F.col("n") > 0, F.lit(False)), F.array_join(repeated, " ")).otherwise(text).alias("text"))
