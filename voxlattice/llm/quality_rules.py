"""Quality rules: fixed base rules, and gradient-boosted trees over document statistics.

Statistics are counted by numpy over whole Arrow batches, every word of every text. The trees are fitted on the driver
on a bounded sample of labelled rows (FIT_ROWS), with logistic loss on binned features; features named in MONOTONE may
only push the score one way: a split that breaks the order is refused and children inherit bounds on their values. The
fitted forest is flattened into a few numpy arrays of nodes, which travel to the executors with the function (tens of
kilobytes) and score a batch with one gather per level and tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import Texts, later_copies, mix, repeated, shingle_hash, shingle_starts, slices, spans_sum

#: The most labelled rows that are fitted on; the ones with the smallest hash of doc_id.
FIT_ROWS = 12_000
#: A text with fewer words fails, as does one with a larger share of words in repeated windows (percent).
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: The least probability of good quality at which a document stays.
KEEP_FROM = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature -> -1 if more of it can only lower the probability of good quality, 1 if it can only raise it, 0 if free.
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "exclaim_per_word": -1,
    "punctuation_share": 0,
    "space_share": 0,
    "words_per_line": 0,
    "distinct_share": 0,
    "markup_per_word": -1,
}

SLICE = 2 << 20
_is = {
    "symbol": b"#*$%&|<>",
    "upper": bytes(range(ord("A"), ord("Z") + 1)),
    "digit": b"0123456789",
    "exclaim": b"!?",
    "punctuation": b".,;:'\"()-",
    "markup": b"{}[]<>/\\=_|~^",
}
_CLASS = {k: np.isin(np.arange(256), list(v)) for k, v in _is.items()}


def statistics(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the COUNTS (long) and the FEATURES (double)."""
    t = Texts(col)
    d = len(t)
    n = t.n_words.astype(np.int64)
    lead = (t.data & 0xC0) != 0x80
    by = lambda name: t.sum_by_text(_CLASS[name][t.data])
    word_chars = t.sum_by_text(lead & ~t.space)
    chars = t.sum_by_text(lead)
    words = t.word_hash()
    # words in windows of five that come twice or more
    at, _ = shingle_starts(t.word_off, WINDOW)
    of_text = np.repeat(np.arange(d), n)
    salt = mix(np.arange(d, dtype=np.uint64) + np.uint64(1))
    grams = shingle_hash(words, WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
    twice = at[repeated(grams ^ salt[of_text[at]])] if len(at) else at
    cover = np.zeros(len(words) + 1, np.int32)
    cover[: len(words)] += np.bincount(twice, minlength=len(words)).astype(np.int32) if len(words) else 0
    cover -= np.bincount(twice + WINDOW, minlength=len(cover)).astype(np.int32)
    repeat = spans_sum((np.cumsum(cover)[:-1] > 0) if len(words) else np.zeros(0, bool), t.word_off)
    # lines with a word that equal an earlier line of the text
    breaks = np.flatnonzero(t.data == 0x0A)
    line_start = np.concatenate([t.off[:-1], breaks + 1])
    line_text = np.concatenate([np.arange(d), np.searchsorted(t.off, breaks, "right") - 1])
    order = np.lexsort((line_start, line_text))
    line_start, line_text = line_start[order], line_text[order]
    ends_text = np.append(line_text[1:] != line_text[:-1], True) if d else np.zeros(0, bool)
    line_end = np.where(ends_text, t.off[line_text + 1], np.append(line_start[1:] - 1, 0)) if d else line_start
    has_word = np.searchsorted(t.start, line_end) > np.searchsorted(t.start, line_start)
    s, e, who = line_start[has_word], line_end[has_word], line_text[has_word]
    dup_lines = np.bincount(who[later_copies(t.segment_hash(s, e) ^ salt[who])], minlength=d).astype(np.int64) if len(s) else np.zeros(d, np.int64)
    lines = np.bincount(who, minlength=d) if len(who) else np.zeros(d, np.int64)
    distinct = n - (np.bincount(of_text[later_copies(words ^ salt[of_text])], minlength=d) if len(words) else 0)
    symbols = by("symbol")
    per_word, per_char = np.maximum(n, 1), np.maximum(chars, 1)
    features = [
        np.log1p(n),
        word_chars / per_word,
        symbols / per_word,
        dup_lines / np.maximum(lines, 1),
        repeat / per_word,
        by("upper") / per_char,
        by("digit") / per_char,
        by("exclaim") / per_word,
        by("punctuation") / per_char,
        t.sum_by_text(t.space) / per_char,
        n / np.maximum(lines, 1),
        distinct / per_word,
        by("markup") / per_word,
    ]
    return np.stack([n, word_chars, symbols, dup_lines, repeat], 1).astype(np.int64), np.stack(features, 1).astype(np.float64)


@dataclass(frozen=True)
class Forest:
    """All trees' nodes end to end. A leaf points to itself on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            score += self.value[node]
        return 1.0 / (1.0 + np.exp(-score))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, penalty: float = 1.0, least: int = 10) -> Forest:
    """Second-order boosting of the logistic loss. With no rows or one class only, every row gets probability 1."""
    if len(y) == 0 or y.min() == y.max():
        zero = np.zeros(1, np.int32)
        return Forest(zero, np.zeros(1), zero, zero, np.zeros(1), zero[:0], 0, 50.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    width = max(len(c) for c in cuts) + 1
    k = x.shape[1]
    bias = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), bias)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    flat = binned + np.arange(k) * width

    def best_split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        w = k * width
        where = flat[rows].ravel()
        sums = [np.bincount(where, np.repeat(v[rows], k), w).reshape(k, width).cumsum(1) for v in (g, h)]
        count = np.bincount(where, minlength=w).reshape(k, width).cumsum(1)
        gt, ht, nt = sums[0][:, -1:], sums[1][:, -1:], len(rows)
        gl, hl = sums
        vl, vr = (np.clip(-a / (b + penalty), low, high) for a, b in ((gl, hl), (gt - gl, ht - hl)))
        loss = lambda a, b, v: a * v + 0.5 * (b + penalty) * v * v
        v0 = np.clip(-gt / (ht + penalty), low, high)
        gain = loss(gt, ht, v0) - loss(gl, hl, vl) - loss(gt - gl, ht - hl, vr)
        sign = np.array(monotone)[:, None]
        fine = (count >= least) & (nt - count >= least) & ((sign == 0) | (sign * (vr - vl) >= 0))
        for f, c in enumerate(cuts):
            fine[f, len(c) :] = False
        gain = np.where(fine, gain, -1.0)
        f, b = divmod(int(gain.argmax()), width)
        return (gain[f, b], f, b, vl[f, b], vr[f, b]) if gain[f, b] > 1e-6 else None

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high))
        nodes.append([0, 0.0, me, me, value * rate])
        found = best_split(rows, g, h, low, high) if level < depth else None
        if found is None:
            score[rows] += value * rate
            return me
        _, f, b, vl, vr = found
        goes = binned[rows, f] <= b
        mid = 0.5 * (vl + vr)
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[monotone[f]]
        a = grow(rows[goes], g, h, level + 1, *bounds[0])
        c = grow(rows[~goes], g, h, level + 1, *bounds[1])
        nodes[me] = [f, float(cuts[f][b]), a, c, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    f, t, a, b, v = zip(*nodes)
    return Forest(np.array(f, np.int32), np.array(t), np.array(a, np.int32), np.array(b, np.int32), np.array(v), np.array(roots, np.int32), depth, bias)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fit on at most fit_rows labelled documents: those with the smallest hash of doc_id, whatever the input's size.

    An id counts once, however many rows have it: with the text of the least hash and its largest label. Null ids and
    null labels do not count; null and empty texts count as texts without words; other columns are not read. Without
    labelled rows, or with one class only, every text that the base rules pass is kept.
    """
    some = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(target).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # At most fit_rows rows of 16 bytes: a bound by parameter.
    joined = _columns(docs, id_col, text_col).join(F.broadcast(some), "doc_id").withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(0), SLICE):
                part = b.slice(i, j - i)
                x = statistics(part.column(0))[1]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), part.column(3), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "h", "x"])

    measured = joined.select("text", "y", "doc_id", "h").mapInArrow(run, "doc_id long, y double, h long, x array<double>")
    # One row an id, chosen before the shuffle and again after it, so fit_rows rows at most reach the driver.
    rows = measured.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct("h", "x")).alias("least")).select("doc_id", "y", "least.x").toPandas().sort_values("doc_id")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, (rows["y"].to_numpy() > 0).astype(float), list(FEATURES.values()))


def verdicts(col: pa.Array, forest: Forest, keep_from: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """COUNTS, base_failed, probability and kept of each text."""
    counts, x = statistics(col)
    n, repeat = counts[:, 0], counts[:, 4]
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    p = forest.probability(x)
    return counts, failed, p, ~failed & (p >= keep_from)


def keep_rows(docs: DataFrame, forest: Forest, keep_from: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is kept, all columns as they were: the verdicts of apply(). Null and empty texts go."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(at), SLICE):
                part = b.slice(i, j - i)
                yield part.filter(pa.array(verdicts(part.column(at), forest, keep_from)[3]))

    return docs.mapInArrow(run, docs.schema)


def apply(docs: DataFrame, forest: Forest, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the COUNTS, base_failed, score, kept: one row per document.

    kept is false if base_failed, else whether the trees' probability reaches keep_from. Null and empty texts have no
    words and fail. Repeated rows repeat, equal texts get equal verdicts, null ids stay, other columns are not read, an
    empty table gives no rows. A very long text is measured whole, in some 60 bytes of memory a byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                part = b.slice(i, j - i)
                counts, failed, p, kept = verdicts(part.column(1), forest, keep_from)
                arrays = [part.column(0), *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(p), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return _columns(docs, id_col, text_col).mapInArrow(run, schema)
