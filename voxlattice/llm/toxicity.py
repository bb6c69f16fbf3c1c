"""Toxicity by class-conditional Kneser-Ney models of the bytes of words.

A word, with a mark before and one after it, is a sequence of bytes; a byte is predicted from the ORDER - 1 before it, as
far as the word reaches. For each class c (toxic, ordinary)

    P_c(x | context) = (max(n_c(context x) - D, 0) + (PRIOR + D * types_c(context)) * P(x | context)) / (n_c(context) + PRIOR)

where P is one interpolated Kneser-Ney model of both classes together, whose shorter contexts count distinct left
neighbours. Rare expressions get what the classes share; only what one class has often tells them apart. A document is
compared by the mean over its distinct words (repeating one says no more) of log P_toxic - log P_ordinary. For what
neither class has seen, P cancels: the difference depends on the context alone, and is 0 for an unseen context. So a table
of seen grams and contexts, one number each, is all that scoring needs.

The counts come from every labelled row outside the calibration fold, by an aggregation that combines in the tasks; the
table is made by joins, range-partitioned, and written to the shared folder. Nothing is broadcast but labels while they
are few: a scoring task reads the table a file at a time, each of bounded size, and looks up the grams of the distinct
words of a slice of its texts. Score and predicted class come from a logistic fit of two numbers on a bounded sample of the
calibration fold, whose rows the counts do not hold.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, open_fs, written
from .textkernel import column_bytes, cut_out, prefix_sums, runs_of, segment_hash, slices

#: Bytes of a gram: a packed gram has to fit 56 bits.
ORDER = 6
#: Pseudo-counts of the shared model in each context.
PRIOR = 30.0
#: The most rows of the calibration fold that the logistic fit looks at: those with the smallest hash of doc_id.
FIT_ROWS = 12_000
#: Labels are sent around up to so many rows (16 bytes each), beyond that they are joined by a shuffle.
FEW_LABELS = 2_000_000
#: Entries of the table in one file (12 bytes each in memory), and bytes of text that a task looks at together.
FILE_ROWS = 1_000_000
SLICE = 8 << 20
FOLDS = 5
#: Fold 0 is held out; the counts do not use this one either.
CALIBRATION = 1

#: What the logistic fit looks at: the mean over a text's distinct words of the difference of log-likelihoods, their median
#: (what the language and the style are worth), the mean beyond it in units of its error, the most telling word, the length.
FEATURES = ("mean", "median", "beyond", "most", "log_words")

_BEFORE, _AFTER = 1, 2
_CONTEXT = 1 << 60
_INSIDE = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words (bytes end to end, offsets) of some texts, and each text's distinct words: their numbers, the texts."""
    data, off = column_bytes(col)
    data = _LOWER[data]
    start, end, text = runs_of(_INSIDE[data], off)
    if not len(start):
        none = np.zeros(0, np.int64)
        return data[:0], np.zeros(1, np.int64), none, none
    _, first, which = np.unique(segment_hash(prefix_sums(data), start, end), return_index=True, return_inverse=True)
    own, own_off = cut_out(data, start[first], end[first])
    text, which = np.divmod(np.unique(text * len(first) + which), len(first))
    return own, own_off, which, text


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word and each byte of it (and its end mark) the packed gram that ends there, and the number of the word."""
    size = np.diff(off) + 2
    at = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(at[-1], np.int64)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(at[-1]) - at[word]
    middle = (place > 0) & (place < size[word] - 1)
    marked[place == 0], marked[place == size[word] - 1], marked[middle] = _BEFORE, _AFTER, data
    g = marked.copy()
    for j in range(1, ORDER):
        g[j:] |= np.where(place[j:] >= j, marked[:-j] << (8 * j), 0) if len(g) > j else 0
    tell = place > 0
    return g[tell], word[tell]


def _train(docs: DataFrame, labels: DataFrame, target: str, id_col: str, text_col: str) -> DataFrame:
    """text, y, doc_id, fold of the rows with a label outside fold 0."""
    known = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((F.col(target) > 0).cast("int")).alias("y"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = F.broadcast(known) if labels.count() <= FEW_LABELS else known
    return rows.join(known, "doc_id").select("text", "y", "doc_id", "fold")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a missing id has fold 0, so it is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def gram_counts(rows: DataFrame) -> DataFrame:
    """g, n1, n0: how often each gram stands in toxic and in ordinary texts of rows (text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(0), SLICE):
                part = b.slice(i, j - i)
                data, off, which, text = words(part.column(0))
                toxic = part.column(1).to_numpy(zero_copy_only=False)[text] == 1
                g, word = grams(data, off)
                each = [np.bincount(which[s], minlength=len(off) - 1)[word] for s in (toxic, ~toxic)]
                key, at = np.unique(g, return_inverse=True)
                sums = [np.bincount(at, n, len(key)).astype(np.int64) for n in each]
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums)], ["g", "n1", "n0"])

    return rows.select("text", "y").mapInArrow(run, "g long, n1 long, n0 long").groupBy("g").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _discount(counts: DataFrame, n: str) -> Column:
    """n1 / (n1 + 2 n2) of the counts of counts, as one number of the driver; 0.5 where it does not exist."""
    once, twice = counts.agg(F.count_if(F.col(n) == 1), F.count_if(F.col(n) == 2)).first()
    return F.lit(once / (once + 2 * twice) if once and twice else 0.5)


def _without_first(g: Column) -> Column:
    """A gram of 2 to ORDER bytes less its first byte."""
    out = F.when(g >= 1 << (8 * (ORDER - 1)), g % (1 << (8 * (ORDER - 1))))
    for k in range(ORDER - 2, 0, -1):
        out = out.when(g >= 1 << (8 * k), g % (1 << (8 * k)))
    return out


def _interpolated(level: DataFrame, lower: DataFrame | None, shorter: Column | None) -> DataFrame:
    """g, p: the counts n of grams, discounted and mixed with the probability of each gram less its first byte."""
    d = _discount(level, "n")
    of = level.groupBy(F.shiftright("g", 8).alias("c")).agg(F.sum("n").alias("of"), F.count(F.lit(1)).alias("types"))
    rows = level.withColumn("c", F.shiftright("g", 8)).join(of, "c")
    q = F.lit(1 / 256)
    if lower is not None:
        rows, q = rows.withColumn("s", shorter).join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), "s"), F.col("q")
    return rows.select("g", ((F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("types") * q) / F.col("of")).alias("p"))


def shared_probabilities(top: DataFrame) -> DataFrame:
    """g, p of every gram of top (g, n): the interpolated Kneser-Ney model of both classes.

    Level k holds the suffixes of k bytes that do not begin a word, each with its number of distinct left neighbours.
    """
    levels: dict[int, DataFrame] = {}
    longer = top.select("g")
    for k in range(ORDER - 1, 0, -1):
        # longer has the distinct grams of k + 1 bytes: a row of it is one left neighbour of one suffix.
        cut = longer.where(F.col("g") >= 1 << (8 * k)).select((F.col("g") % (1 << (8 * k))).alias("g"))
        levels[k] = written(cut.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "toxicity-level")
        begin = top.where((F.col("g") < 1 << (8 * k)) & (F.col("g") >= 1 << (8 * (k - 1)))).select("g")
        longer = levels[k].select("g").unionByName(begin)
    p: list[DataFrame] = []
    for k in range(1, ORDER):
        p.append(written(_interpolated(levels[k], p[-1] if p else None, F.col("g") % (1 << (8 * (k - 1)))), "toxicity-p"))
    # A gram that begins a word may be shorter than ORDER bytes: its suffix is at the level of its own length.
    out = written(_interpolated(top, functools.reduce(DataFrame.unionByName, p), _without_first(F.col("g"))), "toxicity-p")
    discard(*levels.values(), *p)
    return out


def differences(counts: DataFrame) -> DataFrame:
    """key, value: log P_toxic - log P_ordinary of each seen gram (its number) and, for what is unseen in it, of each seen context."""
    counts = written(counts, "toxicity-counts")
    p = shared_probabilities(counts.select("g", (F.col("n1") + F.col("n0")).alias("n")))
    c = F.shiftright("g", 8).alias("c")
    of = counts.groupBy(c).agg(*[x for k in "10" for x in (F.sum(f"n{k}").alias(f"of{k}"), F.count_if(F.col(f"n{k}") > 0).alias(f"types{k}"))])
    d = {k: _discount(counts, f"n{k}") for k in "10"}
    free = {k: (PRIOR + d[k] * F.col(f"types{k}")) / (F.col(f"of{k}") + PRIOR) for k in "10"}
    own = {k: F.greatest(F.col(f"n{k}") - d[k], F.lit(0.0)) / (F.col(f"of{k}") + PRIOR) + free[k] * F.col("p") for k in "10"}
    seen = counts.withColumn("c", c).join(of, "c").join(p, "g").select(F.col("g").alias("key"), F.log(own["1"] / own["0"]).alias("value"))
    rest = of.select((F.col("c") + _CONTEXT).alias("key"), F.log(free["1"] / free["0"]).alias("value"))
    out = written(seen.unionByName(rest), "toxicity-differences")
    discard(counts, p)
    return out


@dataclass(frozen=True)
class Model:
    """The files of the table of differences, and the logistic fit: mean, deviation and weight of each feature, and bias."""

    files: list[str]
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.centre) / self.spread) @ self.weights + self.bias, -700, 700)))


@functools.lru_cache(maxsize=4)
def _file(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """A file's keys and values: bounded by FILE_ROWS, and the last few are kept by the worker."""
    filesystem, path = open_fs(uri)
    t = pq.read_table(path, filesystem=filesystem)
    return t["key"].to_numpy(), t["value"].to_numpy()


def _looked_up(keys: np.ndarray, files: list[str]) -> np.ndarray:
    """The value of each of some sorted keys, NaN where the table has none. One file is in memory at a time, but for a few."""
    out = np.full(len(keys), np.nan)
    for uri in files:
        have, value = _file(uri)
        if not len(have):
            continue
        a, b = np.searchsorted(keys, have[0], "left"), np.searchsorted(keys, have[-1], "right")
        at = np.searchsorted(have, keys[a:b])
        hit = have[np.minimum(at, len(have) - 1)] == keys[a:b]
        out[a:b][hit] = value[at[hit]]
    return out


def evidence(col: pa.Array, files: list[str]) -> np.ndarray:
    """FEATURES of each text, from log P_toxic - log P_ordinary of its distinct words."""
    data, off, which, text = words(col)
    g, word = grams(data, off)
    key, at = np.unique(g, return_inverse=True)
    context, context_at = np.unique(key >> 8, return_inverse=True)
    value = _looked_up(key, files)
    unseen = np.isnan(value)
    fallback = np.nan_to_num(_looked_up(context + _CONTEXT, files))[context_at]
    value[unseen] = fallback[unseen]
    d = np.bincount(word, value[at], len(off) - 1)[which]
    n = np.bincount(text, minlength=len(col))
    mean = np.bincount(text, d, len(col)) / np.maximum(n, 1)
    d = d[np.lexsort((d, text))]
    last = np.cumsum(n)
    some = n > 0
    median, most = np.zeros(len(col)), np.zeros(len(col))
    median[some], most[some] = d[(last - n + n // 2)[some]], d[last[some] - 1]
    return np.stack([mean, median, (mean - median) * np.sqrt(n), most, np.log1p(n)], 1)


def _evidence_of(rows: DataFrame, files: list[str], keys: str) -> DataFrame:
    """The columns `keys` (a schema) of rows (text first) with x, the FEATURES of the text."""
    names = [x.split()[0] for x in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(0), SLICE):
                part = b.slice(i, j - i)
                x = evidence(part.column(0), files)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(list(x), pa.list_(pa.float64()))], [*names, "x"])

    return rows.select("text", *names).mapInArrow(run, f"{keys}, x array<double>")


def _logistic(x: np.ndarray, y: np.ndarray, files: list[str], penalty: float = 1.0, rounds: int = 50) -> Model:
    """Newton steps on the penalised loss. Without rows, or toxic ones, every score is 0; with toxic ones alone it is 1."""
    k = len(FEATURES)
    if not len(y) or y.min() == y.max():
        return Model(files, np.zeros(k), np.ones(k), np.zeros(k), 700.0 if len(y) and y[0] else -700.0)
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-12)
    z = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    ridge = np.diag([penalty] * k + [1e-6])
    w = np.zeros(k + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return Model(files, centre, spread, w[:k], float(w[k]))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts from the labelled rows of folds other than 0 and CALIBRATION, the logistic fit from the latter.

    An id has its largest label; null ids and null labels do not count, and rows of null id are not learned from. A row
    counts as often as it comes, each of its words once. Of ids that repeat, the fit takes the row of the least features.
    """
    rows = _train(docs, labels, target, id_col, text_col)
    table = differences(gram_counts(rows.where(F.col("fold") != CALIBRATION)))
    n_files = max(1, -(-table.count() // FILE_ROWS))
    kept = written(table.repartitionByRange(n_files, "key").sortWithinPartitions("key"), "toxicity-model")
    discard(table)
    files = sorted(kept.inputFiles())
    some = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((F.col(target) > 0).cast("int")).alias("y")).where(fold(F.col("doc_id")) == CALIBRATION)
    # At most fit_rows rows of 12 bytes.
    few = F.broadcast(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    fit = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(few, "doc_id")
    seen = _evidence_of(fit, files, "doc_id long, y int").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.stack(seen["x"].to_numpy()) if len(seen) else np.zeros((0, len(FEATURES)))
    return _logistic(x, seen["y"].to_numpy(float), files)


def apply(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, x (FEATURES): one row per document.

    held_out: the fold of the id is 0. Null and empty texts have no words and get the score of all features 0; repeated rows
    repeat; a null id is held out; other columns are not read; an empty table gives no rows. A very long text is scored
    whole, in some 100 bytes of memory a byte.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                part = b.slice(i, j - i)
                x = evidence(part.column(1), model.files)
                score = model.score(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "score", "predicted", "x"])

    found = rows.mapInArrow(run, "doc_id long, score double, predicted int, x array<double>")
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "x")
