"""SimHash near-duplicates with anchor-point covering.

Fingerprints within three bits of each other agree up to one bit in one of their 32-bit halves. Anchors of a half are
the words of a covering code: the [31, 26] Hamming code (covering radius 1) with one free bit beside it. A fingerprint
is sent to each anchor within radius + threshold = 1 + 1 bits of its half, at most 17. If two halves differ in one bit
at most, the anchor nearest to the one is at most two bits from the other, so both meet there: no link is lost. Equal
fingerprints are one node before anything is sent, so copies cost nothing here.

Each anchor compares its distinct fingerprints in blocks and emits a spanning forest of its links (fewer links than
members), never all pairs. Anchors with more members than TILE are dealt out as pairs of tiles over many tasks, so
no task holds an unbounded group and no candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written
from .textkernel import Texts, slices

#: Bits of difference at which two fingerprints are linked.
MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: Members of an anchor that one task compares at once.
TILE = 4096
#: Bytes of text that a Python worker takes at once.
SLICE = 2 << 20

_PARITY = [sum(1 << (p - 1) for p in range(1, 32) if p >> bit & 1) for bit in range(5)]


def fingerprints_of(col: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each text: bit b is set if it is set in over half of the shingles' XXH64 values."""
    out = np.zeros(len(col), np.uint64)
    t = Texts(col, lower=True)
    if not len(t.start):
        return out
    # Words joined by one space: keep word bytes and the first white space after each word.
    keep = ~t.space
    gap = t.end[t.end < len(t.data)]
    keep[gap] = True
    # A text that ends in a word has no byte after it that is its own; shingles never cross texts, so that is no matter.
    place = np.cumsum(keep) - 1
    norm = np.where(t.space, np.uint8(0x20), t.data)[keep].tobytes()
    start, end = place[t.start], place[t.end - 1] + 1
    n = t.n_words
    fits = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(fits)])
    first = np.arange(off[-1]) + np.repeat(t.word_off[:-1] - off[:-1], fits)
    last = np.minimum(first + shingle, np.repeat(t.word_off[1:], fits)) - 1
    digest = xxhash.xxh64_intdigest
    values = [digest(norm[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist())]
    bits = np.unpackbits(np.array(values, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(fits)
    ones = np.add.reduceat(bits, off[some], axis=0, dtype=np.int32)
    set_ = (2 * ones > fits[some, None]).astype(np.uint8)
    out[some] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (XXH64 of the text), fp (the fingerprint as a signed long); empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(2), SLICE):
                part = b.slice(i, j - i)
                fp = fingerprints_of(part.column(2)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], ["doc_id", "text_key", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _anchors(half: F.Column, side: int) -> F.Column:
    """The anchors of a 32-bit half as longs, tagged with the side: at most 17."""
    code = half.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    free = half.bitwiseAND(F.lit(0x80000000).cast("long"))
    syndrome = sum((F.bit_count(code.bitwiseAND(F.lit(m).cast("long"))) % 2) * (1 << k) for k, m in enumerate(_PARITY))
    bit = lambda p: F.expr("1L") if p is None else F.call_function("shiftleft", F.lit(1).cast("long"), p - 1)
    tag = F.lit(side << 32).cast("long")
    nearest = F.when(syndrome == 0, code).otherwise(code.bitwiseXOR(bit(syndrome.cast("int"))))
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(31)), lambda p: (p != syndrome) & (p < p.bitwiseXOR(syndrome.cast("int"))) & (syndrome != 0)),
        lambda p: code.bitwiseXOR(bit(p)).bitwiseXOR(bit(p.bitwiseXOR(syndrome.cast("int")))),
    )
    here = F.concat(F.array(nearest), pairs)
    all_ = F.concat(F.transform(here, lambda a: a.bitwiseOR(free)), F.array(nearest.bitwiseOR(free.bitwiseXOR(F.lit(0x80000000).cast("long")))))
    return F.transform(all_, lambda a: a.bitwiseOR(tag))


def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(x: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links among fingerprints x. Memory is linear in x."""
    rest, a, b = np.arange(len(x)), [], []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            close = np.bitwise_count(x[rest] ^ x[i]) <= most
            if close.any():
                found = rest[close]
                a.append(np.full(len(found), i))
                b.append(found)
                front += found.tolist()
                rest = rest[~close]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, fp), sorted by anchor: the links of each anchor's run. A run may go over batches."""

    def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        start = np.concatenate([[0], edge])
        size = np.diff(np.concatenate([start, [len(anchor)]]))
        a, b = [], []
        # Most runs are short: all runs at once, by distance within the run.
        small = size <= 16
        member = np.repeat(small, size)
        left = np.repeat(size, size) - (np.arange(len(anchor)) - np.repeat(start, size))
        for d in range(1, int(size[small].max()) if small.any() else 1):
            i = np.flatnonzero(member & (left > d))
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= MAX_BITS]
            a.append(fp[i])
            b.append(fp[i + d])
        for s, m in zip(start[~small].tolist(), size[~small].tolist()):
            own = fp[s : s + m]
            i, j = forest(own)
            a.append(own[i])
            b.append(own[j])
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rest: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        anchor = batch.column(0).to_numpy()
        fp = batch.column(1).to_numpy().view(np.uint64)
        if not len(anchor):
            continue
        if rest is not None:
            anchor, fp = np.concatenate([rest[0], anchor]), np.concatenate([rest[1], fp])
        cut = int(np.searchsorted(anchor, anchor[-1], "left"))
        rest = (anchor[cut:], fp[cut:])
        if cut:
            yield links(anchor[:cut], fp[:cut])
    if rest is not None:
        yield links(*rest)


def _tiles(pdf: pd.DataFrame) -> pd.DataFrame:
    x = pdf["fp"].to_numpy().view(np.uint64)
    a, b = (x[i].view(np.int64) for i in forest(x))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (column fp) -> links (a, b) that connect exactly what links at MAX_BITS bits connect."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned("fp", 32)
    # The distinct fingerprints are few bytes, and Spark would put them into few tasks; the fan-out is what costs. By
    # another expression than fp, by which they are dealt already, so that the planner keeps this exchange.
    # explode_outer: for explode, the optimizer adds a filter that computes all anchors once more.
    n_tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.repartition(n_tasks, F.xxhash64("fp", F.lit("spread")))
    sent = written(spread.select("fp", F.explode_outer(F.concat(_anchors(low, 0), _anchors(high, 1))).alias("anchor")), "simhash-anchors")
    # Anchors with many members, counted by an aggregation that combines before the shuffle: sent / tile rows at most.
    crowded = written(sent.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > tile), "simhash-crowded")
    cold = sent.join(crowded, "anchor", "left_anti").repartition(n_tasks, "anchor").sortWithinPartitions("anchor").select("anchor", "fp").mapInArrow(_runs, "a long, b long")
    met = sent.join(crowded, "anchor")
    n = F.ceil(F.col("m") / F.lit(tile)).cast("int")
    hot = (
        met.withColumn("n", n)
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .select("anchor", "fp", "tile", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        .select("anchor", "fp", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
        .groupBy("anchor", "i", "j")
        .applyInPandas(_tiles, "a long, b long")
    )
    return cold.unionByName(hot).distinct()


def _least_of_components(prints: DataFrame, least: F.Column) -> DataFrame:
    """fp, root, least: for each fingerprint its component's root and the aggregate `least` over the component."""
    nodes = prints.groupBy("fp").agg(least.alias("own"))
    found = components(links(nodes.select("fp")), "a", "b")
    # Copies are one node by now; members of a component meet at its root in an aggregation that combines first.
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("own").alias("least"))
    inner = rooted.where("root <> fp").select("fp", "root").join(named, "root").select("fp", "root", "least")
    return inner.unionByName(named.select(F.col("root").alias("fp"), "root", "least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: one row per document.

    component_id is the smallest doc_id that links of at most MAX_BITS bits reach, the document itself included. Null
    and empty texts have fingerprint zero and are linked like any other; repeated rows give repeated rows; a row without
    doc_id gets the component of its fingerprint; an empty table gives no rows. Other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash-fp")
    found = _least_of_components(prints, F.min("doc_id")).select("fp", F.col("least").alias("component_id"))
    return prints.join(found, "fp", "left").select("doc_id", "fp", "component_id")


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, columns as they were: the one with the smallest doc_id (null first).

    Rows that share that doc_id are told apart by their text; of rows that agree in both, one stays.
    """
    names = docs.columns
    prints = written(fingerprints(docs, id_col, text_col), "simhash-fp")
    found = _least_of_components(prints, F.min(F.struct("doc_id", "text_key"))).where("fp = root")
    kept = found.select(F.col("least.doc_id").alias("_kept_id"), F.col("least.text_key").alias("_kept_key"))
    # The row goes as one value, so that no column of it can clash with those that are added.
    rows = docs.select(F.struct("*").alias("_whole_row"))
    rows = rows.withColumns({"_own_id": F.col(f"_whole_row.`{id_col}`").cast("long"), "_own_key": F.xxhash64(F.col(f"_whole_row.`{text_col}`").cast("string"))})
    chosen = rows.join(kept, rows["_own_id"].eqNullSafe(kept["_kept_id"]) & (rows["_own_key"] == kept["_kept_key"]), "left_semi")
    return chosen.dropDuplicates(["_own_id", "_own_key"]).select(*[F.col(f"_whole_row.`{c}`").alias(c) for c in names])
