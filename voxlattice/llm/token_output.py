"""Token-ID shards in training order.

A document's ids and an end mark are cut into sequences of at most `length` ids. Sequences are numbered densely, and a
keyed Feistel network with cycle-walking maps the N numbers one to one onto the N global slots, so the order is a
seeded shuffle that needs no random sort and no table. Slot s lies in shard s div R at byte (s mod R) * stride, where
the stride is fixed: a reader that knows how many sequences it has consumed seeks there and goes on.

Dense numbers without moving text: a row is known by its file and its index in that file, which no splitting of the
scan, lost executor or second try changes. A first pass counts each row's sequences; their running totals by (file, row)
lie in the shared folder as arrays of BLOCK rows. The second pass encodes again wherever it runs and looks its rows up
there. Encoding twice is the price of disk: ids kept between the passes would be as large as the input once more.
Ids are shuffled once, straight to the shard that they belong to; a shard is one task's file, put in place whole, and
the shards are counted against the layout before they are handed on.

Record layout, little-endian: doc_id int64, chunk uint32 (number of the sequence in its document), n uint32, then
`length` ids of two bytes (four for vocabularies over 65,535) of which the first n count. The top bit of n marks a
document without an id, whose doc_id field is zero.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import WholeFile, discard, located, open_fs, scratch, written
from .textkernel import mix, slices
from .tokenizer import RANKS, Vocabulary, encoder, id_type

LENGTH = 512
SHARD_BYTES = 32 << 20
KEY = 20240229
ROUNDS = 6
SLICE = 2 << 20
#: Rows of a file whose numbers lie in one array.
BLOCK = 1 << 18
#: Shuffle partitions at most; beyond, a task makes several shards in a row.
MOST_TASKS = 20_000
HEAD = np.dtype([("doc_id", "<i8"), ("chunk", "<u4"), ("n", "<u4")])
NO_ID = 1 << 31
MANIFEST = "shard int, first_slot long, n_sequences long, n_tokens long, crc32 long"


def stride(length: int, id_bytes: int = 2) -> int:
    return HEAD.itemsize + id_bytes * length


def permuted(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The keyed permutation of 0 .. n - 1: Feistel on the least even number of bits that hold n, walked back into range."""
    if n <= 1:
        return np.zeros(len(x), np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix((np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """What a reader needs to know; it stands beside the shards as layout.json too."""

    path: str
    length: int
    sequences: int
    per_shard: int
    id_bytes: int = 2

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)

    @property
    def stride(self) -> int:
        return stride(self.length, self.id_bytes)

    def shard_path(self, shard: int) -> str:
        return f"{self.path}/shard-{shard:07d}.bin"

    @classmethod
    def read(cls, path: str) -> Layout:
        filesystem, at = open_fs(f"{path}/layout.json")
        with filesystem.open_input_stream(at) as f:
            return cls(**json.loads(f.read()) | {"path": path})


def _numbers_path(folder: str, file: str, block: int) -> str:
    return f"{folder}/{hashlib.sha1(file.encode()).hexdigest()}/{block:06d}.bin"


def number_rows(counts: DataFrame, folder: str, rows: int = BLOCK) -> int:
    """Rows (_file, _row, n) -> the sum of n; into the folder go arrays: for each row the sum of n before it, -1 where no row is.

    The order is that of file and row. An array is for so many rows of a file, and a task holds one; the totals are a row an array.
    """
    blocked = counts.withColumn("block", F.expr(f"_row div {rows}"))
    totals = written(blocked.groupBy("_file", "block").agg(F.sum("n").alias("n")), "token-blocks")
    total = totals.agg(F.sum("n")).first()[0] or 0
    bases = totals.select("_file", "block", (F.sum("n").over(Window.orderBy("_file", "block")) - F.col("n")).alias("base"))

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        file, block, base = pdf["_file"].iloc[0], int(pdf["block"].iloc[0]), int(pdf["base"].iloc[0])
        n = pdf["n"].to_numpy()
        out = np.full(rows, -1, "<i8")
        out[pdf["_row"].to_numpy() - block * rows] = base + np.cumsum(n) - n
        with WholeFile(_numbers_path(folder, file, block)) as f:
            f.write(out.tobytes())
        return pd.DataFrame({"n": [int(n.sum())]})

    made = written(blocked.join(bases, ["_file", "block"]).groupBy("_file", "block").applyInPandas(store, "n long"), "token-numbered")
    if (made.agg(F.sum("n")).first()[0] or 0) != total:
        raise AssertionError("not every row was numbered")
    discard(totals, made)
    return total


class _Numbers:
    """Looks rows up in the arrays of number_rows; the last few arrays stay in memory."""

    def __init__(self, folder: str, rows: int) -> None:
        self.folder, self.rows, self.held = folder, rows, {}

    def _array(self, file: str, block: int) -> np.ndarray:
        if (file, block) not in self.held:
            while len(self.held) >= 4:
                self.held.pop(next(iter(self.held)))
            filesystem, path = open_fs(_numbers_path(self.folder, file, block))
            with filesystem.open_input_stream(path, compression=None) as f:
                self.held[file, block] = np.frombuffer(f.read(), "<i8")
        return self.held[file, block]

    def of(self, files: pa.Array, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        codes = files.dictionary_encode()
        code = codes.indices.to_numpy()
        block = rows // self.rows
        edge = np.append(np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]))), len(rows))
        for a, z in zip(edge.tolist(), edge[1:].tolist()):
            out[a:z] = self._array(codes.dictionary[int(code[a])].as_py(), int(block[a]))[rows[a:z] - block[a] * self.rows]
        if (out < 0).any():
            raise AssertionError("a row of the second pass was not there in the first")
        return out


def write_shards(docs: DataFrame, path: str, ranks: str = RANKS, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, key: int = KEY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[Layout, DataFrame]:
    """Write the shards; returns the layout and a table shard, first_slot, n_sequences, n_tokens, crc32.

    Every row of docs is written. Null and empty texts are one sequence that holds the end mark alone; repeated rows are
    repeated; a null id is marked in the record; very long texts are cut into as many sequences as they need; other
    columns are not read, whatever their names. An empty table gives no shard. If the shards do not hold every sequence
    of the layout, an error is raised.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.read(ranks)
    content = vocabulary.shared(spark)
    id_bytes = id_type(vocabulary.end()).itemsize
    rows = located(docs, id_col, text_col)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), "_file", "_row")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value)
        for b in batches:
            for i, j in slices(b.column(0), SLICE):
                part = b.slice(i, j - i)
                _, n = enc.encode(part.column(0), only_counts=True)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n // length + 1)], ["_file", "_row", "n"])

    counts = written(rows.select("text", "_file", "_row").mapInArrow(count, "_file string, _row long, n long"), "token-counts")
    numbers = scratch(spark, "token-numbers")
    total = number_rows(counts, numbers, block)
    discard(counts)
    layout = Layout(path, length, total, max(1, shard_bytes // stride(length, id_bytes)), id_bytes)
    if not total:
        return layout, spark.createDataFrame([], MANIFEST)
    per_shard, width = layout.per_shard, layout.stride

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(content.value), _Numbers(numbers, block)
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                part = b.slice(i, j - i)
                ids, n = enc.encode(part.column(1))
                yield sequences(part.column(0), known.of(part.column(2), part.column(3).to_numpy()), ids, n, enc.end)

    def sequences(doc_id: pa.Array, number: np.ndarray, ids: np.ndarray, n: np.ndarray, end: int) -> pa.RecordBatch:
        # the end mark after each document's ids
        stop = np.cumsum(n + 1)
        whole = np.full(stop[-1], end, ids.dtype)
        body = np.ones(len(whole), bool)
        body[stop - 1] = False
        whole[body] = ids
        many = n // length + 1
        doc = np.repeat(np.arange(len(n)), many)
        chunk = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        begin = np.repeat(stop - n - 1, many) + chunk * length
        size = np.minimum(length, np.repeat(stop, many) - begin)
        slot = permuted(number[doc] + chunk, total, key)
        raw = memoryview(whole.tobytes())
        packed = [zlib.compress(raw[id_bytes * s : id_bytes * (s + z)], 1) for s, z in zip(begin.tolist(), size.tolist())]
        arrays = [pa.array(slot), doc_id.take(pa.array(doc)), pa.array(chunk.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["slot", "doc_id", "chunk", "n", "ids"])

    in_a_row = -(-layout.shards // MOST_TASKS)
    dealt = (
        rows.select("doc_id", "text", "_file", "_row")
        .mapInArrow(cut, "slot long, doc_id long, chunk int, n int, ids binary")
        .repartitionById(-(-layout.shards // in_a_row), F.expr(f"cast(slot div {per_shard * in_a_row} as int)"))
        .sortWithinPartitions("slot")
    )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        try:
            for b in batches:
                slot, at = b.column(0).to_numpy(), 0
                records = _records(b, length, width, id_bytes)
                while at < len(slot):
                    if file is None:
                        shard, crc, count, tokens = int(slot[at]) // per_shard, 0, 0, 0
                        file = WholeFile(layout.shard_path(shard))
                        out = file.__enter__()
                    full = min(per_shard, total - shard * per_shard)
                    to = min(len(slot), at + full - count)
                    if not np.array_equal(slot[at:to], shard * per_shard + count + np.arange(to - at)):
                        raise AssertionError(f"the slots of shard {shard} do not follow each other")
                    data = memoryview(records[at:to]).cast("B")
                    out.write(data)
                    crc = zlib.crc32(data, crc)
                    count, tokens, at = count + to - at, tokens + int(b.column(3).slice(at, to - at).to_numpy().sum()), to
                    if count == full:
                        file = file.__exit__(None)
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (shard * per_shard, pa.int64()), (count, pa.int64()), (tokens, pa.int64()), (crc, pa.int64()))], ["shard", "first_slot", "n_sequences", "n_tokens", "crc32"])
            if file is not None:
                raise AssertionError(f"shard {shard} has {count} sequences of {full}")
        except BaseException as e:
            if file is not None:
                file.__exit__(type(e))
            raise

    manifest = written(dealt.mapInArrow(store, MANIFEST), "token-manifest")
    found = manifest.agg(F.count(F.lit(1)), F.count_distinct("shard"), F.sum("n_sequences")).first()
    if tuple(found) != (layout.shards, layout.shards, total):
        raise AssertionError(f"{found[1]} shards with {found[2]} sequences were written of {layout.shards} with {total}")
    with WholeFile(f"{path}/layout.json") as f:
        f.write(json.dumps(asdict(layout)).encode())
    discard(numbers)
    return layout, manifest


def _records(b: pa.RecordBatch, length: int, width: int, id_bytes: int) -> np.ndarray:
    """Rows (slot, doc_id, chunk, n, ids) as records of fixed width, one below the other."""
    n = b.column(3).to_numpy().astype(np.int64)
    out = np.zeros((len(n), width), np.uint8)
    head = np.zeros(len(n), HEAD)
    ids = b.column(1)
    head["doc_id"], head["chunk"] = ids.fill_null(0).to_numpy(), b.column(2).to_numpy()
    head["n"] = n | np.where(ids.is_null().to_numpy(zero_copy_only=False), NO_ID, 0)
    out[:, : HEAD.itemsize] = head.view(np.uint8).reshape(len(n), -1)
    body = np.arange(id_bytes * length) < id_bytes * n[:, None]
    out[:, HEAD.itemsize :][body] = np.frombuffer(b"".join(map(zlib.decompress, b.column(4).to_pylist())), np.uint8)
    return out


def read_slots(layout: Layout, first: int = 0, most: int | None = None) -> Iterator[tuple[int, np.void, np.ndarray]]:
    """Sequences in slot order from `first` on: (slot, head, ids). Seeks straight to the first; reads on in sequence."""
    width, slot = layout.stride, first
    last = layout.sequences if most is None else min(layout.sequences, first + most)
    while slot < last:
        shard, row = divmod(slot, layout.per_shard)
        filesystem, path = open_fs(layout.shard_path(shard))
        with filesystem.open_input_file(path) as f:
            f.seek(row * width)
            while slot < last and slot // layout.per_shard == shard:
                data = f.read(width)
                head = np.frombuffer(data, HEAD, 1)[0]
                yield slot, head, np.frombuffer(data, f"<u{layout.id_bytes}", int(head["n"]) & (NO_ID - 1), HEAD.itemsize)
                slot += 1


def read_back(spark: SparkSession, layout: Layout, manifest: DataFrame) -> DataFrame:
    """A row a sequence, read from the shards: slot, shard, byte_offset, doc_id, chunk, n_tokens, ids_crc32.

    A shard whose bytes do not agree with its checksum raises an error.
    """
    width = layout.stride

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, crc in zip(*(b.column(i).to_pylist() for i in range(3))):
                filesystem, path = open_fs(layout.shard_path(shard))
                found, row = 0, 0
                with filesystem.open_input_stream(path, compression=None) as f:
                    while data := f.read(width * 4096):
                        found = zlib.crc32(data, found)
                        n = len(data) // width
                        heads = np.ndarray(n, HEAD, data, 0, (width,))
                        size, view = heads["n"].astype(np.int64) & (NO_ID - 1), memoryview(data)
                        sums = [zlib.crc32(view[s : s + z]) for s, z in zip(range(HEAD.itemsize, n * width, width), (size * layout.id_bytes).tolist())]
                        at = np.arange(row, row + n)
                        doc_id = pa.array(heads["doc_id"].astype(np.int64), mask=heads["n"] >= NO_ID)
                        arrays = [first + at, np.full(n, shard, np.int32), at * width, doc_id, heads["chunk"].astype(np.int64), size, np.array(sums, np.int64)]
                        yield pa.RecordBatch.from_arrays([x if x is doc_id else pa.array(x) for x in arrays], ["slot", "shard", "byte_offset", "doc_id", "chunk", "n_tokens", "ids_crc32"])
                        row += n
                if found != crc:
                    raise ValueError(f"shard {shard} does not agree with its checksum")

    n = max(1, layout.shards)
    return manifest.select("shard", "first_slot", "crc32").repartition(n).mapInArrow(read, "slot long, shard int, byte_offset long, doc_id long, chunk long, n_tokens long, ids_crc32 long")


def materialise(docs: DataFrame, **options) -> DataFrame:
    """Shards of all documents in the shared folder, and what is read back from them."""
    spark = docs.sparkSession
    layout, manifest = write_shards(docs, scratch(spark, "token-shards"), **options)
    return read_back(spark, layout, manifest)
