"""Token ids of whole batches of texts.

The byte-pair encoder is tiktoken over a public rank file whose path is a parameter. Its pattern never lets a token go
over the place before a space that a visible character follows, so texts are cut there, each distinct piece of a batch
is encoded once, and the ids are gathered back by numpy. A bounded memo of pieces lives as long as the worker.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import SparkSession

from .textkernel import column_bytes, prefix_sums, segment_hash

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the public rank file lies unless told otherwise.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers.
MEMO = 1 << 19

# Lead bytes of the Unicode white space characters: no cut before them.
_AFTER = np.arange(256) > 0x20
_AFTER[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


@dataclass(frozen=True)
class Vocabulary:
    """A rank file's content; small (under two megabytes for 50,000 tokens) and read once on the driver."""

    content: bytes

    @classmethod
    def read(cls, path: str = RANKS) -> Vocabulary:
        if "://" in path:
            filesystem, path = fs.FileSystem.from_uri(path)
            with filesystem.open_input_stream(path) as f:
                return cls(f.read())
        with open(path, "rb") as f:
            return cls(f.read())

    def end(self) -> int:
        """The id after the last rank."""
        return max(int(line.split()[1]) for line in self.content.splitlines() if line) + 1

    def shared(self, spark: SparkSession):
        return spark.sparkContext.broadcast(self.content)


def id_type(end: int) -> np.dtype:
    return np.dtype("<u2" if end <= 0xFFFF else "<u4")


_encoders: dict[bytes, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    key = hashlib.sha1(content).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


class Encoder:
    def __init__(self, content: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        #: The id after the last rank is free and stands for the end of a document.
        self.end = max(ranks.values()) + 1
        #: Two bytes an id where they hold the end mark too, else four.
        self.dtype = id_type(self.end)
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(self.end + 1, np.int64)
        for b, i in ranks.items():
            self.width[i] = len(b)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def _encode_pieces(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of each. plain: the piece begins with a space and can be joined."""
        out, count = [], np.zeros(len(start), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        joined = int(plain.sum())
        if joined:
            s, n = start[order[:joined]], size[order[:joined]]
            end = np.cumsum(n)
            index = np.repeat(s - (end - n), n) + np.arange(end[-1])
            ids = np.array(self.bpe.encode_to_numpy(data[index].tobytes().decode("utf-8", "replace"), disallowed_special=()), self.dtype)
            token_end = np.cumsum(self.width[ids])
            stop = np.searchsorted(token_end, end) + 1
            if len(token_end) != stop[-1] or not np.array_equal(token_end[stop - 1], end):
                raise AssertionError("a token goes over a cut")
            out.append(ids)
            count[order[:joined]] = np.diff(stop, prepend=0)
        for i in order[joined:]:
            ids = self.bpe.encode_ordinary(data[start[i] : start[i] + size[i]].tobytes().decode("utf-8", "replace"))
            out.append(np.array(ids, self.dtype))
            count[i] = len(ids)
        ids = np.concatenate(out) if out else np.zeros(0, self.dtype)
        # back to the order of the pieces
        placed = count[order]
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(placed) - placed
        return ids[_ragged(begin, count)], count

    def encode(self, col: pa.Array, only_counts: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text). Nulls have none."""
        data, off = column_bytes(col)
        n = len(data)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(col), np.int64)
        first = np.zeros(n + 1, bool)
        first[off] = True
        cut = np.zeros(n, bool)
        cut[:-1] = (data[:-1] == 0x20) & _AFTER[data[1:]] & ~first[1:-1]
        start = np.flatnonzero(cut | first[:-1])
        end = np.append(start[1:], n)
        hashes = segment_hash(prefix_sums(data), start, end)
        uniq, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = found < len(self.keys)
        known[inside] = self.keys[found[inside]] == uniq[inside]
        new = np.flatnonzero(~known)
        ids, count = self._encode_pieces(data, start[where[new]], (end - start)[where[new]], cut[start[where[new]]])
        pool = np.concatenate([self.pool, ids])
        at, each = np.empty(len(uniq), np.int64), np.empty(len(uniq), np.int64)
        at[known], each[known] = self.at[found[known]], self.count[found[known]]
        at[new], each[new] = len(self.pool) + np.cumsum(count) - count, count
        if len(self.keys) < MEMO and len(new):
            keys = np.concatenate([self.keys, uniq[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.pool = keys[order], pool
            self.at = np.concatenate([self.at, at[new]])[order]
            self.count = np.concatenate([self.count, each[new]])[order]
        per_piece = each[inverse]
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(per_piece, out=total[1:])
        by_text = total[np.searchsorted(start, off)]
        counts = np.diff(by_text)
        if only_counts:
            return None, counts
        return pool[_ragged(at[inverse], per_piece)], counts


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of the next."""
    end = np.cumsum(count)
    if not len(end) or not end[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(begin - (end - count), count) + np.arange(end[-1])
