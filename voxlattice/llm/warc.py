"""WARC archives: written with one gzip member per record, read back in sequence.

The writer makes each archive in one task from rows that were dealt out by where they stand in their files, which is
even whatever ids and payloads repeat: a record is a gzip member by itself, and an equal payload is stored once, as a
response; the others refer to it (profile identical-payload-digest). The
reader goes through an archive from front to end in bounded memory: members are decompressed piece by piece, blocks are
framed by Content-Length, and both digests are verified. Archives lie in the shared folder; a task that is tried
again writes the same archive again and puts it in place whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import WholeFile, located, reader, scratch, written

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Payload bytes that an archive should hold, and the size of the pieces that the reader takes.
ARCHIVE_BYTES = 64 << 20
PIECE = 64 << 10
LEVEL = 6


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass(frozen=True)
class Row:
    """A row of the table: its page and where it stands. The page may be null and need not be the only one of its id."""

    page_id: int | None
    file: str
    row: int

    @property
    def record_id(self) -> str:
        return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{self.page_id}:{posixpath.basename(self.file)}:{self.row}')}>"


def record(own: Row, url: str | None, payload: bytes, refers_to: Row | None) -> bytes:
    """One record, not compressed. The block is an HTTP response head and, unless it is a revisit, the payload.

    Fields beside the standard's: X-Page-ID and X-Refers-To-Page-ID, left out where the page has no id.
    """
    digest = sha1_base32(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    target = f"urn:page:{own.page_id}"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", own.record_id),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or target).split()) or target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if own.page_id is not None:
        fields.insert(4, ("X-Page-ID", str(own.page_id)))
    if revisit:
        fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to.record_id)]
        if refers_to.page_id is not None:
            fields.insert(6, ("X-Refers-To-Page-ID", str(refers_to.page_id)))
    lines = b"\r\n".join(f"{k}: {v}".encode() for k, v in fields)
    return VERSION + b"\r\n" + lines + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Inflated:
    """The bytes of one gzip member after another, decompressed as they are asked for."""

    def __init__(self, source: BinaryIO, piece: int = PIECE) -> None:
        self.source, self.piece = source, piece
        self.raw = b""
        self.buffer = bytearray()
        self.inflater = None

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the archive. The last one must have been read to its end."""
        if not self.raw:
            self.raw = self.source.read(self.piece)
        if not self.raw:
            return False
        self.buffer.clear()
        self.inflater = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        if self.inflater.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(self.piece)
            if not self.raw:
                raise EOFError("the archive ends inside a gzip member")
        out = self.inflater.decompress(self.raw, self.piece)
        self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        self.buffer += out
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to the mark and over it."""
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                raise ValueError(f"a record has no {mark!r}")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in pieces."""
        while n:
            if not self.buffer and not self._more():
                raise ValueError("a record's block is shorter than its Content-Length")
            out = bytes(self.buffer[:n])
            del self.buffer[: len(out)]
            n -= len(out)
            if out:
                yield out

    def finish(self) -> bytes:
        """What is left of the member."""
        while self._more():
            pass
        out = bytes(self.buffer)
        self.buffer.clear()
        return out


def fields_of(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")) if v}


def records(source: BinaryIO, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order. A framing error or a digest that does not agree raises ValueError."""
    stream = Inflated(source)
    while stream.next_member():
        if stream.until(b"\r\n") != VERSION:
            raise ValueError("a gzip member does not begin with a record")
        head = fields_of(stream.until(b"\r\n\r\n"))
        block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
        http, size = b"", 0
        for piece in stream.pieces(int(head["content-length"])):
            block.update(piece)
            if http is not None:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                stated, piece, http = fields_of(http[:at].partition(b"\r\n")[2]), http[at + 4 :], None
            size += len(piece)
            payload.update(piece)
            if with_payload:
                kept.append(piece)
        if stream.finish() != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        of = lambda h: base64.b32encode(h.digest()).decode()
        if of(block) != head["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"block digest of {head['warc-record-id']} does not agree")
        if not revisit and (of(payload) != digest or size != int(stated["content-length"])):
            raise ValueError(f"payload of {head['warc-record-id']} does not agree with its digest or length")
        yield {
            "record_type": head["warc-type"],
            "record_id": head["warc-record-id"],
            "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
            "target_uri": head["warc-target-uri"],
            "payload_bytes": int(stated["content-length"]),
            "payload_digest": digest,
            "refers_to": head.get("warc-refers-to"),
            "refers_to_page": int(head["x-refers-to-page-id"]) if "x-refers-to-page-id" in head else None,
            "payload": b"".join(kept) if with_payload and not revisit else None,
        }


def plan_revisits(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """_file, _row, response (page_id, _file, _row) for those rows (_file, _row, page_id, url, html) that are revisits.

    Of rows with equal payloads of least_bytes or more, one is the response: that with the largest page_id (a null is the
    least), then with the greatest url, then the last. A hot payload meets only in an aggregation that combines before the
    shuffle, and in a join of two written tables, which Spark can broadcast or split.
    """
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    key = rows.select("_file", "_row", "page_id", "url", F.sha1(raw).alias("k"), F.octet_length(raw).alias("n")).where(F.col("n") >= least_bytes)
    first = key.groupBy("k", "n").agg(F.max(F.struct("page_id", "url", "_file", "_row")).alias("r"), F.count(F.lit(1)).alias("m")).where("m > 1")
    first = written(first.select("k", "n", F.struct("r.page_id", "r._file", "r._row").alias("response")), "warc-responses")
    found = key.join(first, ["k", "n"]).where("_file <> response._file or _row <> response._row")
    return written(found.select("_file", "_row", "response"), "warc-revisits")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write pages (page_id, url, html) as path/part-NNNNN.warc.gz; returns archive, n_records, n_bytes.

    Every row is a record, and every payload is in one of the archives. Null html is an empty payload, a null or blank
    url is urn:page:ID. A null page_id is left out of the record; repeated ids and repeated rows are written as often as
    they come, with equal payloads stored once and different ones each. Very long payloads are held one at a time. Other
    columns are not read. An empty table gives no archives. The returned table is small (a row an archive) and written
    already.
    """
    spark = pages.sparkSession
    rows = located(pages, "page_id", "url", "html")
    rows = rows.select("_file", "_row", F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    total = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    # With fewer than the session's shuffle partitions, Spark would shuffle the payloads again for the join.
    n = max(math.ceil(total / archive_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Both sides are dealt out alike before the join, so the payloads are shuffled once.
    refers = plan_revisits(rows, least_bytes).repartition(n, "_file", "_row")
    dealt = rows.repartition(n, "_file", "_row").join(refers, ["_file", "_row"], "left").sortWithinPartitions("_file", "_row").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, WholeFile, BinaryIO] | None = None
        count = size = 0

        def close():
            held[1].__exit__(None)
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/part-{held[0]:05d}.warc.gz"]), pa.array([count]), pa.array([size])], ["archive", "n_records", "n_bytes"])

        try:
            for b in batches:
                for part, file, row, page, url, html, response in zip(*b.columns):
                    part = part.as_py()
                    if held is None or held[0] != part:
                        if held is not None:
                            yield close()
                        whole = WholeFile(f"{path}/part-{part:05d}.warc.gz")
                        held, count, size = (part, whole, whole.__enter__()), 0, 0
                    to = response.as_py()
                    payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                    refers = None if to is None else Row(to["page_id"], to["_file"], to["_row"])
                    member = gzip_member(record(Row(page.as_py(), file.as_py(), row.as_py()), url.as_py(), payload, refers), level)
                    held[2].write(member)
                    count, size = count + 1, size + len(member)
            if held is not None:
                out = close()
                held = None
                yield out
        except BaseException as e:
            if held is not None:
                held[1].__exit__(type(e))
            raise

    manifest = dealt.select("part", "_file", "_row", "page_id", "url", "html", "response").mapInArrow(write, "archive string, n_records long, n_bytes long")
    return written(manifest, "warc-manifest")


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the archives (column archive), an archive a task, verified as they are read."""
    n = max(1, archives.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["archive"]:
                held, size = [], 0
                with reader(archive) as f:
                    for r in records(f, with_payload):
                        held.append(r | {"archive": archive})
                        size += len(r["payload"] or b"")
                        if len(held) >= 5000 or size > 8 << 20:
                            yield frame(held)
                            held, size = [], 0
                if held:
                    yield frame(held)

    def frame(held: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(held)
        out["page_id"], out["refers_to_page"] = out["page_id"].astype("Int64"), out["refers_to_page"].astype("Int64")
        return out[["record_type", "record_id", "page_id", "target_uri", "payload_bytes", "payload_digest", "refers_to", "refers_to_page", "archive", "payload"]]

    schema = "record_type string, record_id string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to string, refers_to_page long, archive string, payload binary"
    return archives.select("archive").repartition(n).mapInPandas(read, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives of all pages in the shared folder, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A row a page: null, repeated and empty pages as write_archives() has them.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    found = read_archives(spark, write_archives(pages, path, least_bytes))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


#: The rows of op1_warc in DuckDB SQL; base32 takes four letters from each 20 bits of the SHA-1.
SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS top,
    row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN top END AS refers_to
FROM d
"""
