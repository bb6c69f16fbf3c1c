"""Proportional stratified interleaving into shards.

Rows of each source are put into a seeded order; the row of rank r among n has fractional rank (r + phase) / n, with a
phase of its own for each source so that small sources do not all fall on the same place. All rows sorted by fractional
rank interleave the sources in proportion, and equal cuts give shards that match the mixture and whose counts differ by
one at most (the law `rows`).

Neither ranking puts a source, or all rows, into one task: rows that agree in everything are one row with a number of
copies until they have their ranks; rows fall into buckets by the leading bits of the shuffle key (or of the fractional
rank), only bucket counts are summed up in order, and rows are numbered inside a bucket. Both keys are uniform, as the
shuffle key hashes all that tells rows apart, so a source with a third of all rows, or an id that a third of them share,
spreads over its buckets evenly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SHARDS = 16
SEED = "interleave-1"
#: Rows that a bucket should have; their number follows the rows, up to 2**MOST_BITS (for 34,000 million rows).
ROWS_PER_BUCKET = 2048
MOST_BITS = 24
#: Copies of a row that are told apart at once.
COPIES = 4096
_KEY_BITS = 52


def _hash52(*parts) -> F.Column:
    """52 bits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, _KEY_BITS // 4), 16, 10).cast("long")


def interleave(rows: DataFrame, source_col: str, id_cols: tuple[str, ...], shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The columns source_col and id_cols of all rows, with _fraction, _shard and _slot (0, 1, ... inside each shard).

    Null sources form a source of their own; nulls in id_cols are shuffled as empty strings; rows that agree in all
    columns get different slots, which of them which does not matter. Fewer rows than shards leave shards empty; an empty
    table gives no rows. Other columns are not read; the three added ones are named _*, so as not to clash.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = [source_col, *id_cols]
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    base = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_copies"))
    base = written(base.withColumns({"_h": _hash52(F.lit(seed), *[text(c) for c in id_cols]), "_source": source}), "shard-rows")
    total = base.agg(F.sum("_copies")).first()[0] or 0
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, total / ROWS_PER_BUCKET)))))
    ties = ["_h", *id_cols]
    base = base.withColumn("_bucket", F.shiftright("_h", _KEY_BITS - bits))
    by_source = Window.partitionBy("_source")
    sizes = (
        base.groupBy("_source", "_bucket")
        .agg(F.sum("_copies").alias("_n"))
        .withColumn("_before", F.sum("_n").over(by_source.orderBy("_bucket")) - F.col("_n"))
        .withColumn("_all", F.sum("_n").over(by_source))
        .drop("_n")
    )
    phase = (_hash52(F.lit(seed), F.lit("phase"), F.col("_source")) + 0.5) / float(1 << _KEY_BITS)
    upto = F.sum("_copies").over(Window.partitionBy("_source", "_bucket").orderBy(*ties).rowsBetween(Window.unboundedPreceding, 0))
    first = base.join(sizes, ["_source", "_bucket"]).withColumn("_rank", upto - F.col("_copies") + F.col("_before"))
    # A row with very many copies becomes several rows first, so that no task writes them all.
    parts = first.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.expr(f"(_copies - 1) div {COPIES}"))))
    lots = parts.where(F.col("_copies") <= COPIES).unionByName(parts.where(F.col("_copies") > COPIES).repartition("_source", "_h", "_lot"))
    copy = F.explode(F.sequence(F.col("_lot") * COPIES, F.least(F.col("_copies"), (F.col("_lot") + 1) * COPIES) - 1))
    ranked = (
        lots.withColumn("_copy", copy)
        .withColumn("_fraction", (F.col("_rank") + F.col("_copy") + phase) / F.col("_all"))
        .withColumn("_part", F.floor(F.col("_fraction") * (1 << bits)).cast("long"))
        .select(*own, "_source", "_h", "_fraction", "_part")
    )
    ranked = written(ranked, "shard-ranks")
    # At most 2**bits rows.
    parts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("_part").orderBy("_fraction", "_source", *ties)
    placed = ranked.join(parts, "_part").withColumn("_position", F.row_number().over(inside) - 1 + F.col("_before"))
    shard = F.expr(f"_position * {shards} div {max(total, 1)}")
    return placed.withColumn("_shard", shard.cast("int")).withColumn("_slot", F.col("_position") - F.expr(f"(_shard * cast({max(total, 1)} as bigint) + {shards - 1}) div {shards}")).select(*own, "_fraction", "_shard", "_slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard, fraction: one row per document.

    Null texts are empty and have size 1, very long ones are read once and not moved; null ids and sources, repeated rows
    and empty tables as interleave() has them.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = interleave(rows, "source", ("doc_id", "text_crc32", "size"), shards, seed)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_fraction").alias("fraction"))


def sql(shards: int = SHARDS, seed: str = SEED) -> str:
    """The rows of shard_documents in DuckDB SQL; CRC-32 goes by a table of 256 entries made from its polynomial."""
    h52 = lambda parts: f"('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 13))::BIGINT"
    return f"""
WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
b AS (SELECT doc_id, source, encode(coalesce(text, '')) AS raw FROM documents),
y AS (SELECT doc_id, source, octet_length(raw) + 1 AS size, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM b),
c AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM y, tab),
h AS (SELECT *, coalesce('=' || source, 'null') AS s, {h52("coalesce(doc_id::VARCHAR, ''), crc::VARCHAR, size::VARCHAR")} AS h FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id, crc, size) - 1 AS rank, count(*) OVER (PARTITION BY s) AS n, ({h52("'phase', s")} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS phase FROM h),
f AS (SELECT *, (rank + phase) / n::DOUBLE AS fraction FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, s, h, doc_id, crc, size) - 1 AS pos, count(*) OVER () AS total FROM f)
SELECT doc_id, source, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (pos * {shards} // total)::INT AS shard,
  (pos - ((pos * {shards} // total) * total + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, fraction FROM p
"""
