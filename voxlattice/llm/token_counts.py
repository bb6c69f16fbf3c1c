"""Exact token length histogram with suffix sums.

Documents are counted by encoded length, which combines before the shuffle; all that follows is as large as the number
of distinct lengths. Suffix sums are taken in two levels, over blocks of lengths and inside each block, so no task
holds more than a block. From the result every question about a context limit is a lookup: documents and tokens at or
above a length, tokens left when each document is cut at the limit, and quantiles of the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .textkernel import slices
from .tokenizer import RANKS, Vocabulary, encoder

SLICE = 2 << 20
#: Lengths in one block of the suffix sums.
BLOCK = 1024


def token_counts(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens: one row per document.

    Null and empty texts have no tokens, a very long text is encoded whole, repeated rows repeat, null ids stay, other
    columns are not read, an empty table gives no rows.
    """
    spark = docs.sparkSession
    content = Vocabulary.read(ranks).shared(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value)
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                part = b.slice(i, j - i)
                _, n = enc.encode(part.column(1), only_counts=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counts: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per length that occurs.

    Columns: n_tokens, documents and tokens of that length, docs_at_least and tokens_at_least (that length or more),
    docs_below and tokens_below, truncated_total (tokens left if every document is cut at n_tokens). Rows repeat as
    they do in the input, and each counts; null lengths count as zero; an empty table gives no rows.
    """
    n = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    bars = counts.groupBy(n.alias("n_tokens")).agg(F.count(F.lit(1)).alias("documents")).withColumn("tokens", F.col("n_tokens") * F.col("documents")).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    # Used twice from here on; written, the texts are encoded once.
    bars = written(bars, "length-bars")
    blocks = bars.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    # One row per BLOCK lengths: even texts of 10**9 tokens give a million rows.
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("block", zero(F.sum("d").over(after)).alias("d_after"), zero(F.sum("t").over(after)).alias("t_after"), zero(F.sum("d").over(before)).alias("d_before"), zero(F.sum("t").over(before)).alias("t_before"))
    up = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return bars.join(blocks, "block").select(
        "n_tokens",
        "documents",
        "tokens",
        (F.sum("documents").over(up) + F.col("d_after")).alias("docs_at_least"),
        (F.sum("tokens").over(up) + F.col("t_after")).alias("tokens_at_least"),
        (zero(F.sum("documents").over(down)) + F.col("d_before")).alias("docs_below"),
        (zero(F.sum("tokens").over(down)) + F.col("t_before")).alias("tokens_below"),
    ).withColumn("truncated_total", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, documents, truncated_docs, total_tokens, truncated_total for any limits, from the histogram alone."""
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    over = F.col("n_tokens") > F.col("context_limit")
    return (
        hist.select("n_tokens", "documents", "tokens", asked.alias("context_limit"))
        .groupBy("context_limit")
        .agg(
            F.sum("documents").alias("documents"),
            F.sum(F.when(over, F.col("documents")).otherwise(0)).alias("truncated_docs"),
            F.sum("tokens").alias("total_tokens"),
            F.sum(F.least("n_tokens", "context_limit") * F.col("documents")).alias("truncated_total"),
        )
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents do not exceed."""
    total = F.col("docs_below") + F.col("docs_at_least")
    return hist.where(F.col("docs_below") + F.col("documents") >= F.ceil(F.lit(q) * total)).agg(F.min("n_tokens").alias("n_tokens"))
