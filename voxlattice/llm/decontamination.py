"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

A benchmark item is short and a document may be a thousand times longer, so the Jaccard similarity of the two is close
to zero and banded signatures of whole documents would miss most leaks. Containment is searched from the item's side:
items are partitioned by the power of two of their number q of shingles, and the MinHash sketch of an item is its s
smallest shingle hashes, with s = floor((1 - threshold) * upper) + 1 for the upper bound of its size partition. A
document that holds a share `threshold` of the item's shingles lacks at most floor((1 - threshold) * q) of them, so it
holds one of any s: no leak is lost, whatever the document's length. Documents too short to hold enough shingles are
left out by size. What the sketches find is then verified on the words themselves.

An item of fewer than k words is one shingle as wide as itself. Documents are hashed at such a width only if the
benchmark has an item of that width, at k - 1 widths at most.

Documents are known by the MD5 of their text, so thousands of copies are one candidate, repeated and missing ids do no
harm, and only keys, never texts, go through the candidate shuffle. The candidates are written once; from then on only
the texts that have some are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import located, written

SHINGLE = 5
THRESHOLD = 0.8


def words(text: Column) -> Column:
    """Words of the text in lower case: runs outside white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _starts(w: Column, k: int) -> Column:
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, k: int = SHINGLE) -> Column:
    """A 64-bit hash for each run of k words, with no string built."""
    return F.transform(_starts(w, k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """The runs of k words themselves, each once."""
    return F.array_distinct(F.transform(_starts(w, k), lambda i: F.array_join(F.slice(w, i + 1, k), " ")))


def _by_width(w: Column, k: int, widths: list[int], of) -> Column:
    """of(w, width) for the width of an item's shingles: its own number of words if that is one of `widths`, else k."""
    out = of(w, k)
    for j in widths:
        out = F.when(F.size(w) == j, of(w, j)).otherwise(out)
    return out


def sketches(items: DataFrame, threshold: float, k: int, widths: list[int]) -> DataFrame:
    """item_id, hash, need: the sketch of each item (item_id, w), and the least number of shingles of a document that can hold it."""
    hashed = items.select("item_id", "w", F.array_sort(F.array_distinct(_by_width(F.col("w"), k, widths, shingle_hashes))).alias("hashes"))
    q = F.size("hashes")
    upper = F.pow(F.lit(2.0), F.floor(F.log2(q)) + 1) - 1
    s = (F.floor(F.lit(1 - threshold) * upper + F.lit(1e-9)) + 1).cast("int")
    need = F.when(F.size("w") >= k, F.ceil(F.lit(threshold) * q - F.lit(1e-9))).otherwise(F.size("w") - (k - 1))
    return hashed.where(q > 0).select("item_id", need.alias("need"), F.explode(F.slice("hashes", F.lit(1), s)).alias("hash"))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_key, item_id, n_item_shingles, n_shared, containment: a row for each text that holds an item, each once.

    An item is held if at least `threshold` of its distinct shingles of k words stand in the text (case does not
    count). An item of fewer than k words is one shingle and is held if its words stand in the text one after the other;
    an item without words is never held, nor do null or empty texts hold anything. Items with null ids are reported with
    a null id; items repeated under one id count as one item each; other columns are not read; empty tables give no rows.
    """
    rows = located(docs, id_col, text_col)
    texts = rows.select("_file", "_row", F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("text").isNotNull()).withColumn("text_key", F.md5(F.encode("text", "UTF-8")))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = items.withColumn("item_key", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    by_key = items.dropDuplicates(["item_key"]).select(F.col("item_key").alias("item_id"), words(F.col("text")).alias("w"))
    # k - 1 numbers at most
    widths = sorted(r[0] for r in by_key.select(F.size("w").alias("n")).where(F.col("n").between(1, k - 1)).distinct().collect())
    sketch = sketches(by_key, threshold, k, widths)
    hashes = F.concat(*[shingle_hashes(F.col("w"), j) for j in (k, *widths)])
    probes = texts.select("text_key", "_file", "_row", words(F.col("text")).alias("w")).select("text_key", "_file", "_row", (F.size("w") - (k - 1)).alias("n"), hashes.alias("hashes"))
    # explode_outer: for explode, the optimizer adds a filter that computes all hashes once more. Its nulls join nothing.
    probes = probes.select("text_key", "_file", "_row", "n", F.explode_outer("hashes").alias("hash"))
    met = probes.join(sketch, (probes["hash"] == sketch["hash"]) & (probes["n"] >= sketch["need"]))
    # One row stands for all copies of a text.
    found = written(met.groupBy("text_key", "item_id").agg(F.min("_file").alias("_file"), F.min_by("_row", F.struct("_file", "_row")).alias("_row")), "leak-candidates")
    chosen = written(found.groupBy("text_key").agg(F.min(F.struct("_file", "_row")).alias("at")).select("text_key", "at._file", "at._row"), "leak-texts")
    whole = texts.select("_file", "_row", "text").join(chosen, ["_file", "_row"]).select("text_key", words(F.col("text")).alias("w"))
    whole = whole.select("text_key", shingles(F.col("w"), k).alias("own"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("body"))
    asked = by_key.select("item_id", _by_width(F.col("w"), k, widths, shingles).alias("sought"), (F.size("w") < k).alias("short"))
    both = found.select("text_key", "item_id").join(asked, "item_id").join(whole, "text_key")
    stands = F.contains(F.col("body"), F.concat(F.lit(" "), F.get("sought", F.lit(0)), F.lit(" "))).cast("long")
    shared = F.when(F.col("short"), stands).otherwise(F.size(F.array_intersect("sought", "own")).cast("long"))
    counted = both.select("text_key", F.col("item_id").alias("item_key"), F.size("sought").cast("long").alias("n_item_shingles"), shared.alias("n_shared"))
    held = counted.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item_shingles") - F.lit(1e-9))
    named = held.join(items.select("item_key", "item_id"), "item_key")
    return named.select("text_key", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment: a row for each document and item that it holds."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.encode(F.col(text_col).cast("string"), "UTF-8")).alias("text_key"))
    # Written first: a join of two plain shuffles is one whose hot keys (many copies of a leaking text) Spark can split.
    found = written(leaks(docs, benchmark, threshold, k, id_col, text_col), "leaks")
    return rows.join(found, "text_key").drop("text_key")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item, columns as they were. Null texts stay."""
    bad = written(leaks(docs, benchmark, threshold, k, id_col, text_col).select(F.col("text_key").alias("_leak_key")).distinct(), "leaks")
    # The row goes as one value, so that no column of it can clash with the key.
    rows = docs.select(F.struct("*").alias("_whole_row"))
    key = F.md5(F.encode(F.col(f"_whole_row.`{text_col}`").cast("string"), "UTF-8"))
    return rows.join(bad, key == F.col("_leak_key"), "left_anti").select(*[F.col(f"_whole_row.`{c}`").alias(c) for c in docs.columns])


SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0
), bs AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, k)
), q AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared::DOUBLE / n_item_shingles AS containment
FROM m JOIN q USING (item_id) WHERE n_shared >= 0.8 * n_item_shingles - 1e-9
"""
