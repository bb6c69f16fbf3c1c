"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, license_scan, mixing, quality_rules, sharding, simhash, periodic_runs, spelling, substring_dedup, token_counts, token_output, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share."""
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-ID shards in training order, read back: a row a sequence."""
    return token_output.materialise(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths of all documents."""
    return token_counts.histogram(token_counts.token_counts(table(spark, sf_dir, "documents")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and the boosted trees' verdict for all documents."""
    docs = table(spark, sf_dir, "documents")
    forest = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, forest)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents interleaved into 16 shards."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and fuzzy licence notices in all documents."""
    return license_scan.digest(license_scan.find_notices(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their calibrated probabilities and whether they are sampled."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by models learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.apply(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("x")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents; one code point of some occurrences is deleted first."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), 199), least_length=6, least_count=5, factor=5)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, of which a tenth is made periodic from some word on."""
    docs = periodic_runs.made_periodic(table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.find_runs(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_token_output": op3_token_output,
        "op4_simhash": op4_simhash,
        "op5_token_counts": op5_token_counts,
        "op6_quality_rules": op6_quality_rules,
        "op7_sharding": op7_sharding,
        "op8_license_scan": op8_license_scan,
        "op9_mixing": op9_mixing,
        "op10_decontamination": op10_decontamination,
        "op11_toxicity": op11_toxicity,
        "op12_spelling": op12_spelling,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op7_sharding": sharding.sql(),
        "op9_mixing": mixing.sql(),
        "op10_decontamination": decontamination.SQL,
        "op12_spelling": spelling.sql(),
    }
