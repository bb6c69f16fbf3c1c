"""The corpus pipeline: five stages from raw documents to token shards.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a DataFrame; all
but the last return the columns of documents as they came. run() writes each stage's result as Parquet in the shared
folder and reads it again as the next one's docs, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxlattice.llm import decontamination, mixing, quality_rules, simhash, store, token_output


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep.

    Null and empty texts go (too few words), very long ones are judged whole; equal texts are judged alike, so repeated
    rows stay or go together, whatever their ids, null ones included. Without labels only the base rules decide. An empty
    table stays one; extra columns pass through.
    """
    forest = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep_rows(docs, forest)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id, a null one first.

    Of rows that agree in id and text one stays; ids that tie are told apart by their texts' hashes. Null and empty texts
    have fingerprint zero and count like any other. An empty table stays one; extra columns pass through.
    """
    return simhash.one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; copies of a text go together, whatever their ids; items without words hold
    in no document. Without items, or documents, all stays as it is; extra columns pass through.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of source, language and topic.

    Null sources and languages keep the share that they have; texts without words have no tokens and go with their cell;
    rows that agree in id and text stay or go together, those without ids by their texts. An empty table stays one; extra
    columns pass through.
    """
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID shards in training order, read back: a row a sequence.

    Every row is written, repeated ones as often as they come; null and empty texts are an end mark alone; a null id is
    marked as such; very long texts are many sequences. An empty table gives no rows; extra columns are not read.
    """
    return token_output.materialise(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("token_output", tokens),
]

#: SQL can express neither the boosted trees nor the shards; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
