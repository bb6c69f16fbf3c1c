"""Voxelwise moments over a stream of voxel rows: the batch aggregation under an update-mode query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.volumes import moments


def voxel_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """Rows (img_id, i, j, k, value) of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streaming_moments(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A query that keeps n, mean and std of every voxel up to date in the memory table `name`. State: a row a voxel."""
    return moments(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
