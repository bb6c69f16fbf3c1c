"""New folders that the driver and all executors can write to, and tables in them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .paths import filesystem


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path under the folder that the cluster names in spark.checkpoint.dir; in local mode without one, a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return f"{re.sub(r'^file:/+', '/', base).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix=f"voxlattice-{name}-")
    atexit.register(shutil.rmtree, own, True)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read from there, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    path = path if re.match(r"\w[\w+.-]*:", path) else f"file://{path}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._voxlattice_stored = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete tables that stored() made and that nothing reads any more."""
    for t in tables:
        where, inner = filesystem(t._voxlattice_stored)
        where.delete_dir(inner)
