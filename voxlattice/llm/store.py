"""The folder that the driver and all executors share, and files in it.

The folder is the one that the cluster names in spark.checkpoint.dir. Only where that is unset (tests, local mode) a
folder of this process is made and set. Python workers reach it with pyarrow's file systems, so hdfs:// or s3:// folders
work as file:// ones do; a file appears under its name only when it is whole, so a task that is tried again replaces it.
"""

from __future__ import annotations

import atexit
import posixpath
import re
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files when the query ends if this is set.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="voxlattice-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, as a URI."""
    base = shared_dir(spark).rstrip("/")
    if not re.match(r"\w[\w+.-]*:", base):
        base = f"file://{base}"
    return f"{base}/voxlattice/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame cut from its lineage: written once as Parquet in the shared folder and read from there.

    Its shuffle files go when it is written. discard() removes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxlattice_path = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Remove tables that written() made, or folders of the shared folder, which no later step reads."""
    for t in tables:
        filesystem, path = open_fs(t if isinstance(t, str) else t._voxlattice_path)
        filesystem.delete_dir(path)


def located(df: DataFrame, *cols: str) -> DataFrame:
    """cols with _file and _row: where each row physically stands, the same however a scan is split.

    Rows that do not come straight from files that tell this (Parquet) are written to the shared folder first.
    """
    places = lambda x: x.select(*[x[f"`{c}`"] for c in cols], x.metadataColumn("_metadata")["file_path"].alias("_file"), x.metadataColumn("_metadata")["row_index"].alias("_row"))
    if _plain_scan(df):
        try:
            return places(df)
        except AnalysisException:
            pass
    return places(written(df.select(*[df[f"`{c}`"] for c in cols]), "rows"))


def _plain_scan(df: DataFrame) -> bool:
    """Whether each row of df is one row of a file: a relation under nothing but projections."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() == "Project":
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


class WholeFile:
    """A file that gets its name when the block ends without an error."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = open_fs(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def reader(uri: str):
    filesystem, path = open_fs(uri)
    return filesystem.open_input_stream(path, compression=None, buffer_size=1 << 20)
