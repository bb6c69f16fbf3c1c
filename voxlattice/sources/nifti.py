"""NIfTI-1 volumes as a Spark data source: spark.read.format("nifti") and df.write.format("nifti").

Reading gives a long voxel table, one partition a file. `listing` finds the files of a folder; `headers` reads their
geometry only. The writer gives each map to one file, which appears under its name when it is whole.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import paths

SCHEMA = "img_id string, i int, j int, k int, value double"
HEADER_SCHEMA = "img_id string, path string, shape array<int>, zooms array<double>, affine array<array<double>>, dtype string"
HEADER_BYTES = 352

# Fixed values of the format: datatype codes.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


@dataclass(frozen=True)
class Header:
    shape: tuple[int, ...]
    zooms: tuple[float, ...]
    affine: np.ndarray
    dtype: str
    order: str
    offset: int
    slope: float
    inter: float


def parse_header(raw: bytes) -> Header:
    for order in "<>":
        if struct.unpack(order + "i", raw[:4])[0] == 348:
            break
    else:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", raw[40:56])
    code = struct.unpack(order + "h", raw[70:72])[0]
    if code not in DTYPES:
        raise ValueError(f"datatype {code} is not supported")
    pixdim = struct.unpack(order + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    qform, sform = struct.unpack(order + "2h", raw[252:256])
    shape = tuple(int(x) for x in dim[1 : 1 + dim[0]])
    shape = shape[:3] + (1,) * (3 - len(shape)) if len(shape) <= 3 or all(x == 1 for x in shape[3:]) else shape
    if len(shape) != 3:
        raise ValueError(f"only 3-D volumes are supported; shape is {shape}")
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4)
    elif qform > 0:
        affine = _quaternion_affine(struct.unpack(order + "6f", raw[256:280]), pixdim)
    else:
        affine[:3, :3] = np.diag(pixdim[1:4])
    slope = slope if np.isfinite(slope) and slope != 0 else 1.0
    return Header(shape, tuple(float(abs(x)) for x in pixdim[1:4]), affine, DTYPES[code], order, int(offset), float(slope), float(inter) if np.isfinite(inter) else 0.0)


def _quaternion_affine(q: tuple[float, ...], pixdim: tuple[float, ...]) -> np.ndarray:
    b, c, d, x, y, z = q
    a = np.sqrt(max(0.0, 1.0 - (b * b + c * c + d * d)))
    rotation = np.array(
        [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
    )
    scale = np.array([pixdim[1], pixdim[2], pixdim[3] * (-1.0 if pixdim[0] < 0 else 1.0)])
    out = np.eye(4)
    out[:3, :3] = rotation * scale
    out[:3, 3] = x, y, z
    return out


def read_volume(path: str) -> tuple[Header, np.ndarray]:
    raw = paths.read_bytes(path)
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    h = parse_header(raw)
    n = int(np.prod(h.shape))
    data = np.frombuffer(raw, h.order + h.dtype, n, h.offset).reshape(h.shape, order="F").astype(np.float64)
    return h, data if (h.slope, h.inter) == (1.0, 0.0) else data * h.slope + h.inter


def read_header(path: str) -> Header:
    raw = paths.read_bytes(path, HEADER_BYTES * 4)
    if raw[:2] == b"\x1f\x8b":
        import zlib

        raw = zlib.decompressobj(31).decompress(raw, HEADER_BYTES)
    return parse_header(raw[:HEADER_BYTES])


def volume_bytes(data: np.ndarray, affine: np.ndarray, dtype: str = "f4") -> bytes:
    """An uncompressed NIfTI-1 file."""
    codes = {v: k for k, v in DTYPES.items()}
    zooms = np.sqrt((affine[:3, :3] ** 2).sum(0))
    raw = bytearray(HEADER_BYTES)
    struct.pack_into("<i", raw, 0, 348)
    struct.pack_into("<8h", raw, 40, 3, *data.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", raw, 70, codes[dtype], np.dtype(dtype).itemsize * 8)
    struct.pack_into("<8f", raw, 76, 1.0, *zooms, 0, 0, 0, 0)
    struct.pack_into("<3f", raw, 108, float(HEADER_BYTES), 1.0, 0.0)
    struct.pack_into("<2h", raw, 252, 0, 2)
    struct.pack_into("<12f", raw, 280, *affine[:3].ravel())
    raw[344:348] = b"n+1\0"
    return bytes(raw) + np.asarray(data, "<" + dtype).tobytes(order="F")


def is_nifti(name: str) -> bool:
    return name.lower().endswith((".nii", ".nii.gz"))


def image_id(path: str) -> str:
    return re.sub(r"\.nii(\.gz)?$", "", posixpath.basename(path), flags=re.I)


def list_files(path: str) -> list[str]:
    """The NIfTI files of a folder, sorted by name, subfolders left out; or the file itself."""
    where, inner = paths.filesystem(path)
    if where.get_file_info(inner).type == fs.FileType.File:
        return [path if "://" in path and not path.startswith("file:") else inner]
    base = path.rstrip("/") if "://" in path and not path.startswith("file:") else inner.rstrip("/")
    found = where.get_file_info(fs.FileSelector(inner))
    return sorted(f"{base}/{x.base_name}" for x in found if x.type == fs.FileType.File and is_nifti(x.base_name))


@dataclass
class FilePartition(InputPartition):
    path: str
    img_id: str

    def __post_init__(self):
        self.value = self.path


class NiftiReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        # paths is a list in JSON, so that names may hold any character; path is one path.
        asked = json.loads(options["paths"]) if options.get("paths") else [p for p in [options.get("path")] if p]
        if not asked:
            raise ValueError("give a path, or a JSON list of paths")
        self.files = [f for p in asked for f in list_files(p)]
        ids = [image_id(f) for f in self.files]
        full = len(set(ids)) < len(ids)
        self.ids = self.files if full else ids
        self.finite = str(options.get("finite", "false")).lower() == "true"

    def partitions(self):
        return [FilePartition(f, i) for f, i in zip(self.files, self.ids)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        _, data = read_volume(partition.path)
        # A plane at a time keeps batches small.
        for i in range(data.shape[0]):
            plane = data[i]
            j, k = np.indices(plane.shape)
            keep = np.isfinite(plane).ravel() if self.finite else slice(None)
            v = plane.ravel()[keep]
            arrays = [pa.array([partition.img_id] * len(v)), pa.array(np.full(len(v), i, np.int32)), pa.array(j.ravel()[keep].astype(np.int32)), pa.array(k.ravel()[keep].astype(np.int32)), pa.array(v, from_pandas=False)]
            yield pa.RecordBatch.from_arrays(arrays, ["img_id", "i", "j", "k", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list


class NiftiWriter(DataSourceWriter):
    """Writes rows (img_id, i, j, k, value); all rows of an image must be in one partition (see write_volumes)."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = options["path"].rstrip("/")
        self.shape = tuple(int(x) for x in options["shape"].split(","))
        self.affine = np.array([float(x) for x in options.get("affine", "1,0,0,0,0,1,0,0,0,0,1,0,0,0,0,1").split(",")]).reshape(4, 4)
        self.fill = float(options.get("fill", "nan"))
        self.dtype = options.get("dtype", "f4")
        self.overwrite = overwrite

    def write(self, rows) -> Written:
        done, name, data = [], None, None

        def close():
            target = f"{self.path}/{name}.nii.gz"
            paths.write_bytes(target, gzip.compress(volume_bytes(data, self.affine, self.dtype), mtime=0))
            done.append(target)

        for r in rows:
            if r["img_id"] != name:
                if name is not None:
                    close()
                name, data = r["img_id"], np.full(self.shape, self.fill)
            data[r["i"], r["j"], r["k"]] = np.nan if r["value"] is None else r["value"]
        if name is not None:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        for m in messages:
            for f in getattr(m, "files", None) or []:
                paths.remove(f)


class NiftiDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NiftiReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NiftiWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NiftiDataSource)


def read_volumes(spark: SparkSession, files: str | list[str]) -> DataFrame:
    register(spark)
    return spark.read.format("nifti").option("paths", json.dumps([files] if isinstance(files, str) else list(files))).load()


def headers(spark: SparkSession, files: list[str]) -> DataFrame:
    """HEADER_SCHEMA: the geometry of each file, read where the task runs; only the first bytes are touched."""

    def run(batches):
        for b in batches:
            for p in b["path"]:
                h = read_header(p)
                yield pa.RecordBatch.from_pylist([{"img_id": image_id(p), "path": p, "shape": list(h.shape), "zooms": list(h.zooms), "affine": h.affine.tolist(), "dtype": h.dtype}], pa.schema([("img_id", pa.string()), ("path", pa.string()), ("shape", pa.list_(pa.int32())), ("zooms", pa.list_(pa.float64())), ("affine", pa.list_(pa.list_(pa.float64()))), ("dtype", pa.string())]))

    wrapped = lambda it: run({"path": b.column(0).to_pylist()} for b in it)
    return spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, min(len(files), 256))).mapInArrow(wrapped, HEADER_SCHEMA)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path of each NIfTI file in a folder, in order, by Spark's own file listing; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path")
    return files.where(F.lower("path").rlike(r"\.nii(\.gz)?$")).orderBy("path")


def write_volumes(rows: DataFrame, path: str, shape: tuple[int, int, int], affine: np.ndarray, fill: float = float("nan"), dtype: str = "f4", mode: str = "append") -> None:
    """One file img_id.nii.gz an image. mode "ignore" leaves images that exist alone; "overwrite" and "append" replace."""
    register(rows.sparkSession)
    if mode == "ignore":
        there = [image_id(f) for f in list_files(path)] if paths.is_folder(path) else []
        rows = rows.where(~F.col("img_id").isin(there)) if there else rows
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("img_id", "i", "j", "k", F.col("value").cast("double")).repartition(n, "img_id").sortWithinPartitions("img_id")
    dealt.write.format("nifti").mode("append").option("path", path).option("shape", ",".join(map(str, shape))).option("affine", ",".join(repr(float(x)) for x in np.asarray(affine).ravel())).option("fill", repr(float(fill))).option("dtype", dtype).save()
