"""Bring a subject's volume to template space with the transform of its preprocessing folder."""

from __future__ import annotations

import os
import posixpath
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid, interpolation, resampled, zoom_tag
from ..sources import paths as files
from ..sources.design import find_transform
from ..sources.nifti import image_id, read_header, read_volumes, write_volumes

FIELD = ["dx", "dy", "dz"]


def grid_of(path: str) -> Grid:
    h = read_header(path)
    return Grid(tuple(h.shape), tuple(map(tuple, h.affine.tolist())))


def read_transform(spark: SparkSession, path: str) -> tuple[np.ndarray, DataFrame | None]:
    """(world affine, displacement rows on the reference grid or None) of a transform table.

    The table (Parquet) has rows kind = 'field' with i, j, k, dx, dy, dz, and at most one kind = 'affine' with its 16
    numbers in the array column affine. HDF5 composites must be exported to this form first.
    """
    if not path.endswith(".parquet"):
        raise NotImplementedError(f"{os.path.basename(path)}: HDF5 transforms cannot be read here; export the transform to a .parquet table beside it")
    t = spark.read.parquet(path)
    row = t.where("kind = 'affine'").select("affine").first()
    field = t.where("kind = 'field'").select("i", "j", "k", *[F.col(c).cast("double") for c in FIELD])
    return (np.eye(4) if row is None else np.array(row[0], float).reshape(4, 4)), (None if field.isEmpty() else field)


def warp_to_template(spark: SparkSession, in_path: str, subject_dir: str, out_path: str, method: str = "linear", voxel_size: tuple[float, float, float] | None = None, template: str | None = None) -> str:
    """Write the warped volume and return its path.

    The output has the reference's box at voxel_size, by default the input's own voxel size; the reference at that size is
    kept beside the output as ref_MNI_{size}mm.nii.gz and used again if it is there.
    """
    transform, reference = find_transform(subject_dir, template)
    affine, field = read_transform(spark, transform)
    source, full = grid_of(in_path), grid_of(reference)
    size = tuple(voxel_size or source.zooms)
    target = full.with_spacing(size)
    # A path without a scheme is local, and may be relative.
    folder = posixpath.dirname(out_path if "://" in out_path else os.path.abspath(out_path))
    cached = f"ref_MNI_{zoom_tag(size)}mm"
    if not files.exists(f"{folder}/{cached}.nii.gz"):
        small = resampled(read_volumes(spark, reference), full, target, "linear").withColumn("img_id", F.lit(cached))
        write_volumes(small, folder, target.shape, target.matrix)
    if field is not None and target != full:
        parts = [field.select(F.lit(c).alias("part"), "i", "j", "k", F.col(c).alias("value")) for c in FIELD]
        moved = resampled(parts[0].unionByName(parts[1]).unionByName(parts[2]), full, target, "linear", keys=["part"])
        field = moved.groupBy("i", "j", "k").pivot("part", FIELD).agg(F.first("value"))
    out = resampled(read_volumes(spark, in_path), source, target, interpolation(method), field, affine)
    write_volumes(out.withColumn("img_id", F.lit(image_id(out_path))), folder, target.shape, target.matrix)
    return re.sub(r"(\.nii)?(\.gz)?$", "", out_path, count=1) + ".nii.gz"
