"""Design tables: which images enter a model, and their covariates."""

from __future__ import annotations

import csv
import fnmatch
import posixpath
from collections.abc import Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import paths as files
from .nifti import image_id, list_files

DELIMITERS = ",;\t|"
#: Design rows that are sent to every task at most.
MOST_BROADCAST = 200_000


def normalised(name: object) -> str:
    return str(name).strip().lstrip("﻿").strip()


def sniff_delimiter(path: str) -> str:
    head = "".join(files.read_bytes(path, 1 << 16).decode("utf-8-sig", "replace").splitlines(True)[:20])
    try:
        return csv.Sniffer().sniff(head, DELIMITERS).delimiter
    except csv.Error:
        return "\t" if path.lower().endswith(".tsv") else ","


def with_path_column(df: DataFrame) -> DataFrame:
    """Column names without white space and byte order mark, the path column under the name path.

    path is looked up without regard to case, then map_path; if both stand there, path is taken and map_path stays a
    covariate.
    """
    names = [normalised(c) for c in df.columns]
    df = df.toDF(*names)
    if "path" not in names:
        lower = {c.lower(): c for c in names}
        found = lower.get("path", lower.get("map_path"))
        if found is None:
            other = [d for d in DELIMITERS if any(normalised(x).lower() in ("path", "map_path") for x in names[0].split(d))] if len(names) == 1 else []
            if other:
                raise ValueError(f"the table was read as one column, {names[0]!r}; its columns seem to be parted by {other[0]!r}")
            raise ValueError(f"a design needs a path (or map_path) column; columns are {names}")
        df = df.withColumnRenamed(found, "path")
    return df.withColumn("path", F.col("path").cast("string"))


def read_design(spark: SparkSession, maps: str | Path | pd.DataFrame | DataFrame | Sequence) -> tuple[str | None, DataFrame]:
    """(folder or None, row_id, path, covariates...) from a folder, a CSV or TSV file, a table, or a sequence of paths."""
    folder = None
    if isinstance(maps, DataFrame):
        df = maps
    elif isinstance(maps, pd.DataFrame):
        df = spark.createDataFrame(maps.rename(columns=normalised))
    elif isinstance(maps, (str, Path)) and files.is_folder(str(maps)):
        folder = str(maps)
        df = spark.createDataFrame([(p,) for p in list_files(folder)], "path string")
    elif isinstance(maps, (str, Path)) and str(maps).lower().endswith((".csv", ".tsv")):
        if not files.exists(str(maps)):
            raise FileNotFoundError(f"no design table at {maps}")
        sep = sniff_delimiter(str(maps))
        df = spark.read.csv(str(maps), header=True, sep=sep, inferSchema=True)
    elif isinstance(maps, (str, Path)):
        df = spark.createDataFrame([(str(maps),)], "path string")
    else:
        paths = list(maps)
        if any(isinstance(p, (list, tuple)) or getattr(p, "ndim", 0) for p in paths):
            raise ValueError("a sequence of paths must have one dimension")
        df = spark.createDataFrame([(str(p),) for p in paths], "path string")
    return folder, with_path_column(df)


def checked_paths(design: DataFrame) -> list[str]:
    """Paths in order; fewer than two, or missing ones (the first five are named), raise an error. A row an image."""
    paths = [r["path"] for r in design.select("path").collect()]
    if not paths:
        raise ValueError("no volumes are given")
    if len(paths) < 2:
        raise ValueError(f"a group model needs two volumes at least; got {len(paths)}")
    missing = [p for p in paths if not files.exists(p)]
    if missing:
        raise FileNotFoundError(f"some volumes do not exist (up to 5 shown): {missing[:5]}")
    return paths


def find_transform(folder: str, template: str | None = None) -> tuple[str, str]:
    """(transform, reference) of a subject's preprocessing folder.

    The transform is the subject's T1w to MNI152NLin2009cAsym file under anat (as a table: .parquet, or .h5); of the
    references in that space, the first with res-2 in its name is preferred, else the first by name, else `template`.
    """
    anat = f"{folder.rstrip('/')}/anat"
    subject = posixpath.splitext(posixpath.basename(folder.rstrip("/")))[0]
    stem = f"{subject}_from-T1w_to-MNI152NLin2009cAsym_mode-image_xfm"
    found = [p for end in (".parquet", ".h5") if files.exists(p := f"{anat}/{stem}{end}")]
    if not found:
        raise FileNotFoundError(f"no transform {stem} in {anat}")
    refs = [p for p in files.names(anat) if fnmatch.fnmatchcase(p, "*space-MNI152NLin2009cAsym*_T1w.nii*")]
    refs = [p for p in refs if "res-2" in p] or refs
    if refs:
        return found[0], f"{anat}/{refs[0]}"
    if template is None:
        raise FileNotFoundError(f"no reference volume in {anat}, and no template is configured")
    return found[0], template


def with_image_ids(design: DataFrame) -> DataFrame:
    """The design with img_id as the volume reader names images."""
    paths = [r["path"] for r in design.select("path").collect()]
    ids = [image_id(p) for p in paths]
    ids = paths if len(set(ids)) < len(ids) else ids
    names = design.sparkSession.createDataFrame(list(dict(zip(paths, ids)).items()), "path string, img_id string")
    # A row an image; sent around only while that is small.
    return design.join(F.broadcast(names) if len(paths) <= MOST_BROADCAST else names, "path")
