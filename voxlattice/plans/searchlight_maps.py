"""From features to searchlight metric maps on disk."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decoding import searchlight_decoding
from ..operators.metrics import windowwise_metric
from ..operators.permutation import permuted_labels
from ..operators.windows import reconstruct, searchlight_centres, suffix_maps
from ..sources.nifti import write_volumes


def searchlight_predictions(features: DataFrame, mask: DataFrame, targets: DataFrame, radius: int, stride: int = 1, **options) -> tuple[DataFrame, DataFrame]:
    """(predictions of every window, centres window_id, i, j, k)."""
    centres = searchlight_centres(mask, stride)
    return searchlight_decoding(features, mask, targets, radius, stride, **options), centres


def metric_maps(predictions: DataFrame, centres: DataFrame, mask: DataFrame, targets: DataFrame, metric: str | Callable = "roc_auc", name: str = "metric", stride: int = 1, permutations: int = 0, seed: int = 0, y_transform: Callable | None = None) -> DataFrame:
    """suffix, i, j, k, value: the metric, and with permutations its null mean, null std, p and z, for every mask voxel."""
    permuted = None
    if permutations:
        y = targets.withColumn("y", y_transform(F.col("y"))) if y_transform else targets
        permuted = permuted_labels(y, permutations, seed)
    found = windowwise_metric(predictions, targets, metric, permuted, y_transform)
    return reconstruct(mask, suffix_maps(found, centres, name), stride, keys=["suffix"])


def save_metric_maps(maps: DataFrame, out_dir: str, subject: str, shape: tuple[int, int, int], affine: np.ndarray) -> None:
    """A file {subject}_searchlight_{suffix}.nii.gz a map; voxels outside the mask are NaN."""
    named = maps.withColumn("img_id", F.concat(F.lit(f"{subject}_searchlight_"), F.col("suffix")))
    write_volumes(named.select("img_id", "i", "j", "k", "value"), out_dir, shape, affine)
