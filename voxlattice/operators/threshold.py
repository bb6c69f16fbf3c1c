"""Height thresholds and cluster extent of statistic maps (map_id, i, j, k, stat).

Statistics are read on the normal scale. The ranking of a map that fdr needs looks only at voxels whose tail is below alpha;
clusters go by bricks of the grid, so no task holds a map.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import is_finite
from ..functions.normal import critical_value, upper_tail
from ..sources.shared import stored
from . import bricks

HEIGHT_CONTROLS = ("fpr", "fdr", "bonferroni", None)
_JUST_BELOW = 1e-12


def height_thresholds(stats: DataFrame, alpha: float = 0.05, height_control: str | None = "fdr", two_sided: bool = True, threshold: float | None = None, key: str = "map_id") -> DataFrame:
    """key, n_voxels, height: the statistic above which a voxel is kept; infinite if none is.

    fpr: the quantile of alpha; bonferroni: of alpha / n; fdr: Benjamini-Hochberg, the least kept statistic less
    1e-12; None: the given threshold. Two-sided tests use alpha / 2 on absolute values. Missing values do not count.
    """
    if height_control not in HEIGHT_CONTROLS:
        raise ValueError(f"height_control must be one of {HEIGHT_CONTROLS}; got {height_control!r}")
    level = alpha / 2 if two_sided else alpha
    z = F.abs("stat") if two_sided else F.col("stat")
    valid = stats.where(is_finite(F.col("stat"))).select(key, z.cast("double").alias("_z"))
    if height_control is None:
        if threshold is None:
            raise ValueError("height_control None needs a threshold")
        return valid.groupBy(key).agg(F.count(F.lit(1)).alias("n_voxels")).withColumn("height", F.lit(float(threshold)))
    if height_control == "fpr":
        return valid.groupBy(key).agg(F.count(F.lit(1)).alias("n_voxels")).withColumn("height", F.lit(critical_value(level)))
    if height_control == "bonferroni":
        from ..functions.normal import upper_quantile

        return valid.groupBy(key).agg(F.count(F.lit(1)).alias("n_voxels")).withColumn("height", upper_quantile(F.lit(level) / F.col("n_voxels")))
    # Only voxels whose tail is below alpha can pass at any rank, so only they are ranked.
    counts = valid.groupBy(key).agg(F.count(F.lit(1)).alias("n_voxels"))
    ranked = valid.where(upper_tail(F.col("_z")) < level).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_z"))))
    kept = ranked.join(counts, key).where(upper_tail(F.col("_z")) < F.lit(level) * F.col("_rank") / F.col("n_voxels"))
    least = kept.groupBy(key).agg((F.min("_z") - _JUST_BELOW).alias("height"))
    return counts.join(least, key, "left").select(key, "n_voxels", F.coalesce("height", F.lit(float("inf"))).alias("height"))


def thresholded(stats: DataFrame, alpha: float = 0.05, height_control: str | None = "fdr", cluster_threshold: int = 0, two_sided: bool = True, threshold: float | None = None, sign: int = 1, key: str = "map_id") -> DataFrame:
    """All voxels with their statistic where it passes, else 0. sign -1 turns the map first (the < direction).

    Missing values and maps where nothing passes give 0. With cluster_threshold k, face-connected clusters of fewer than
    k voxels of one sign are dropped.
    """
    turned = stats.select(key, "i", "j", "k", (F.col("stat").cast("double") * sign).alias("stat"))
    heights = height_thresholds(turned, alpha, height_control, two_sided, threshold, key)
    size: Column = F.abs("stat") if two_sided else F.col("stat")
    marked = turned.join(heights.select(key, "height"), key, "left").withColumn("_pass", F.coalesce(is_finite(F.col("stat")) & (size > F.col("height")), F.lit(False)))
    if cluster_threshold > 1:
        large = clusters(marked.where("_pass").select(key, "i", "j", "k", "stat"), key).where(F.col("size") >= cluster_threshold).select(key, "i", "j", "k", F.lit(True).alias("_large"))
        marked = marked.join(large, [key, "i", "j", "k"], "left").withColumn("_pass", F.col("_pass") & F.coalesce("_large", F.lit(False)))
    return marked.select(key, "i", "j", "k", F.when(F.col("_pass"), F.col("stat")).otherwise(F.lit(0.0)).alias("stat"))


def label_faces(cells: np.ndarray) -> np.ndarray:
    """Component number of each cell of an (n, 3) array of grid cells, connected by faces. Numbers are first cells."""
    n = len(cells)
    if not n:
        return np.zeros(0, np.int64)
    low = cells.min(0) - 1
    shape = cells.max(0) - low + 2
    flat = np.ravel_multi_index(tuple((cells - low).T), tuple(shape))
    order = np.argsort(flat)
    label = np.arange(n)
    steps = []
    for axis_step in (shape[1] * shape[2], shape[2], 1):
        at = np.searchsorted(flat[order], flat + axis_step)
        at = np.minimum(at, n - 1)
        hit = flat[order][at] == flat + axis_step
        steps.append((np.flatnonzero(hit), order[at[hit]]))
    a, b = (np.concatenate(x) for x in zip(*steps))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(before, label):
            return label


def clusters(passed: DataFrame, key: str = "map_id", brick: int = bricks.BRICK) -> DataFrame:
    """key, i, j, k, stat, cluster, size of the voxels given: face-connected clusters of one sign.

    cluster is the smallest cell of it as a string i,j,k. Clusters are labelled in bricks of the grid and joined over the
    seams between them, so no task holds a map; the size of the bricks does not change the result. Cells are distinct in a
    map; statistics of 0 go with the negative ones.
    """
    signed = passed.withColumn("_positive", F.col("stat") > 0)
    rows = signed.select(key, F.col("_positive").cast("int").alias("side"), "i", "j", "k", F.lit(1).alias("level"))
    weights = bricks.size_weights()
    inner, voxels = bricks.merged(stored(bricks.pieces_of_rows(rows, key, weights, brick), "pieces"), key, weights)
    found = bricks.voxel_values(inner, voxels, key)
    name = F.concat_ws(",", *[x.cast("string") for x in bricks.unpacked(F.col("outermost"))])
    sized = found.select(key, "i", "j", "k", name.alias("cluster"), F.col("value").cast("long").alias("size"))
    return passed.select(key, "i", "j", "k", "stat").join(sized, [key, "i", "j", "k"])


def levels(t: np.ndarray, step: float, most: int) -> np.ndarray:
    """How many of the heights step, 2 step, ... up to most each value reaches."""
    n = np.clip(np.floor(t / step), 0, most).astype(np.int64)
    n += (n < most) & (t >= (n + 1) * step - 1e-12)
    n -= (n > 0) & (t < n * step - 1e-12)
    return n


def tfce(t: np.ndarray, cells: np.ndarray, steps: int = 100) -> np.ndarray:
    """Threshold-free cluster enhancement of the positive values: sum over heights h of extent**0.5 * h**2 * dh.

    The plain sum, height by height, over one map in memory; tests hold the enhancement by bricks against it.
    """
    out = np.zeros(len(t))
    top = float(np.nanmax(t)) if len(t) else 0.0
    if not top > 0:
        return out
    dh = top / steps
    for s in range(1, steps + 1):
        up = np.flatnonzero(levels(t, dh, steps) >= s)
        own = label_faces(cells[up])
        out[up] += np.sqrt(np.bincount(own, minlength=len(own))[own]) * (s * dh) ** 2 * dh
    return out
