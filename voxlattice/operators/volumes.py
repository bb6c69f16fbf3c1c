"""Group statistics over a long voxel table (img_id, i, j, k, value).

All of them are aggregations by voxel, which combine before the shuffle, so what is shuffled grows with voxels and
tasks and not with images.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import NAN, finite_or_null, is_finite, or_nan

VOXEL = ["i", "j", "k"]
#: Rows of a table that is sent to every task: design rows and grids of one volume's axis, never voxels of many.
MOST_BROADCAST = 200_000


def moments(voxels: DataFrame, base_mask: DataFrame | None = None, by: list[str] = VOXEL) -> DataFrame:
    """Voxelwise n, mean and std (ddof 1) over the finite values.

    Voxels without a finite value have mean 0 and std NaN, as have those outside base_mask (a table of voxels); a
    single value has std NaN.
    """
    value = finite_or_null(F.col("value").cast("double"))
    if base_mask is not None:
        voxels = voxels.join(base_mask.select(*by).distinct().withColumn("_in", F.lit(True)), by, "left")
        value = F.when(F.col("_in"), value)
    found = voxels.withColumn("_v", value).groupBy(*by).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"))
    return found.select(*by, "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), or_nan(F.col("std")).alias("std"))


def validity_mask(voxels: DataFrame, min_std: float, min_images: int | None = None, base_mask: DataFrame | None = None) -> DataFrame:
    """Voxels (i, j, k, in_mask) with enough finite values and enough spread between images; all images by default."""
    if min_std < 0:
        raise ValueError("the least standard deviation must be 0 or more")
    if min_images is not None and min_images < 1:
        raise ValueError("the least number of images must be 1 or more")
    need = min_images if min_images is not None else voxels.agg(F.count_distinct("img_id")).first()[0]
    m = moments(voxels, base_mask)
    return m.select(*VOXEL, ((F.col("n") >= need) & is_finite(F.col("std")) & (F.col("std") >= min_std)).alias("in_mask"))


def one_sample_t(voxels: DataFrame, by: list[str] = VOXEL, complete: bool = True) -> DataFrame:
    """Voxelwise one-sample t: n, mean, t. With complete=True a voxel with a missing value has t NaN.

    Zero spread gives an infinite t with the mean's sign, NaN for mean 0.
    """
    v = finite_or_null(F.col("value").cast("double"))
    g = voxels.withColumn("_v", v).groupBy(*by).agg(F.count("_v").alias("n"), F.count(F.lit(1)).alias("_rows"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("_s"))
    t = F.try_divide(F.col("mean"), F.col("_s") / F.sqrt(F.col("n").cast("double")))
    flat = F.when(F.col("mean") == 0, F.lit(NAN)).otherwise(F.signum("mean") * F.lit(float("inf")))
    t = F.when(F.col("_s") == 0, flat).otherwise(or_nan(t))
    if complete:
        t = F.when(F.col("n") < F.col("_rows"), F.lit(NAN)).otherwise(t)
    return g.select(*by, "n", "mean", t.alias("t"))


def design_inverse(design: DataFrame, regressors: list[str]) -> tuple[np.ndarray, int, int]:
    """(pinv(X'X), rank, rows) of a design table: one aggregation, k * k numbers on the driver."""
    k = len(regressors)
    sums = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")) for a in regressors for b in regressors]
    row = design.agg(F.count(F.lit(1)), *sums).first()
    xtx = np.array(row[1:], float).reshape(k, k)
    return np.linalg.pinv(xtx), int(np.linalg.matrix_rank(xtx)), int(row[0])


def ols(voxels: DataFrame, design: DataFrame, regressors: list[str], by: list[str] = VOXEL) -> DataFrame:
    """Voxelwise least squares: for each regressor beta_<name> and t_<name>.

    design has img_id and the regressors (the intercept among them, see with_intercept). One pass over the voxels
    gathers X'y and y'y for all contrasts. Voxels with a missing value have NaN in all columns.
    """
    inverse, rank, n = design_inverse(design, regressors)
    y = finite_or_null(F.col("value").cast("double"))
    side = design.select("img_id", *[F.col(r).cast("double").alias(f"_x_{r}") for r in regressors])
    # A design has a row an image; it is sent around only while that is small.
    side = F.broadcast(side) if n <= MOST_BROADCAST else side
    sums = [F.sum(F.col("_y") * F.col(f"_x_{r}")).alias(f"_xy_{r}") for r in regressors]
    g = voxels.withColumn("_y", y).join(side, "img_id").groupBy(*by).agg(F.count("_y").alias("_n"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"), *sums)
    add: Column = lambda xs: reduce(lambda a, b: a + b, xs)
    for a, r in enumerate(regressors):
        g = g.withColumn(f"_b_{r}", add([F.lit(float(inverse[a, b])) * F.col(f"_xy_{q}") for b, q in enumerate(regressors)]))
    rss = F.greatest(F.lit(0.0), F.col("_yy") - add([F.col(f"_b_{r}") * F.col(f"_xy_{r}") for r in regressors]))
    g = g.withColumn("_s2", rss / float(n - rank) if n > rank else F.lit(None).cast("double"))
    whole = F.col("_n") == n
    out = []
    for a, r in enumerate(regressors):
        t = F.try_divide(F.col(f"_b_{r}"), F.sqrt(F.col("_s2") * float(inverse[a, a])))
        out += [or_nan(F.when(whole, F.col(f"_b_{r}"))).alias(f"beta_{r}"), or_nan(F.when(whole, t)).alias(f"t_{r}")]
    return g.select(*by, *out)


def with_intercept(design: DataFrame, covariates: list[str]) -> DataFrame:
    """The design matrix: img_id, intercept and the covariates as doubles.

    A covariate named intercept is refused. Values that are not numbers raise an error with their count by column; the
    counts are one aggregation.
    """
    if any(c.lower() == "intercept" for c in covariates):
        raise ValueError("a covariate may not be named intercept")
    cast = {c: F.expr(f"try_cast(`{c}` AS double)") for c in covariates}
    if covariates:
        bad = design.agg(*[F.count_if(cast[c].isNull() | F.isnan(cast[c])).alias(c) for c in covariates]).first().asDict()
        bad = {c: n for c, n in bad.items() if n}
        if bad:
            raise ValueError(f"covariates must be numbers in every row; bad values by column: {bad}")
    return design.select("img_id", F.lit(1.0).alias("intercept"), *[cast[c].alias(c) for c in covariates])
