"""Resampling, warping and smoothing on voxel grids.

A volume is rows (img_id, i, j, k, value), a grid a shape and an affine (4 x 4, voxel to world). Every output voxel
computes where it comes from and meets its source voxels by equality: one for nearest neighbours, eight with weights for
linear interpolation, 64 coefficients with weights for cubic B-splines.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elementwise import finite_or_null

#: Names of interpolations; unknown ones mean linear.
INTERPOLATIONS = {"linear": "linear", "lin": "linear", "nearest": "nearest", "nn": "nearest", "nearestneighbor": "nearest", "bspline": "bspline", "spline": "bspline"}
FWHM_PER_SIGMA = math.sqrt(8 * math.log(2))


@dataclass(frozen=True)
class Grid:
    shape: tuple[int, int, int]
    affine: tuple[tuple[float, ...], ...] = field(default=((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0)))

    @property
    def matrix(self) -> np.ndarray:
        return np.array(self.affine, float)

    @property
    def zooms(self) -> tuple[float, float, float]:
        return tuple(np.sqrt((self.matrix[:3, :3] ** 2).sum(0)).tolist())

    def cells(self, spark: SparkSession) -> DataFrame:
        """All voxels, generated where they are needed."""
        i, j, k = self.shape
        n = spark.range(i * j * k)
        return n.select(F.expr(f"cast(id div {j * k} as int)").alias("i"), F.expr(f"cast(id div {k} % {j} as int)").alias("j"), F.expr(f"cast(id % {k} as int)").alias("k"))

    def with_spacing(self, zooms: tuple[float, float, float]) -> Grid:
        """The same box of space at another voxel size."""
        factor = np.array(self.zooms) / np.array(zooms, float)
        shape = tuple(int(x) for x in np.maximum(1, np.ceil(np.array(self.shape) * factor - 1e-6)))
        m = self.matrix.copy()
        m[:3, :3] = m[:3, :3] / factor
        return Grid(shape, tuple(map(tuple, m.tolist())))


def interpolation(name: str) -> str:
    return INTERPOLATIONS.get(str(name).lower().strip(), "linear")


def zoom_tag(zooms: tuple[float, ...]) -> str:
    """Voxel sizes in a file name: 2.5, 2, 2 -> 2p5_2_2."""
    return "_".join(("%g" % z).replace(".", "p") for z in zooms)


def _apply(m: np.ndarray, at: list[Column]) -> list[Column]:
    return [sum((F.lit(float(m[r, c])) * at[c] for c in range(3)), F.lit(float(m[r, 3]))) for r in range(3)]


def resampled(volume: DataFrame, source: Grid, target: Grid, method: str = "linear", displacement: DataFrame | None = None, world: np.ndarray | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys..., i, j, k, value on the target grid.

    A target voxel goes to world space, is moved by displacement (i, j, k, dx, dy, dz on the target grid) and then by
    the world affine, and from there to source indices. Places outside the source, and missing source values, are 0;
    with linear interpolation each of the eight corners counts so by itself. B-splines are cubic and go through the values;
    beyond the first and last voxel the volume is mirrored, and only places between them have a value.
    """
    method = interpolation(method)
    keys = keys or ["img_id"]
    spark = volume.sparkSession
    cells = target.cells(spark)
    at = _apply(target.matrix, [F.col(c).cast("double") for c in "ijk"])
    moved = cells.select("i", "j", "k", *[x.alias(f"_w{n}") for n, x in enumerate(at)])
    if displacement is not None:
        moved = moved.join(displacement, ["i", "j", "k"], "left").select("i", "j", "k", *[(F.col(f"_w{n}") + F.coalesce(F.col(d), F.lit(0.0))).alias(f"_w{n}") for n, d in enumerate(("dx", "dy", "dz"))])
    back = np.linalg.inv(source.matrix) @ (np.eye(4) if world is None else np.asarray(world, float))
    place = moved.select("i", "j", "k", *[x.alias(f"_x{n}") for n, x in enumerate(_apply(back, [F.col(f"_w{n}") for n in range(3)]))])
    values = volume.select(*keys, *[F.col(c).alias(f"_{c}") for c in "ijk"], finite_or_null(F.col("value").cast("double")).alias("_v"))
    # A name a volume; each volume is sampled by itself.
    names = volume.select(*keys).distinct()
    if method == "nearest":
        near = place.select("i", "j", "k", *[F.floor(F.col(f"_x{n}") + F.lit(0.5)).cast("int").alias(f"_{c}") for n, c in enumerate("ijk")])
        wanted = names.join(near)
        return wanted.join(values, [*keys, "_i", "_j", "_k"], "left").select(*keys, "i", "j", "k", F.coalesce("_v", F.lit(0.0)).alias("value"))
    low = [F.floor(F.round(F.col(f"_x{n}"), 9)) for n in range(3)]
    part = [F.greatest(F.lit(0.0), F.round(F.col(f"_x{n}"), 9) - low[n]) for n in range(3)]
    if method == "bspline":
        inside = F.lit(True)
        for n in range(3):
            inside &= F.round(F.col(f"_x{n}"), 9).between(0, source.shape[n] - 1)
        spread = place.where(inside)
        for n in range(3):
            spread = spread.withColumn(f"_a{n}", F.explode(_spline_weights(low[n], part[n], source.shape[n]))).where(f"_a{n}.w > 0")
        spread = spread.select("i", "j", "k", (F.col("_a0.w") * F.col("_a1.w") * F.col("_a2.w")).alias("w"), *[F.col(f"_a{n}.at").alias(f"_{c}") for n, c in enumerate("ijk")])
        values = spline_coefficients(values, source.shape, keys)
        fed = spread.join(values, ["_i", "_j", "_k"]).groupBy(*keys, "i", "j", "k").agg(F.sum(F.col("w") * F.col("_v")).alias("_s"))
        return names.join(cells).join(fed, [*keys, "i", "j", "k"], "left").select(*keys, "i", "j", "k", F.coalesce("_s", F.lit(0.0)).alias("value"))
    corners = []
    for c in range(8):
        bits = [(c >> n) & 1 for n in range(3)]
        w = F.lit(1.0)
        for n in range(3):
            w = w * (part[n] if bits[n] else F.lit(1.0) - part[n])
        corners.append(F.struct(w.alias("w"), *[(low[n] + bits[n]).cast("int").alias(f"_{x}") for n, x in enumerate("ijk")]))
    spread = place.select("i", "j", "k", F.explode(F.array(*corners)).alias("c")).where("c.w > 0").select("i", "j", "k", "c.w", "c._i", "c._j", "c._k")
    # Source voxels look up the target voxels that they feed; only then are the weighted values summed by voxel.
    fed = spread.join(values, ["_i", "_j", "_k"]).groupBy(*keys, "i", "j", "k").agg(F.sum(F.col("w") * F.coalesce("_v", F.lit(0.0))).alias("_s"))
    return names.join(cells).join(fed, [*keys, "i", "j", "k"], "left").select(*keys, "i", "j", "k", F.coalesce("_s", F.lit(0.0)).alias("value"))


#: The pole of the cubic B-spline's inverse filter.
POLE = math.sqrt(3) - 2


def _spline_weights(low: Column, part: Column, n: int) -> Column:
    """Weights and (mirrored) places of the four coefficients around a place on an axis of n voxels."""
    t = part
    w = [(1 - t) * (1 - t) * (1 - t) / 6, (4 - 6 * t * t + 3 * t * t * t) / 6, (1 + 3 * t + 3 * t * t - 3 * t * t * t) / 6, t * t * t / 6]
    at = [F.abs(low + d) for d in (-1, 0, 1, 2)]
    at = [F.when(x > n - 1, F.lit(2 * (n - 1)) - x).otherwise(x) if n > 1 else F.lit(0) for x in at]
    return F.array(*[F.struct(a.alias("w"), b.cast("int").alias("at")) for a, b in zip(w, at)])


def _spline_lines(lines: np.ndarray) -> np.ndarray:
    """Coefficients of cubic B-splines through the values of each row, mirrored at both ends: a forward and a backward recursion."""
    n = lines.shape[1]
    if n == 1:
        return lines
    k = np.arange(n)
    first = np.where((k == 0) | (k == n - 1), POLE**k, POLE**k + POLE ** (2 * n - 2 - k)) / (1 - POLE ** (2 * n - 2))
    c = lines.copy()
    c[:, 0] = lines @ first
    for i in range(1, n):
        c[:, i] += POLE * c[:, i - 1]
    c[:, -1] = POLE / (POLE**2 - 1) * (c[:, -1] + POLE * c[:, -2])
    for i in range(n - 2, -1, -1):
        c[:, i] = POLE * (c[:, i + 1] - c[:, i])
    return 6 * c


def spline_coefficients(values: DataFrame, shape: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """keys..., _i, _j, _k, _v: values (the same columns; missing voxels and values are 0) as coefficients, an axis after another.

    A task has whole lines of voxels, many at a time; no task has a volume.
    """
    rows = values.select(*keys, "_i", "_j", "_k", F.coalesce("_v", F.lit(0.0)).alias("_v"))
    for axis, n in zip(("_i", "_j", "_k"), shape):
        whole = [*keys, *[c for c in ("_i", "_j", "_k") if c != axis]]
        lines = rows.groupBy(*whole).agg(F.collect_list(axis).alias("_at"), F.collect_list("_v").alias("_c"))
        schema = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in whole) + ", _c array<double>"

        def run(batches, n=n, whole=whole):
            for pdf in batches:
                dense = np.zeros((len(pdf), n))
                for r, (at, v) in enumerate(zip(pdf["_at"], pdf["_c"])):
                    dense[r, at] = v
                yield pdf[whole].assign(_c=list(_spline_lines(dense)))

        out = lines.mapInPandas(run, schema).select(*whole, F.posexplode("_c").alias(axis, "_v"))
        rows = out.select(*keys, "_i", "_j", "_k", "_v")
    return rows


def warped(volume: DataFrame, source: Grid, reference: Grid, affine: np.ndarray | None = None, displacement: DataFrame | None = None, method: str = "linear", voxel_size: tuple[float, float, float] | None = None, keys: list[str] | None = None) -> tuple[DataFrame, Grid]:
    """A volume brought to the reference's space by a displacement field and an affine; voxels as large as the source's.

    displacement is on the grid that results. Returns the rows and that grid.
    """
    target = reference.with_spacing(voxel_size or source.zooms)
    return resampled(volume, source, target, method, displacement, affine, keys), target


def smoothed(volume: DataFrame, grid: Grid, fwhm: float | None, truncate: float = 4.0, keys: list[str] | None = None) -> DataFrame:
    """Gaussian smoothing, an axis after another; outside the grid and missing values count as 0.

    The kernel of an axis is a literal array of a few weights; each voxel feeds its neighbours by equality.
    """
    keys = keys or ["img_id"]
    out = volume.select(*keys, "i", "j", "k", F.coalesce(finite_or_null(F.col("value").cast("double")), F.lit(0.0)).alias("value"))
    if not fwhm:
        return out
    for n, c in enumerate("ijk"):
        sigma = fwhm / FWHM_PER_SIGMA / grid.zooms[n]
        r = int(truncate * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        w /= w.sum()
        kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(x)).alias("w")) for d, x in zip(range(-r, r + 1), w)])
        others = [x for x in "ijk" if x != c]
        fed = out.select(*keys, *others, F.col(c).alias("_at"), "value", F.explode(kernel).alias("_k"))
        fed = fed.select(*keys, *others, (F.col("_at") + F.col("_k.d")).alias(c), (F.col("value") * F.col("_k.w")).alias("value")).where(F.col(c).between(0, grid.shape[n] - 1))
        out = fed.groupBy(*keys, "i", "j", "k").agg(F.sum("value").alias("value"))
    return out.select(*keys, "i", "j", "k", "value")


def mosaic_slices(volume: DataFrame, axis: str, every: int = 1, keys: list[str] | None = None) -> DataFrame:
    """keys..., axis, at, row, cells: slices of a map as arrays of a row's values, for a plotter to draw."""
    keys = keys or ["img_id"]
    a, b = [c for c in "ijk" if c != axis]
    g = volume.where(F.col(axis) % every == 0).groupBy(*keys, F.col(axis).alias("at"), F.col(a).alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(b).alias("x"), F.col("value").cast("double").alias("v")))), lambda s: s["v"]).alias("cells"))
    return g.withColumn("axis", F.lit(axis))
