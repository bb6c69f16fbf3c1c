"""Neighbourhood windows on a voxel grid, and volumes rebuilt from their centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import NAN, or_nan

#: Names of maps that are sent to every task at most.
MOST_NAMES = 10_000


def voxel_ids(mask: DataFrame) -> DataFrame:
    """voxel_id, i, j, k of a mask's voxels: numbers from 0 in C order.

    The running count goes by slices of i, so no task holds more than a slice and only slice sizes are summed up.
    """
    cells = mask.select("i", "j", "k").distinct()
    slices = cells.groupBy("i").agg(F.count(F.lit(1)).alias("_n"))
    slices = slices.select("i", (F.sum("_n").over(Window.orderBy("i")) - F.col("_n")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("i").orderBy("j", "k"))
    return cells.join(slices, "i").select((F.col("_base") + inside - 1).cast("long").alias("voxel_id"), "i", "j", "k")


def searchlight_members(mask: DataFrame, radius: int, stride: int = 1) -> DataFrame:
    """window_id, ci, cj, ck, pos, voxel_id: the mask voxels in the cube around each centre, in C order.

    Centres are mask voxels on the lattice of the stride. The cube's offsets are generated and joined by equality, which
    shuffles (2 radius + 1)**3 rows a centre and never compares all voxels with all centres.
    """
    if radius < 0 or stride <= 0:
        raise ValueError("radius must be 0 or more and stride above 0")
    voxels = voxel_ids(mask)
    on = [F.col(c) % stride == 0 for c in "ijk"]
    centres = voxels.where(on[0] & on[1] & on[2]).select("i", "j", "k", F.col("voxel_id").alias("_c"))
    # Window numbers follow the centres' order; at stride 1 they are the voxel numbers.
    named = centres if stride == 1 else voxel_ids(centres).withColumnRenamed("voxel_id", "_w").join(centres, ["i", "j", "k"])
    named = named.select((F.col("_c") if stride == 1 else F.col("_w")).alias("window_id"), F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("k").alias("ck"))
    near = F.sequence(F.lit(-radius), F.lit(radius))
    spread = named.withColumn("_di", F.explode(near)).withColumn("_dj", F.explode(near)).withColumn("_dk", F.explode(near))
    wanted = spread.select("window_id", "ci", "cj", "ck", (F.col("ci") + F.col("_di")).alias("i"), (F.col("cj") + F.col("_dj")).alias("j"), (F.col("ck") + F.col("_dk")).alias("k"))
    found = wanted.join(voxels, ["i", "j", "k"])
    pos = F.row_number().over(Window.partitionBy("window_id").orderBy("voxel_id")) - 1
    return found.select("window_id", "ci", "cj", "ck", pos.alias("pos"), "voxel_id")


def searchlight_centres(mask: DataFrame, stride: int = 1) -> DataFrame:
    """window_id, i, j, k of the centres: the mask voxels on the lattice of the stride, numbered in C order."""
    on = [F.col(c) % stride == 0 for c in "ijk"]
    return voxel_ids(mask.where(on[0] & on[1] & on[2])).select(F.col("voxel_id").alias("window_id"), "i", "j", "k")


def searchlight_windows(mask: DataFrame, radius: int, stride: int = 1) -> DataFrame:
    """window_id, i, j, k (the centre), voxel_ids: one row a window."""
    m = searchlight_members(mask, radius, stride)
    return m.groupBy("window_id", F.col("ci").alias("i"), F.col("cj").alias("j"), F.col("ck").alias("k")).agg(F.array_sort(F.collect_list("voxel_id")).alias("voxel_ids"))


def reconstruct(mask: DataFrame, centres: DataFrame, stride: int = 1, fill: float = NAN, keys: list[str] | None = None) -> DataFrame:
    """keys..., i, j, k, value (float) for every mask voxel from values at centres (keys..., i, j, k, value).

    At stride 1 a voxel has its own centre's value. At larger strides values are piecewise linear on the six tetrahedra
    of each lattice cell (fractions sorted: each step adds one axis), so a voxel meets four centres by equality. A voxel
    with a missing corner of weight above 0 gets the fill value, as do those beyond the lattice.
    """
    keys = keys or []
    cells = mask.select("i", "j", "k").distinct()
    values = centres.select(*keys, "i", "j", "k", F.col("value").cast("double").alias("_v"))
    grid = cells
    if keys:
        # Every map has every voxel, so this is as large as the result; the names are sent around only while they are few.
        names = centres.select(*keys).distinct()
        few = names.limit(MOST_NAMES + 1).count() <= MOST_NAMES
        grid = cells.crossJoin(F.broadcast(names) if few else names)
    if stride == 1:
        return grid.join(values, [*keys, "i", "j", "k"], "left").select(*keys, "i", "j", "k", F.coalesce("_v", F.lit(fill)).cast("float").alias("value"))
    axes = ["i", "j", "k"]
    base = {c: F.floor(F.col(c) / stride) * stride for c in axes}
    steps = F.array_sort(F.array(*[F.struct((-(F.col(c) - base[c]) / F.lit(float(stride))).alias("f"), F.lit(n).alias("a")) for n, c in enumerate(axes)]))
    g = grid.withColumn("_s", steps)
    f = [-(F.col("_s")[n]["f"]) for n in range(3)]
    axis = [F.col("_s")[n]["a"] for n in range(3)]
    weight = [F.lit(1.0) - f[0], f[0] - f[1], f[1] - f[2], f[2]]
    corner: list[Column] = []
    for n in range(4):
        moved = {c: base[c] + stride * sum([(axis[m] == a).cast("int") for m in range(n)], F.lit(0)) for a, c in enumerate(axes)}
        corner.append(F.struct(weight[n].alias("w"), *[moved[c].cast("int").alias(f"_{c}") for c in axes]))
    spread = g.select(*keys, *axes, F.explode(F.array(*corner)).alias("c")).where("c.w > 1e-12").select(*keys, *axes, "c.w", "c._i", "c._j", "c._k")
    at = values.select(*keys, *[F.col(c).alias(f"_{c}") for c in axes], "_v")
    summed = spread.join(at, [*keys, "_i", "_j", "_k"], "left").groupBy(*keys, *axes).agg(F.sum(F.col("w") * F.col("_v")).alias("s"), F.count("_v").alias("n"), F.count(F.lit(1)).alias("m"))
    whole = F.when(F.col("n") == F.col("m"), F.col("s"))
    return summed.select(*keys, *axes, F.coalesce(whole, F.lit(fill)).cast("float").alias("value"))


def suffix_maps(metrics: DataFrame, centres: DataFrame, name: str = "metric") -> DataFrame:
    """suffix, window_id, i, j, k, value: one map a metric column, named as the outputs are."""
    cols = [c for c in ("metric", "null_mean", "null_std", "p", "z") if c in metrics.columns]
    pairs = ", ".join(f"'{name if c == 'metric' else name + '_' + c}', `{c}`" for c in cols)
    long = metrics.selectExpr("window_id", f"stack({len(cols)}, {pairs}) as (suffix, value)")
    return long.join(centres.select("window_id", "i", "j", "k"), "window_id").select("suffix", "window_id", "i", "j", "k", or_nan(F.col("value")).alias("value"))
