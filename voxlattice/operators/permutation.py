"""Permutations that do not depend on partitioning, and family-wise inference by permuted maxima.

Order and signs come from the MD5 of (seed, permutation, row), so any engine and any number of tasks gets the same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import finite_or_null, or_nan
from ..functions.normal import critical_value
from ..sources.shared import stored
from . import bricks
from .ordering import running_total
from .threshold import levels

#: Bytes of signs or orders that may be sent to every task.
MOST_BYTES = 256 << 20
STATISTICS = ("max_t", "max_size", "max_tfce")
#: Heights up to a map's greatest value at which its components are enhanced.
TFCE_STEPS = 100


#: Rows of a split that are sorted together: a larger split is dealt into buckets of about so many.
BUCKET = 2048


def permuted_labels(samples: DataFrame, n: int, seed: int = 0, sample: str = "sample_id", split: str = "split_id", label: str = "y", bucket: int = BUCKET) -> DataFrame:
    """perm_id, sample_id, y: labels shuffled inside each split, n times. A split of one row keeps its label.

    Slots are the split's rows in order of sample id; slot r of permutation p gets the label of the row whose MD5 is the
    r-th. Slots are numbered once, over ranges; the order by MD5 goes by buckets of its leading bits, whose counts are summed
    up, so a split with most of the rows is many buckets, and no task sorts it. Sample ids are distinct.
    """
    return labels_by_split(samples, n, seed, sample, split, label, bucket).select("perm_id", "sample_id", "y")


def labels_by_split(samples: DataFrame, n: int, seed: int = 0, sample: str = "sample_id", split: str = "split_id", label: str = "y", bucket: int = BUCKET) -> DataFrame:
    """perm_id, split_id, sample_id, y of permuted_labels(); here a sample may be in several splits."""
    if n < 1:
        raise ValueError("the number of permutations must be 1 or more")
    spark = samples.sparkSession
    base = samples.select(F.col(sample).alias("sample_id"), F.col(split).alias("split_id"), F.col(label).alias("y"))
    slots = running_total(base, ["split_id"], ["sample_id"], name="_r")
    many = base.groupBy("split_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket)).alias("_n")).withColumnRenamed("split_id", "_split")
    perms = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Bytes have the order of their digits and are half as long.
    key = F.unhex(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm_id").cast("string"), F.col("sample_id").cast("string"))))
    # A number given keeps small tables, which are n times as large a step later, from being put into one task.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = base.join(many, base["split_id"].eqNullSafe(F.col("_split"))).drop("_split").repartition(parts, "sample_id")
    keyed = spread.withColumn("perm_id", perms).withColumn("_key", key)
    # The leading 32 bits of the MD5, as a share of all: in order of the MD5.
    lead = F.shiftright(F.conv(F.hex(F.substring("_key", 1, 4)), 16, 10).cast("long") * F.col("_n"), 32)
    keyed = keyed.withColumn("_bucket", lead.cast("long"))
    counts = keyed.groupBy("perm_id", "split_id", "_bucket").agg(F.count(F.lit(1)).alias("_of"))
    before = counts.withColumn("_before", F.sum("_of").over(Window.partitionBy("perm_id", "split_id").orderBy("_bucket")) - F.col("_of")).drop("_of")
    place = F.row_number().over(Window.partitionBy("perm_id", "split_id", "_bucket").orderBy("_key", "sample_id")) - 1
    named = [F.col(c).alias(f"{c}_2") for c in ("perm_id", "split_id", "_bucket")]
    ranked = keyed.withColumn("_place", place)
    on = (F.col("perm_id") == F.col("perm_id_2")) & F.col("split_id").eqNullSafe(F.col("split_id_2")) & (F.col("_bucket") == F.col("_bucket_2"))
    source = ranked.join(before.select(*named, "_before"), on).select("perm_id", "split_id", "y", (F.col("_before") + F.col("_place")).alias("_r"))
    # A slot is the same in all permutations, so it is a row once and not once for each.
    to = slots.select("sample_id", F.col("split_id").alias("split_id_2"), F.col("_r").alias("_r_2"))
    on = F.col("split_id").eqNullSafe(F.col("split_id_2")) & (F.col("_r") == F.col("_r_2"))
    return source.join(to, on).select("perm_id", "split_id", "sample_id", "y")


def sign(seed: int, perm: int, row: str) -> int:
    return 1 if hashlib.md5(f"{seed}:{perm}:{row}".encode()).hexdigest()[0] < "8" else -1


def sign_matrix(rows: list, n: int, seed: int = 0) -> np.ndarray:
    """(len(rows), n) of +1 and -1 as int8."""
    if len(rows) * n > MOST_BYTES:
        raise ValueError("signs of so many rows and permutations are too large to send to every task")
    return np.array([[sign(seed, p, r) for p in range(n)] for r in rows], np.int8)


def row_orders(rows: list, n: int, seed: int = 0) -> np.ndarray:
    """(len(rows), n): permutation p puts row orders[r, p] into place r."""
    if len(rows) * n * 4 > MOST_BYTES:
        raise ValueError("orders of so many rows and permutations are too large to send to every task")
    orders = [sorted(range(len(rows)), key=lambda r: hashlib.md5(f"{seed}:{p}:{rows[r]}".encode()).hexdigest()) for p in range(n)]
    return np.array(orders, np.int32).T


def _t_values(y: np.ndarray, x: np.ndarray, dof: int) -> np.ndarray:
    """t of each row of y (v, n) on each column of x (n, p), both with the other regressors taken out."""
    xx = (x * x).sum(0)
    xy = y @ x
    rss = np.maximum((y * y).sum(1)[:, None] - xy * xy / xx, 0.0)
    with np.errstate(all="ignore"):
        return xy / np.sqrt(xx * rss / dof)


def by_image(voxels: DataFrame, by: list[str]) -> DataFrame:
    """One row a voxel with its values in order of image; voxels with missing values or images have none (NULL)."""
    v = voxels.select(*by, "img_id", finite_or_null(F.col("value").cast("double")).alias("v"))
    g = v.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("img_id", "v"))).alias("a"))
    return g.select(*by, F.transform("a", lambda s: s["v"]).alias("y"))


def fwer(voxels: DataFrame, n_perm: int = 10_000, statistic: str = "max_t", tail: str = "two_sided", design: DataFrame | None = None, regressor: str = "intercept", seed: int = 0, cluster_p: float | None = None, by: list[str] = ["i", "j", "k"], block: int = 256, brick: int = bricks.BRICK) -> DataFrame:
    """Voxelwise t and -log10 of the family-wise p of one regressor by permutation.

    The intercept is tested by sign flips, a covariate by permuting the rows of its residual on the other regressors.
    p = (1 + #{permutations whose maximum reaches the voxel's value}) / (n_perm + 1). tail: gt, lt or two_sided; for lt
    the t that is returned is turned, so that effects are positive.

    max_t: values are a matrix product per block of voxels, and only a block's maxima leave the task. max_size and
    max_tfce: a task has a brick of the grid under all permutations and makes the trees of its components; what touches
    the brick's faces is joined over the seams (see bricks). No task holds a map. The null, a number a permutation, is made
    when this is called; a voxel's p is a binary search in it.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"statistic must be one of {STATISTICS}")
    if tail not in ("gt", "lt", "two_sided"):
        raise ValueError("tail must be gt, lt or two_sided")
    if statistic == "max_size" and cluster_p is None:
        raise ValueError("max_size needs cluster_p, the p that forms clusters")
    turn = -1.0 if tail == "lt" else 1.0
    both = tail == "two_sided"
    images = sorted(r[0] for r in voxels.select("img_id").distinct().limit(MOST_BYTES // max(1, n_perm) + 1).collect())
    n = len(images)
    x, basis = _regressor(images, design, regressor)
    flips = regressor == "intercept" and basis.shape[1] == 0
    if flips:
        draws = x[:, None] * sign_matrix(images, n_perm, seed)
    else:
        draws = x[row_orders(images, n_perm, seed)]
    sent = voxels.sparkSession.sparkContext.broadcast((x, basis, draws))
    dof = n - 1 - basis.shape[1]
    rows = by_image(voxels, by).where(F.size("y") == n)
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def residual(ys) -> tuple[np.ndarray, np.ndarray]:
        y = np.array([np.asarray(v, float) for v in ys]) if len(ys) else np.zeros((0, n))
        good = np.isfinite(y).all(1)
        q = sent.value[1]
        return (y - (y @ q) @ q.T if q.shape[1] else y), good

    def observed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y, good = residual(pdf["y"])
            t = np.full(len(pdf), np.nan)
            t[good] = turn * _t_values(y[good], sent.value[0][:, None], dof)[:, 0]
            yield pdf[by].assign(t=t)

    def maxima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up, down = np.full(n_perm, -np.inf), np.full(n_perm, -np.inf)
        for pdf in batches:
            y, good = residual(pdf["y"])
            y = y[good]
            for a in range(0, len(y), 4096):
                for p in range(0, n_perm, block):
                    t = turn * _t_values(y[a : a + 4096], sent.value[2][:, p : p + block], dof)
                    up[p : p + block] = np.fmax(up[p : p + block], np.fmax.reduce(t, 0))
                    down[p : p + block] = np.fmax(down[p : p + block], np.fmax.reduce(-t, 0))
        yield pd.DataFrame({"perm_id": np.arange(n_perm), "up": up, "down": down})

    found = rows.mapInPandas(observed, f"{keys}, t double").withColumn("t", or_nan(F.col("t")))
    if statistic != "max_size":
        # Two numbers a permutation.
        tops = rows.mapInPandas(maxima, "perm_id long, up double, down double").groupBy("perm_id").agg(F.max("up").alias("up"), F.max("down").alias("down")).toPandas().set_index("perm_id").reindex(range(n_perm), fill_value=-np.inf)
    if statistic == "max_t":
        found = found.withColumn("s", F.abs("t") if both else F.col("t"))
        null = np.maximum(tops["up"], tops["down"]).to_numpy() if both else tops["up"].to_numpy()
    else:
        sides = (1, -1) if both else (1,)
        if statistic == "max_size":
            height = critical_value(cluster_p / 2 if both else cluster_p)
            weights, unit = bricks.size_weights(), {(p, s): 1.0 for p in range(-1, n_perm) for s in sides}
        else:
            weights = bricks.tfce_weights(TFCE_STEPS)
            top = found.where(~F.isnan("t")).agg(F.max("t").alias("up"), F.max(-F.col("t")).alias("down")).first()
            step = {(int(p), s): float(x) / TFCE_STEPS for s, name in ((1, "up"), (-1, "down")) for p, x in [(-1, top[name] or 0.0), *tops[name].items()]}
            unit = {k: v**3 for k, v in step.items() if v > 0} or {(-1, 1): 1.0}

        def leveled(t: np.ndarray, perm: int, side: int) -> np.ndarray:
            if statistic == "max_size":
                return (side * t >= height).astype(np.int64)
            dh = step[perm, side]
            return levels(side * t, dh, TFCE_STEPS) if dh > 0 else np.zeros(len(t), np.int64)

        def of_brick(t: pa.Table) -> pa.Table:
            y, good = residual(t.column("y").to_pylist())
            y, cells = y[good], np.column_stack([t.column(c).to_numpy() for c in by]).astype(np.int64)[good]
            found, perm = [], []
            for p in range(-1, n_perm if len(cells) else -1, block):
                last = min(p + block, n_perm)
                x = sent.value[2][:, max(p, 0) : last]
                each = turn * _t_values(y, np.column_stack([sent.value[0], x]) if p < 0 else x, dof)
                for q in range(p, last):
                    for s in sides:
                        made = bricks.pieces(cells, leveled(each[:, q - p], q, s), cells[0] // brick * brick, brick, weights, s, q < 0)
                        found += made
                        perm += [q] * len(made)
            return bricks.as_table(found, "perm_id", pa.array(perm, pa.int32()))

        made = stored(rows.groupBy(*bricks.brick_of(brick, tuple(by))).applyInArrow(of_brick, f"perm_id int, {bricks.PIECES}"), "pieces")
        inner, parts = bricks.merged(made, "perm_id", weights)
        # A number a permutation and side.
        units = F.broadcast(voxels.sparkSession.createDataFrame([(p, s, u) for (p, s), u in unit.items()], "perm_id int, side int, unit double"))
        inner = inner.join(units, ["perm_id", "side"]).withColumns({c: F.col(c) * F.col("unit") for c in ("base", "best")}).drop("unit")
        most = inner.where("perm_id >= 0").groupBy("perm_id").agg(F.max(F.col("base") + F.col("best")).alias("most")).toPandas()
        null = np.zeros(n_perm)
        null[most["perm_id"].to_numpy(np.int64)] = most["most"]
        parts = parts.where("perm_id = -1").join(units, ["perm_id", "side"]).withColumn("inside", F.col("inside") * F.col("unit")).drop("unit")
        own = bricks.voxel_values(inner.where("perm_id = -1"), parts, "perm_id").select(*[F.col(a).alias(b) for a, b in zip("ijk", by)], F.col("value").alias("s"))
        found = found.join(own, by, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    null = np.sort(null)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reach = n_perm - np.searchsorted(null, pdf["s"].to_numpy() - 1e-9, "left")
            p = np.where(pdf["t"].isna(), 1.0, (reach + 1) / (n_perm + 1.0))
            yield pdf[[*by, "t"]].assign(p=p, logp=-np.log10(p))

    return found.select(*by, "t", "s").mapInPandas(judged, f"{keys}, t double, p double, logp double").withColumn("t", or_nan(F.col("t")))


def _regressor(images: list, design: DataFrame | None, regressor: str) -> tuple[np.ndarray, np.ndarray]:
    """The regressor with the others taken out, and an orthonormal basis of the others."""
    if design is None:
        return np.ones(len(images)), np.zeros((len(images), 0))
    rows = {r["img_id"]: r for r in design.limit(len(images) + 1).collect()}
    others = [c for c in design.columns if c not in ("img_id", regressor)]
    x = np.array([float(rows[i][regressor]) for i in images])
    z = np.array([[float(rows[i][c]) for c in others] for i in images]).reshape(len(images), len(others))
    if not others:
        return x, z
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    q = u[:, s > 1e-10 * s.max()]
    return x - q @ (q.T @ x), q


def passed(found: DataFrame, alpha: float = 0.05, by: list[str] = ["i", "j", "k"]) -> DataFrame:
    """t where -log10 p reaches -log10 alpha (for one tail: and t is positive in its direction), else 0."""
    return found.select(*by, F.when(F.col("logp") >= -np.log10(alpha), F.col("t")).otherwise(F.lit(0.0)).alias("t"))
