"""Ranks, ROC AUC, permutation tests of metrics, and top-k nearest neighbours.

A metric may be computed for many windows at once: give the grouping columns in `by`. Ranks are made once, and a
permutation only sums them up, so the permutation table meets (sample, rank) rows and never recomputes an order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import NAN, or_nan
from ..functions.normal import signed_z
from ..sources.paths import filesystem
from ..sources.shared import stored
from .ordering import running_total

DISTANCES = ("euclidean", "sqeuclidean", "manhattan", "cityblock", "chebyshev", "cosine")


def average_rank(rows: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """rows with `rank`: ties share the mean of their places. If a group holds NaN, all its ranks are NaN.

    Without `by` all rows are one group: distinct scores are counted, their counts summed up in order over ranges, and the
    ranks joined to the rows, so no task sorts the table. With `by` a group is a window partition.
    """
    s = F.col(score).cast("double")
    if not by:
        counts = rows.groupBy(s.alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
        placed = running_total(counts, [], ["_s"], F.col("_c"), "_before")
        # One row.
        bad = F.broadcast(counts.agg(F.coalesce(F.bool_or(F.isnan("_s") | F.col("_s").isNull()), F.lit(False)).alias("_bad")))
        ranks = placed.crossJoin(bad).select("_s", F.when(F.col("_bad"), F.lit(NAN)).otherwise(F.col("_before") + (F.col("_c") + 1) / F.lit(2.0)).alias("rank"))
        return rows.join(ranks, s.eqNullSafe(F.col("_s"))).drop("_s")
    whole = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, score)
    place = F.rank().over(whole.orderBy(s)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    bad = F.max(F.isnan(s) | s.isNull()).over(whole)
    return rows.withColumn("rank", F.when(bad, F.lit(NAN)).otherwise(place.cast("double")))


def _auc(rank_sum: Column, n_pos: Column, n: Column) -> Column:
    n_neg = n - n_pos
    return F.when((n_pos == 0) | (n_neg == 0), F.lit(NAN)).otherwise(F.try_divide(rank_sum - n_pos * (n_pos + 1) / F.lit(2.0), (n_pos * n_neg).cast("double")))


def roc_auc(rows: DataFrame, label: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """by..., n, n_pos, auc by the rank sum. Labels are 0 or 1, anything else raises an error; one class gives NaN.

    Without `by` it comes from counts of the two classes by distinct score; the rows are not sorted or joined.
    """
    by = by or []
    y = F.when(F.col(label).isin(0, 1), F.col(label).cast("long")).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("long"))
    if not by:
        counts = rows.groupBy(F.col(score).cast("double").alias("_s")).agg(F.count(F.lit(1)).alias("_c"), F.sum(y).alias("_p"))
        placed = running_total(counts, [], ["_s"], F.col("_c"), "_before")
        rank = F.when(F.isnan("_s") | F.col("_s").isNull(), F.lit(NAN)).otherwise(F.col("_before") + (F.col("_c") + 1) / F.lit(2.0))
        bad = F.bool_or(F.isnan("_s") | F.col("_s").isNull())
        g = placed.withColumn("rank", rank).agg(F.sum("_c").alias("n"), F.sum("_p").alias("n_pos"), F.coalesce(F.sum(F.when(F.col("_p") > 0, F.col("rank") * F.col("_p"))), F.lit(0.0)).alias("_r"), bad.alias("_bad"))
        g = g.select(F.coalesce("n", F.lit(0)).alias("n"), "n_pos", F.when(F.col("_bad"), F.lit(NAN)).otherwise(F.col("_r")).alias("_r"))
        return g.select("n", "n_pos", _auc(F.col("_r"), F.col("n_pos"), F.col("n")).alias("auc"))
    r = average_rank(rows.withColumn("_y", y), score, by)
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n_pos"), F.coalesce(F.sum(F.when(F.col("_y") == 1, F.col("rank"))), F.lit(0.0)).alias("_r"))
    return g.select(*by, "n", "n_pos", _auc(F.col("_r"), F.col("n_pos"), F.col("n")).alias("auc"))


def test_summary(null: DataFrame, observed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """null (by..., value) and observed (by..., score) -> score, null_mean, null_std (ddof 1), p, z.

    p is two-sided around the mean of the null: (1 + #{|null - mean| >= |score - mean|}) / (P + 1). One permutation has
    null_std NaN. A NaN score has p and z NaN.
    """
    by = by or []
    dev = F.abs(F.col("value") - F.col("_mean"))
    far = dev >= F.abs(F.col("score") - F.col("_mean")) - 1e-12
    if by:
        joined = null.join(observed, by).withColumn("_mean", F.avg("value").over(Window.partitionBy(*by)))
    else:
        # A row each.
        joined = null.join(F.broadcast(observed)).join(F.broadcast(null.agg(F.avg("value").alias("_mean"))))
    g = (
        joined.groupBy(*by)
        .agg(F.first("score").alias("score"), F.avg("value").alias("null_mean"), or_nan(F.stddev_samp("value")).alias("null_std"), F.count_if(far).alias("_far"), F.count(F.lit(1)).alias("_n"))
    )
    p = F.when(F.isnan("score"), F.lit(NAN)).otherwise((F.col("_far") + 1) / (F.col("_n") + F.lit(1.0)))
    g = g.withColumn("p", p)
    z = F.when(F.isnan("score"), F.lit(NAN)).otherwise(signed_z(F.col("p"), F.col("score") - F.col("null_mean")))
    return g.select(*by, "score", "null_mean", "null_std", "p", z.alias("z"))


def auc_permutation_test(rows: DataFrame, permuted: DataFrame, label: str = "y", score: str = "score", sample: str = "sample_id", by: list[str] | None = None) -> DataFrame:
    """AUC and its null from permuted labels (perm_id, sample_id, y); one row a group, five NaN for one class."""
    by = by or []
    ranked = average_rank(rows, score, by).select(*by, F.col(sample).alias("sample_id"), "rank", F.col(label).cast("long").alias("_true"))
    observed = roc_auc(rows, label, score, by).select(*by, F.col("auc").alias("score"), "n", "n_pos")
    sums = ranked.join(permuted.select("perm_id", "sample_id", F.col("y").cast("long").alias("_y")), "sample_id").groupBy(*by, "perm_id").agg(F.coalesce(F.sum(F.when(F.col("_y") == 1, F.col("rank"))), F.lit(0.0)).alias("_r"), F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_n"))
    null = sums.select(*by, _auc(F.col("_r"), F.col("_p"), F.col("_n")).alias("value"))
    return test_summary(null, observed.select(*by, "score"), by)


def metric_permutation_test(rows: DataFrame, permuted: DataFrame, metric: str | Callable[[np.ndarray, np.ndarray], float], label: str = "y", score: str = "score", sample: str = "sample_id", by: list[str] | None = None) -> DataFrame:
    """The permutation test of any metric: "roc_auc" runs natively, a function (y, score) -> float a group at a time."""
    if metric == "roc_auc":
        return auc_permutation_test(rows, permuted, label, score, sample, by)
    if not callable(metric):
        raise ValueError(f"unknown metric {metric!r}")
    by = by or []
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    base = rows.select(*by, F.col(sample).alias("sample_id"), F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y"))

    def value(name: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("sample_id")
            out = float(metric(pdf["_y"].to_numpy(), pdf["_s"].to_numpy()))
            return pdf[by].head(1).assign(**{name: out}) if by else pd.DataFrame({name: [out]})

        return run

    observed = base.groupBy(*by).applyInPandas(value("score"), f"{kinds}score double")
    shuffled = base.drop("_y").join(permuted.select("perm_id", "sample_id", F.col("y").cast("double").alias("_y")), "sample_id")
    null = shuffled.groupBy(*by, "perm_id").applyInPandas(value("value"), f"{kinds}value double")
    return test_summary(null, observed, by)


def windowwise_metric(predictions: DataFrame, targets: DataFrame, metric: str | Callable = "roc_auc", permuted: DataFrame | None = None, y_transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """window_id, metric (and null_mean, null_std, p, z with permuted labels) for each window of predictions.

    predictions has window_id, sample_id, y_pred; targets sample_id, y. Windows whose predictions are all equal or all
    missing have NaN throughout and are not computed.
    """
    y = targets.select("sample_id", (y_transform(F.col("y")) if y_transform else F.col("y")).alias("y"))
    rows = predictions.select("window_id", "sample_id", F.col("y_pred").cast("double").alias("score")).join(y, "sample_id")
    whole = Window.partitionBy("window_id")
    flat = F.min("score").over(whole) == F.max("score").over(whole)
    moving = rows.withColumn("_flat", flat).where(~F.col("_flat")).drop("_flat")
    if permuted is None:
        if metric == "roc_auc":
            found = roc_auc(moving, by=["window_id"]).select("window_id", F.col("auc").alias("metric"))
        else:
            found = moving.groupBy("window_id").applyInPandas(lambda p: pd.DataFrame({"window_id": p["window_id"].head(1), "metric": [float(metric(p.sort_values("sample_id")["y"].to_numpy(), p.sort_values("sample_id")["score"].to_numpy()))]}), "window_id long, metric double")
        names = ["metric"]
    else:
        found = metric_permutation_test(moving, permuted, metric, by=["window_id"]).withColumnRenamed("score", "metric")
        names = ["metric", "null_mean", "null_std", "p", "z"]
    all_ = predictions.select("window_id").distinct()
    return all_.join(found, "window_id", "left").select("window_id", *[or_nan(F.col(c)).alias(c) for c in names])


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two arrays of doubles."""
    if metric not in DISTANCES:
        raise ValueError(f"metric must be one of {DISTANCES}")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        dot = total(F.zip_with(a, b, lambda x, y: x * y))
        norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
        return F.lit(1.0) - F.coalesce(F.try_divide(dot, norm), F.lit(0.0))
    if metric == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric in ("manhattan", "cityblock"):
        return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    squared = total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    return F.sqrt(squared) if metric == "euclidean" else squared


#: Candidates at most around which the others are put into cells, and the number of candidates that a cell aims at.
MOST_PIVOTS = 4096
CELL = 1024
#: Rows whose distances to all pivots are held at a time, and queries that a task is given.
ROWS = 1024
ROWS_OF_TASK = 8192
#: Distances are trusted to this share when a cell is left out or taken whole.
_MARGIN = 1e-9


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of a and b, row by row; the same for a pair wherever it is computed."""
    if metric == "cosine":
        norm = np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1))
        return 1 - np.divide((a * b).sum(-1), norm, out=np.zeros(norm.shape), where=norm > 0)
    if metric == "chebyshev":
        return np.abs(a - b).max(-1)
    if metric in ("manhattan", "cityblock"):
        return np.abs(a - b).sum(-1)
    d = ((a - b) ** 2).sum(-1)
    return np.sqrt(d) if metric == "euclidean" else d


def _bounding(d: np.ndarray, metric: str) -> np.ndarray:
    """Distances as ones that obey the triangle inequality, in the same order."""
    if metric == "sqeuclidean":
        return np.sqrt(d)
    # The chord of an angle on the unit sphere.
    return np.sqrt(np.maximum(2 * d, 0.0)) if metric == "cosine" else d


def _to_pivots(x: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    return np.stack([_bounding(_distances(x, p[None], metric), metric) for p in pivots], 1)


class _Block:
    """Candidates that queries are compared with, at most a few thousand: row numbers and vectors."""

    def __init__(self, pos: np.ndarray, x: np.ndarray, metric: str) -> None:
        self.pos, self.x, self.metric = pos, x, metric
        if metric == "cosine":
            norm = np.sqrt((x * x).sum(1))
            self.side = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0).T
        elif metric in ("euclidean", "sqeuclidean"):
            self.square = (x * x).sum(1)
            self.side = -2 * x.T
        else:
            self.side = np.ascontiguousarray(x.T)

    def nearer(self, q: np.ndarray, d: np.ndarray, true: np.ndarray) -> np.ndarray:
        """How many come before each query's own candidate, which has distance d and row number true.

        Distances of all pairs come from a product, or from sums a dimension at a time; those too near d for the rounding
        of these to tell are computed again, pair by pair.
        """
        rounding = 4 * (q.shape[1] + 8) * np.finfo(float).eps
        if self.metric == "cosine":
            norm = np.sqrt((q * q).sum(1))
            far = np.divide(q, norm[:, None], out=np.zeros_like(q), where=norm[:, None] > 0) @ self.side
            np.subtract(1.0, far, out=far)
            own, slack = d, np.full(len(q), rounding)
        elif self.metric in ("euclidean", "sqeuclidean"):
            far = q @ self.side
            far += self.square
            square = (q * q).sum(1)
            far += square[:, None]
            own = d if self.metric == "sqeuclidean" else d * d
            slack = rounding * (np.sqrt(square) + np.sqrt(np.fmax.reduce(self.square, initial=0.0))) ** 2 + rounding * own
        else:
            far, part = np.zeros((len(q), len(self.pos))), np.empty((len(q), len(self.pos)))
            into = np.maximum if self.metric == "chebyshev" else np.add
            for x, v in zip(self.side, q.T):
                np.subtract(x, v[:, None], out=part)
                np.abs(part, out=part)
                into(far, part, out=far)
            own, slack = d, rounding * d
        line = np.flatnonzero((far <= (own + slack)[:, None]).any(1))
        out = np.zeros(len(q), np.int64)
        if len(line):
            far, low = far[line], (own - slack)[line, None]
            sure = far < low
            out[line] = sure.sum(1)
            i, j = np.nonzero((far <= (own + slack)[line, None]) & ~sure)
            for at in range(0, len(i), 4096):
                a, b = line[i[at : at + 4096]], j[at : at + 4096]
                again = _distances(self.x[b], q[a], self.metric)
                np.add.at(out, a, (again < d[a]) | ((again == d[a]) & (self.pos[b] < true[a])))
        return out


#: Pairs whose distances are held at a time: by a product, and a dimension at a time.
_PRODUCT, _TILE = 1 << 22, 1 << 16


def nearer_candidates(candidates: DataFrame, queries: DataFrame, enough: int, metric: str = "euclidean", block: int = 4096, cell: int = CELL) -> DataFrame:
    """query_id, n_nearer, n_compared: how many candidates come before a query's own one, exactly up to `enough`.

    candidates has row_pos and vec, queries query_id, true_pos and vec. Before means nearer, or as near with a lower
    row_pos; n_nearer is NULL for a query whose candidate does not exist. Candidates are put into cells around pivots (a
    bounded sample of them); a cell whose pivot and radius say that all of it is farther than the query's own candidate is
    left out, one that is nearer as a whole is counted, and only the rest is compared. Cells are written as blocks of at
    most `block` candidates; a task has some thousand queries and reads the blocks one after the other, and a query that
    has `enough` nearer candidates goes no further. So only blocks are in memory, and no query is sent to cells.
    n_compared tells the number of candidates that were compared.
    """
    spark = candidates.sparkSession
    c = candidates.select(F.col("row_pos").cast("long"), F.col("vec").cast("array<double>"))
    q = queries.select(F.col("query_id").cast("long"), F.col("true_pos").cast("long"), F.col("vec").cast("array<double>"))
    n_pivots = max(1, min(MOST_PIVOTS, -(-c.count() // cell)))
    # MOST_PIVOTS vectors at most.
    chosen = c.orderBy(F.xxhash64("row_pos"), "row_pos").limit(n_pivots).toPandas()
    pivots = np.stack(chosen["vec"].to_numpy()) if len(chosen) else np.zeros((1, 1))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at : at + ROWS]
                x = np.stack(part["vec"].to_numpy())
                d = _to_pivots(x, pivots, metric)
                own = d.argmin(1)
                reach = d[np.arange(len(x)), own]
                # What has a NaN is as far from everything, and so is a vector of zeros from all angles; nothing bounds them.
                reach = np.where(np.isnan(reach) | ((metric == "cosine") & ~((x * x).sum(1) > 0)), np.inf, reach)
                yield part.assign(cell=own.astype(np.int32), reach=reach)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, own in pdf.groupby("cell", sort=False):
                for at in range(0, len(own), block):
                    part = own.iloc[at : at + block]
                    x = np.stack(part["vec"].to_numpy()).astype(float)
                    yield pd.DataFrame({"cell": [k], "pos": [part["row_pos"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    placed = stored(c.mapInPandas(put, "row_pos long, vec array<double>, cell int, reach double"), "cells")
    # A row a pivot.
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).toPandas().sort_values("cell")
    number, size, radius = cells["cell"].to_numpy(), cells["n"].to_numpy(), cells["radius"].to_numpy()
    blocks = stored(placed.repartitionByRange("cell", "row_pos").sortWithinPartitions("cell", "row_pos").mapInPandas(packed, "cell int, pos binary, x binary"), "blocks")
    folder = blocks._voxlattice_stored

    def needed(x: np.ndarray, true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many candidates are surely nearer, and which cells have to be looked at."""
        bound, d = _bounding(true, metric), _to_pivots(x, pivots[number], metric)
        if metric == "cosine":
            bound = np.where((x * x).sum(1) > 0, bound, np.inf)
        slack = _MARGIN * (1 + bound[:, None] + d)
        # Of unbounded queries nothing is known.
        whole = (d + radius < bound[:, None] - slack) & np.isfinite(bound)[:, None]
        sure = np.where(whole, size, 0).sum(1)
        return sure, ~whole & (d - radius <= bound[:, None] + slack)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, own, true = np.stack(pdf["vec"].to_numpy()), np.stack(pdf["own"].to_numpy()), pdf["true_pos"].to_numpy(np.int64)
            d = _distances(x, own, metric)
            parts = [needed(x[at : at + ROWS], d[at : at + ROWS]) for at in range(0, len(x), ROWS)]
            found, need = (np.concatenate(p) for p in zip(*parts))
            compared = np.zeros(len(x), np.int64)
            # Tasks begin at different blocks.
            for k, pos, v in _blocks(folder, int(pdf["query_id"].iloc[0])):
                column = need[:, np.searchsorted(number, k)]
                if not (column & (found < enough)).any():
                    continue
                some = metric not in ("cosine", "euclidean", "sqeuclidean")
                step = 1024 if some else len(pos)
                for at in range(0, len(pos), step):
                    one = _Block(pos[at : at + step], v[at : at + step], metric)
                    asked = np.flatnonzero(column & (found < enough))
                    tile = max(1, (_TILE if some else _PRODUCT) // len(one.pos))
                    for a in range(0, len(asked), tile):
                        rows = asked[a : a + tile]
                        found[rows] += one.nearer(x[rows], d[rows], true[rows])
                        compared[rows] += len(one.pos)
            yield pd.DataFrame({"query_id": pdf["query_id"], "n_nearer": found, "n_compared": compared})

    both = q.join(placed.select(F.col("row_pos").alias("true_pos"), F.col("vec").alias("own")), "true_pos").select("query_id", "true_pos", "vec", "own")
    tasks = max(spark.sparkContext.defaultParallelism, -(-both.count() // ROWS_OF_TASK))
    known = both.repartition(tasks, "query_id").mapInPandas(counted, "query_id long, n_nearer long, n_compared long")
    return q.select("query_id").join(known, "query_id", "left").select("query_id", "n_nearer", F.coalesce("n_compared", F.lit(0).cast("long")).alias("n_compared"))


def _blocks(folder: str, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """cell, row numbers and vectors of each written block, a few blocks in memory; first says with which file to begin."""
    where, inner = filesystem(folder)
    files = sorted(x.path for x in where.get_file_info(fs.FileSelector(inner)) if x.path.endswith(".parquet"))
    at = first % max(1, len(files))
    for path in files[at:] + files[:at]:
        with where.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=4):
                for k, pos, x in zip(*(batch.column(c) for c in ("cell", "pos", "x"))):
                    pos = np.frombuffer(pos.as_buffer(), np.int64)
                    yield k.as_py(), pos, np.frombuffer(x.as_buffer(), float).reshape(len(pos), -1)


def top_k_accuracy(candidates: DataFrame, queries: DataFrame, k: int | list[int], metric: str = "euclidean", block: int = 4096, cell: int = CELL) -> DataFrame:
    """k, accuracy, in the order given: how often the true candidate is among the k nearest of a query.

    candidates has row_pos and vec, queries query_id, true_pos and vec; ids are distinct. Ties go to the lowest row_pos.
    The true candidate is among the k nearest if fewer than k come before it (see nearer_candidates).
    """
    ks = [int(x) for x in (k if isinstance(k, (list, tuple, np.ndarray)) else [k])]
    if not ks or min(ks) < 1:
        raise ValueError("k must be 1 or more")
    if metric not in DISTANCES:
        raise ValueError(f"metric must be one of {DISTANCES}")
    found = nearer_candidates(candidates, queries, max(ks), metric, block, cell)
    counted = found.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("n_nearer") < x).alias(f"_h{n}") for n, x in enumerate(ks)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("o"), F.lit(x).alias("k"), F.try_divide(F.col(f"_h{n}").cast("double"), F.col("_n")).alias("accuracy")) for n, x in enumerate(ks)])).alias("s")).select("s.k", "s.accuracy")
