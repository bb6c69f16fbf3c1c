"""Leave-one-split-out decoding over whole feature sets and inside windows.

features is long: voxel_id, sample_id, value; targets has sample_id, split_id, y (and target_id for several targets).
One feature with ridge is a plan of sums. A whole feature set goes by products of features, summed over the samples, or,
of more features than samples, by products of samples, summed over blocks of features. Windows of many samples go by
products of a brick's features; other windows, and models or selectors that are any functions, run a group at a time in
numpy.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import or_nan
from ..sources.shared import stored
from .permutation import labels_by_split
from .windows import voxel_ids

Model = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Selector = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Ridge:
    """Ridge with an intercept that is not penalised.

    dual() is the same from products of samples, slopes() from products of features: gram of the centred training columns,
    side of these by the columns of y.
    """

    def __init__(self, alpha: float = 1.0) -> None:
        self.alpha = alpha

    def __call__(self, x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
        mx, my = x.mean(0), y.mean(0)
        z = x - mx
        if x.shape[1] <= x.shape[0]:
            b = np.linalg.solve(z.T @ z + self.alpha * np.eye(x.shape[1]), z.T @ (y - my))
        else:
            b = z.T @ np.linalg.solve(z @ z.T + self.alpha * np.eye(x.shape[0]), y - my)
        return (test - mx) @ b + my

    def dual(self, gram: np.ndarray, y: np.ndarray, cross: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Predictions for columns y; gram is of the centred training rows, cross of test by training rows, own of each test row."""
        my = y.mean(0)
        if self.alpha <= 0:
            return LeastSquares().dual(gram, y, cross, own)
        return cross @ np.linalg.solve(gram + self.alpha * np.eye(len(gram)), y - my) + my

    def slopes(self, gram: np.ndarray, side: np.ndarray) -> np.ndarray:
        if self.alpha <= 0:
            return LeastSquares().slopes(gram, side)
        return np.linalg.solve(gram + self.alpha * np.eye(len(gram)), side)


class LeastSquares:
    """The solution of least norm."""

    #: Eigenvalues below this share of the greatest are none.
    least = 1e-11

    def __call__(self, x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
        mx, my = x.mean(0), y.mean(0)
        return (test - mx) @ (np.linalg.pinv(x - mx) @ (y - my)) + my

    def dual(self, gram: np.ndarray, y: np.ndarray, cross: np.ndarray, own: np.ndarray) -> np.ndarray:
        my = y.mean(0)
        w, v = np.linalg.eigh(gram)
        good = w > self.least * max(w.max(initial=0.0), 0.0)
        return cross @ (v[:, good] @ ((v[:, good].T @ (y - my)) / w[good][:, None])) + my

    def slopes(self, gram: np.ndarray, side: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(gram)
        good = w > self.least * max(w.max(initial=0.0), 0.0)
        return v[:, good] @ ((v[:, good].T @ side) / w[good][:, None])


class NearestMean:
    """The label whose training mean is nearest; labels are numbers."""

    def __call__(self, x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
        out = []
        for col in y.reshape(len(y), -1).T:
            labels = np.unique(col)
            means = np.stack([x[col == v].mean(0) for v in labels])
            out.append(labels[((test[:, None] - means) ** 2).sum(2).argmin(1)])
        return np.stack(out, 1).reshape(len(test), *y.shape[1:])

    def dual(self, gram: np.ndarray, y: np.ndarray, cross: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.empty((len(cross), y.shape[1]))
        for n, col in enumerate(y.T):
            labels = np.unique(col)
            d = [own - 2 * cross[:, col == v].mean(1) + gram[np.ix_(col == v, col == v)].mean() for v in labels]
            out[:, n] = labels[np.stack(d, 1).argmin(1)]
        return out


def ridge(alpha: float = 1.0) -> Model:
    return Ridge(alpha)


def least_squares() -> Model:
    return LeastSquares()


def nearest_mean() -> Model:
    return NearestMean()


MODELS: dict[str, Callable[..., Model]] = {"ridge": ridge, "least_squares": least_squares, "nearest_mean": nearest_mean}


class KBest:
    """The k features of largest absolute correlation with y (of several targets, the first); the first of equals."""

    def __init__(self, k: int) -> None:
        self.k = k

    def score(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """|r| of the columns of z (centred) with y; 0 for a constant."""
        w = y.reshape(len(y), -1)[:, 0] - y.reshape(len(y), -1)[:, 0].mean()
        norm = np.sqrt((z * z).sum(0) * (w * w).sum())
        return np.divide(np.abs(z.T @ w), norm, out=np.zeros(z.shape[1]), where=norm > 0)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keep = np.zeros(x.shape[1], bool)
        keep[np.argsort(-self.score(x - x.mean(0), y), kind="stable")[: self.k]] = True
        return keep


class VarianceAbove:
    """The features whose variance, after scaling if that is done, is above a threshold."""

    def __init__(self, threshold: float = 0.0) -> None:
        self.threshold = threshold

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x.var(0) > self.threshold


def k_best(k: int) -> Selector:
    return KBest(k)


def variance_above(threshold: float = 0.0) -> Selector:
    return VarianceAbove(threshold)


def training_order(names: np.ndarray, perm: int, seed: int = 0) -> np.ndarray:
    """Permutation `perm` of the rows with these names: by the MD5 of (seed, permutation, name), so every engine has the same."""
    keys = [hashlib.md5(f"{seed}:{perm}:{n}".encode()).hexdigest() for n in names.tolist()]
    return np.array(sorted(range(len(keys)), key=lambda r: (keys[r], r)), np.int64)


def decode(x: np.ndarray, y: np.ndarray, split: np.ndarray, model: Model, selector: Selector | None = None, permutations: int = 0, scale: bool = True, normalise: bool = False, seed: int = 0, names: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Predictions for every sample by the model fitted on the other splits, and {split: selected features}.

    With permutations, training labels are shuffled (over the whole training set, see training_order; names are the
    samples', else their numbers) and the last axis counts them; selection is made on the true labels. normalise brings each split's predictions to mean 0 and standard
    deviation 1 over all elements. A constant feature is scaled by 1; constant predictions normalise to NaN.
    """
    shape = (*y.shape, permutations) if permutations else y.shape
    out = np.full(shape, np.nan)
    selected = {}
    for s in np.unique(split):
        test = split == s
        train, fit, seen = x[~test], y[~test], x[test]
        if not len(train):
            continue
        if scale:
            sd = train.std(0)
            sd[sd == 0] = 1.0
            train, seen = (train - train.mean(0)) / sd, (seen - train.mean(0)) / sd
        if selector is not None:
            keep = np.asarray(selector(train, fit), bool)
            train, seen = train[:, keep], seen[:, keep]
        selected[s] = train.shape[1]

        def predicted(labels: np.ndarray) -> np.ndarray:
            p = np.asarray(model(train, labels, seen), float).reshape(y[test].shape)
            if normalise:
                with np.errstate(all="ignore"):
                    p = (p - p.mean()) / p.std()
            return p

        if permutations:
            own = (np.arange(len(y)) if names is None else names)[~test]
            out[test] = np.stack([predicted(fit[training_order(own, p, seed)]) for p in range(permutations)], -1)
        else:
            out[test] = predicted(fit)
    return out, selected


#: Samples at most of a decoding.
MOST_SAMPLES = 2_000_000_000
#: Samples at most whose products with each other, or whose values in a window, are in one task.
MOST_PRODUCTS = 20_000
#: Features at most of a set or a brick whose products with each other are in one task.
MOST_FEATURES = 4096
#: Bytes of a brick's values up to which they are one group; of more, only products of features are.
BRICK_BYTES = 64 << 20
#: Samples of a split, about, that are predicted together.
CHUNK = 2048
#: Rows and columns of a tile of products, and features that a task works on together.
TILE = 512
FEATURES = 256

PREDICTED = "sample_id long, target_id int, perm_id int, y_pred double, n_features int, n_selected int"


def leave_one_split_out(features: DataFrame, targets: DataFrame, model: str | Model = "ridge", model_params: dict | None = None, selector: Selector | None = None, permutations: int = 0, scale: bool = True, normalise: bool = False, seed: int = 0) -> DataFrame:
    """All features as one set: sample_id, target_id, perm_id, y_pred, n_features, n_selected.

    Ridge and least squares with at least as many samples as features, and MOST_FEATURES at most, go by products of
    features (see by_products). Else the models and selectors of this module see no sample's features at once: tasks sum
    the products of samples over blocks of features, a fold at a time, scaled by its training rows; tiles of the sums are
    added up over tasks, and a fold is solved on samples x samples (MOST_PRODUCTS at most), for all targets and permuted
    labels together. Every feature has a value for every sample that has a target (else an error); samples without a
    target or without features have no row. Other models and selectors, any functions, need all features of all samples
    in one group, so those are for sets that fit a task.
    """
    fn = MODELS[model](**(model_params or {})) if isinstance(model, str) else model
    if not hasattr(fn, "dual") or not isinstance(selector, (KBest, VarianceAbove, type(None))):
        members = features.select("voxel_id").distinct().select(F.lit(0).cast("long").alias("window_id"), "voxel_id", F.lit(0).alias("pos"))
        return windows_decoding(features, members, targets, fn, None, selector, permutations, scale, normalise, seed).drop("window_id")
    spark = features.sparkSession
    names = features.select("voxel_id").distinct()
    if hasattr(fn, "slopes") and names.count() <= min(count_of(targets, features), MOST_FEATURES):
        cells = names.select(F.lit(0).cast("long").alias("g"), F.col("voxel_id").cast("long"), F.lit(0).cast("long").alias("w"), *[F.lit(0).alias(c) for c in "ijk"])
        return by_products(features, cells, targets, fn, selector, permutations, scale, normalise, seed).drop("w")
    samples, split, y = labels_of(targets, features)
    if not len(samples):
        return spark.createDataFrame([], PREDICTED)
    folds = [f for f in range(split.max() + 1) if (split != f).any()]
    n = len(samples)
    by_feature = feature_rows(features)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """voxel ids and values (sample, feature) of some features."""
        for pdf in batches:
            for at in range(0, len(pdf), FEATURES):
                part = pdf.iloc[at : at + FEATURES]
                x = np.empty((n, len(part)))
                for c, (s, v) in enumerate(zip(part["s"], part["x"])):
                    x[:, c] = in_order(part["voxel_id"].iloc[c], s, v, samples)
                yield part["voxel_id"].to_numpy(np.int64), x

    def of_fold(x: np.ndarray, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """Values less their training mean, over their training deviation; the variances that selectors look at."""
        train = x[split != fold]
        sd = train.std(0)
        z = x - train.mean(0)
        return (z / np.where(sd == 0, 1.0, sd), (sd > 0).astype(float)) if scale else (z, sd**2)

    chosen: dict[int, np.ndarray] | None = None
    if isinstance(selector, KBest):

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = {f: (np.zeros(0, np.int64), np.zeros(0)) for f in folds}
            for voxel, x in blocks(batches):
                for f in folds:
                    z = of_fold(x, f)[0][split != f]
                    v, r = np.concatenate([kept[f][0], voxel]), np.concatenate([kept[f][1], selector.score(z - z.mean(0), y[split != f])])
                    top = np.lexsort((v, -r))[: selector.k]
                    kept[f] = v[top], r[top]
            for f, (v, r) in kept.items():
                yield pd.DataFrame({"fold": f, "voxel_id": v, "r": r})

        place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("r"), "voxel_id"))
        # k rows a fold, from k rows a fold and task.
        top = by_feature.mapInPandas(best, "fold int, voxel_id long, r double").withColumn("place", place).where(F.col("place") <= selector.k).toPandas()
        chosen = {f: np.sort(top.loc[top["fold"] == f, "voxel_id"].to_numpy(np.int64)) for f in folds}

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = {f: np.zeros((n, n)) for f in folds}
        seen, used = 0, dict.fromkeys(folds, 0)
        for voxel, x in blocks(batches):
            seen += len(voxel)
            for f in folds:
                z, var = of_fold(x, f)
                if chosen is not None:
                    z = z[:, np.isin(voxel, chosen[f])]
                elif selector is not None:
                    z = z[:, var > selector.threshold]
                used[f] += z.shape[1]
                gram[f] += z @ z.T
        if seen:
            for f in folds:
                for a in range(0, n, TILE):
                    tiles = [(f, a, b, gram[f][a : a + TILE, b : b + TILE].tobytes(), seen, used[f]) for b in range(a, n, TILE)]
                    yield pd.DataFrame(tiles, columns=["fold", "a", "b", "tile", "seen", "used"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["tile"].iloc[0]).copy()
        for t in pdf["tile"].iloc[1:]:
            total += np.frombuffer(t)
        return pdf.head(1).assign(tile=[total.tobytes()], seen=pdf["seen"].sum(), used=pdf["used"].sum())

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["fold"].iloc[0])
        gram = np.empty((n, n))
        for a, b, t in zip(pdf["a"], pdf["b"], pdf["tile"]):
            part = np.frombuffer(t).reshape(min(TILE, n - a), min(TILE, n - b))
            gram[a : a + TILE, b : b + TILE] = part
            gram[b : b + TILE, a : a + TILE] = part.T
        train, test = np.flatnonzero(split != f), np.flatnonzero(split == f)
        fit = y[train]
        if permutations:
            order = np.stack([training_order(samples[train], p, seed) for p in range(permutations)], 1)
            fit = fit[order].transpose(0, 2, 1).reshape(len(train), -1)
        pred = fn.dual(gram[np.ix_(train, train)], fit, gram[np.ix_(test, train)], gram[test, test]).reshape(len(test), y.shape[1], -1)
        if normalise:
            with np.errstate(all="ignore"):
                pred = (pred - pred.mean((0, 1))) / pred.std((0, 1))
        return predictions(samples[test], pred, int(pdf["seen"].iloc[0]), int(pdf["used"].iloc[0]))

    tiles = by_feature.mapInPandas(products, "fold int, a int, b int, tile binary, seen long, used long")
    found = tiles.groupBy("fold", "a", "b").applyInPandas(added, tiles.schema).groupBy("fold").applyInPandas(solved, PREDICTED)
    found = found.withColumn("y_pred", or_nan(F.col("y_pred")))
    alone = [f for f in range(split.max() + 1) if f not in folds]
    if alone:
        # The only split: nothing to fit on.
        count = by_feature.count()
        rows = [(int(s), t, p, float("nan"), count, 0) for s in samples for t in range(y.shape[1]) for p in range(max(1, permutations))]
        return spark.createDataFrame(rows, PREDICTED)
    return found


def labels_of(targets: DataFrame, features: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample ids in order, their splits as numbers from 0, and targets (sample, target) of the samples that have features.

    They come to the driver: MOST_PRODUCTS rows at most, else an error.
    """
    most = min(MOST_PRODUCTS, MOST_SAMPLES)
    labels = label_rows(targets, features).limit(most + 1).toPandas().sort_values("sample_id")
    if len(labels) > most:
        raise ValueError(f"decoding by products of samples is for {most} samples at most")
    if not len(labels):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1))
    return labels["sample_id"].to_numpy(np.int64), pd.factorize(labels["split_id"], sort=True)[0], np.stack(labels["ys"].to_numpy()).astype(float)


def label_rows(targets: DataFrame, features: DataFrame) -> DataFrame:
    """sample_id, split_id, ys (in order of target) of the samples that have features."""
    targets = targets if "target_id" in targets.columns else targets.withColumn("target_id", F.lit(0))
    known = features.select("sample_id").distinct()
    ys = F.transform(F.array_sort(F.collect_list(F.struct("target_id", F.col("y").cast("double").alias("y")))), lambda s: s["y"])
    return targets.join(known, "sample_id", "left_semi").groupBy("sample_id", "split_id").agg(ys.alias("ys"))


def count_of(targets: DataFrame, features: DataFrame) -> int:
    """How many samples have labels and features: MOST_SAMPLES at most, else an error."""
    n = label_rows(targets, features).count()
    if n > MOST_SAMPLES:
        raise ValueError(f"decoding is for {MOST_SAMPLES} samples at most")
    return n


def feature_rows(features: DataFrame) -> DataFrame:
    """voxel_id, s, x: a row a feature with its samples, in order, and their values; each value is shuffled once."""
    value = F.struct("sample_id", F.col("value").cast("double").alias("value"))
    rows = features.groupBy("voxel_id").agg(F.array_sort(F.collect_list(value)).alias("a"))
    return rows.select("voxel_id", F.transform("a", lambda s: s["sample_id"]).alias("s"), F.transform("a", lambda s: s["value"]).alias("x"))


def in_order(voxel: int, own: np.ndarray, values: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """A feature's values for the samples, by its own sample ids."""
    place = np.minimum(np.searchsorted(own, samples), len(own) - 1)
    if len(own) < len(samples) or not np.array_equal(np.asarray(own)[place], samples):
        raise ValueError(f"feature {voxel} has no value for some samples")
    return np.asarray(values, float)[place]


def joined(a: tuple | None, b: tuple | None) -> tuple | None:
    """Sums of two disjoint sets of rows: their number, means, least, greatest, and products about the means of some columns by all."""
    if a is None or b is None:
        return b if a is None else a
    n, m, low, high, at, p = a
    n2, m2, low2, high2, _, p2 = b
    d = m2 - m
    return n + n2, m + d * (n2 / (n + n2)), np.minimum(low, low2), np.maximum(high, high2), at, p + p2 + np.outer(d[at : at + len(p)], d) * (n * n2 / (n + n2))


def by_products(features: DataFrame, cells: DataFrame, targets: DataFrame, fn: Ridge | LeastSquares, selector: KBest | VarianceAbove | None, permutations: int, scale: bool, normalise: bool, seed: int, radius: int | None = None) -> DataFrame:
    """w and the columns of leave_one_split_out() by products of features, for any number of samples.

    cells has g (a group of features), voxel_id, w, i, j, k: w is the window whose centre a feature is, if any; the window
    is of the group's features within the radius, or of all without one. Tasks sum products of a group's features with
    each other and with the labels over the samples of a split; a fold's are those of the other splits together. Its windows
    are solved from them, and slopes meet the samples again, some thousand at a time. No task holds all samples.
    """
    spark = features.sparkSession
    labels = stored(label_rows(targets, features), "labels")
    # A row a split, in order.
    names = [r[0] for r in labels.select("split_id").distinct().orderBy("split_id").collect()]
    if not names:
        return spark.createDataFrame([], f"w long, {PREDICTED}")
    split = spark.createDataFrame([(n, s) for n, s in enumerate(names)], f"split int, _split {labels.schema['split_id'].dataType.simpleString()}")
    labels = labels.join(F.broadcast(split), labels["split_id"].eqNullSafe(split["_split"])).select("sample_id", "split", "ys")
    first = labels.agg(F.count(F.lit(1)), F.max(F.size("ys"))).first()
    n, n_targets = first[0], first[1]
    folds = range(len(names))
    own = np.dtype(np.float64)
    if permutations:
        fold = F.explode(F.array(*[F.lit(f) for f in folds])) if len(names) > 1 else F.lit(0)
        training = labels.withColumn("fold", fold).where(F.col("fold") != F.col("split"))
        drawn = labels_by_split(training, permutations, seed, split="fold", label="ys").withColumnRenamed("split_id", "fold")
        each = F.transform(F.array_sort(F.collect_list(F.struct("fold", "perm_id", "y"))), lambda s: s["y"])
        labels = labels.join(drawn.groupBy("sample_id").agg(F.flatten(each).alias("yp")), "sample_id", "left").withColumn("yp", F.coalesce("yp", F.array().cast("array<double>")))
    else:
        labels = labels.withColumn("yp", F.col("ys"))
    width = max(1, permutations) * n_targets
    value = F.struct(F.col("voxel_id").cast("long").alias("voxel_id"), F.col("value").cast("double").alias("value"))
    of_cells = features.join(cells.select("g", "voxel_id"), "voxel_id") if radius is not None else features.withColumn("g", F.lit(0).cast("long"))
    per = of_cells.groupBy("g", "sample_id").agg(F.array_sort(F.collect_list(value)).alias("a"))
    known = features.select("voxel_id").distinct()
    cell = F.struct(F.col("voxel_id").cast("long").alias("voxel_id"), "w", "i", "j", "k", "has")
    all_cells = cells.join(known.withColumn("has", F.lit(True)), "voxel_id", "left").withColumn("has", F.coalesce("has", F.lit(False))).groupBy("g").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    all_cells = stored(all_cells, "cells")
    wanted = all_cells.select("g", F.transform(F.filter("cells", lambda c: c["has"]), lambda c: c["voxel_id"]).alias("vs"))
    missing = F.raise_error(F.concat(F.lit("features have no value for some samples, as sample "), F.col("sample_id").cast("string"))).cast("array<double>")
    x = F.when(F.transform("a", lambda s: s["voxel_id"]) == F.col("vs"), F.transform("a", lambda s: s["value"])).otherwise(missing)
    rows = per.join(labels, "sample_id").join(wanted, "g").select("g", "sample_id", "split", "ys", "yp", x.alias("x"))
    bare = wanted.where(F.size("vs") == 0).select("g")
    rows = rows.unionByName(bare.crossJoin(labels).select("g", "sample_id", "split", "ys", "yp", F.array().cast("array<double>").alias("x")))
    rows = stored(rows, "samples")

    def sums(part: pd.DataFrame, s: int) -> tuple:
        x = np.stack(part["x"].to_numpy()).astype(float).reshape(len(part), -1)
        y = np.stack(part["yp"].to_numpy()).astype(float)
        if permutations:
            # No fold is trained on its own split: zeros, which are not used.
            full = np.zeros((len(part), len(names), width))
            full[:, [f for f in folds if f != s]] = y.reshape(len(part), len(names) - 1, width)
            y = full.reshape(len(part), -1)
        z = np.concatenate([x, y, np.stack(part["ys"].to_numpy()).astype(float)[:, :1]], 1)
        m = z.mean(0)
        c = z - m
        return len(part), m, z.min(0), z.max(0), 0, c[:, : x.shape[1]].T @ c

    def tiles(key: tuple, held: tuple) -> pd.DataFrame:
        count, m, low, high, _, p = held
        out = [(*key, a, count, m.tobytes(), low.tobytes(), high.tobytes(), p[a : a + TILE].tobytes()) for a in range(0, max(1, len(p)), TILE)]
        return pd.DataFrame(out, columns=["g", "fold", "a", "n", "mean", "low", "high", "tile"])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for pdf in batches:
            for (g, s), part in pdf.groupby(["g", "split"], sort=False):
                if held is not None and key != (g, s):
                    yield tiles(key, held)
                    held = None
                key, held = (g, s), joined(held, sums(part, s))
        if held is not None:
            yield tiles(key, held)

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of the parts of all splits, the sums of each fold's training rows."""
        if pdf["n"].sum() != n:
            raise ValueError("features have no value for some samples")
        of = dict.fromkeys(folds)
        for r in pdf.sort_values(["fold", "mean"]).itertuples():
            m = np.frombuffer(r.mean, own)
            of[r.fold] = joined(of[r.fold], (r.n, m, np.frombuffer(r.low, own), np.frombuffer(r.high, own), int(r.a), np.frombuffer(r.tile, own).reshape(-1, len(m))))
        after = [None]
        for f in reversed(folds):
            after.append(joined(of[f], after[-1]))
        before, out = None, []
        for f in folds:
            t = joined(before, after[len(names) - 1 - f])
            before = joined(before, of[f])
            out.append((int(pdf["g"].iloc[0]), f, int(pdf["a"].iloc[0]), 0 if t is None else t[0], *[b"" if t is None else t[c].tobytes() for c in (1, 2, 3, 5)]))
        return pd.DataFrame(out, columns=["g", "fold", "a", "n", "mean", "low", "high", "tile"])

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        r, f = pdf.iloc[0], int(pdf["fold"].iloc[0])
        table = np.array([(c["voxel_id"], -1 if c["w"] is None else c["w"], c["i"], c["j"], c["k"], c["has"]) for c in r["cells"]], np.int64)
        have = table[table[:, 5] == 1]
        v = len(have)
        if r["n"]:
            m, low, high = (np.frombuffer(r[c], own) for c in ("mean", "low", "high"))
            full = np.concatenate([np.frombuffer(t, own).reshape(-1, len(m)) for t in pdf["tile"]])
            at = v + (f * width if permutations else 0)
            gram, side, first, mx, my = full[:, :v], full[:, at : at + width], full[:, -1], m[:v], m[at : at + width]
            var = np.where(low[:v] == high[:v], 0.0, np.diag(gram) / r["n"])
            sd = np.where(var == 0, 1.0, np.sqrt(var)) if scale else np.ones(v)
            strength = np.abs(np.divide(first, np.sqrt(var), out=np.zeros(v), where=var > 0)) * float(low[-1] < high[-1])
        windows = [(0, np.arange(v))] if radius is None else [(w, np.flatnonzero((np.abs(have[:, 2:5] - c) <= radius).all(1))) for w, c in zip(table[:, 1], table[:, 2:5]) if w >= 0]
        out = []
        for w, inside in windows:
            keep, b, zero = inside[:0], np.zeros((0, width)), np.full(width, np.nan)
            if r["n"] and len(inside):
                keep = inside
                if isinstance(selector, KBest):
                    # Features that are the same are equals, whatever the rounding of their sums.
                    s = np.round(strength[inside] / max(strength[inside].max(), 1e-300), 12)
                    keep = np.sort(inside[np.argsort(-s, kind="stable")[: selector.k]])
                elif selector is not None:
                    keep = inside[((var[inside] > 0) if scale else var[inside]) > selector.threshold]
                b = fn.slopes(gram[np.ix_(keep, keep)] / np.outer(sd[keep], sd[keep]), side[keep] / sd[keep][:, None]) / sd[keep][:, None]
                zero = my
            # Predictions are slopes by values less their means.
            about = mx[keep] if len(keep) else np.zeros(0)
            out.append((int(r["g"]), f, int(w), keep.astype(np.int64).tobytes(), about.tobytes(), b.tobytes(), np.asarray(zero, float).tobytes(), len(inside), len(keep)))
        return pd.DataFrame(out, columns=["g", "fold", "w", "at", "about", "slopes", "zero", "n_features", "n_selected"])

    def predicted(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["w", "split", *[c.split()[0] for c in PREDICTED.split(", ")]]).astype("float64")
        x, samples, out = np.stack(a["x"].to_numpy()).astype(float).reshape(len(a), -1), a["sample_id"].to_numpy(np.int64), []
        for r in b.itertuples():
            at = np.frombuffer(r.at, np.int64)
            p = (x[:, at] - np.frombuffer(r.about, own)) @ np.frombuffer(r.slopes, own).reshape(len(at), width) + np.frombuffer(r.zero, own)
            each = predictions(samples, p.reshape(len(a), -1, n_targets).transpose(0, 2, 1), r.n_features, r.n_selected)
            each.insert(0, "w", r.w)
            each.insert(1, "split", r.fold)
            out.append(each)
        return pd.concat(out)

    parts = "g long, fold int, a int, n long, mean binary, low binary, high binary, tile binary"
    by_split = rows.sortWithinPartitions("g", "split").select("g", "split", "x", "ys", "yp").mapInPandas(products, parts)
    trained = by_split.groupBy("g", "a").applyInPandas(added, parts).join(all_cells, "g")
    fits = trained.groupBy("g", "fold").applyInPandas(solved, "g long, fold int, w long, at binary, about binary, slopes binary, zero binary, n_features int, n_selected int")
    chunks = max(1, n // (CHUNK * len(names)))
    left = rows.select("g", "split", "sample_id", "x", F.pmod(F.xxhash64("sample_id"), F.lit(chunks)).alias("chunk"))
    right = fits.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    found = left.groupBy("g", "split", "chunk").cogroup(right.groupBy("g", "fold", "chunk")).applyInPandas(predicted, f"w long, split int, {PREDICTED}")
    found = found.withColumn("y_pred", or_nan(F.col("y_pred")))
    if normalise:
        p = F.col("y_pred")
        spread = found.groupBy("w", "split", "perm_id").agg(F.avg(p).alias("_mean"), F.when(F.min(p) < F.max(p), F.stddev_pop(p)).alias("_sd"))
        found = found.join(spread, ["w", "split", "perm_id"]).withColumn("y_pred", or_nan((p - F.col("_mean")) / F.col("_sd")))
    return found.select("w", *[c.split()[0] for c in PREDICTED.split(", ")])


def searchlight_decoding(features: DataFrame, mask: DataFrame, targets: DataFrame, radius: int, stride: int = 1, model: str | Model = "ridge", model_params: dict | None = None, selector: Selector | None = None, permutations: int = 0, scale: bool = True, normalise: bool = False, seed: int = 0, brick: int = 8) -> DataFrame:
    """Leave-one-split-out in the cube around each centre of a mask: the rows of windows_decoding().

    A voxel is one row with its samples as an array. It goes to the brick of the grid that it is in, and to those whose rim
    of `radius` voxels it belongs to; there the windows of the brick's centres are cut, so a value moves about
    (1 + 2 radius / brick) ** 3 times and not once for each window that holds it. Voxels of the mask without features are
    in no window; a window without any is NaN for every sample. Every other voxel has a value for every sample. Where a
    brick's values are more than BRICK_BYTES, ridge and least squares go by products of its features (see by_products);
    other models and selectors are for MOST_PRODUCTS samples at most.
    """
    if radius < 0 or stride <= 0:
        raise ValueError("radius must be 0 or more and stride above 0")
    fn = MODELS[model](**(model_params or {})) if isinstance(model, str) else model
    spark = features.sparkSession
    schema = f"window_id long, {PREDICTED}"
    n, side = count_of(targets, features), brick + 2 * radius
    if not n:
        return spark.createDataFrame([], schema)
    sums = hasattr(fn, "slopes") and isinstance(selector, (KBest, VarianceAbove, type(None))) and n * side**3 * 8 > BRICK_BYTES
    while sums and brick > 1 and (brick + 2 * radius) ** 3 > MOST_FEATURES:
        brick //= 2
    voxels = voxel_ids(mask)
    on = F.lit(True)
    for c in "ijk":
        on &= F.col(c) % stride == 0
    # Windows are numbered as their centres are; at stride 1 that is as the voxels are.
    centres = voxels.where(on).select("i", "j", "k") if stride > 1 else None
    numbered = voxels.join(voxel_ids(centres).withColumnRenamed("voxel_id", "window_id"), ["i", "j", "k"], "left") if stride > 1 else voxels.withColumn("window_id", F.col("voxel_id"))
    rows = numbered if sums else numbered.join(feature_rows(features), "voxel_id", "left")
    for c in "ijk":
        low, high = (F.floor((F.col(c) + d) / brick).cast("int") for d in (-radius, radius))
        rows = rows.withColumn(f"_b{c}", F.explode(F.sequence(low, high)))
    home = F.lit(True)
    for c in "ijk":
        home &= F.floor(F.col(c) / brick).cast("int") == F.col(f"_b{c}")
    rows = rows.withColumn("window_id", F.when(home, F.col("window_id")))
    if sums:
        # Bricks that are nothing but a rim have no windows.
        g = (F.col("_bi").cast("long") * (1 << 21) + F.col("_bj")) * (1 << 21) + F.col("_bk")
        bricks = rows.where("window_id IS NOT NULL").select("_bi", "_bj", "_bk").distinct().withColumn("g", g)
        cells = stored(rows.join(bricks, ["_bi", "_bj", "_bk"]).select("g", "voxel_id", F.col("window_id").alias("w"), "i", "j", "k"), "bricks")
        return by_products(features, cells, targets, fn, selector, permutations, scale, normalise, seed, radius).withColumnRenamed("w", "window_id")
    samples, split, y = labels_of(targets, features)
    flat = y[:, 0] if y.shape[1] == 1 else y

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("voxel_id")
        cells = pdf[["i", "j", "k"]].to_numpy(np.int64)
        have = pdf["x"].notna().to_numpy()
        x = np.stack([in_order(v, s, z, samples) for v, s, z in zip(pdf["voxel_id"][have], pdf["s"][have], pdf["x"][have])], 1) if have.any() else np.zeros((len(samples), 0))
        cells_of, out = cells[have], []
        for w, c in zip(pdf["window_id"], cells):
            if pd.isna(w):
                continue
            inside = (np.abs(cells_of - c) <= radius).all(1)
            if inside.any():
                pred, selected = decode(x[:, inside], flat, split, fn, selector, permutations, scale, normalise, seed, samples)
                used = np.array([selected.get(s, 0) for s in split])
            else:
                pred, used = np.full((*flat.shape, max(1, permutations)), np.nan), 0
            rows = predictions(samples, pred.reshape(len(samples), y.shape[1], max(1, permutations)), int(inside.sum()), used)
            rows.insert(0, "window_id", int(w))
            out.append(rows)
        return pd.concat(out) if out else pd.DataFrame(columns=["window_id", *[f.split()[0] for f in PREDICTED.split(", ")]]).astype("float64")

    found = rows.groupBy("_bi", "_bj", "_bk").applyInPandas(run, schema)
    return found.withColumn("y_pred", or_nan(F.col("y_pred")))


def predictions(samples: np.ndarray, pred: np.ndarray, n_features: int, n_selected) -> pd.DataFrame:
    """The rows of predictions (sample, target, permutation)."""
    n, t, p = pred.shape
    return pd.DataFrame(
        {
            "sample_id": np.repeat(samples, t * p),
            "target_id": np.tile(np.repeat(np.arange(t), p), n),
            "perm_id": np.tile(np.arange(p), n * t),
            "y_pred": pred.ravel(),
            "n_features": n_features,
            "n_selected": np.repeat(np.broadcast_to(n_selected, n), t * p),
        }
    )


def windows_decoding(features: DataFrame, members: DataFrame, targets: DataFrame, model: str | Model = "ridge", model_params: dict | None = None, selector: Selector | None = None, permutations: int = 0, scale: bool = True, normalise: bool = False, seed: int = 0) -> DataFrame:
    """Leave-one-split-out in every window of members (window_id, pos, voxel_id).

    window_id, sample_id, target_id, perm_id, y_pred, n_features, n_selected. Voxel ids that have no features are
    dropped, repeated ones are kept as often. A window that is empty, or that a NULL voxel id announces as empty, gives
    NaN for every sample. Only windows x samples x members rows are shuffled; the labels are sent around if small.
    """
    fn = MODELS[model](**(model_params or {})) if isinstance(model, str) else model
    _warn_of_members(features, members)
    targets = targets if "target_id" in targets.columns else targets.withColumn("target_id", F.lit(0))
    n_labels = targets.count()
    # A row a sample and target; sent around only while small.
    small = n_labels <= 2_000_000
    labels = targets.select("sample_id", "split_id", "target_id", F.col("y").cast("double").alias("y"))
    packed = labels.groupBy("sample_id", "split_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("target_id", "y"))), lambda s: s["y"]).alias("ys"))
    packed = F.broadcast(packed) if small else packed
    rows = members.select("window_id", "pos", "voxel_id").join(features.select("voxel_id", "sample_id", F.col("value").cast("double").alias("value")), "voxel_id")
    per_sample = rows.groupBy("window_id", "sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "voxel_id", "value"))), lambda s: s["value"]).alias("x")).join(packed, "sample_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_id")
        x, y = np.stack(pdf["x"].to_numpy()).astype(float), np.stack(pdf["ys"].to_numpy()).astype(float)
        flat = y[:, 0] if y.shape[1] == 1 else y
        split = pd.factorize(pdf["split_id"], sort=True)[0]
        pred, selected = decode(x, flat, split, fn, selector, permutations, scale, normalise, seed, pdf["sample_id"].to_numpy())
        rows = predictions(pdf["sample_id"].to_numpy(), pred.reshape(len(x), y.shape[1], max(1, permutations)), x.shape[1], np.array([selected.get(s, 0) for s in split]))
        return rows.assign(window_id=int(pdf["window_id"].iloc[0]))[["window_id", *rows.columns]]

    schema = "window_id long, sample_id long, target_id int, perm_id int, y_pred double, n_features int, n_selected int"
    # pandas hands NaN over as NULL
    found = per_sample.groupBy("window_id").applyInPandas(run, schema).withColumn("y_pred", or_nan(F.col("y_pred")))
    empty = members.select("window_id").distinct().join(rows.select("window_id").distinct(), "window_id", "left_anti")
    perms = F.explode(F.sequence(F.lit(0).cast("int"), F.lit(max(1, permutations) - 1).cast("int")))
    blank = empty.join(F.broadcast(labels.select("sample_id", "target_id")) if small else labels.select("sample_id", "target_id")).select("window_id", "sample_id", F.col("target_id").cast("int"), perms.alias("perm_id"), F.lit(float("nan")).alias("y_pred"), F.lit(0).alias("n_features"), F.lit(0).alias("n_selected"))
    return found.unionByName(blank)


def _warn_of_members(features: DataFrame, members: DataFrame) -> None:
    """Warnings for voxel ids without features and for windows that are left empty: three numbers, one row."""
    known = features.select(F.col("voxel_id").alias("_known")).distinct()
    seen = members.join(known, members["voxel_id"] == known["_known"], "left")
    bad = F.col("voxel_id").isNotNull() & F.col("_known").isNull()
    per_window = seen.groupBy("window_id").agg(F.count_if(bad).alias("bad"), F.max(F.when(bad, F.col("voxel_id"))).alias("most"), F.count("_known").alias("good"))
    row = per_window.agg(F.sum("bad").alias("bad"), F.max("most").alias("most"), F.count_if(F.col("good") == 0).alias("empty")).first()
    if row["bad"]:
        warnings.warn(f"{row['bad']} members of windows name voxels without features (the largest is {row['most']}); they are dropped", stacklevel=3)
    if row["empty"]:
        warnings.warn(f"{row['empty']} windows are empty; their predictions are NaN", stacklevel=3)


def one_feature_ridge(features: DataFrame, targets: DataFrame, alpha: float = 1.0, scale: bool = True, normalise: bool = False) -> DataFrame:
    """Ridge on each feature by itself, as sums only: voxel_id, sample_id, split_id, y_pred.

    The training sums of a split are the feature's totals less the split's own, so no sample meets another and there is
    no theta join.
    """
    n_labels = targets.count()
    side = targets.select("sample_id", "split_id", F.col("y").cast("double").alias("y"))
    rows = features.select("voxel_id", "sample_id", F.col("value").cast("double").alias("x")).join(F.broadcast(side) if n_labels <= 2_000_000 else side, "sample_id")
    terms = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y")}
    per_split = rows.groupBy("voxel_id", "split_id").agg(*[F.sum(v).alias(k) for k, v in terms.items()])
    whole = Window.partitionBy("voxel_id")
    rest = per_split.select("voxel_id", "split_id", *[(F.sum(k).over(whole) - F.col(k)).alias(k) for k in terms])
    n, mx, my = F.col("n"), F.try_divide(F.col("sx"), F.col("n")), F.try_divide(F.col("sy"), F.col("n"))
    var = F.greatest(F.lit(0.0), F.col("sxx") / n - mx * mx)
    sd = F.when(var < 1e-24, F.lit(1.0)).otherwise(F.sqrt(var)) if scale else F.lit(1.0)
    cov = F.col("sxy") - n * mx * my
    slope = F.try_divide(cov / sd, n * var / (sd * sd) + F.lit(float(alpha)))
    fit = rest.where(n > 0).select("voxel_id", "split_id", mx.alias("_mx"), my.alias("_my"), sd.alias("_sd"), slope.alias("_b"))
    p = rows.join(fit, ["voxel_id", "split_id"]).select("voxel_id", "sample_id", "split_id", (F.col("_my") + F.col("_b") * (F.col("x") - F.col("_mx")) / F.col("_sd")).alias("y_pred"))
    if normalise:
        fold = Window.partitionBy("voxel_id", "split_id")
        p = p.withColumn("y_pred", F.coalesce(F.try_divide(F.col("y_pred") - F.avg("y_pred").over(fold), F.stddev_pop("y_pred").over(fold)), F.lit(float("nan"))))
    return p
