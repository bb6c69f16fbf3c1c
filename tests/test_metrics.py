import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlattice.operators import decoding, metrics, permutation

NAN = float("nan")


def scores(spark, y, s, split=None):
    return spark.createDataFrame([(n, int(a), float(b), 0 if split is None else split[n]) for n, (a, b) in enumerate(zip(y, s))], "sample_id long, y int, score double, split_id int")


@pytest.mark.parametrize("y, s, auc", [([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75), ([0, 1], [0.5, 0.5], 0.5), ([0, 1, 1, 0, 1], [1, 2, 2, 3, 4], 0.6666667)])
def test_auc(spark, y, s, auc):
    assert metrics.roc_auc(scores(spark, y, s)).first()["auc"] == pytest.approx(auc)
    turned = metrics.roc_auc(scores(spark, [1 - v for v in y], s)).first()["auc"]
    assert turned == pytest.approx(1 - auc)


def test_auc_of_one_class_and_bad_labels(spark):
    assert math.isnan(metrics.roc_auc(scores(spark, [1, 1], [1, 2])).first()["auc"])
    with pytest.raises(Exception, match="0 or 1"):
        metrics.roc_auc(scores(spark, [0, 2], [1, 2])).collect()


def test_average_rank(spark):
    r = metrics.average_rank(scores(spark, [0] * 5, [1, 2, 2, 3, 4])).orderBy("sample_id").collect()
    assert [x["rank"] for x in r] == [1, 2.5, 2.5, 4, 5]
    assert all(math.isnan(x["rank"]) for x in metrics.average_rank(scores(spark, [0, 0], [1, NAN])).collect())


def given_permutations(spark):
    p = ["0101", "1010", "0110", "1001"]
    return spark.createDataFrame([(n, s, int(c)) for n, row in enumerate(p) for s, c in enumerate(row)], "perm_id int, sample_id long, y int")


@pytest.mark.parametrize("metric", ["roc_auc", "callable"])
def test_permutation_test(spark, metric):
    def auc(y, s):
        pos, neg = s[y == 1], s[y == 0]
        return float(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))

    rows = scores(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    r = metrics.metric_permutation_test(rows, given_permutations(spark), auc if metric == "callable" else metric).first()
    assert [r["score"], r["null_mean"], r["null_std"], r["p"]] == pytest.approx([0.75, 0.5, 0.4082483, 0.6])
    assert r["z"] == pytest.approx(0.5244005, abs=1e-6)


def test_one_permutation_has_no_spread(spark):
    rows = scores(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    r = metrics.auc_permutation_test(rows, given_permutations(spark).where("perm_id = 0")).first()
    assert math.isnan(r["null_std"])


def test_permuted_labels_keep_splits(spark):
    split = [0, 0, 0, 1, 1, 2]
    rows = scores(spark, [1, 0, 0, 1, 0, 1], range(6), split)
    p = permutation.permuted_labels(rows, 30).toPandas()
    assert len(p) == 180
    for _, g in p.groupby("perm_id"):
        y = g.sort_values("sample_id")["y"].tolist()
        assert sorted(y[:3]) == [0, 0, 1] and sorted(y[3:5]) == [0, 1] and y[5] == 1
    again = permutation.permuted_labels(rows.repartition(3), 30).toPandas()
    assert p.sort_values(["perm_id", "sample_id"])["y"].tolist() == again.sort_values(["perm_id", "sample_id"])["y"].tolist()
    with pytest.raises(ValueError):
        permutation.permuted_labels(rows, 0)


def test_windowwise_flat_windows_are_nan(spark):
    pred = spark.createDataFrame([(w, s, v) for w, vs in enumerate([(0.1, 0.4, 0.35, 0.8), (1, 1, 1, 1), (NAN,) * 4]) for s, v in enumerate(map(float, vs))], "window_id long, sample_id long, y_pred double")
    t = scores(spark, [0, 0, 1, 1], [0] * 4).select("sample_id", "y")
    got = {r["window_id"]: r for r in metrics.windowwise_metric(pred, t, "roc_auc", given_permutations(spark)).collect()}
    assert got[0]["metric"] == pytest.approx(0.75) and all(math.isnan(got[w][c]) for w in (1, 2) for c in ("metric", "p", "z"))


def vectors(spark, xs, name):
    return [(n, [float(v) for v in np.atleast_1d(x)]) for n, x in enumerate(xs)]


@pytest.mark.parametrize("metric", metrics.DISTANCES)
def test_top_k(spark, metric):
    rng = np.random.default_rng(3)
    c, q = rng.normal(size=(40, 5)), rng.normal(size=(25, 5))
    true = rng.integers(0, 40, 25)
    cands = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(c)], "row_pos long, vec array<double>")
    asks = spark.createDataFrame([(n, int(t), v.tolist()) for n, (t, v) in enumerate(zip(true, q))], "query_id long, true_pos long, vec array<double>")
    got = {r["k"]: r["accuracy"] for r in metrics.top_k_accuracy(cands, asks, [1, 7], metric, block=8).collect()}
    diff = q[:, None] - c[None]
    d = {"euclidean": (diff**2).sum(2), "sqeuclidean": (diff**2).sum(2), "manhattan": abs(diff).sum(2), "cityblock": abs(diff).sum(2), "chebyshev": abs(diff).max(2), "cosine": 1 - (q @ c.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(c, axis=1)}[metric]
    order = d.argsort(1, kind="stable")
    assert got == {k: pytest.approx(np.mean([t in o[:k] for t, o in zip(true, order)])) for k in (1, 7)}


def test_top_k_example(spark):
    cands = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [3.0])], "row_pos long, vec array<double>")
    asks = spark.createDataFrame([(0, 0, [0.9]), (1, 2, [2.2])], "query_id long, true_pos long, vec array<double>")
    assert [r["accuracy"] for r in metrics.top_k_accuracy(cands, asks, [1, 2, 3]).collect()] == [0.5, 1.0, 1.0]
    assert metrics.top_k_accuracy(cands, asks, 2).count() == 1
    for bad in ({"k": 0}, {"k": 1, "metric": "x"}):
        with pytest.raises(ValueError):
            metrics.top_k_accuracy(cands, asks, **bad)


def ridge_rows(spark, x, y, split):
    f = spark.createDataFrame([(0, n, float(v)) for n, v in enumerate(x)], "voxel_id long, sample_id long, value double")
    t = spark.createDataFrame([(n, s, float(v)) for n, (v, s) in enumerate(zip(y, split))], "sample_id long, split_id int, y double")
    return f, t


EXPECTED = [1.17, 2.05, 3.170588, 3.829412, 4.95, 5.83]


def test_one_feature_ridge(spark):
    f, t = ridge_rows(spark, range(1, 7), [1, 3, 2, 5, 4, 6], [0, 0, 1, 1, 2, 2])
    p = lambda df: [r["y_pred"] for r in df.orderBy("sample_id").collect()]
    assert p(decoding.one_feature_ridge(f, t)) == pytest.approx(EXPECTED, abs=1e-6)
    assert p(decoding.leave_one_split_out(f, t)) == pytest.approx(EXPECTED, abs=1e-6)
    assert p(decoding.one_feature_ridge(f, t, normalise=True)) == pytest.approx([-1, 1] * 3)
    assert p(decoding.leave_one_split_out(f, t, normalise=True)) == pytest.approx([-1, 1] * 3)


def test_constant_feature_and_predictions(spark):
    f, t = ridge_rows(spark, [2, 2, 2, 2], [1, 2, 3, 4], [0, 0, 1, 1])
    for df in (decoding.one_feature_ridge(f, t), decoding.leave_one_split_out(f, t)):
        assert [r["y_pred"] for r in df.orderBy("sample_id").collect()] == pytest.approx([3.5, 3.5, 1.5, 1.5])
    assert all(math.isnan(r["y_pred"]) for r in decoding.leave_one_split_out(f, t, normalise=True).collect())


def test_windows_selectors_targets_and_models(spark):
    rng = np.random.default_rng(0)
    x, split = rng.normal(size=(12, 4)), np.repeat(range(3), 4)
    y = x[:, :2] @ np.array([[1.0, 0], [0, 2]]) + 0.1
    f = spark.createDataFrame([(v, s, float(x[s, v])) for v in range(4) for s in range(12)], "voxel_id long, sample_id long, value double")
    t2 = spark.createDataFrame([(s, int(split[s]), k, float(y[s, k])) for s in range(12) for k in range(2)], "sample_id long, split_id int, target_id int, y double")
    members = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 99), (2, 0, -1)], "window_id long, pos int, voxel_id long")
    got = decoding.windows_decoding(f, members, t2, "least_squares").toPandas()
    assert len(got) == 3 * 12 * 2 and got[got.window_id == 2]["y_pred"].isna().all()
    w0 = got[got.window_id == 0].sort_values(["sample_id", "target_id"])["y_pred"].to_numpy().reshape(12, 2)
    assert w0 == pytest.approx(y)
    assert set(got[got.window_id == 1]["n_features"]) == {1}
    t = t2.where("target_id = 0").drop("target_id")
    best = decoding.leave_one_split_out(f, t, selector=decoding.k_best(1)).toPandas()
    assert set(best["n_selected"]) == {1} and set(best["n_features"]) == {4}
    null = decoding.leave_one_split_out(f, t, permutations=3).toPandas()
    assert len(null) == 36 and null.groupby("perm_id")["y_pred"].sum().nunique() == 3
    hard = decoding.leave_one_split_out(f, t.withColumn("y", (F.col("y") > 0).cast("double")), "nearest_mean").toPandas()
    assert set(hard["y_pred"]) <= {0.0, 1.0}


def test_single_split_has_no_training_rows(spark):
    f, t = ridge_rows(spark, range(3), range(3), [0, 0, 0])
    assert all(math.isnan(r["y_pred"]) for r in decoding.leave_one_split_out(f, t).collect())
    assert decoding.one_feature_ridge(f, t).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.integers(3, 8), st.integers(1, 3), st.integers(0, 10**6))
def test_ridge_forms_agree(n, k, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, k + n)), rng.normal(size=n)
    wide = decoding.ridge(0.7)(x, y, x)
    mx = x.mean(0)
    z = x - mx
    b = np.linalg.solve(z.T @ z + 0.7 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert wide == pytest.approx(z @ b + y.mean())
