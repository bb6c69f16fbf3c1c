"""Decoding of more samples than whose products with each other fit a task."""

import numpy as np
import pytest

from voxlattice.operators import decoding


def wide(spark, x, y, split):
    n, v = x.shape
    rows = [(s, int(split[s]), [float(a) for a in x[s]], [float(b) for b in y[s]]) for s in range(n)]
    t = spark.createDataFrame(rows, "sample_id long, split_id int, x array<double>, y array<double>")
    f = t.selectExpr("sample_id", "posexplode(x) AS (p, value)").selectExpr("CAST(p AS long) AS voxel_id", "sample_id", "value")
    return f, t.selectExpr("sample_id", "split_id", "posexplode(y) AS (target_id, y)")


def test_more_samples_than_a_task_has_products_for(spark):
    rng = np.random.default_rng(1)
    n = 20_050
    x, split = rng.normal(size=(n, 3)) + 1e3, rng.integers(0, 3, n)
    y = x[:, :1] + rng.normal(size=(n, 1))
    f, t = wide(spark, x, y, split)
    want, _ = decoding.decode(x, y[:, 0], split, decoding.ridge())
    got = decoding.leave_one_split_out(f, t).toPandas().sort_values("sample_id")
    assert got["sample_id"].tolist() == list(range(n))
    assert got["y_pred"].to_numpy() == pytest.approx(want, abs=1e-7)
    mask = spark.createDataFrame([(0, 0, k) for k in range(3)], "i int, j int, k int")
    want, _ = decoding.decode(x[:, :2], y[:, 0], split, decoding.ridge())
    got = decoding.searchlight_decoding(f, mask, t, 1).where("window_id = 0").toPandas().sort_values("sample_id")
    assert got["y_pred"].to_numpy() == pytest.approx(want, abs=1e-7) and set(got["n_features"]) == {2}


@pytest.mark.parametrize("radius,stride,brick,options", [(1, 1, 2, {}), (2, 2, 3, {"permutations": 2, "normalise": True}), (0, 1, 8, {"model": "least_squares", "scale": False})])
def test_searchlights_by_products_agree_with_bricks(spark, monkeypatch, radius, stride, brick, options):
    rng = np.random.default_rng(2)
    n, cells = 60, [(i, j, k) for i in range(4) for j in range(3) for k in range(5) if (i, j, k) != (1, 1, 1)]
    mask = spark.createDataFrame(cells, "i int, j int, k int")
    x, split = rng.normal(size=(n, len(cells))), rng.integers(0, 3, n)
    f, t = wide(spark, x, x[:, [5, 7]] + rng.normal(size=(n, 2)), split)
    # The voxels of a corner have no features.
    f = f.where("voxel_id NOT IN (0, 1, 5)")
    key = ["window_id", "sample_id", "target_id", "perm_id"]
    want = decoding.searchlight_decoding(f, mask, t, radius, stride, brick=brick, **options).toPandas().sort_values(key).reset_index(drop=True)
    monkeypatch.setattr(decoding, "BRICK_BYTES", 0)
    monkeypatch.setattr(decoding, "TILE", 7)
    monkeypatch.setattr(decoding, "CHUNK", 7)
    got = decoding.searchlight_decoding(f, mask, t, radius, stride, brick=brick, **options).toPandas().sort_values(key).reset_index(drop=True)
    assert got[key].equals(want[key])
    assert got["y_pred"].to_numpy() == pytest.approx(want["y_pred"].to_numpy(), abs=1e-7, nan_ok=True)
    assert got[["n_features", "n_selected"]].astype(int).equals(want[["n_features", "n_selected"]].astype(int))


def test_features_that_are_the_same_are_equals(spark):
    rng = np.random.default_rng(3)
    x, split = rng.normal(size=(40, 6)), np.arange(40) % 4
    x[:, 4] = x[:, 2]
    f, t = wide(spark, x, x[:, 2:3] + 0.1 * rng.normal(size=(40, 1)), split)
    want, _ = decoding.decode(x, np.array([r["y"] for r in t.orderBy("sample_id").collect()]), split, decoding.ridge(), decoding.k_best(1))
    got = decoding.leave_one_split_out(f, t, selector=decoding.k_best(1)).toPandas().sort_values("sample_id")
    assert got["y_pred"].to_numpy() == pytest.approx(want, abs=1e-7)
