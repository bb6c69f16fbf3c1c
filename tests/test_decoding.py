"""Whole feature sets by products of samples against the same models on all features at once."""

import math
import warnings

import numpy as np
import pytest

from voxlattice.operators import decoding


def rows(spark, x, y, split, parts=5):
    n, v = x.shape
    f = spark.createDataFrame([(10 * a, s, float(x[s, a])) for a in range(v) for s in range(n)], "voxel_id long, sample_id long, value double").repartition(parts)
    y = y.reshape(n, -1)
    t = spark.createDataFrame([(s, int(split[s]), k, float(y[s, k])) for s in range(n) for k in range(y.shape[1])], "sample_id long, split_id int, target_id int, y double")
    return f, t


def cube(found, n):
    p = found.toPandas().sort_values(["sample_id", "target_id", "perm_id"])
    return p, p["y_pred"].to_numpy().reshape(n, -1)


SELECTORS = {"all": None, "best": decoding.k_best(3), "varying": decoding.variance_above(0.0)}


@pytest.mark.parametrize("model,params", [("ridge", {"alpha": 2.0}), ("least_squares", None), ("nearest_mean", None)])
@pytest.mark.parametrize("selector", SELECTORS)
def test_products_agree_with_all_features_at_once(spark, monkeypatch, model, params, selector):
    monkeypatch.setattr(decoding, "TILE", 7)
    monkeypatch.setattr(decoding, "FEATURES", 4)
    rng = np.random.default_rng(5)
    for n, v, targets, scale, normalise, perms in ((24, 9, 1, True, False, 0), (24, 40, 2, True, model != "nearest_mean", 4), (20, 11, 1, False, False, 3)):
        x = rng.normal(size=(n, v)) * rng.uniform(0.5, 3, v) + 5
        x[:, 4] = 2.0
        y = x[:, :targets] + 0.3 * rng.normal(size=(n, targets))
        y = (y > np.median(y)).astype(float) if model == "nearest_mean" else y
        split = rng.permutation(np.arange(n) % 4)
        fn = decoding.MODELS[model](**(params or {}))
        want, chosen = decoding.decode(x, y[:, 0] if targets == 1 else y, split, fn, SELECTORS[selector], perms, scale, normalise)
        f, t = rows(spark, x, y, split)
        got, p = cube(decoding.leave_one_split_out(f, t, model, params, SELECTORS[selector], perms, scale, normalise), n)
        assert p == pytest.approx(want.reshape(n, -1), abs=1e-7)
        assert set(got["n_features"]) == {v}
        assert got.groupby("sample_id")["n_selected"].first().tolist() == [chosen[s] for s in split]


def test_other_functions_still_see_all_features(spark):
    rng = np.random.default_rng(6)
    x, split = rng.normal(size=(12, 3)), np.arange(12) % 3
    f, t = rows(spark, x, x[:, 0], split)
    size = lambda train, y, test: np.full(len(test), float(train.shape[1]))
    assert set(cube(decoding.leave_one_split_out(f, t, size), 12)[1].ravel()) == {3.0}
    odd = lambda train, y: np.array([True, False, True])
    assert set(decoding.leave_one_split_out(f, t, selector=odd).toPandas()["n_selected"]) == {2}


def test_samples_without_targets_or_features_have_no_row(spark):
    rng = np.random.default_rng(7)
    x, split = rng.normal(size=(12, 3)), np.arange(12) % 3
    f, t = rows(spark, x, x[:, 0], split)
    found = decoding.leave_one_split_out(f.where("sample_id <> 4"), t.where("sample_id <> 7")).toPandas()
    keep = np.array([s not in (4, 7) for s in range(12)])
    want, _ = decoding.decode(x[keep], x[keep, 0], split[keep], decoding.ridge())
    assert found.sort_values("sample_id")["sample_id"].tolist() == np.flatnonzero(keep).tolist()
    assert found.sort_values("sample_id")["y_pred"].to_numpy() == pytest.approx(want)
    with pytest.raises(Exception, match="no value for some samples"):
        decoding.leave_one_split_out(f.where("NOT (sample_id = 4 AND voxel_id = 10)"), t).collect()
    assert decoding.leave_one_split_out(f.where("false"), t).count() == 0


def test_too_many_samples_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(decoding, "MOST_SAMPLES", 5)
    f, t = rows(spark, np.ones((6, 1)), np.ones(6), np.arange(6) % 2)
    with pytest.raises(ValueError, match="samples at most"):
        decoding.leave_one_split_out(f, t)


def test_no_task_sees_more_than_blocks_of_features(spark):
    """No group of the plan has all features: groups are a feature, a tile, and a fold's tiles."""
    rng = np.random.default_rng(8)
    f, t = rows(spark, rng.normal(size=(10, 6)), rng.normal(size=10), np.arange(10) % 2)
    plan = decoding.leave_one_split_out(f, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "window_id" not in plan and plan.count("FlatMapGroupsInPandas") == 2 and "MapInPandas" in plan


def test_one_split_only(spark):
    f, t = rows(spark, np.ones((3, 2)), np.arange(3.0), np.zeros(3))
    found = decoding.leave_one_split_out(f, t, permutations=2).collect()
    assert len(found) == 6 and all(math.isnan(r["y_pred"]) and r["n_selected"] == 0 and r["n_features"] == 2 for r in found)


@pytest.mark.parametrize("radius,stride,brick", [(1, 1, 2), (1, 2, 3), (2, 1, 8), (0, 3, 2)])
def test_searchlights_by_bricks_agree_with_windows(spark, radius, stride, brick):
    from voxlattice.operators import windows

    rng = np.random.default_rng(9)
    cells = [c for c in np.ndindex(4, 3, 5) if rng.random() < 0.8]
    mask = spark.createDataFrame([tuple(map(int, c)) for c in cells], "i int, j int, k int")
    x, split = rng.normal(size=(12, len(cells))), np.arange(12) % 3
    f = spark.createDataFrame([(v, s, float(x[s, v])) for v in range(len(cells)) for s in range(12) if v not in (3, 4)], "voxel_id long, sample_id long, value double")
    t = spark.createDataFrame([(s, int(split[s]), float(x[s, 5])) for s in range(12)], "sample_id long, split_id int, y double")
    members = windows.searchlight_members(mask, radius, stride)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = decoding.windows_decoding(f, members.select("window_id", "pos", "voxel_id"), t).toPandas()
    got = decoding.searchlight_decoding(f, mask, t, radius, stride, brick=brick).toPandas()
    key = ["window_id", "sample_id", "target_id", "perm_id"]
    a, b = (p.sort_values(key).reset_index(drop=True) for p in (got, want))
    assert a[key].astype("int64").equals(b[key].astype("int64"))
    assert a["y_pred"].to_numpy(float) == pytest.approx(b["y_pred"].to_numpy(float), abs=1e-9, nan_ok=True)
    assert (a["n_features"].to_numpy() == b["n_features"].to_numpy()).all() and (a["n_selected"].to_numpy() == b["n_selected"].to_numpy()).all()
    centres = {tuple(r) for r in windows.searchlight_centres(mask, stride).collect()}
    assert centres == {(r["window_id"], r["ci"], r["cj"], r["ck"]) for r in members.select("window_id", "ci", "cj", "ck").distinct().collect()}
