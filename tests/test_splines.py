"""Cubic B-splines: the recursion against the linear system, values at voxels, and polynomials."""

import numpy as np
import pytest

from voxlattice.operators import grid


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40])
def test_recursion_solves_the_mirrored_system(n):
    f = np.random.default_rng(n).normal(size=(3, n))
    a = np.zeros((n, n))
    for i in range(n):
        for d, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            j = abs(i + d) if n > 1 else 0
            a[i, 2 * (n - 1) - j if j > n - 1 else j] += w
    assert grid._spline_lines(f) @ a.T == pytest.approx(f)


def rows(spark, value, shape, name="a"):
    cells = np.argwhere(np.ones(shape, bool))
    return spark.createDataFrame([(name, *map(int, c), float(value(*c))) for c in cells], "img_id string, i int, j int, k int, value double")


def sampled(found):
    return {(r["i"], r["j"], r["k"]): r["value"] for r in found.collect()}


def shifted(shape, step, move):
    return grid.Grid(shape, ((step, 0.0, 0.0, move), (0.0, step, 0.0, move), (0.0, 0.0, step, move), (0.0, 0.0, 0.0, 1.0)))


def test_cubic_polynomials_are_reproduced_inside(spark):
    p = lambda x, y, z: 1 + x - 0.5 * y**2 + 0.01 * z**3 + 0.02 * x * y * z
    source = grid.Grid((24, 24, 24))
    # The mirror at the ends is felt by a factor of 0.27 less a voxel.
    target = shifted((3, 3, 3), 0.37, 11.1)
    got = sampled(grid.resampled(rows(spark, p, (24, 24, 24)), source, target, "spline"))
    assert all(v == pytest.approx(p(*(11.1 + 0.37 * np.array(c))), abs=2e-4) for c, v in got.items()) and len(got) == 27


def test_voxels_keep_their_values_and_outside_is_zero(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=(4, 1, 3))
    both = rows(spark, lambda *c: f[c], f.shape).unionByName(rows(spark, lambda *c: 2 * f[c], f.shape, "b"))
    got = grid.resampled(both, grid.Grid(f.shape), shifted((6, 1, 5), 1.0, 0.0), "bspline").collect()
    for r in got:
        c = (r["i"], r["j"], r["k"])
        want = f[c] * (1 if r["img_id"] == "a" else 2) if all(x < n for x, n in zip(c, f.shape)) else 0.0
        assert r["value"] == pytest.approx(want)
    assert len(got) == 60


def test_missing_values_count_as_zero(spark):
    one = rows(spark, lambda *c: np.nan if c == (1, 1, 1) else 1.0, (3, 3, 3))
    got = sampled(grid.resampled(one, grid.Grid((3, 3, 3)), grid.Grid((3, 3, 3)), "bspline"))
    assert got[1, 1, 1] == pytest.approx(0.0) and got[0, 0, 0] == pytest.approx(1.0)
