import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.functions.elementwise import fisher_z, masked, transformation_tag
from voxlattice.functions.normal import upper_quantile, upper_tail
from voxlattice.operators import threshold, volumes

NAN = float("nan")


def voxel_rows(spark, images):
    return spark.createDataFrame([(str(n), 0, 0, k, float(v)) for n, img in enumerate(images) for k, v in enumerate(img)], "img_id string, i int, j int, k int, value double")


def by_k(df, col):
    return [r[col] for r in sorted(df.collect(), key=lambda r: r["k"])]


def test_moments(spark):
    m = volumes.moments(voxel_rows(spark, [(1, 2, NAN, NAN), (2, NAN, NAN, math.inf), (6, 4, 5, NAN)])).cache()
    assert by_k(m, "n") == [3, 2, 1, 0]
    assert by_k(m, "mean") == [3.0, 3.0, 5.0, 0.0]
    std = by_k(m, "std")
    assert std[:2] == pytest.approx([2.6457513, 1.4142136]) and all(map(math.isnan, std[2:]))


def test_moments_outside_base_mask(spark):
    base = spark.createDataFrame([(0, 0, 1)], "i int, j int, k int")
    m = volumes.moments(voxel_rows(spark, [(1, 2), (3, 4)]), base)
    assert by_k(m, "n") == [0, 2]


def test_validity_mask(spark):
    v = voxel_rows(spark, [(1, 2, 5), (2, NAN, 5), (6, 4, 5)])
    assert by_k(volumes.validity_mask(v, 0.5), "in_mask") == [True, False, False]
    assert by_k(volumes.validity_mask(v, 0.5, 2), "in_mask") == [True, True, False]
    with pytest.raises(ValueError):
        volumes.validity_mask(v, -1)
    with pytest.raises(ValueError):
        volumes.validity_mask(v, 0, 0)


def test_fisher_z(spark):
    df = spark.createDataFrame([(0.5,), (-0.25,), (1.0,), (NAN,)], "x double")
    z = [r[0] for r in df.select(fisher_z(F.col("x"))).collect()]
    assert z[:3] == pytest.approx([0.5493061443, -0.2554128119, 8.4056213910]) and math.isnan(z[3])
    with pytest.raises(Exception, match="Fisher"):
        df.select(fisher_z(F.col("x"), clip=False)).collect()


def test_transformation_tag():
    assert [transformation_tag(x) for x in (None, "none", " FisherZ ", "fisher-z")] == ["", "", "_fisherz", "_fisherz"]
    with pytest.raises(ValueError):
        transformation_tag("log")


def test_masked(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (NAN, True), (3.0, None)], "v double, m boolean")
    assert [r[0] for r in df.select(masked(F.col("v"), F.col("m"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_one_sample_t(spark):
    t = by_k(volumes.one_sample_t(voxel_rows(spark, [(1, 5, 1), (2, 5, NAN), (6, 5, 2)])), "t")
    assert t[0] == pytest.approx(1.9639610) and t[1] == math.inf and math.isnan(t[2])


def test_ols(spark):
    v = voxel_rows(spark, [(1,), (2,), (2,), (4,)])
    d = volumes.with_intercept(spark.createDataFrame([(str(n), str(n)) for n in range(4)], "img_id string, c string"), ["c"])
    r = volumes.ols(v, d, ["intercept", "c"]).first()
    assert [r["beta_intercept"], r["beta_c"]] == pytest.approx([0.9, 0.9])
    assert [r["t_intercept"], r["t_c"]] == pytest.approx([1.8182746, 3.4016803])


def test_design_errors(spark):
    d = spark.createDataFrame([("a", "x", "1"), ("b", "2", None)], "img_id string, c string, e string")
    with pytest.raises(ValueError, match="numbers"):
        volumes.with_intercept(d, ["c", "e"])
    with pytest.raises(ValueError, match="intercept"):
        volumes.with_intercept(d.withColumnRenamed("c", "Intercept"), ["Intercept"])


def test_normal(spark):
    df = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 0.5, 1.6448536, 5.0)], "x double")
    for x, p in df.select("x", upper_tail(F.col("x"))).collect():
        assert p == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), rel=2e-7)
    qs = [1e-300, 1e-8, 0.01, 0.3, 0.5, 0.9, 0.999]
    from statistics import NormalDist

    got = [r[0] for r in spark.createDataFrame([(q,) for q in qs], "q double").select(upper_quantile(F.col("q"))).collect()]
    assert got[1:] == pytest.approx([-NormalDist().inv_cdf(q) for q in qs[1:]], abs=1e-7) and 36 < got[0] < 38


def stats(spark, z):
    return spark.createDataFrame([("m", 0, 0, k, float(v)) for k, v in enumerate(z)], "map_id string, i int, j int, k int, stat double")


def test_heights(spark):
    s = stats(spark, [4, 3, 2.5, 1, 0.5, -3])
    h = lambda **o: threshold.height_thresholds(s, **o).first()["height"]
    assert h(two_sided=False) == pytest.approx(2.5)
    assert h(two_sided=True) == pytest.approx(2.5)
    assert [h(height_control="fpr", two_sided=b) for b in (False, True)] == pytest.approx([1.6448536, 1.9599640])
    assert h(height_control="bonferroni", two_sided=False) == pytest.approx(2.3939798, abs=1e-6)
    assert h(height_control=None, threshold=1.5) == 1.5
    assert threshold.height_thresholds(stats(spark, [0.1, 0.2])).first()["height"] == math.inf
    for bad in ({"height_control": "x"}, {"height_control": None}):
        with pytest.raises(ValueError):
            threshold.height_thresholds(s, **bad)


def test_thresholded_two_sided_and_turned(spark):
    s = stats(spark, [4, 3, 2.5, 1, NAN, -3])
    assert by_k(threshold.thresholded(s), "stat") == [4, 3, 2.5, 0, 0, -3]
    gt, lt = by_k(threshold.thresholded(s, two_sided=False), "stat"), by_k(threshold.thresholded(s, two_sided=False, sign=-1), "stat")
    assert lt == [0, 0, 0, 0, 0, 3] and not any(a and b for a, b in zip(gt, lt))


def test_cluster_extent_by_sign(spark):
    s = stats(spark, [5, 5, 5, -5, -5, 5])
    kept = by_k(threshold.thresholded(s, height_control=None, threshold=1.0, cluster_threshold=3), "stat")
    assert kept == [5, 5, 5, 0, 0, 0]


def test_label_faces_against_search():
    rng = np.random.default_rng(1)
    cells = np.argwhere(rng.random((6, 6, 6)) < 0.35)
    label = threshold.label_faces(cells)
    where, seen, expected = {tuple(c): n for n, c in enumerate(cells)}, set(), [None] * len(cells)
    for n, c in enumerate(map(tuple, cells)):
        stack = [c] if c not in seen else []
        while stack:
            x = stack.pop()
            if x in seen:
                continue
            seen.add(x)
            expected[where[x]] = n
            for axis in range(3):
                for d in (-1, 1):
                    y = tuple(v + d * (a == axis) for a, v in enumerate(x))
                    if y in where:
                        stack.append(y)
    assert label.tolist() == expected
    assert len(threshold.label_faces(np.zeros((0, 3), int))) == 0


def test_tfce_is_larger_in_clusters():
    cells = np.array([[0, 0, 0], [0, 0, 1], [0, 0, 2], [5, 5, 5]])
    e = threshold.tfce(np.array([2.0, 2, 2, 2]), cells)
    assert e[0] > e[3] > 0 and not threshold.tfce(np.array([-1.0, 0]), cells[:2]).any()
