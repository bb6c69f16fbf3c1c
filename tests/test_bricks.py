"""Components, clusters and enhancement by bricks against whole maps, at several brick sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.operators import bricks, components, permutation, threshold
from voxlattice.sources.shared import stored


def test_components_of_chains_stars_and_many_graphs(spark):
    rng = np.random.default_rng(0)
    links = [("chain", n, n + 1) for n in range(40)] + [("star", 1000, n) for n in range(50)] + [("self", 1, 1)]
    links += [("random", int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [("chain", 3, 2), ("chain", None, 2)]
    got = {}
    for r in components.components(spark.createDataFrame(links, "g string, a long, b long"), ["g"]).collect():
        got[r["g"], r["node"]] = r["root"]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for g, a, b in links:
        if a is not None and a != b:
            u, v = sorted((top((g, a)), top((g, b))))
            root[v] = u
            root.setdefault(u, u)
    want = {(g, x): top((g, x))[1] for g, a, b in links if a is not None and a != b for x in (a, b)}
    assert got == want
    assert components.components(spark.createDataFrame([], "g string, a long, b long"), ["g"]).count() == 0


def field(spark, maps):
    rows = [(m, *map(int, c), float(t[tuple(c)])) for m, t in maps.items() for c in np.argwhere(np.isfinite(t))]
    return spark.createDataFrame(rows, "map_id string, i int, j int, k int, stat double")


def smooth(rng, shape):
    t = rng.normal(size=shape)
    for axis in range(3):
        t = t + np.roll(t, 1, axis)
    return t / 2


@pytest.mark.parametrize("brick", [2, 3, 16])
def test_clusters_do_not_depend_on_bricks(spark, brick):
    rng = np.random.default_rng(1)
    maps = {m: np.where(abs(t) > 0.7, t, np.nan) for m, t in (("a", smooth(rng, (7, 6, 8))), ("b", smooth(rng, (5, 9, 4))))}
    got = {(r["map_id"], r["i"], r["j"], r["k"]): (r["cluster"], r["size"], r["stat"]) for r in threshold.clusters(field(spark, maps), brick=brick).collect()}
    want = {}
    for m, t in maps.items():
        for side in (1, -1):
            cells = np.argwhere(np.nan_to_num(t) * side > 0)
            own = threshold.label_faces(cells)
            size = np.bincount(own)
            want |= {(m, *map(int, c)): (",".join(map(str, cells[o])), int(size[o]), t[tuple(c)]) for c, o in zip(cells, own)}
    assert got == want and max(v[1] for v in want.values()) > 30


def test_negative_places(spark):
    rows = spark.createDataFrame([("m", 0, 0, k, 1.0) for k in (-3, -2, -1, 0, 1, 5)], "map_id string, i int, j int, k int, stat double")
    got = {r["k"]: (r["cluster"], r["size"]) for r in threshold.clusters(rows, brick=2).collect()}
    assert got == {k: ("0,0,-3", 5) for k in range(-3, 2)} | {5: ("0,0,5", 1)}


def tree_sums(spark, maps, brick, steps):
    weights = bricks.tfce_weights(steps)
    rows = [(m, s, *map(int, c), int(n)) for m, t in maps.items() for s in (1, -1) if (s * t).max() > 0 for c, n in zip(np.argwhere(np.isfinite(t)), threshold.levels((s * t).ravel(), (s * t).max() / steps, steps))]
    frame = spark.createDataFrame(rows, "map_id string, side int, i int, j int, k int, level int")
    made = stored(bricks.pieces_of_rows(frame, "map_id", weights, brick), "pieces")
    inner, voxels = bricks.merged(made, "map_id", weights)
    return inner, bricks.voxel_values(inner, voxels, "map_id")


@pytest.mark.parametrize("brick", [2, 3, 16])
def test_enhancement_equals_the_sum_over_heights(spark, brick):
    rng = np.random.default_rng(2)
    maps = {"a": smooth(rng, (7, 6, 8)), "b": smooth(rng, (5, 9, 4)), "plateau": np.ones((4, 3, 5)), "none": -np.ones((3, 3, 3))}
    inner, found = tree_sums(spark, maps, brick, 40)
    got = {(r["map_id"], r["side"], r["i"], r["j"], r["k"]): r["value"] for r in found.collect()}
    most = {(r["map_id"], r["side"]): r["most"] for r in inner.groupBy("map_id", "side").agg(F.max(F.col("base") + F.col("best")).alias("most")).collect()}
    for m, t in maps.items():
        for side in (1, -1):
            if (side * t).max() <= 0:
                assert (m, side) not in most
                continue
            cells = np.argwhere(np.isfinite(t))
            unit = ((side * t).max() / 40) ** 3
            want = threshold.tfce((side * t).ravel(), cells, 40)
            assert [got.get((m, side, *map(int, c)), 0.0) * unit for c in cells] == pytest.approx(want.tolist(), rel=1e-9)
            assert most[m, side] * unit == pytest.approx(want.max(), rel=1e-9)


def plain_fwer(values, n_perm, statistic, tail, cluster_p):
    """t and p with whole maps in memory."""
    images = sorted(values)
    y = np.stack([values[i].ravel() for i in images], 1)
    cells = np.argwhere(np.ones(values[images[0]].shape, bool))
    n, turn = len(images), -1.0 if tail == "lt" else 1.0
    signs = np.column_stack([np.ones(n), permutation.sign_matrix(images, n_perm)])
    maps = (turn * permutation._t_values(y, signs, n - 1)).T
    height = permutation.critical_value(cluster_p / 2 if tail == "two_sided" else cluster_p) if cluster_p else None

    def enhanced(t):
        out = np.zeros(len(t))
        for s in (1, -1) if tail == "two_sided" else (1,):
            if statistic == "max_tfce":
                out = np.maximum(out, threshold.tfce(s * t, cells))
            else:
                up = s * t >= height
                own = threshold.label_faces(cells[up])
                out[up] = np.bincount(own, minlength=len(own))[own]
        return out

    e = [enhanced(t) for t in maps]
    null = np.array([x.max() for x in e[1:]])
    return maps[0], (1 + (null[:, None] >= e[0] - 1e-9).sum(0)) / (n_perm + 1)


@pytest.mark.parametrize("statistic,tail", [("max_size", "two_sided"), ("max_size", "lt"), ("max_tfce", "two_sided"), ("max_tfce", "gt")])
def test_fwer_by_bricks_against_whole_maps(spark, statistic, tail):
    rng = np.random.default_rng(3)
    values = {f"s{n}": smooth(rng, (5, 4, 6)) + 0.4 * (np.indices((5, 4, 6))[0] > 2) for n in range(8)}
    rows = spark.createDataFrame([(n, *map(int, c), float(v[tuple(c)])) for n, v in values.items() for c in np.argwhere(np.isfinite(v))], "img_id string, i int, j int, k int, value double")
    cluster_p = 0.2 if statistic == "max_size" else None
    t, p = plain_fwer(values, 12, statistic, tail, cluster_p)
    for brick, block in ((2, 5), (3, 256), (16, 4)):
        got = permutation.fwer(rows, 12, statistic, tail, cluster_p=cluster_p, brick=brick, block=block).toPandas().sort_values(["i", "j", "k"])
        assert got["t"].to_numpy() == pytest.approx(t) and got["p"].to_numpy() == pytest.approx(p)
        assert got["logp"].to_numpy() == pytest.approx(-np.log10(p))


def test_voxels_with_missing_values_have_p_one(spark):
    rows = [(f"s{n}", 0, 0, k, math.nan if (n, k) == (0, 2) else float(n + k + 1)) for n in range(4) for k in range(4)]
    frame = spark.createDataFrame(rows, "img_id string, i int, j int, k int, value double")
    for statistic in permutation.STATISTICS:
        got = {r["k"]: r for r in permutation.fwer(frame, 7, statistic, "gt", cluster_p=0.1).collect()}
        assert len(got) == 4 and math.isnan(got[2]["t"]) and got[2]["p"] == 1.0 and got[0]["p"] < 1.0


def test_no_group_holds_a_map(spark):
    """A map of 216,000 voxels: tasks have bricks, and the largest group is a brick."""
    n = 60
    rows = spark.range(n**3).select(F.lit("m").alias("map_id"), F.lit(1).alias("side"), (F.col("id") / n**2).cast("int").alias("i"), (F.col("id") / n % n).cast("int").alias("j"), (F.col("id") % n).cast("int").alias("k"))
    rows = rows.withColumn("level", F.pmod(F.xxhash64("i", "j", "k"), F.lit(4)).cast("int"))
    made = stored(bricks.pieces_of_rows(rows, "map_id", bricks.tfce_weights(3), 16), "pieces")
    assert made.where("kind = 3").groupBy(*[F.floor(c / 16) for c in bricks.unpacked(F.col("cell"))]).count().agg(F.max("count")).first()[0] <= 16**3
    inner, voxels = bricks.merged(made, "map_id", bricks.tfce_weights(3))
    found = bricks.voxel_values(inner, voxels, "map_id")
    # Level 1 is above the threshold of percolation: one component holds nearly all of it, over all bricks.
    own = threshold.label_faces(np.argwhere(np.array([r[0] for r in rows.orderBy("i", "j", "k").select("level").collect()]).reshape(n, n, n) >= 1))
    assert found.where("value > 0").count() == len(own)
    least = np.sqrt(np.bincount(own).max())
    assert found.where(F.col("value") >= least - 1e-9).count() >= np.bincount(own).max()
