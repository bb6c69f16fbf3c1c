"""Nearest neighbours by cells around pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.operators import metrics


def frames(spark, c, q, true, parts=3):
    cands = spark.createDataFrame([(3 * n, v.tolist()) for n, v in enumerate(c)], "row_pos long, vec array<double>").repartition(parts)
    asks = spark.createDataFrame([(n, None if t is None else 3 * int(t), v.tolist()) for n, (t, v) in enumerate(zip(true, q))], "query_id long, true_pos long, vec array<double>")
    return cands, asks


@pytest.mark.parametrize("metric", metrics.DISTANCES)
@pytest.mark.parametrize("cell,block", [(1, 4), (20, 7), (1024, 4096)])
def test_counts_agree_with_all_pairs(spark, metric, cell, block):
    rng = np.random.default_rng(4)
    c = rng.normal(size=(6, 5))[rng.integers(0, 6, 150)] * 4 + rng.normal(size=(150, 5))
    c[10:40] = c[10]
    c[50] = 0
    true = rng.integers(0, 150, 40)
    q = c[true] + rng.normal(size=(40, 5)) * rng.uniform(0, 2, 40)[:, None]
    q[3] = 0
    cands, asks = frames(spark, c, q, true)
    found = {r["query_id"]: r["n_nearer"] for r in metrics.nearer_candidates(cands, asks, 7, metric, block, cell).collect()}
    for n, (v, t) in enumerate(zip(q, true)):
        d = metrics._distances(c, v[None], metric)
        want = int(((d < d[t]) | ((d == d[t]) & (np.arange(150) < t))).sum())
        # exact up to what is asked for
        assert min(found[n], 7) == min(want, 7)


def test_most_pairs_of_clustered_vectors_are_not_compared(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 8)) * 30
    c = centre[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 8))
    true = rng.integers(0, 2000, 200)
    cands, asks = frames(spark, c, c[true] + 0.1 * rng.normal(size=(200, 8)), true)
    found = metrics.nearer_candidates(cands, asks, 10, cell=20)
    share = found.agg(F.sum("n_compared")).first()[0] / (2000 * 200)
    assert share < 0.15
    assert found.where("n_nearer < 5").count() > 150


def test_queries_without_their_candidate_miss(spark):
    cands, asks = frames(spark, np.eye(3), np.eye(3), [0, 9, None])
    assert [r["n_nearer"] for r in metrics.nearer_candidates(cands, asks, 2).orderBy("query_id").collect()] == [0, None, None]
    assert metrics.top_k_accuracy(cands, asks, 1).first()["accuracy"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_queries_with_enough_go_no_further(spark, metric):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(3000, 16))
    true = rng.integers(0, 3000, 100)
    # Their own candidate is as far as any other.
    cands, asks = frames(spark, c, rng.normal(size=(100, 16)), true)
    found = metrics.nearer_candidates(cands, asks, 3, metric, 64, 100)
    assert found.agg(F.sum("n_compared")).first()[0] / (3000 * 100) < 0.3
    assert found.where("n_nearer >= 3").count() > 90


def test_a_candidate_that_is_no_number_hides_no_other(spark):
    c = np.arange(12.0)[:, None] * np.ones((1, 2))
    c[4] = np.nan
    cands, asks = frames(spark, c, np.full((1, 2), 3.4), [6])
    for metric in ("euclidean", "manhattan"):
        # 3, 2, 5 and 1 are nearer than 6
        assert metrics.nearer_candidates(cands, asks, 9, metric, cell=100).first()["n_nearer"] == 4
