"""Running totals, ranks and permuted labels without a task that holds a group."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.operators import metrics, ordering, permutation


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals(spark, by):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else rng.choice(["b", None]), k, rng.randrange(5)) for k in rng.sample(range(1000), 300)] + [("a", None, 3)]
    got = ordering.running_total(spark.createDataFrame(rows, "g string, k int, w int"), by, ["k"], F.col("w")).collect()
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    for r in got:
        assert r["before"] == sum(w for g, k, w in order[: order.index((r["g"], r["k"], r["w"]))] if not by or g == r["g"])
    assert len(got) == len(rows)


def plain_rank(s):
    return [sum(b < a for b in s) + (sum(b == a for b in s) + 1) / 2 for a in s]


def test_ranks_and_auc_of_a_whole_table(spark):
    rng = np.random.default_rng(2)
    s = rng.integers(0, 40, 500) / 7
    s[:200] = 3.0
    y = rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(n, int(a), float(b), "x") for n, (a, b) in enumerate(zip(y, s))], "sample_id long, y int, score double, extra string").repartition(7)
    got = metrics.average_rank(rows).orderBy("sample_id").collect()
    assert [r["rank"] for r in got] == plain_rank(s.tolist()) and got[0]["extra"] == "x"
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    one = metrics.roc_auc(rows).first()
    assert (one["n"], one["n_pos"]) == (500, y.sum()) and one["auc"] == pytest.approx(auc)
    assert math.isnan(metrics.roc_auc(rows.withColumn("score", F.when(F.col("sample_id") == 3, F.lit(float("nan"))).otherwise(F.col("score")))).first()["auc"])
    assert metrics.roc_auc(rows.where("false")).first()["n"] == 0


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_partition_window(spark):
    rows = spark.range(2000).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("int").alias("y"), F.sin(F.col("id")).alias("score"), (F.col("id") % 3).alias("split_id"))
    for df in (metrics.average_rank(rows), metrics.roc_auc(rows), permutation.permuted_labels(rows, 3)):
        plan = exchanges(df)
        windows = [n for n, line in enumerate(plan.splitlines()) if "Window" in line]
        for n in windows:
            below = next((x for x in plan.splitlines()[n:] if "Exchange" in x), "")
            assert "SinglePartition" not in below


@pytest.mark.parametrize("bucket", [1, 7, 10**6])
def test_permuted_labels_do_not_depend_on_buckets(spark, bucket):
    split = [0] * 60 + [1] * 20 + [None] * 3 + [7]
    rows = [(3 * n, split[n], n) for n in range(len(split))]
    got = {(r["perm_id"], r["sample_id"]): r["y"] for r in permutation.permuted_labels(spark.createDataFrame(rows, "sample_id long, split_id int, y int").repartition(5), 4, 9, bucket=bucket).collect()}
    want = {}
    for p in range(4):
        for s in {*split}:
            own = [r for r in rows if r[1] == s]
            order = sorted(own, key=lambda r: hashlib.md5(f"9:{p}:{r[0]}".encode()).hexdigest())
            want |= {(p, a[0]): b[2] for a, b in zip(own, order)}
    assert got == want


def test_a_hot_split_is_spread(spark):
    """A split with half of all rows: its rows of a permutation are in many sorted groups."""
    rows = spark.range(20_000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("split_id"), F.col("id").alias("y"))
    assert permutation.permuted_labels(rows, 2, bucket=500).count() == 40_000
    n = F.ceil(F.lit(10_000) / 500)
    lead = F.shiftright(F.conv(F.substring(F.md5(F.concat(F.lit("0:0:"), F.col("sample_id").cast("string"))), 1, 8), 16, 10).cast("long") * n, 32)
    most = rows.where("split_id = -1").groupBy(lead).count().agg(F.max("count"), F.count("*")).first()
    assert most[0] < 700 and most[1] == 20


def test_permutations_of_a_small_table_are_dealt_before_they_are_made(spark):
    rows = spark.range(300).selectExpr("id AS sample_id", "id % 3 AS split_id", "CAST(id % 2 AS int) AS y").coalesce(1)
    found = permutation.permuted_labels(rows, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Wherever copies of the rows are made, it is from rows that are dealt out to a given number of tasks.
    assert plan.count("Generate explode") == plan.count("RepartitionByExpression") > 0
    for made in plan.split("Generate explode")[1:]:
        assert "RepartitionByExpression" in made
    got = found.groupBy("perm_id").agg(F.count("sample_id"), F.sum("y")).collect()
    assert sorted(map(tuple, got)) == [(p, 300, 150) for p in range(5)]
