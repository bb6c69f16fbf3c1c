"""The library's own queries over the driver's tables, and the same in SQL.

embeddings is a set of volumes: 64 values are a 4 x 4 x 4 grid in C order, the split is vec_id % 5, the target the
label, the binary target label >= 5. Values are rounded alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.elementwise import NAN, fisher_z, in_mask, masked
from .functions.normal import critical_value, upper_tail_sql
from .operators import decoding, grid, metrics, permutation, threshold, volumes, windows
from .plans import searchlight_maps
from .sources import nifti
from .sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), "label", F.posexplode("embedding").alias("pos", "value"))
    at = lambda x: F.expr(x).cast("int")
    return e.select("img_id", "label", "pos", at("pos div 16").alias("i"), at("pos div 4 % 4").alias("j"), at("pos % 4").alias("k"), F.col("value").cast("double").alias("value"))


def full_mask(spark: SparkSession) -> DataFrame:
    return GRID.cells(spark)


def table_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxels whose mean over all images is above 0: an uneven mask."""
    return volumes.moments(voxels(spark, sf_dir)).where("mean > 0").select("i", "j", "k")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).select(F.col("pos").cast("long").alias("voxel_id"), F.col("img_id").alias("sample_id"), "value")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 5).cast("int").alias("split_id"), F.col("label").cast("double").alias("y"))


def binary(df: DataFrame) -> DataFrame:
    return df.withColumn("y", (F.col("y") >= 5).cast("int"))


def r9(c: str) -> F.Column:
    return F.round(F.col(c), 9).alias(c)


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


GRID = grid.Grid((4, 4, 4))
VOX = """v AS (
  SELECT vec_id AS img_id, label, p - 1 AS pos, ((p - 1) // 16)::INT AS i, ((p - 1) // 4 % 4)::INT AS j, ((p - 1) % 4)::INT AS k, e::DOUBLE AS value
  FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(1, 65)) AS p FROM embeddings))"""


# --- moments, masks and elementwise operators -------------------------------------------------------------------------


@query(f"WITH {VOX} SELECT i, j, k, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std FROM v GROUP BY ALL")
def voxel_moments(spark, sf_dir):
    return volumes.moments(voxels(spark, sf_dir)).select("i", "j", "k", "n", r9("mean"), r9("std"))


@query(f"WITH {VOX} SELECT i, j, k, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std FROM v WHERE (img_id * 7 + pos) % 97 <> 0 GROUP BY ALL")
def voxel_moments_nan(spark, sf_dir):
    v = voxels(spark, sf_dir).withColumn("value", F.when((F.col("img_id") * 7 + F.col("pos")) % 97 == 0, F.lit(NAN)).otherwise(F.col("value")))
    return volumes.moments(v).select("i", "j", "k", "n", r9("mean"), r9("std"))


@query("SELECT l_partkey, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS std FROM lineitem GROUP BY 1")
def part_moments(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("value"))
    return volumes.moments(v, by=["l_partkey"]).select("l_partkey", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


@query(f"WITH {VOX}, m AS (SELECT i, j, k, count(*) AS n, stddev_samp(value) AS s FROM v WHERE (img_id * 7 + pos) % 97 <> 0 GROUP BY ALL) SELECT i, j, k, n >= 490 AND s >= 0.124 AS in_mask FROM m")
def validity_mask(spark, sf_dir):
    v = voxels(spark, sf_dir).withColumn("value", F.when((F.col("img_id") * 7 + F.col("pos")) % 97 == 0, F.lit(NAN)).otherwise(F.col("value")))
    return volumes.validity_mask(v, 0.124, 490)


@query(f"WITH {VOX} SELECT img_id, i, j, k, round(atanh(greatest(-1 + 1e-7, least(1 - 1e-7, value * 2))), 9) AS z FROM v")
def fisher_z_values(spark, sf_dir):
    return voxels(spark, sf_dir).select("img_id", "i", "j", "k", F.round(fisher_z(F.col("value") * 2), 9).alias("z"))


@query(f"WITH {VOX} SELECT i, j, k, count(*) AS n, round(avg(atanh(value)), 9) AS mean, round(stddev_samp(atanh(value)), 9) AS std FROM v GROUP BY ALL")
def fisher_z_moments(spark, sf_dir):
    return volumes.moments(voxels(spark, sf_dir).withColumn("value", fisher_z(F.col("value")))).select("i", "j", "k", "n", r9("mean"), r9("std"))


@query(f"WITH {VOX} SELECT img_id, i, j, k, value > 0 AS in_mask FROM v")
def binary_mask(spark, sf_dir):
    return voxels(spark, sf_dir).select("img_id", "i", "j", "k", in_mask(F.col("value")).alias("in_mask"))


@query(f"WITH {VOX} SELECT a.img_id, a.i, a.j, a.k, CASE WHEN b.value > 0 THEN a.value ELSE 0 END::FLOAT AS value FROM v a JOIN v b ON b.img_id = 0 AND a.pos = b.pos")
def apply_mask(spark, sf_dir):
    v = voxels(spark, sf_dir)
    m = v.where("img_id = 0").select("i", "j", "k", in_mask(F.col("value")).alias("_in"))
    return v.join(m, ["i", "j", "k"], "left").select("img_id", "i", "j", "k", masked(F.col("value"), F.col("_in")).alias("value"))


# --- t-maps and thresholds --------------------------------------------------------------------------------------------

T = f"{VOX}, t AS (SELECT i, j, k, avg(value) / (stddev_samp(value) / sqrt(count(*))) AS t FROM v GROUP BY ALL)"


def t_map(spark, sf_dir) -> DataFrame:
    return volumes.one_sample_t(voxels(spark, sf_dir)).select(F.lit("all").alias("map_id"), "i", "j", "k", F.col("t").alias("stat"))


@query(f"WITH {T} SELECT i, j, k, round(t, 6) AS t FROM t")
def one_sample_t(spark, sf_dir):
    return volumes.one_sample_t(voxels(spark, sf_dir)).select("i", "j", "k", r6("t"))


@query(f"""WITH {VOX}, s AS (
  SELECT i, j, k, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS sx, sum(label * label)::DOUBLE AS sxx, sum(value) AS sy, sum(value * value) AS syy, sum(label * value) AS sxy FROM v GROUP BY ALL
), b AS (SELECT *, n * sxx - sx * sx AS d, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM s),
e AS (SELECT *, (syy - b0 * sy - b1 * sxy) / (n - 2) AS s2 FROM b)
SELECT i, j, k, round(b0, 6) AS beta_intercept, round(b0 / sqrt(s2 * sxx / d), 6) AS t_intercept, round(b1, 6) AS beta_label, round(b1 / sqrt(s2 * n / d), 6) AS t_label FROM e""")
def ols_t_intercept_covariate(spark, sf_dir):
    design = volumes.with_intercept(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), "label"), ["label"])
    return volumes.ols(voxels(spark, sf_dir).drop("label"), design, ["intercept", "label"]).select("i", "j", "k", r6("beta_intercept"), r6("t_intercept"), r6("beta_label"), r6("t_label"))


def _kept(spark, sf_dir, **options) -> DataFrame:
    return threshold.thresholded(t_map(spark, sf_dir), **options).select("i", "j", "k", F.round("stat", 6).alias("stat"))


FPR, FPR2 = critical_value(0.05), critical_value(0.025)


@query(f"WITH {T} SELECT i, j, k, round(CASE WHEN abs(t) > {FPR2!r} THEN t ELSE 0 END, 6) AS stat FROM t")
def threshold_fpr(spark, sf_dir):
    return _kept(spark, sf_dir, height_control="fpr")


@query(f"WITH {T} SELECT i, j, k, round(CASE WHEN t > {critical_value(0.05 / 64)!r} THEN t ELSE 0 END, 6) AS stat FROM t")
def threshold_bonferroni(spark, sf_dir):
    return _kept(spark, sf_dir, height_control="bonferroni", two_sided=False)


def _fdr_sql(z: str, level: float, out: str) -> str:
    return f"""WITH {T}, z AS (SELECT i, j, k, t, {z} AS z FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY z DESC) AS rn, count(*) OVER () AS n FROM z),
h AS (SELECT coalesce(min(z) - 1e-12, 'infinity'::DOUBLE) AS h FROM r WHERE {upper_tail_sql('z')} < {level} * rn / n)
SELECT i, j, k, round(CASE WHEN z > h THEN {out} ELSE 0 END, 6) AS stat FROM z, h"""


@query(_fdr_sql("abs(t)", 0.1, "t"))
def threshold_fdr_two_sided(spark, sf_dir):
    return _kept(spark, sf_dir, alpha=0.2)


@query(_fdr_sql("t", 0.2, "t"))
def threshold_fdr_gt(spark, sf_dir):
    return _kept(spark, sf_dir, alpha=0.2, two_sided=False)


@query(_fdr_sql("-t", 0.2, "-t"))
def threshold_fdr_lt(spark, sf_dir):
    return _kept(spark, sf_dir, alpha=0.2, two_sided=False, sign=-1)


@query(f"""WITH RECURSIVE {T}, p AS (SELECT i, j, k, t, t > 0 AS up, i * 16 + j * 4 + k AS id FROM t WHERE abs(t) > 0.5),
r AS (SELECT id AS a, id AS b, i, j, k, up FROM p UNION SELECT r.a, p.id, p.i, p.j, p.k, p.up FROM r JOIN p ON r.up = p.up AND abs(r.i - p.i) + abs(r.j - p.j) + abs(r.k - p.k) = 1),
s AS (SELECT a, count(*) AS size FROM r GROUP BY 1)
SELECT i, j, k, round(CASE WHEN size >= 4 THEN t ELSE 0 END, 6) AS stat FROM (SELECT t.i, t.j, t.k, t.t, coalesce(s.size, 0) AS size FROM t LEFT JOIN s ON s.a = t.i * 16 + t.j * 4 + t.k)""")
def cluster_extent(spark, sf_dir):
    return _kept(spark, sf_dir, height_control=None, threshold=0.5, cluster_threshold=4)


PERMS = 50


def _maxt_sql(value: str, t: str) -> str:
    return f"""WITH {VOX}, ids AS (SELECT DISTINCT img_id FROM v), n AS (SELECT count(*)::DOUBLE AS n FROM ids),
s AS (SELECT p, img_id, CASE WHEN substr(md5(concat('0:', p, ':', img_id)), 1, 1) < '8' THEN 1 ELSE -1 END AS s FROM ids, (SELECT unnest(range(0, {PERMS})) AS p)),
y AS (SELECT pos, sum(value) AS sy, sum(value * value) AS syy FROM v GROUP BY 1),
m AS (SELECT p, pos, sum(s * value) AS sy FROM v JOIN s USING (img_id) GROUP BY ALL),
tp AS (SELECT p, sy / sqrt(n * (syy - sy * sy / n) / (n - 1)) AS t FROM (SELECT m.p, m.sy, y.syy FROM m JOIN y USING (pos)), n),
mx AS (SELECT p, max({value}) AS most FROM tp GROUP BY 1),
o AS (SELECT pos, sy / sqrt(n * (syy - sy * sy / n) / (n - 1)) AS t FROM y, n)
SELECT (pos // 16)::INT AS i, (pos // 4 % 4)::INT AS j, (pos % 4)::INT AS k, round({t}, 6) AS t, round((1 + count(*) FILTER (WHERE most >= {value} - 1e-9)) / {PERMS + 1}.0, 6)::DOUBLE AS p FROM o, mx GROUP BY pos, t"""


def _maxt(spark, sf_dir, tail: str) -> DataFrame:
    return permutation.fwer(voxels(spark, sf_dir), PERMS, "max_t", tail).select("i", "j", "k", r6("t"), r6("p"))


@query(_maxt_sql("t", "t"))
def maxt_fwer_gt(spark, sf_dir):
    return _maxt(spark, sf_dir, "gt")


@query(_maxt_sql("-t", "-t"))
def maxt_fwer_lt(spark, sf_dir):
    return _maxt(spark, sf_dir, "lt")


@query(_maxt_sql("abs(t)", "t"))
def maxt_fwer_two_sided(spark, sf_dir):
    return _maxt(spark, sf_dir, "two_sided")


def _t_of_signs(n_perm: int) -> str:
    """tp (p, pos, t): t-maps of sign flips; permutation -1 is the map itself."""
    return f"""ids AS (SELECT DISTINCT img_id FROM v), n AS (SELECT count(*)::DOUBLE AS n FROM ids),
s AS (SELECT p, img_id, CASE WHEN p < 0 OR substr(md5(concat('0:', p, ':', img_id)), 1, 1) < '8' THEN 1 ELSE -1 END AS s FROM ids, (SELECT unnest(range(-1, {n_perm})) AS p)),
y AS (SELECT pos, sum(value * value) AS syy FROM v GROUP BY 1),
tp AS (SELECT p, m.pos, sy / sqrt(n * (syy - sy * sy / n) / (n - 1)) AS t FROM (SELECT p, pos, sum(s * value) AS sy FROM v JOIN s USING (img_id) GROUP BY ALL) m JOIN y USING (pos), n)"""


_FACES = "abs(r.pos // 16 - u.pos // 16) + abs(r.pos // 4 % 4 - u.pos // 4 % 4) + abs(r.pos % 4 - u.pos % 4) = 1"


def _fwer_of(value: str, n_perm: int) -> str:
    """The end of a query: t and p of the map itself by the null of the permutations' greatest values (p, pos, value)."""
    return f"""mx AS (SELECT p, max(value) AS most FROM {value} WHERE p >= 0 GROUP BY 1)
SELECT (o.pos // 16)::INT AS i, (o.pos // 4 % 4)::INT AS j, (o.pos % 4)::INT AS k, round(o.t, 6) AS t, round((1 + count(*) FILTER (WHERE most >= e.value - 1e-9)) / {n_perm + 1}.0, 6)::DOUBLE AS p
FROM tp o JOIN {value} e ON o.p = -1 AND e.p = -1 AND o.pos = e.pos, mx GROUP BY o.pos, o.t, e.value"""


CLUSTER_SIZE = f"""WITH RECURSIVE {VOX}, {_t_of_signs(20)}, u AS (SELECT p, pos, t > 0 AS up FROM tp WHERE abs(t) >= {critical_value(0.1)!r}),
r AS (SELECT p, pos AS a, pos, up FROM u UNION SELECT r.p, r.a, u.pos, r.up FROM r JOIN u ON u.p = r.p AND u.up = r.up AND {_FACES}),
c AS (SELECT p, a AS pos, count(*)::DOUBLE AS value FROM r GROUP BY ALL), e AS (SELECT tp.p, tp.pos, coalesce(value, 0) AS value FROM tp LEFT JOIN c USING (p, pos)), {_fwer_of('e', 20)}"""


def _cluster_size(spark, sf_dir, **options) -> DataFrame:
    return permutation.fwer(voxels(spark, sf_dir), 20, "max_size", "two_sided", cluster_p=0.2, **options).select("i", "j", "k", r6("t"), r6("p"))


@query(CLUSTER_SIZE)
def cluster_size_fwer(spark, sf_dir):
    return _cluster_size(spark, sf_dir)


@query(CLUSTER_SIZE)
def cluster_size_fwer_seams(spark, sf_dir):
    """The same from bricks of eight voxels, so that clusters go over seams."""
    return _cluster_size(spark, sf_dir, brick=2)


def _tfce_sql(n_perm: int, steps: int = 100) -> str:
    return f"""WITH RECURSIVE {VOX}, {_t_of_signs(n_perm)}, g AS (SELECT p, side, max(side * t) / {steps} AS dh FROM tp, (SELECT unnest([1, -1]) AS side) GROUP BY ALL HAVING max(side * t) > 0),
u AS (SELECT p, side, h, dh, pos FROM tp JOIN g USING (p), (SELECT unnest(range(1, {steps + 1})) AS h) WHERE side * t >= h * dh - 1e-12),
r AS (SELECT p, side, h, dh, pos AS a, pos FROM u UNION SELECT r.p, r.side, r.h, r.dh, r.a, u.pos FROM r JOIN u ON u.p = r.p AND u.side = r.side AND u.h = r.h AND {_FACES}),
c AS (SELECT p, side, h, dh, a, count(*) AS size FROM r GROUP BY ALL), f AS (SELECT p, a AS pos, side, sum(sqrt(size) * (h * dh) * (h * dh) * dh) AS value FROM c GROUP BY ALL),
e AS (SELECT tp.p, tp.pos, coalesce(max(value), 0) AS value FROM tp LEFT JOIN f USING (p, pos) GROUP BY ALL), {_fwer_of('e', n_perm)}"""


@query(_tfce_sql(10))
def tfce_fwer(spark, sf_dir):
    return permutation.fwer(voxels(spark, sf_dir), 10, "max_tfce", "two_sided").select("i", "j", "k", r6("t"), r6("p"))


@query(_tfce_sql(10))
def tfce_fwer_seams(spark, sf_dir):
    """The same from bricks of 27 voxels and what the grid leaves beside them."""
    return permutation.fwer(voxels(spark, sf_dir), 10, "max_tfce", "two_sided", brick=3).select("i", "j", "k", r6("t"), r6("p"))


@query(f"""WITH {VOX}, ids AS (SELECT DISTINCT img_id, label::DOUBLE AS x FROM v), n AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, sum(x * x) - count(*) * avg(x) * avg(x) AS xx FROM ids),
d AS (SELECT p, img_id, x, row_number() OVER (PARTITION BY p ORDER BY img_id) AS slot, row_number() OVER (PARTITION BY p ORDER BY CASE WHEN p < 0 THEN '' ELSE md5(concat('0:', p, ':', img_id)) END, img_id) AS src FROM ids, (SELECT unnest(range(-1, 50)) AS p)),
s AS (SELECT a.p, a.img_id, b.x FROM d a JOIN d b ON a.p = b.p AND a.slot = b.src),
y AS (SELECT pos, sum(value) AS sy, sum(value * value) - sum(value) * sum(value) / count(*) AS yy FROM v GROUP BY 1),
c AS (SELECT p, pos, sum((x - mx) * value) AS xy FROM v JOIN s USING (img_id), n GROUP BY ALL),
tp AS (SELECT p, pos, xy / sqrt(xx * greatest(yy - xy * xy / xx, 0) / (n - 2)) AS t FROM c JOIN y USING (pos), n), e AS (SELECT p, pos, abs(t) AS value FROM tp), {_fwer_of('e', 50)}""")
def covariate_fwer(spark, sf_dir):
    design = volumes.with_intercept(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), "label"), ["label"])
    return permutation.fwer(voxels(spark, sf_dir).drop("label"), 50, "max_t", "two_sided", design, "label").select("i", "j", "k", r6("t"), r6("p"))


@query(f"SELECT i, j, k, CASE WHEN p <= 0.2 THEN t ELSE 0 END AS t FROM ({_maxt_sql('abs(t)', 't')})")
def logp_threshold(spark, sf_dir):
    found = permutation.fwer(voxels(spark, sf_dir), PERMS, "max_t", "two_sided")
    return permutation.passed(found, 0.2).select("i", "j", "k", r6("t"))


# --- ranks, metrics and their nulls -----------------------------------------------------------------------------------

RANK = "rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0"


def scored(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("split_id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("y"))


def by_voxel(spark, sf_dir) -> DataFrame:
    v = voxels(spark, sf_dir)
    return v.select(F.col("pos").cast("long").alias("window_id"), F.col("img_id").alias("sample_id"), F.col("value").alias("score"), (F.col("label") >= 5).cast("int").alias("y"))


@query(f"SELECT doc_id AS sample_id, ({RANK})::DOUBLE AS rank FROM documents JOIN labels USING (doc_id)")
def average_rank(spark, sf_dir):
    return metrics.average_rank(scored(spark, sf_dir)).select("sample_id", "rank")


@query(f"""WITH r AS (SELECT toxic AS y, {RANK} AS rank FROM documents JOIN labels USING (doc_id)), s AS (SELECT count(*) AS n, sum(y)::BIGINT AS n_pos, sum(rank) FILTER (WHERE y = 1)::DOUBLE AS r FROM r)
SELECT n, n_pos, round((r - n_pos * (n_pos + 1) / 2.0) / (n_pos * (n - n_pos)), 9)::DOUBLE AS auc FROM s""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir)).select("n", "n_pos", r9("auc"))


@query(f"""WITH {VOX}, r AS (SELECT pos AS window_id, (label >= 5)::INT AS y, rank() OVER (PARTITION BY pos ORDER BY value) + (count(*) OVER (PARTITION BY pos, value) - 1) / 2.0 AS rank FROM v),
s AS (SELECT window_id, count(*) AS n, sum(y)::BIGINT AS n_pos, sum(rank) FILTER (WHERE y = 1)::DOUBLE AS r FROM r GROUP BY 1)
SELECT window_id, n, n_pos, round((r - n_pos * (n_pos + 1) / 2.0) / (n_pos * (n - n_pos)), 9)::DOUBLE AS auc FROM s""")
def roc_auc_by_window(spark, sf_dir):
    return metrics.roc_auc(by_voxel(spark, sf_dir), by=["window_id"]).select("window_id", "n", "n_pos", r9("auc"))


def _permuted_sql(source: str, n: int) -> str:
    return f"""pb AS ({source}), pq AS (SELECT unnest(range(0, {n})) AS perm_id),
px AS (SELECT perm_id, split_id, sample_id, y, row_number() OVER (PARTITION BY perm_id, split_id ORDER BY sample_id) AS slot, row_number() OVER (PARTITION BY perm_id, split_id ORDER BY md5(concat('0:', perm_id, ':', sample_id)), sample_id) AS src FROM pb, pq),
pl AS (SELECT a.perm_id, a.sample_id, c.y FROM px a JOIN px c ON a.perm_id = c.perm_id AND a.split_id = c.split_id AND a.slot = c.src)"""


DOC_LABELS = "SELECT doc_id AS sample_id, lang AS split_id, toxic AS y FROM documents JOIN labels USING (doc_id)"
EMB_LABELS = "SELECT vec_id AS sample_id, vec_id % 5 AS split_id, (label >= 5)::INT AS y FROM embeddings"


@query(f"WITH {_permuted_sql(DOC_LABELS, 20)} SELECT perm_id::INT AS perm_id, sample_id, y FROM pl")
def permuted_labels(spark, sf_dir):
    return permutation.permuted_labels(scored(spark, sf_dir), 20)


NULL_SUMMARY = "(1 + count(*) FILTER (WHERE abs(auc - m) >= abs(score - m) - 1e-12)) / (count(*) + 1.0)"


@query(f"""WITH {_permuted_sql(DOC_LABELS, 200)}, r AS (SELECT doc_id AS sample_id, toxic AS y, ({RANK})::DOUBLE AS rank FROM documents JOIN labels USING (doc_id)),
o AS (SELECT (sum(rank) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS score FROM r),
a AS (SELECT perm_id, (sum(rank) FILTER (WHERE pl.y = 1) - sum(pl.y) * (sum(pl.y) + 1) / 2.0) / (sum(pl.y) * (count(*) - sum(pl.y))) AS auc FROM pl JOIN r USING (sample_id) GROUP BY 1),
w AS (SELECT auc, avg(auc) OVER () AS m, score FROM a, o)
SELECT round(any_value(score), 9)::DOUBLE AS score, round(avg(auc), 9)::DOUBLE AS null_mean, round(stddev_samp(auc), 9)::DOUBLE AS null_std, round({NULL_SUMMARY}, 9)::DOUBLE AS p FROM w""")
def auc_permutation_test(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return metrics.auc_permutation_test(rows, permutation.permuted_labels(rows, 200)).select(r9("score"), r9("null_mean"), r9("null_std"), r9("p"))


@query(f"""WITH {VOX}, {_permuted_sql(EMB_LABELS, 20)}, r AS (SELECT pos AS window_id, img_id AS sample_id, (label >= 5)::INT AS y, (rank() OVER (PARTITION BY pos ORDER BY value) + (count(*) OVER (PARTITION BY pos, value) - 1) / 2.0)::DOUBLE AS rank FROM v),
o AS (SELECT window_id, (sum(rank) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS score FROM r GROUP BY 1),
a AS (SELECT window_id, perm_id, (sum(rank) FILTER (WHERE pl.y = 1) - sum(pl.y) * (sum(pl.y) + 1) / 2.0) / (sum(pl.y) * (count(*) - sum(pl.y))) AS auc FROM pl JOIN r USING (sample_id) GROUP BY ALL),
w AS (SELECT window_id, auc, avg(auc) OVER (PARTITION BY window_id) AS m, score FROM a JOIN o USING (window_id))
SELECT window_id, round(any_value(score), 9)::DOUBLE AS metric, round(avg(auc), 9)::DOUBLE AS null_mean, round(stddev_samp(auc), 9)::DOUBLE AS null_std, round({NULL_SUMMARY}, 9)::DOUBLE AS p FROM w GROUP BY 1""")
def windowwise_auc_perm(spark, sf_dir):
    t = binary(targets(spark, sf_dir))
    pred = by_voxel(spark, sf_dir).select("window_id", "sample_id", F.col("score").alias("y_pred"))
    found = metrics.windowwise_metric(pred, t.select("sample_id", "y"), "roc_auc", permutation.permuted_labels(t, 20))
    return found.select("window_id", r9("metric"), r9("null_mean"), r9("null_std"), r9("p"))


@query(f"""WITH {_permuted_sql(DOC_LABELS, 50)}, s AS (SELECT doc_id AS sample_id, toxic AS y, n_chars::DOUBLE AS s FROM documents JOIN labels USING (doc_id)),
o AS (SELECT corr(y, s) AS score FROM s), a AS (SELECT perm_id, corr(pl.y, s) AS auc FROM pl JOIN s USING (sample_id) GROUP BY 1), w AS (SELECT auc, avg(auc) OVER () AS m, score FROM a, o)
SELECT round(any_value(score), 9)::DOUBLE AS score, round(avg(auc), 9)::DOUBLE AS null_mean, round(stddev_samp(auc), 9)::DOUBLE AS null_std, round({NULL_SUMMARY}, 9)::DOUBLE AS p FROM w""")
def callable_metric_test(spark, sf_dir):
    """The generic path: any function of labels and scores."""
    rows = scored(spark, sf_dir)
    corr = lambda y, s: float(np.corrcoef(y, s)[0, 1]) if y.std() and s.std() else float("nan")
    return metrics.metric_permutation_test(rows, permutation.permuted_labels(rows, 50), corr).select(r9("score"), r9("null_mean"), r9("null_std"), r9("p"))


@query(f"""WITH {VOX}, r AS (SELECT pos AS window_id, (label >= 5)::INT AS y, rank() OVER (PARTITION BY pos ORDER BY value) + (count(*) OVER (PARTITION BY pos, value) - 1) / 2.0 AS rank FROM v),
s AS (SELECT window_id, count(*) AS n, sum(y)::BIGINT AS n_pos, sum(rank) FILTER (WHERE y = 1)::DOUBLE AS r FROM r GROUP BY 1)
SELECT window_id, CASE WHEN window_id % 8 = 0 THEN NULL ELSE round((r - n_pos * (n_pos + 1) / 2.0) / (n_pos * (n - n_pos)), 9)::DOUBLE END AS metric FROM s""")
def windowwise_y_transform(spark, sf_dir):
    """Targets made binary on the way; windows whose predictions are all equal or all missing have none."""
    flat = F.when(F.col("window_id") % 16 == 0, F.lit(0.5)).when(F.col("window_id") % 8 == 0, F.lit(None)).otherwise(F.col("score"))
    pred = by_voxel(spark, sf_dir).select("window_id", "sample_id", flat.alias("y_pred"))
    found = metrics.windowwise_metric(pred, targets(spark, sf_dir), "roc_auc", y_transform=lambda y: (y >= 5).cast("int"))
    return found.select("window_id", F.when(~F.isnan("metric"), F.round("metric", 9)).alias("metric"))


def _knn(spark, sf_dir, metric: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    c = e.select(F.col("vec_id").alias("row_pos"), F.col("embedding").cast("array<double>").alias("vec"))
    noise = F.transform("vec", lambda x, i: x + F.sin((F.col("row_pos") * 64 + i).cast("double")) * 0.3)
    q = c.select(F.col("row_pos").alias("query_id"), F.col("row_pos").alias("true_pos"), noise.alias("vec"))
    return metrics.top_k_accuracy(c, q, [1, 5, 10], metric).select("k", F.round("accuracy", 9).alias("accuracy"))


def _knn_sql(distance: str) -> str:
    return f"""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id, list_transform(range(0, 64), lambda i: v[i + 1] + 0.3 * sin((vec_id * 64 + i)::DOUBLE)) AS v FROM c),
d AS (SELECT q.vec_id AS q, c.vec_id AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance}, c.vec_id) AS r FROM q, c),
h AS (SELECT r FROM d WHERE q = c)
SELECT k::INT AS k, round(avg((r <= k)::INT), 9) AS accuracy FROM h, (SELECT unnest([1, 5, 10]) AS k) GROUP BY 1"""


@query(_knn_sql("list_distance(q.v, c.v)"))
def top_knn_accuracy(spark, sf_dir):
    return _knn(spark, sf_dir, "euclidean")


@query(_knn_sql("1 - list_cosine_similarity(q.v, c.v)"))
def top_knn_accuracy_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


@query(_knn_sql("list_sum(list_transform(range(1, 65), lambda i: abs(q.v[i] - c.v[i])))"))
def top_knn_accuracy_manhattan(spark, sf_dir):
    return _knn(spark, sf_dir, "manhattan")


# --- windows and decoding ---------------------------------------------------------------------------------------------

CELLS = "g AS (SELECT i, j, k, row_number() OVER (ORDER BY i, j, k) - 1 AS voxel_id FROM (SELECT i, j, k FROM v GROUP BY ALL HAVING avg(value) > 0))"


def _window_sql(stride: int, radius: int = 1) -> str:
    return f"""WITH {VOX}, {CELLS}, c AS (SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS window_id, i, j, k FROM g WHERE i % {stride} = 0 AND j % {stride} = 0 AND k % {stride} = 0)
SELECT window_id, c.i AS ci, c.j AS cj, c.k AS ck, row_number() OVER (PARTITION BY window_id ORDER BY voxel_id) - 1 AS pos, voxel_id FROM c JOIN g ON abs(g.i - c.i) <= {radius} AND abs(g.j - c.j) <= {radius} AND abs(g.k - c.k) <= {radius}"""


def _long_pos(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.col("pos").cast("long"))


@query(_window_sql(1))
def searchlight_windows(spark, sf_dir):
    return _long_pos(windows.searchlight_members(table_mask(spark, sf_dir), 1))


@query(f"SELECT window_id, count(*) AS size FROM ({_window_sql(1, 2)}) GROUP BY 1")
def searchlight_window_sizes(spark, sf_dir):
    return windows.searchlight_windows(table_mask(spark, sf_dir), 2).select("window_id", F.size("voxel_ids").cast("long").alias("size"))


@query(_window_sql(2))
def searchlight_stride2(spark, sf_dir):
    return _long_pos(windows.searchlight_members(table_mask(spark, sf_dir), 1, 2))


FOLDS = f"""{VOX}, x AS (SELECT pos AS voxel_id, img_id AS sample_id, img_id % 5 AS split_id, value AS x, label::DOUBLE AS y FROM v),
f AS (SELECT a.voxel_id, s.split_id, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sd, sum(x * y) - count(*) * avg(x) * avg(y) AS cov FROM x a JOIN (SELECT DISTINCT split_id FROM x) s ON a.split_id <> s.split_id GROUP BY ALL),
p AS (SELECT x.voxel_id, x.sample_id, x.split_id::INT AS split_id, my + cov / sd / (n + 1.0) * (x - mx) / sd AS y_pred FROM x JOIN f USING (voxel_id, split_id))"""


FEATURES = f"""{VOX}, x AS (SELECT pos AS a, img_id AS sample_id, (img_id % 5)::INT AS split_id, value AS x, label::DOUBLE AS y FROM v), fold AS (SELECT DISTINCT split_id AS f FROM x)"""


def _ridge_sql(members: str, y: str = "y", n_perm: int = 0) -> str:
    """p (window_id, sample_id, perm_id, y_pred, n_features): ridge on members m (window_id, f, r, a) by normal equations.

    Training sums of a fold are differences of sums; the systems are solved by elimination, one column a step.
    """
    labels = f"""lab AS (SELECT DISTINCT sample_id, split_id, {y}::DOUBLE AS y FROM x), q AS (SELECT unnest(range(0, {max(1, n_perm)})) AS q),
d AS (SELECT q, f, sample_id, y, row_number() OVER (PARTITION BY q, f ORDER BY sample_id) AS slot, row_number() OVER (PARTITION BY q, f ORDER BY {"md5(concat('0:', q, ':', sample_id)), " if n_perm else ""}sample_id) AS src FROM lab, fold, q WHERE split_id <> f),
ty AS (SELECT d.q, d.f, d.sample_id, e.y FROM d JOIN d e ON d.q = e.q AND d.f = e.f AND d.slot = e.src)"""
    return f"""{labels}, mean AS (SELECT f, avg(y) AS my FROM ty WHERE q = 0 GROUP BY 1),
one AS (SELECT f, a, count(*)::DOUBLE AS n, avg(x) AS mx, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM x, fold WHERE split_id <> f GROUP BY ALL),
pp AS (SELECT b.split_id, b.a, c.a AS b, sum(b.x * c.x) AS s FROM x b JOIN x c USING (sample_id) GROUP BY ALL),
gram AS (SELECT g.f, g.a, g.b, (g.s - p.n * p.mx * r.mx) / (p.sd * r.sd) AS g FROM (SELECT f, a, b, sum(s) AS s FROM pp, fold WHERE split_id <> f GROUP BY ALL) g JOIN one p ON p.f = g.f AND p.a = g.a JOIN one r ON r.f = g.f AND r.a = g.b),
side AS (SELECT o.f, o.a, list((s - n * mx * my) / sd ORDER BY q) AS rhs FROM (SELECT ty.f, ty.q, x.a, sum(x.x * ty.y) AS s FROM x JOIN ty USING (sample_id) GROUP BY ALL) z JOIN one o USING (f, a) JOIN mean USING (f) GROUP BY ALL),
m AS ({members}),
line AS (SELECT b.window_id, b.f, b.r, list(g + CASE WHEN b.r = c.r THEN 1e0 ELSE 0e0 END ORDER BY c.r) AS row FROM m b JOIN m c ON b.window_id = c.window_id AND b.f = c.f JOIN gram ON gram.f = b.f AND gram.a = b.a AND gram.b = c.a GROUP BY ALL),
mat AS (SELECT line.window_id, line.f, list(row || rhs ORDER BY line.r) AS w, count(*) AS n FROM line JOIN m USING (window_id, f, r) JOIN side ON side.f = m.f AND side.a = m.a GROUP BY ALL),
el AS (SELECT window_id, f, n, 0::BIGINT AS k, w FROM mat UNION ALL
  SELECT window_id, f, n, k + 1, list_transform(w, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / row[k + 1]) ELSE list_transform(row, lambda v, j: v - row[k + 1] * w[k + 1][j] / w[k + 1][k + 1]) END) FROM el WHERE k < n),
beta AS (SELECT m.window_id, m.f, m.a, n, q, w[r + 1][n + 1 + q] AS b FROM el JOIN m USING (window_id, f), q WHERE k = n),
p AS (SELECT beta.window_id, x.sample_id, q AS perm_id, any_value(my) + sum(b * (x.x - mx) / sd) AS y_pred, any_value(beta.n)::INT AS n_features FROM beta JOIN x ON x.split_id = beta.f AND x.a = beta.a JOIN one ON one.f = beta.f AND one.a = beta.a JOIN mean ON mean.f = beta.f GROUP BY ALL)"""


ALL_FEATURES = "SELECT 0 AS window_id, f, a AS r, a FROM (SELECT DISTINCT a FROM x), fold"
NEAR = "SELECT c.a AS window_id, f, row_number() OVER (PARTITION BY c.a, f ORDER BY g.a) - 1 AS r, g.a FROM (SELECT DISTINCT a FROM x) c JOIN (SELECT DISTINCT a FROM x) g ON abs(g.a // 16 - c.a // 16) <= 1 AND abs(g.a // 4 % 4 - c.a // 4 % 4) <= 1 AND abs(g.a % 4 - c.a % 4) <= 1, fold"
BEST = """SELECT 0 AS window_id, f, row_number() OVER (PARTITION BY f ORDER BY a) - 1 AS r, a FROM (
  SELECT f, a, row_number() OVER (PARTITION BY f ORDER BY abs(corr(x, y)) DESC, a) AS place FROM x, fold WHERE split_id <> f GROUP BY f, a) WHERE place <= 8"""


@query("SELECT f::BIGINT AS fold, count(*) FILTER (WHERE vec_id % 5 <> f) AS n_train, count(*) FILTER (WHERE vec_id % 5 = f) AS n_test FROM embeddings, (SELECT unnest(range(0, 5)) AS f) GROUP BY 1")
def loso_folds(spark, sf_dir):
    """Sizes of the training and test sets that the decoder really sees: a model that answers with the size of what it was fitted on."""
    size = lambda x, y, test: np.full(len(test), float(len(x)))
    one = features(spark, sf_dir).where("voxel_id = 0")
    seen = decoding.leave_one_split_out(one, targets(spark, sf_dir), size)
    return seen.join(targets(spark, sf_dir).select("sample_id", "split_id"), "sample_id").groupBy(F.col("split_id").cast("long").alias("fold")).agg(F.max("y_pred").cast("long").alias("n_train"), F.count(F.lit(1)).alias("n_test"))


@query(f"WITH RECURSIVE {FEATURES}, {_ridge_sql(ALL_FEATURES)} SELECT sample_id, round(y_pred, 6) AS y_pred, n_features FROM p")
def loso_ridge(spark, sf_dir):
    return decoding.leave_one_split_out(features(spark, sf_dir), targets(spark, sf_dir)).select("sample_id", r6("y_pred"), "n_features")


@query(f"WITH RECURSIVE {FEATURES}, {_ridge_sql(ALL_FEATURES)} SELECT sample_id, t::INT AS target_id, round(CASE WHEN t = 0 THEN y_pred ELSE 1 - 2 * y_pred END, 6) AS y_pred FROM p, (SELECT unnest([0, 1]) AS t)")
def loso_two_targets(spark, sf_dir):
    """Two targets at once, in the order of their ids: the label, and one less twice the label."""
    one = targets(spark, sf_dir)
    two = one.withColumn("target_id", F.lit(1)).withColumn("y", 1 - 2 * F.col("y")).unionByName(one.withColumn("target_id", F.lit(0)))
    return decoding.leave_one_split_out(features(spark, sf_dir), two).select("sample_id", "target_id", r6("y_pred"))


@query(f"WITH {FOLDS} SELECT voxel_id, sample_id, split_id, round(y_pred, 6) AS y_pred FROM p")
def loso_ridge_1f(spark, sf_dir):
    return decoding.one_feature_ridge(features(spark, sf_dir), targets(spark, sf_dir)).select("voxel_id", "sample_id", "split_id", r6("y_pred"))


@query(f"WITH {FOLDS} SELECT voxel_id, sample_id, split_id, round((y_pred - avg(y_pred) OVER w) / stddev_pop(y_pred) OVER w, 5) AS y_pred FROM p WINDOW w AS (PARTITION BY voxel_id, split_id)")
def loso_ridge_1f_norm(spark, sf_dir):
    return decoding.one_feature_ridge(features(spark, sf_dir), targets(spark, sf_dir), normalise=True).select("voxel_id", "sample_id", "split_id", F.round("y_pred", 5).alias("y_pred"))


@query(f"WITH {FOLDS} SELECT voxel_id AS window_id, sample_id, round(y_pred, 6) AS y_pred FROM p")
def searchlight_ridge_r0(spark, sf_dir):
    pred, _ = searchlight_maps.searchlight_predictions(features(spark, sf_dir), full_mask(spark), targets(spark, sf_dir), 0)
    return pred.select("window_id", "sample_id", r6("y_pred"))


@query(f"WITH RECURSIVE {FEATURES}, {_ridge_sql(NEAR)} SELECT window_id, sample_id, round(y_pred, 6) AS y_pred, n_features FROM p")
def searchlight_ridge_r1(spark, sf_dir):
    pred, _ = searchlight_maps.searchlight_predictions(features(spark, sf_dir), full_mask(spark), targets(spark, sf_dir), 1)
    return pred.select("window_id", "sample_id", r6("y_pred"), "n_features")


@query(f"WITH RECURSIVE {FEATURES}, {_ridge_sql(BEST)} SELECT sample_id, round(y_pred, 6) AS y_pred, 64::INT AS n_features, n_features AS n_selected FROM p")
def loso_k_best(spark, sf_dir):
    return decoding.leave_one_split_out(features(spark, sf_dir), targets(spark, sf_dir), selector=decoding.k_best(8)).select("sample_id", r6("y_pred"), "n_features", "n_selected")


@query(f"WITH RECURSIVE {FEATURES}, {_ridge_sql(ALL_FEATURES, 'y', 5)} SELECT sample_id, perm_id::INT AS perm_id, round(y_pred, 6) AS y_pred FROM p")
def loso_permuted_training(spark, sf_dir):
    return decoding.leave_one_split_out(features(spark, sf_dir), targets(spark, sf_dir), permutations=5).select("sample_id", "perm_id", r6("y_pred"))


@query(f"""WITH RECURSIVE {FEATURES}, {_ridge_sql(NEAR, '(y >= 5)::INT')}, {_permuted_sql(EMB_LABELS, 10)},
r AS (SELECT window_id, sample_id, b.y, (rank() OVER (PARTITION BY window_id ORDER BY y_pred) + (count(*) OVER (PARTITION BY window_id, y_pred) - 1) / 2.0)::DOUBLE AS rank FROM p JOIN pb b USING (sample_id)),
o AS (SELECT window_id, (sum(rank) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS score FROM r GROUP BY 1),
nul AS (SELECT window_id, perm_id, (sum(rank) FILTER (WHERE pl.y = 1) - sum(pl.y) * (sum(pl.y) + 1) / 2.0) / (sum(pl.y) * (count(*) - sum(pl.y))) AS auc FROM pl JOIN r USING (sample_id) GROUP BY ALL),
z AS (SELECT window_id, auc, avg(auc) OVER (PARTITION BY window_id) AS m, score FROM nul JOIN o USING (window_id)),
t AS (SELECT window_id, any_value(score)::DOUBLE AS auc, avg(auc)::DOUBLE AS auc_null_mean, stddev_samp(auc)::DOUBLE AS auc_null_std, ({NULL_SUMMARY})::DOUBLE AS auc_p FROM z GROUP BY 1)
SELECT suffix, (window_id // 16)::INT AS i, (window_id // 4 % 4)::INT AS j, (window_id % 4)::INT AS k, round(value::FLOAT::DOUBLE, 5) AS value FROM (UNPIVOT t ON auc, auc_null_mean, auc_null_std, auc_p INTO NAME suffix VALUE value)""")
def searchlight_metric_maps(spark, sf_dir):
    """All maps but that of z, whose quantile SQL does not have; it is a function of p and the score."""
    t = binary(targets(spark, sf_dir))
    mask = full_mask(spark)
    pred, centres = searchlight_maps.searchlight_predictions(features(spark, sf_dir), mask, t, 1, 1)
    maps = searchlight_maps.metric_maps(pred, centres, mask, t, "roc_auc", "auc", 1, 10)
    return maps.where("suffix <> 'auc_z'").select("suffix", "i", "j", "k", F.round(F.col("value").cast("double"), 5).alias("value"))


# --- grids ------------------------------------------------------------------------------------------------------------


@query(f"WITH {VOX} SELECT label, i, j, k, avg(value)::FLOAT AS value FROM v GROUP BY ALL")
def reconstruct_stride1(spark, sf_dir):
    centres = voxels(spark, sf_dir).groupBy("label", "i", "j", "k").agg(F.avg("value").alias("value"))
    return windows.reconstruct(full_mask(spark), centres, 1, keys=["label"])


@query(f"""WITH {VOX}, m AS (SELECT label, i, j, k, avg(value) AS value FROM v GROUP BY ALL)
SELECT g.label, g.i, g.j, g.k, round(CASE WHEN hi.value IS NULL THEN 'nan' ELSE (lo.value + hi.value) / 2 END::FLOAT::DOUBLE, 5) AS value FROM m g
JOIN m lo ON lo.label = g.label AND lo.i = g.i // 2 * 2 AND lo.j = g.j // 2 * 2 AND lo.k = g.k // 2 * 2
LEFT JOIN m hi ON hi.label = g.label AND hi.i = g.i + g.i % 2 AND hi.j = g.j + g.j % 2 AND hi.k = g.k + g.k % 2""")
def reconstruct_stride2(spark, sf_dir):
    """Halfway on the lattice of every second voxel, each axis as far as it is: the mean of two corners."""
    on = (F.col("i") % 2 == 0) & (F.col("j") % 2 == 0) & (F.col("k") % 2 == 0)
    found = windows.reconstruct(full_mask(spark), label_means(spark, sf_dir).where(on), 2, keys=["label"])
    return found.select("label", "i", "j", "k", F.round(F.col("value").cast("double"), 5).alias("value"))


HALF = grid.Grid((7, 7, 7), ((0.5, 0.0, 0.0, 0.0), (0.0, 0.5, 0.0, 0.0), (0.0, 0.0, 0.5, 0.0), (0.0, 0.0, 0.0, 1.0)))
HALF_CELLS = "h AS (SELECT (x // 49)::INT AS i, (x // 7 % 7)::INT AS j, (x % 7)::INT AS k FROM (SELECT unnest(range(0, 343)) AS x))"
_MEANS = "m AS (SELECT label, i, j, k, avg(value) AS value FROM v GROUP BY ALL)"


def label_means(spark, sf_dir) -> DataFrame:
    return voxels(spark, sf_dir).groupBy("label", "i", "j", "k").agg(F.avg("value").alias("value"))


@query(f"""WITH {VOX}, {_MEANS}, {HALF_CELLS}, l AS (SELECT DISTINCT label FROM m)
SELECT l.label, h.i, h.j, h.k, round(coalesce(m.value, 0), 9) AS value FROM l, h LEFT JOIN m ON m.label = l.label AND m.i = (h.i + 1) // 2 AND m.j = (h.j + 1) // 2 AND m.k = (h.k + 1) // 2""")
def regrid_nearest(spark, sf_dir):
    return grid.resampled(label_means(spark, sf_dir), GRID, HALF, "nearest", keys=["label"]).select("label", "i", "j", "k", r9("value"))


def _linear_sql(shift: str = "0", lo: str = "h.{a} // 2", part: str = "(h.{a} % 2) / 2.0") -> str:
    low = {a: lo.format(a=a) for a in "ijk"}
    w = {a: part.format(a=a) for a in "ijk"}
    weight = " * ".join(f"CASE WHEN m.{a} = {low[a]} THEN 1 - {w[a]} ELSE {w[a]} END" for a in "ijk")
    near = " AND ".join(f"m.{a} BETWEEN {low[a]} AND {low[a]} + 1" for a in "ijk")
    return f"SELECT l.label, h.i, h.j, h.k, round(coalesce(sum(m.value * {weight}), 0), 9) AS value FROM l, h LEFT JOIN m ON m.label = l.label AND {near} GROUP BY l.label, h.i, h.j, h.k"


@query(f"WITH {VOX}, {_MEANS}, {HALF_CELLS}, l AS (SELECT DISTINCT label FROM m) {_linear_sql()}")
def regrid_trilinear(spark, sf_dir):
    return grid.resampled(label_means(spark, sf_dir), GRID, HALF, "linear", keys=["label"]).select("label", "i", "j", "k", r9("value"))


def _spline_sql(n: int = 4) -> str:
    """c (label, i, j, k, value): coefficients of cubic B-splines through m, by a forward and a backward recursion an axis."""
    z = grid.POLE
    steps, before = [], "m"
    for axis in "ijk":
        on = " AND ".join(f"r.{c} = s.{c}" for c in ["label", *[c for c in "ijk" if c != axis]])
        others = ", ".join(f"r.{c}" if c != axis else f"r.{axis} + 1 AS {axis}" for c in "ijk")
        back = ", ".join(f"r.{c}" if c != axis else f"r.{axis} - 1 AS {axis}" for c in "ijk")
        kept = ", ".join("0 AS " + c if c == axis else c for c in "ijk")
        group = ", ".join(["label", *[c for c in "ijk" if c != axis]])
        weight = f"CASE WHEN {axis} IN (0, {n - 1}) THEN pow({z!r}, {axis}) ELSE pow({z!r}, {axis}) + pow({z!r}, {2 * n - 2} - {axis}) END"
        last = ", ".join(f"{n - 1} AS {c}" if c == axis else f"s.{c}" for c in "ijk")
        steps.append(f"""f_{axis} AS (SELECT label, {kept}, sum(value * {weight}) / {1 - z ** (2 * n - 2)!r} AS value FROM {before} GROUP BY {group}
  UNION ALL SELECT r.label, {others}, s.value + {z!r} * r.value FROM f_{axis} r JOIN {before} s ON {on} AND s.{axis} = r.{axis} + 1),
b_{axis} AS (SELECT s.label, {last}, {z / (z * z - 1)!r} * (s.value + {z!r} * r.value) AS value FROM f_{axis} s JOIN f_{axis} r ON {on} AND s.{axis} = {n - 1} AND r.{axis} = {n - 2}
  UNION ALL SELECT r.label, {back}, {z!r} * (r.value - s.value) FROM b_{axis} r JOIN f_{axis} s ON {on} AND s.{axis} = r.{axis} - 1),
c_{axis} AS (SELECT label, i, j, k, 6 * value AS value FROM b_{axis})""")
        before = f"c_{axis}"
    return ", ".join(steps)


@query(f"""WITH RECURSIVE {VOX}, {_MEANS}, {HALF_CELLS}, {_spline_sql()},
near AS (SELECT half, CASE WHEN abs(place) > 3 THEN 6 - abs(place) ELSE abs(place) END AS place, sum(w) AS w FROM (SELECT half, half // 2 + d AS place, CASE WHEN half % 2 = 0 THEN CASE abs(d) WHEN 0 THEN 4 / 6.0 WHEN 1 THEN 1 / 6.0 ELSE 0 END ELSE CASE WHEN d IN (0, 1) THEN 23 / 48.0 ELSE 1 / 48.0 END END AS w
  FROM (SELECT unnest(range(0, 7)) AS half), (SELECT unnest([-1, 0, 1, 2]) AS d)) WHERE w > 0 GROUP BY ALL)
SELECT c.label, h.i, h.j, h.k, round(sum(c.value * x.w * y.w * z.w), 9) AS value FROM h JOIN near x ON x.half = h.i JOIN near y ON y.half = h.j JOIN near z ON z.half = h.k JOIN c_k c ON c.i = x.place AND c.j = y.place AND c.k = z.place GROUP BY ALL""")
def regrid_bspline(spark, sf_dir):
    return grid.resampled(label_means(spark, sf_dir), GRID, HALF, "bspline", keys=["label"]).select("label", "i", "j", "k", r9("value"))


@query(f"WITH {VOX}, {_MEANS}, h AS (SELECT i, j, k FROM m WHERE label = (SELECT min(label) FROM m)), l AS (SELECT DISTINCT label FROM m) {_linear_sql(lo='h.{a}', part='0.25')}")
def affine_warp(spark, sf_dir):
    """Every voxel is taken a quarter of a voxel further on; half of that is the affine's, half the field's."""
    move = np.eye(4)
    move[:3, 3] = 0.125
    field = GRID.cells(spark).select("i", "j", "k", *[F.lit(0.125).alias(d) for d in ("dx", "dy", "dz")])
    out, _ = grid.warped(label_means(spark, sf_dir), GRID, GRID, move, field, "linear", keys=["label"])
    return out.select("label", "i", "j", "k", r9("value"))


def _smooth_sql(fwhm: float) -> str:
    sigma = fwhm / grid.FWHM_PER_SIGMA
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w = (w / w.sum()).tolist()
    kernel = "kn AS (SELECT * FROM (VALUES " + ", ".join(f"({d}, {x!r}::DOUBLE)" for d, x in zip(range(-r, r + 1), w)) + ") t(d, w))"
    return f"""WITH {VOX}, {_MEANS}, {kernel}
SELECT o.label, o.i, o.j, o.k, round(sum(m.value * a.w * b.w * c.w), 9) AS value FROM m o JOIN m ON m.label = o.label JOIN kn a ON a.d = o.i - m.i JOIN kn b ON b.d = o.j - m.j JOIN kn c ON c.d = o.k - m.k GROUP BY ALL"""


@query(_smooth_sql(2.0))
def smooth_gaussian(spark, sf_dir):
    return grid.smoothed(label_means(spark, sf_dir), GRID, 2.0, keys=["label"]).select("label", "i", "j", "k", r9("value"))


@query(f"WITH {VOX} SELECT 'label-' || label AS img_id, i, j, k, round(avg(value)::FLOAT::DOUBLE, 5) AS value FROM v GROUP BY ALL")
def volume_files(spark, sf_dir):
    """Mean volumes of the labels written as files and read back."""
    path = shared_folder(spark, "volumes")
    rows = label_means(spark, sf_dir).withColumn("img_id", F.concat(F.lit("label-"), F.col("label").cast("string")))
    nifti.write_volumes(rows, path, GRID.shape, GRID.matrix)
    return nifti.read_volumes(spark, path).select("img_id", "i", "j", "k", F.round("value", 5).alias("value"))


@query("SELECT vec_id AS img_id, 1.0::DOUBLE AS intercept, label::DOUBLE AS label, (vec_id % 5)::DOUBLE AS split FROM embeddings")
def design_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.col("label").cast("string").alias("label"), (F.col("vec_id") % 5).alias("split"))
    return volumes.with_intercept(d, ["label", "split"])


@query(f"WITH {VOX}, {_MEANS} SELECT label, 'i' AS axis, i AS at, j AS row, count(*) AS cells, round(min_by(value, k), 6) AS first, round(max_by(value, k), 6) AS last FROM m GROUP BY label, i, j")
def mosaic(spark, sf_dir):
    s = grid.mosaic_slices(label_means(spark, sf_dir), "i", keys=["label"])
    return s.select("label", "axis", "at", "row", F.size("cells").cast("long").alias("cells"), F.round(F.col("cells")[0], 6).alias("first"), F.round(F.element_at("cells", -1), 6).alias("last"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group t-map, thresholded at a false discovery rate of 5 %: every voxel with its t where it passes, else 0."""
    return threshold.thresholded(t_map(spark, sf_dir)).select("i", "j", "k", F.round("stat", 6).alias("stat"))


QUERIES["group_t_fdr"] = flagship
SQL["group_t_fdr"] = _fdr_sql("abs(t)", 0.025, "t")
