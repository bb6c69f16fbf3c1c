"""Queries over files: volumes, designs, transforms, and the group analysis with all that it writes.

The volumes are the labels' mean volumes of the embeddings table, written to the shared folder and read from there.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.elementwise import transformation_tag, transformed
from .functions.normal import critical_value
from .operators import decoding, grid, threshold, volumes
from .__main__ import main
from .plans import searchlight_maps
from .plans.group_analysis import Settings, analysis_mask, group_analysis, mask_path
from .plans.warping import grid_of as plan_grid
from .queries import _MEANS, CLUSTER_SIZE, FOLDS, GRID, HALF, HALF_CELLS, PERMS, VOX, _linear_sql, _maxt_sql, _tfce_sql, binary, features, full_mask, label_means, query, targets, voxels
from .sources import design, nifti, paths
from .sources.shared import shared_folder

def study(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a volume a label, 2 mm apart, and a mask beside it that leaves out the plane i = 3."""
    path = shared_folder(spark, "study")
    affine = [[2.0, 0, 0, -3], [0, 2.0, 0, -3], [0, 0, 2.0, -3], [0, 0, 0, 1]]
    rows = label_means(spark, sf_dir).withColumn("img_id", F.concat(F.lit("label-"), F.col("label").cast("string")))
    nifti.write_volumes(rows, path, GRID.shape, affine, dtype="f8")
    mask = full_mask(spark).select(F.lit("mask").alias("img_id"), "i", "j", "k", (F.col("i") < 3).cast("double").alias("value"))
    nifti.write_volumes(mask, f"{path}/masks", GRID.shape, affine)
    return path


def rows(spark: SparkSession, names: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, names)


LABELS = "SELECT DISTINCT label FROM embeddings"


@query(f"SELECT 'label-' || label || '.nii.gz' AS name FROM ({LABELS})")
def file_listing(spark, sf_dir):
    return nifti.listing(spark, study(spark, sf_dir)).select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query(f"SELECT 'label-' || label AS img_id, '4x4x4' AS shape, 2.0::DOUBLE AS zoom, -3.0::DOUBLE AS origin, 'f8' AS dtype FROM ({LABELS})")
def volume_headers(spark, sf_dir):
    h = nifti.headers(spark, nifti.list_files(study(spark, sf_dir)))
    return h.select("img_id", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), F.array_max("zooms").alias("zoom"), F.col("affine")[2][3].alias("origin"), "dtype")


@query(f"SELECT source, 'label-' || label AS img_id, CASE WHEN source IN ('csv', 'tsv') THEN (label * 2)::DOUBLE END AS age FROM ({LABELS}), (SELECT unnest(['csv', 'tsv', 'folder', 'paths', 'table']) AS source)")
def design_sources(spark, sf_dir):
    """One design from a CSV with a byte order mark and another delimiter, a TSV, a folder, paths and a table."""
    folder = study(spark, sf_dir)
    files = nifti.list_files(folder)
    ages = {f: 2 * int(nifti.image_id(f).split("-")[1]) for f in files}
    for name, sep, head in (("d.csv", ";", "﻿ Map_Path ;age"), ("d.tsv", "\t", "PATH\tage")):
        paths.write_bytes(f"{folder}/tables/{name}", "\n".join([head, *(f"{f}{sep}{a}" for f, a in ages.items())]).encode())
    given = {"csv": f"{folder}/tables/d.csv", "tsv": f"{folder}/tables/d.tsv", "folder": folder, "paths": files, "table": rows(spark, "map_path string", [(f,) for f in files])}
    out = None
    for source, maps in given.items():
        _, d = design.read_design(spark, maps)
        design.checked_paths(d)
        d = design.with_image_ids(d)
        one = d.select(F.lit(source).alias("source"), "img_id", (F.col("age").cast("double") if "age" in d.columns else F.lit(None).cast("double")).alias("age"))
        out = one if out is None else out.unionByName(one)
    return out


def caught(calls: dict) -> list[tuple[str, str]]:
    """(case, type of the error that it raises, or none)."""
    out = []
    for name, call in calls.items():
        try:
            call()
            out.append((name, "none"))
        except Exception as e:
            out.append((name, type(e).__name__))
    return out


def as_values(pairs: dict) -> str:
    """SQL of a table of two columns of text."""
    return ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())


DESIGN_ERRORS = {"no maps": "ValueError", "one map": "ValueError", "missing maps": "FileNotFoundError", "no path column": "ValueError", "no such table": "FileNotFoundError", "words for numbers": "ValueError", "covariate named intercept": "ValueError", "fine": "none"}


@query(f"SELECT * FROM (VALUES {as_values(DESIGN_ERRORS)}) t(name, error)")
def design_errors(spark, sf_dir):
    """What a design may not be."""
    named = lambda *p: rows(spark, "path string", [(x,) for x in p])
    files = nifti.list_files(study(spark, sf_dir))
    table = rows(spark, "img_id string, age string", [("a", "1"), ("b", "old")])
    calls = {
        "no maps": lambda: design.checked_paths(named("x").where("false")),
        "one map": lambda: design.checked_paths(named(files[0])),
        "missing maps": lambda: design.checked_paths(named("/no/a.nii", "/no/b.nii")),
        "no path column": lambda: design.read_design(spark, rows(spark, "x string", [("a",)])),
        "no such table": lambda: design.read_design(spark, "/no/table.csv"),
        "words for numbers": lambda: volumes.with_intercept(table, ["age"]),
        "covariate named intercept": lambda: volumes.with_intercept(table.withColumnRenamed("age", "Intercept"), ["Intercept"]),
        "fine": lambda: design.checked_paths(named(*files)),
    }
    return rows(spark, "name string, error string", caught(calls))


@query("""SELECT c AS name, CASE WHEN n = good THEN 'none' ELSE 'ValueError' END AS error FROM (
  SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS c, count(*) AS n,
    unnest([count(try_cast(c_custkey AS DOUBLE)), count(try_cast(c_name AS DOUBLE)), count(try_cast(c_nationkey AS DOUBLE)), count(try_cast(c_acctbal AS DOUBLE)), count(try_cast(c_mktsegment AS DOUBLE))]) AS good FROM customer)""")
def design_coercion(spark, sf_dir):
    """Which columns of a table of text can be covariates: those that are numbers throughout."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    table = c.select(F.concat(F.lit("img"), F.col("c_custkey").cast("string")).alias("img_id"), *[F.concat(F.lit(" "), F.col(n).cast("string")).alias(n) for n in names])
    return rows(spark, "name string, error string", caught({n: lambda n=n: volumes.with_intercept(table, [n]) for n in names}))


STEM = "_from-T1w_to-MNI152NLin2009cAsym_mode-image_xfm"


@query(f"""SELECT n_name AS subject, 'sub-' || n_nationkey || '{STEM}' || CASE WHEN n_nationkey % 2 = 0 THEN '.parquet' ELSE '.h5' END AS transform,
  CASE n_nationkey % 3 WHEN 0 THEN 'sub-' || n_nationkey || '_space-MNI152NLin2009cAsym_res-2_T1w.nii.gz' WHEN 1 THEN 'sub-' || n_nationkey || '_space-MNI152NLin2009cAsym_res-1_T1w.nii.gz' ELSE 'template.nii' END AS reference FROM nation""")
def transform_discovery(spark, sf_dir):
    """The transform and the reference of a subject a nation: a table beside or in place of an HDF5 file; two references, one or none."""
    base = shared_folder(spark, "subjects")
    out = []
    # 25 rows.
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect():
        n = r["n_nationkey"]
        anat = f"{base}/sub-{n}/anat"
        files = [f"sub-{n}{STEM}.h5"] + [f"sub-{n}{STEM}.parquet"] * (n % 2 == 0) + [f"sub-{n}_space-MNI152NLin2009cAsym_{x}_T1w.nii.gz" for x in (("res-1", "res-2"), ("res-1",), ())[n % 3]]
        for f in files:
            paths.write_bytes(f"{anat}/{f}", b"")
        found = design.find_transform(f"{base}/sub-{n}", "template.nii")
        out.append((r["n_name"], *(os.path.basename(x) for x in found)))
    return rows(spark, "subject string, transform string, reference string", out)


METHODS = {"lin": "linear", "anything": "linear", "NN": "nearest", "nearestNeighbor": "nearest"}
_WEIGHT = "(1 + i + 2 * j + 3 * k)"


@query(f"""WITH {VOX}, {_MEANS}, {HALF_CELLS}, l AS (SELECT DISTINCT label FROM m),
lin AS ({_linear_sql()}), near AS (SELECT l.label, h.i, h.j, h.k, coalesce(m.value, 0) AS value FROM l, h LEFT JOIN m ON m.label = l.label AND m.i = (h.i + 1) // 2 AND m.j = (h.j + 1) // 2 AND m.k = (h.k + 1) // 2),
t AS (SELECT 'linear' AS method, label, sum(value * {_WEIGHT}) AS total FROM lin GROUP BY ALL UNION ALL SELECT 'nearest', label, sum(value * {_WEIGHT}) FROM near GROUP BY ALL)
SELECT name, label, round(total, 5) AS total FROM t JOIN (VALUES {as_values(METHODS)}) n(name, method) USING (method)""")
def option_names(spark, sf_dir):
    """Names of interpolations, known and unknown ones: what the volumes come to under each."""
    out = None
    for name in METHODS:
        one = grid.resampled(label_means(spark, sf_dir), GRID, HALF, name, keys=["label"])
        one = one.groupBy("label").agg(F.round(F.sum(F.col("value") * F.expr(_WEIGHT)), 5).alias("total")).select(F.lit(name).alias("name"), "label", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT label, replace(printf('%g', 1 + label / 4.0), '.', 'p') || '_2_' || (label + 1) AS tag FROM ({LABELS})")
def voxel_size_names(spark, sf_dir):
    """The voxel sizes of a file a label, as they stand in file names."""
    path = shared_folder(spark, "sizes")
    means = label_means(spark, sf_dir).withColumn("img_id", F.col("label").cast("string"))
    labels = [r[0] for r in means.select("label").distinct().collect()]
    for n in labels:
        nifti.write_volumes(means.where(F.col("label") == n), path, GRID.shape, [[1 + n / 4, 0, 0, 0], [0, 2, 0, 0], [0, 0, n + 1, 0], [0, 0, 0, 1]])
    found = nifti.headers(spark, nifti.list_files(path)).select("img_id", "zooms").collect()
    return rows(spark, "label int, tag string", [(int(r["img_id"]), grid.zoom_tag(r["zooms"])) for r in found])


MASKS = {"mni152": "brain", "MNI_template": "other", "none": "brain", "own path": "other"}


@query(f"""WITH {VOX}, b AS (SELECT i, j, k, avg(value) FILTER (WHERE label = 0) > 0 AS brain, avg(value) FILTER (WHERE label = 1) > 0 AS other FROM v GROUP BY ALL)
SELECT name, i, j, k, CASE WHEN kind = 'brain' THEN brain ELSE other END AS in_mask FROM b, (VALUES {as_values(MASKS)}) n(name, kind)""")
def mask_names(spark, sf_dir):
    """Masks by their names, by none and by a path: the mean volumes of two labels, where they are above 0."""
    folder = study(spark, sf_dir)
    templates = {"brain_mask": f"{folder}/label-0.nii.gz", "template": f"{folder}/label-1.nii.gz"}
    asked = {"mni152": "mni152", "MNI_template": "MNI_template", "none": None, "own path": templates["template"]}
    own = plan_grid(templates["brain_mask"])
    out = None
    for name, mask in asked.items():
        one = analysis_mask(spark, mask_path(mask, templates), own).select(F.lit(name).alias("name"), "i", "j", "k", "in_mask")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {VOX} SELECT tag, img_id, pos, round(CASE WHEN tag = '' THEN value ELSE atanh(greatest(-1 + 1e-7, least(1 - 1e-7, value))) END, 9) AS value FROM v, (SELECT unnest(['', '_fisherz']) AS tag)")
def transformation_by_name(spark, sf_dir):
    v = voxels(spark, sf_dir)
    one = lambda name: v.select(F.lit(transformation_tag(name)).alias("tag"), "img_id", F.col("pos").cast("long").alias("pos"), F.round(transformed(F.col("value"), name), 9).alias("value"))
    return one(None).unionByName(one("Fisher_Z"))


@query(f"""WITH {VOX}, {_MEANS} SELECT label || ':' || kind AS map_id, count(*) AS n, round(sum(CASE WHEN kind = 'whole' AND abs(value) > 0.02 THEN abs(value) ELSE 0 END), 6)::DOUBLE AS total
FROM m, (SELECT unnest(['missing', 'zero', 'whole']) AS kind) GROUP BY ALL""")
def degenerate_maps(spark, sf_dir):
    """Maps without finite values, and those without anything but zeros, are zero after thresholding, beside whole ones."""
    means = label_means(spark, sf_dir)
    kinds = {"missing": F.lit(float("nan")), "zero": F.col("value") * 0, "whole": F.col("value")}
    parts = [means.select(F.concat_ws(":", F.col("label").cast("string"), F.lit(k)).alias("map_id"), "i", "j", "k", v.alias("stat")) for k, v in kinds.items()]
    kept = threshold.thresholded(parts[0].unionByName(parts[1]).unionByName(parts[2]), height_control=None, threshold=0.02)
    return kept.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("stat")), 6).alias("total"))


@query("SELECT vec_id AS sample_id, window_id::BIGINT AS window_id, 0::INT AS n_features, NULL::DOUBLE AS y_pred, 2::BIGINT AS warnings FROM embeddings, (SELECT unnest([1, 7]) AS window_id)")
def empty_windows(spark, sf_dir):
    """Windows that are empty, and members that have no features: NaN for every sample, and two warnings."""
    members = rows(spark, "window_id long, pos int, voxel_id long", [(1, 0, None), (7, 0, 64), (7, 1, 99), (3, 0, 5), (3, 1, 1000)])
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        found = decoding.windows_decoding(features(spark, sf_dir), members, targets(spark, sf_dir))
    n = sum("windows" in str(w.message) for w in seen)
    return found.where("window_id <> 3").select("sample_id", "window_id", "n_features", F.when(~F.isnan("y_pred"), F.col("y_pred")).alias("y_pred"), F.lit(n).cast("long").alias("warnings"))


# --- the group analysis -----------------------------------------------------------------------------------------------

INSIDE = "i < 3"
TG = f"""{VOX}, {_MEANS}, t AS (SELECT i, j, k, avg(value) / (stddev_samp(value) / sqrt(count(*))) AS t, stddev_samp(value) AS sd FROM m GROUP BY ALL)"""


def analysed(spark: SparkSession, sf_dir: str, **options) -> tuple[str, DataFrame]:
    folder = study(spark, sf_dir)
    settings = Settings(mask=f"{folder}/masks/mask.nii.gz", cluster_threshold=0, height_control="fpr", **options)
    return folder, group_analysis(spark, folder, f"{folder}/group", settings)


def read_map(spark: SparkSession, path: str, digits: int = 4) -> DataFrame:
    return nifti.read_volumes(spark, path).select("img_id", "i", "j", "k", F.round("value", digits).alias("value"))


@query("SELECT 'intercept' AS regressor, 'tmap_unc.nii.gz' AS t_unc, 'tmap_fpr_alpha0p05_k0.nii.gz' AS two_sided, 'tmap_fpr_alpha0p05_k0_gt_onesided.nii.gz' AS gt, 'tmap_fpr_alpha0p05_k0_lt_onesided.nii.gz' AS lt, (SELECT count(DISTINCT label) FROM embeddings)::INT AS n_used")
def group_manifest(spark, sf_dir):
    _, m = analysed(spark, sf_dir)
    base = lambda c, name: F.element_at(F.split(c, "/"), -1).alias(name)
    return m.select("regressor", base("t_unc_path", "t_unc"), base("thresholded_two_sided_path", "two_sided"), base("thresholded_gt_path", "gt"), base("thresholded_lt_path", "lt"), F.size("used_map_paths").alias("n_used"))


@query(f"""WITH {TG}, o AS (SELECT i, j, k, CASE WHEN {INSIDE} THEN t ELSE 0 END AS t FROM t)
SELECT name AS img_id, i, j, k, round(CASE name WHEN 'tmap_unc' THEN t WHEN 'tmap_fpr_alpha0p05_k0' THEN CASE WHEN abs(t) > {critical_value(0.025)!r} THEN t ELSE 0 END
  WHEN 'tmap_fpr_alpha0p05_k0_gt_onesided' THEN CASE WHEN t > {critical_value(0.05)!r} THEN t ELSE 0 END ELSE CASE WHEN -t > {critical_value(0.05)!r} THEN -t ELSE 0 END END::FLOAT::DOUBLE, 3) AS value
FROM o, (SELECT unnest(['tmap_unc', 'tmap_fpr_alpha0p05_k0', 'tmap_fpr_alpha0p05_k0_gt_onesided', 'tmap_fpr_alpha0p05_k0_lt_onesided']) AS name)""")
def group_maps(spark, sf_dir):
    """The t-map and the three thresholded maps, as they stand in their files."""
    folder, _ = analysed(spark, sf_dir)
    return read_map(spark, f"{folder}/group", 3)


@query(f"WITH {TG} SELECT name AS img_id, i, j, k, CASE WHEN {INSIDE} AND (name = 'analysis_mask_resolved' OR sd >= 0.02) THEN 1 ELSE 0 END::DOUBLE AS value FROM t, (SELECT unnest(['analysis_mask_resolved', 'analysis_mask_validity_std']) AS name)")
def group_masks(spark, sf_dir):
    folder, _ = analysed(spark, sf_dir, min_std=0.02)
    return read_map(spark, f"{folder}/group/masks")


@query(f"""SELECT * FROM (VALUES ('alpha', '0.05'), ('height_control', 'fpr'), ('inference', 'parametric'), ('n_maps', (SELECT count(DISTINCT label)::VARCHAR FROM embeddings)), ('transformation', 'fisherz'), ('reused', 'True'), ('made again', 'True')) t(name, value)""")
def group_arguments(spark, sf_dir):
    """args.json, and that a second run with the same arguments makes nothing again, but one that is told to overwrite does."""
    folder, m = analysed(spark, sf_dir, transformation="fisherz")
    args = json.loads(paths.read_bytes(f"{folder}/group/args.json"))
    made = lambda: paths.filesystem(file)[0].get_file_info(paths.filesystem(file)[1]).mtime
    file = m.first()["t_unc_path"]
    settings = Settings(mask=f"{folder}/masks/mask.nii.gz", cluster_threshold=0, height_control="fpr", transformation="fisherz")
    first = made()
    group_analysis(spark, folder, f"{folder}/group", settings)
    second = made()
    group_analysis(spark, folder, f"{folder}/group", Settings(**settings.__dict__ | {"overwrite": True}))
    out = [(k, str(args[k])) for k in ("alpha", "height_control", "inference", "n_maps", "transformation")]
    return rows(spark, "name string, value string", [*out, ("reused", str(first == second)), ("made again", str(made() != second))])


_NULL_OF_MEANS = _maxt_sql("t", "t").replace(f"WITH {VOX}", f"WITH {VOX.replace('v AS (', 'v0 AS (', 1)}, v AS (SELECT 'label-' || label AS img_id, pos, avg(value) AS value FROM v0 WHERE i < 3 GROUP BY ALL)").replace("round((1 +", "((1 +").replace(".0, 6)::DOUBLE AS p", ".0)::DOUBLE AS p")


@query(f"WITH r AS ({_NULL_OF_MEANS}) SELECT i, j, k, round(coalesce(-log10(p), 0)::FLOAT::DOUBLE, 4) AS logp FROM (SELECT (x // 16)::INT AS i, (x // 4 % 4)::INT AS j, (x % 4)::INT AS k FROM (SELECT unnest(range(0, 64)) AS x)) LEFT JOIN r USING (i, j, k)")
def group_raw_logp(spark, sf_dir):
    """The map of -log10 p that a permutation analysis leaves beside its results."""
    folder, _ = analysed(spark, sf_dir, inference="non_parametric", n_perm=PERMS)
    found = nifti.read_volumes(spark, f"{folder}/group/nonparametric_raw")
    return found.where("img_id like '%_gt'").select("i", "j", "k", F.round("value", 4).alias("logp"))


def _of_means(sql: str) -> str:
    """A query over images as one over the labels' mean volumes inside the mask."""
    return sql.replace(VOX, f"{VOX.replace('v AS (', 'v0 AS (', 1)}, v AS (SELECT 'label-' || label AS img_id, pos, avg(value) AS value FROM v0 WHERE i < 3 GROUP BY ALL)").replace("round((1 +", "((1 +").replace(".0, 6)::DOUBLE AS p", ".0)::DOUBLE AS p")


def _raw_of_statistics() -> str:
    logp = "SELECT '{s}' AS statistic, i, j, k, round(coalesce(-log10(p), 0)::FLOAT::DOUBLE, 4) + 0.0::DOUBLE AS logp FROM (SELECT (x // 16)::INT AS i, (x // 4 % 4)::INT AS j, (x % 4)::INT AS k FROM (SELECT unnest(range(0, 64)) AS x)) LEFT JOIN ({q}) USING (i, j, k)"
    return " UNION ALL ".join(f"({logp.format(s=s, q=_of_means(q))})" for s, q in (("size", CLUSTER_SIZE), ("tfce", _tfce_sql(20))))


@query(_raw_of_statistics())
def group_statistics(spark, sf_dir):
    """The permutation statistic that the settings choose: the size of clusters that a p forms, or enhanced values."""
    out = None
    for name, options in (("size", {"cluster_p": 0.2}), ("tfce", {"tfce": True})):
        folder, _ = analysed(spark, sf_dir, inference="non_parametric", n_perm=20, **options)
        one = nifti.read_volumes(spark, f"{folder}/group/nonparametric_raw").where("img_id like '%_two_sided'")
        one = one.select(F.lit(name).alias("statistic"), "i", "j", "k", F.round("value", 4).alias("logp"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {VOX}, {_MEANS} SELECT 'mni152_template_T1w' AS img_id, i, j, k, round(value::FLOAT::DOUBLE, 4) AS value FROM m WHERE label = 2")
def group_background(spark, sf_dir):
    """The template that is kept with the results as a background for plots."""
    folder = study(spark, sf_dir)
    settings = Settings(mask=f"{folder}/masks/mask.nii.gz", cluster_threshold=0, height_control="fpr", templates={"template": f"{folder}/label-2.nii.gz"})
    shown = group_analysis(spark, folder, f"{folder}/group", settings).first()["template_image_path"]
    return read_map(spark, shown)


@query(f"WITH {TG} SELECT 'tmap_bonferroni_alpha0p1_k0' AS img_id, i, j, k, round(CASE WHEN {INSIDE} AND abs(t) > {critical_value(0.05 / 48)!r} THEN t ELSE 0 END::FLOAT::DOUBLE, 3) AS value FROM t")
def command_line(spark, sf_dir):
    """The group analysis as it is called from the command line."""
    folder = study(spark, sf_dir)
    with contextlib.redirect_stdout(io.StringIO()):
        main(["second_level", folder, "--out-dir", f"{folder}/cli", "--mask", f"{folder}/masks/mask.nii.gz", "--alpha", "0.1", "--height-control", "bonferroni", "--cluster-threshold", "0"])
    return read_map(spark, f"{folder}/cli/tmap_bonferroni_alpha0p1_k0.nii.gz", 3)


@query(f"""WITH {FOLDS.replace("label::DOUBLE AS y", "(label >= 5)::INT::DOUBLE AS y")},
r AS (SELECT voxel_id, x.y, rank() OVER w + (count(*) OVER (PARTITION BY voxel_id, y_pred) - 1) / 2.0 AS rank FROM p JOIN (SELECT DISTINCT sample_id, y FROM x) x USING (sample_id) WINDOW w AS (PARTITION BY voxel_id ORDER BY y_pred)),
s AS (SELECT voxel_id, count(*) AS n, sum(y) AS n_pos, sum(rank) FILTER (WHERE y = 1)::DOUBLE AS r FROM r GROUP BY 1)
SELECT 'sub-1_searchlight_auc' AS img_id, (voxel_id // 16)::INT AS i, (voxel_id // 4 % 4)::INT AS j, (voxel_id % 4)::INT AS k, round(((r - n_pos * (n_pos + 1) / 2.0) / (n_pos * (n - n_pos)))::FLOAT::DOUBLE, 4) AS value FROM s""")
def searchlight_files(spark, sf_dir):
    """Metric maps of a subject as they stand in their files."""
    path = shared_folder(spark, "searchlight")
    t = binary(targets(spark, sf_dir))
    mask = full_mask(spark)
    pred, centres = searchlight_maps.searchlight_predictions(features(spark, sf_dir), mask, t, 0)
    maps = searchlight_maps.metric_maps(pred, centres, mask, t, "roc_auc", "auc")
    searchlight_maps.save_metric_maps(maps, path, "sub-1", GRID.shape, GRID.matrix)
    return read_map(spark, path)
