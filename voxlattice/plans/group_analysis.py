"""Group analysis of volumes: t-maps by regressor, thresholded three ways, with a manifest of outputs."""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elementwise import in_mask, masked, transformation_tag, transformed
from ..operators.grid import Grid, resampled, smoothed
from ..operators.permutation import fwer, passed
from ..operators.threshold import thresholded
from ..operators.volumes import ols, validity_mask, with_intercept
from ..sources import paths as files
from ..sources.design import checked_paths, read_design, with_image_ids
from ..sources.nifti import headers, image_id, read_header, read_volumes, write_volumes

MASK_NAMES = {"brain_mask": ("mni", "mni152", "mni_brain", "mni_brain_mask"), "template": ("mni_template", "mni152_template", "mni_t1w_template")}
TAILS = {"two_sided": "", "gt": "_gt_onesided", "lt": "_lt_onesided"}


@dataclass(frozen=True)
class Settings:
    """Choices of a group analysis. templates gives paths for the names brain_mask and template."""

    smoothing_fwhm: float | None = None
    mask: str | None = None
    use_mask_in_thresholding: bool = True
    transformation: str | None = None
    min_std: float | None = None
    min_images: int | None = None
    inference: str = "parametric"
    n_perm: int = 10_000
    seed: int = 0
    tfce: bool = False
    cluster_p: float | None = None
    alpha: float = 0.05
    height_control: str | None = "fdr"
    threshold: float | None = None
    cluster_threshold: int = 20
    overwrite: bool = False
    templates: dict[str, str] = field(default_factory=dict)

    def check(self) -> None:
        if self.inference not in ("parametric", "non_parametric"):
            raise ValueError("inference must be parametric or non_parametric")
        if self.min_std is not None and self.min_std < 0:
            raise ValueError("min_std must be 0 or more")
        if self.min_images is not None and self.min_images < 1:
            raise ValueError("min_images must be 1 or more")
        transformation_tag(self.transformation)

    @property
    def stem(self) -> str:
        """The common part of the thresholded maps' names."""
        a, tag = str(self.alpha).replace(".", "p"), transformation_tag(self.transformation)
        if self.inference == "parametric":
            return f"tmap_{self.height_control}_alpha{a}_k{self.cluster_threshold}{tag}"
        cfp = "" if self.cluster_p is None else "_cfp" + str(self.cluster_p).replace(".", "p")
        return f"tmap_vfwe_alpha{a}{'_tfce' if self.tfce else ''}{cfp}{tag}"


def mask_path(name: str | None, templates: dict[str, str]) -> str:
    """The file behind a mask's name; None means the brain mask, as its names do."""
    wanted = name or "mni"
    for kind, names in MASK_NAMES.items():
        if str(wanted).lower() in names:
            if kind not in templates:
                raise ValueError(f"the mask {wanted!r} needs templates[{kind!r}], the path of that volume; none is bundled")
            return templates[kind]
    return str(wanted)


def analysis_mask(spark: SparkSession, path: str, grid: Grid) -> DataFrame:
    """i, j, k, in_mask on the grid: the mask volume, regridded by nearest neighbours where it differs."""
    h = read_header(path)
    rows = read_volumes(spark, path)
    own = Grid(tuple(h.shape), tuple(map(tuple, h.affine.tolist())))
    if own.shape != grid.shape or not np.allclose(own.matrix, grid.matrix):
        rows = resampled(rows.withColumn("value", in_mask(F.col("value")).cast("double")), own, grid, "nearest")
    return rows.select("i", "j", "k", in_mask(F.col("value")).alias("in_mask"))


def run_id(paths: list[str], settings: Settings) -> str:
    """What outputs depend on; results are used again only under the same one."""
    args = {k: v for k, v in asdict(settings).items() if k != "overwrite"}
    return hashlib.sha1(json.dumps([paths, args], sort_keys=True).encode()).hexdigest()


def group_analysis(spark: SparkSession, maps, out_dir: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """One-sample or covariate model of the given volumes; writes maps and returns the manifest.

    maps: a folder, a CSV or TSV table, a DataFrame, or paths. The manifest has a row a regressor (the intercept among
    them): regressor, group_dir, template_image_path, t_unc_path, thresholded_two_sided_path, thresholded_gt_path, thresholded_lt_path,
    used_map_paths. With covariates each regressor has a folder of its own. Outputs that exist for the same arguments
    are used again unless overwrite is set.
    """
    settings.check()
    folder, design = read_design(spark, maps)
    paths = checked_paths(design)
    covariates = [c for c in design.columns if c not in ("path", "row_id")]
    group_dir = out_dir or (f"{folder.rstrip('/')}/group" if folder else str(Path.cwd() / "group"))
    files.make_folder(group_dir)
    args_path, ident = f"{group_dir}/args.json", run_id(paths, settings)
    known = json.loads(files.read_bytes(args_path)).get("run_id") if files.exists(args_path) else None
    reuse = known == ident and not settings.overwrite
    if not reuse:
        # Whatever is there belongs to other arguments, and may be half replaced when this run stops.
        files.remove(args_path)

    first = read_header(paths[0])
    shapes = headers(spark, paths).groupBy(F.col("shape").cast("string").alias("shape")).agg(F.min("path").alias("path"), F.count_distinct(F.col("affine").cast("string")).alias("affines")).collect()
    if len(shapes) > 1:
        raise ValueError(f"volumes differ in shape: {[(r['shape'], r['path']) for r in shapes]}")
    if shapes[0]["affines"] > 1:
        warnings.warn("volumes have one shape but different affines; they are compared voxel by voxel", stacklevel=2)
    grid = Grid(tuple(first.shape), tuple(map(tuple, first.affine.tolist())))

    shown_on = None
    if "template" in settings.templates:
        # The background for plots, kept with the results.
        shown_on = f"{group_dir}/mni152_template_T1w.nii.gz"
        if not files.exists(shown_on):
            h = read_header(settings.templates["template"])
            write_volumes(read_volumes(spark, settings.templates["template"]).withColumn("img_id", F.lit(image_id(shown_on))), group_dir, h.shape, h.affine)

    design = with_intercept(with_image_ids(design), covariates)
    regressors = ["intercept", *covariates]
    voxels = read_volumes(spark, paths)
    resolved = analysis_mask(spark, mask_path(settings.mask, settings.templates), grid)
    mask = resolved
    if settings.min_std is not None:
        # Spread is judged on the volumes as they are, before transformation and smoothing.
        mask = validity_mask(voxels, settings.min_std, settings.min_images or len(paths), resolved.where("in_mask"))
    inside = mask.where("in_mask").select("i", "j", "k").persist()
    # Voxels that are tested: of the resolved mask, or all; those without a statistic count as zero.
    tested = resolved.where("in_mask").select("i", "j", "k") if settings.use_mask_in_thresholding else grid.cells(spark)
    values = voxels.withColumn("value", transformed(F.col("value"), settings.transformation))
    if settings.smoothing_fwhm:
        values = smoothed(values, grid, settings.smoothing_fwhm)
    values = values.join(inside, ["i", "j", "k"]).persist()
    fitted = ols(values, design, regressors).persist()

    out = []
    for r in regressors:
        where = f"{group_dir}/{r}" if covariates else group_dir
        names = {"unc": f"tmap_unc{transformation_tag(settings.transformation)}"} | {tail: settings.stem + suffix for tail, suffix in TAILS.items()}
        target = {k: f"{where}/{v}.nii.gz" for k, v in names.items()}
        if not (reuse and all(files.exists(p) for p in target.values())):
            t = fitted.select("i", "j", "k", F.col(f"t_{r}").alias("stat"))
            save = lambda rows, name, to=where: write_volumes(rows.withColumn("img_id", F.lit(name)).select("img_id", "i", "j", "k", "value"), to, grid.shape, grid.matrix, 0.0)
            save(t.select("i", "j", "k", F.nanvl("stat", F.lit(0.0)).alias("value")), names["unc"])
            save(resolved.select("i", "j", "k", F.col("in_mask").cast("double").alias("value")), "analysis_mask_resolved", f"{where}/masks")
            if settings.min_std is not None:
                save(mask.select("i", "j", "k", F.col("in_mask").cast("double").alias("value")), "analysis_mask_validity_std", f"{where}/masks")
            for tail in TAILS:
                save(_tail(t, values, design, r, tail, settings, where, save, tested), names[tail])
        out.append((r, where, shown_on, target["unc"], target["two_sided"], target["gt"], target["lt"], paths))
    for df in (fitted, values, inside):
        df.unpersist()
    if not reuse:
        # Last, so that maps are used again only if all of them are of this run.
        shown = asdict(settings) | {"maps": folder or "table", "out_dir": group_dir, "n_maps": len(paths), "covariates": covariates, "run_id": ident}
        files.write_bytes(args_path, json.dumps(shown, indent=2).encode())
    return spark.createDataFrame(out, "regressor string, group_dir string, template_image_path string, t_unc_path string, thresholded_two_sided_path string, thresholded_gt_path string, thresholded_lt_path string, used_map_paths array<string>")


def _tail(t: DataFrame, values: DataFrame, design: DataFrame, regressor: str, tail: str, s: Settings, where: str, save, tested: DataFrame) -> DataFrame:
    """i, j, k, value of one thresholded map; positive in the direction of lt."""
    if s.inference == "parametric":
        named = tested.join(t, ["i", "j", "k"], "left").select(F.lit(tail).alias("map_id"), "i", "j", "k", F.coalesce("stat", F.lit(0.0)).alias("stat"))
        kept = thresholded(named, s.alpha, s.height_control, s.cluster_threshold, tail == "two_sided", s.threshold, -1 if tail == "lt" else 1)
        return kept.select("i", "j", "k", masked(F.col("stat"), F.lit(True)).alias("value"))
    statistic = "max_tfce" if s.tfce else "max_size" if s.cluster_p is not None else "max_t"
    plain = regressor == "intercept" and len(design.columns) == 2
    found = fwer(values, s.n_perm, statistic, tail, None if plain else design, regressor, s.seed, s.cluster_p)
    found = found.persist()
    save(found.select("i", "j", "k", F.col("logp").alias("value")), f"logp_vfwe_alpha{str(s.alpha).replace('.', 'p')}_{tail}", f"{where}/nonparametric_raw")
    kept = passed(found, s.alpha)
    positive = F.col("t") > 0 if tail != "two_sided" else F.lit(True)
    return kept.select("i", "j", "k", masked(F.col("t"), positive).alias("value"))
