import gzip
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxlattice import __main__ as cli
from voxlattice.operators import grid, permutation, windows
from voxlattice.plans.group_analysis import Settings, group_analysis, mask_path
from voxlattice.sources import design, nifti

CUBE = grid.Grid((4, 4, 4))


def mask(spark):
    return CUBE.cells(spark)


def volume_rows(spark, data, img="a"):
    return spark.createDataFrame([(img, *map(int, c), float(data[tuple(c)])) for c in np.ndindex(data.shape)], "img_id string, i int, j int, k int, value double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["i"], r["j"], r["k"]] = np.nan if r["value"] is None else r["value"]
    return out


def test_window_sizes(spark):
    sizes = [len(r["voxel_ids"]) for r in windows.searchlight_windows(mask(spark), 1).collect()]
    assert sorted(sizes) == sorted([8] * 8 + [12] * 24 + [18] * 24 + [27] * 8)
    assert windows.searchlight_windows(mask(spark), 1, 2).count() == 8
    assert windows.searchlight_windows(mask(spark), 0, 9).count() == 1
    assert windows.searchlight_windows(mask(spark).where("false"), 1).count() == 0
    for bad in ((-1, 1), (1, 0)):
        with pytest.raises(ValueError):
            windows.searchlight_members(mask(spark), *bad)


def test_membership_is_symmetric_and_in_c_order(spark):
    m = windows.searchlight_members(mask(spark).where("(i + 2 * j + 3 * k) % 5 <> 0"), 1).toPandas()
    pairs = set(zip(m.window_id, m.voxel_id))
    assert all((b, a) in pairs for a, b in pairs)
    for _, g in m.groupby("window_id"):
        assert g.sort_values("pos").voxel_id.is_monotonic_increasing


def test_reconstruct(spark):
    line = lambda df: df.withColumn("value", F.expr("2 + i - 2 * j + 0.25 * k"))
    full = mask(spark)
    assert array(windows.reconstruct(full, line(full)), (4, 4, 4)) == pytest.approx(np.fromfunction(lambda i, j, k: 2 + i - 2 * j + 0.25 * k, (4, 4, 4)))
    got = array(windows.reconstruct(full, line(full.where("i % 3 = 0 and j % 3 = 0 and k % 3 = 0")), 3), (4, 4, 4))
    assert got == pytest.approx(np.fromfunction(lambda i, j, k: 2 + i - 2 * j + 0.25 * k, (4, 4, 4)))
    some = array(windows.reconstruct(full, line(full.where("i = 0")), 1, fill=-1.0), (4, 4, 4))
    assert (some[1:] == -1).all()


def test_resampling(spark):
    data = np.random.default_rng(0).normal(size=(4, 4, 4))
    v = volume_rows(spark, data)
    assert array(grid.resampled(v, CUBE, CUBE), (4, 4, 4)) == pytest.approx(data)
    fine = CUBE.with_spacing((0.5, 1.0, 1.0))
    assert fine.shape == (8, 4, 4) and fine.zooms == pytest.approx((0.5, 1, 1))
    got = array(grid.resampled(v, CUBE, fine), fine.shape)
    assert got[0::2] == pytest.approx(data) and got[1:-1:2] == pytest.approx((data[1:] + data[:-1]) / 2)
    near = array(grid.resampled(v, CUBE, fine, "nn"), fine.shape)
    assert near[0::2] == pytest.approx(data)
    assert grid.interpolation("whatever") == "linear" and grid.zoom_tag((2.5, 2.0, 2.0)) == "2p5_2_2"


def test_warp_by_field_and_affine(spark):
    data = np.random.default_rng(1).normal(size=(4, 4, 4))
    move = np.eye(4)
    move[0, 3] = 1.0
    field = mask(spark).select("i", "j", "k", F.lit(0.0).alias("dx"), F.lit(1.0).alias("dy"), F.lit(0.0).alias("dz"))
    out, target = grid.warped(volume_rows(spark, data), CUBE, CUBE, move, field, "nearest")
    got = array(out, target.shape)
    assert got[:-1, :-1] == pytest.approx(data[1:, 1:]) and not got[-1].any()


def test_smoothing(spark):
    data = np.zeros((4, 4, 4))
    data[1, 1, 1] = 1.0
    s = 2.0 / grid.FWHM_PER_SIGMA
    r = int(4 * s + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
    w /= w.sum()
    axis = np.array([w[x - 1 + r] if abs(x - 1) <= r else 0 for x in range(4)])
    assert array(grid.smoothed(volume_rows(spark, data), CUBE, 2.0), (4, 4, 4)) == pytest.approx(np.einsum("i,j,k", axis, axis, axis))
    assert array(grid.smoothed(volume_rows(spark, data), CUBE, None), (4, 4, 4)) == pytest.approx(data)


def test_fwer(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(10, 3)) + np.array([4.0, -4.0, 0])
    rows = spark.createDataFrame([(f"{n:02d}", 0, 0, k, float(data[n, k])) for n in range(10) for k in range(3)], "img_id string, i int, j int, k int, value double")
    two = {r["k"]: r for r in permutation.fwer(rows, 99, "max_t").collect()}
    t = data.mean(0) / (data.std(0, ddof=1) / np.sqrt(10))
    assert [two[k]["t"] for k in range(3)] == pytest.approx(t)
    assert two[0]["p"] <= 0.05 and two[1]["p"] <= 0.05 and two[2]["p"] > 0.05
    gt = {r["k"]: r for r in permutation.fwer(rows, 99, "max_t", "gt").collect()}
    lt = {r["k"]: r for r in permutation.fwer(rows, 99, "max_t", "lt").collect()}
    assert gt[0]["p"] <= 0.05 < gt[1]["p"] and lt[1]["p"] <= 0.05 < lt[0]["p"] and lt[1]["t"] > 0
    for o in ({"statistic": "max_tfce"}, {"statistic": "max_size", "cluster_p": 0.05}):
        assert permutation.fwer(rows, 20, **o).count() == 3
    for bad in ({"statistic": "x"}, {"tail": "x"}, {"statistic": "max_size"}):
        with pytest.raises(ValueError):
            permutation.fwer(rows, 5, **bad)


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    rng = np.random.default_rng(5)
    paths = []
    for n in range(8):
        data = rng.normal(0, 0.1, (4, 4, 4))
        data[:2] += 0.6
        data[3] = 0.2
        p = root / f"sub-{n}.nii.gz"
        p.write_bytes(gzip.compress(nifti.volume_bytes(data, np.eye(4), "f8")))
        paths.append(str(p))
    (root / "mask").mkdir()
    (root / "mask" / "mask.nii").write_bytes(nifti.volume_bytes(np.ones((4, 4, 4)), np.eye(4), "u1"))
    (root / "notes.txt").write_text("no volume")
    return root, paths


def test_nifti_round_trip(spark, study, tmp_path):
    root, paths = study
    assert nifti.list_files(str(root)) == sorted(paths)
    assert [os.path.basename(r["path"]) for r in nifti.listing(spark, str(root)).collect()] == [os.path.basename(p) for p in paths]
    v = nifti.read_volumes(spark, str(root))
    assert v.count() == 8 * 64
    _, data = nifti.read_volume(paths[0])
    assert array(v.where("img_id = 'sub-0'"), (4, 4, 4)) == pytest.approx(data)
    h = nifti.headers(spark, paths).where("img_id = 'sub-3'").first()
    assert h["shape"] == [4, 4, 4] and h["zooms"] == [1, 1, 1] and h["dtype"] == "f8"
    affine = np.diag([2.0, 3, 4, 1])
    rows = v.where("img_id < 'sub-2'").withColumn("value", F.when(F.col("k") == 0, F.lit(math.nan)).otherwise(F.col("value")))
    nifti.write_volumes(rows, str(tmp_path / "out"), (4, 4, 4), affine)
    head, back = nifti.read_volume(str(tmp_path / "out" / "sub-0.nii.gz"))
    assert head.zooms == (2, 3, 4) and np.isnan(back[:, :, 0]).all() and back[:, :, 1:] == pytest.approx(data[:, :, 1:], abs=1e-6)
    before = os.path.getmtime(tmp_path / "out" / "sub-0.nii.gz")
    nifti.write_volumes(rows.withColumn("value", F.lit(1.0)), str(tmp_path / "out"), (4, 4, 4), affine, mode="ignore")
    assert os.path.getmtime(tmp_path / "out" / "sub-0.nii.gz") == before
    with pytest.raises(ValueError):
        nifti.parse_header(b"x" * 352)


def test_scaling_and_quaternions(tmp_path):
    import struct

    raw = bytearray(nifti.volume_bytes(np.arange(8).reshape(2, 2, 2), np.eye(4), "i2"))
    struct.pack_into("<2f", raw, 112, 2.0, 1.0)
    struct.pack_into("<2h", raw, 252, 1, 0)
    struct.pack_into("<6f", raw, 256, 0, 0, 1, 5, 6, 7)
    (tmp_path / "x.nii").write_bytes(bytes(raw))
    h, data = nifti.read_volume(str(tmp_path / "x.nii"))
    assert data.ravel().tolist() == [2 * v + 1 for v in range(8)]
    assert h.affine == pytest.approx(np.array([[-1, 0, 0, 5], [0, -1, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1.0]]))


def test_designs(spark, study, tmp_path):
    root, paths = study
    folder, d = design.read_design(spark, str(root))
    assert folder == str(root) and d.count() == 8
    semi = tmp_path / "d.csv"
    semi.write_text("﻿ Map_Path ;age\n" + "\n".join(f"{p};{n}" for n, p in enumerate(paths)), encoding="utf-8")
    assert design.read_design(spark, str(semi))[1].columns == ["path", "age"]
    both = design.read_design(spark, pd.DataFrame({"PATH": ["a"], "map_path": ["b"]}))[1]
    assert both.columns == ["path", "map_path"] and both.first()["path"] == "a"
    assert design.read_design(spark, paths)[1].count() == 8 and design.read_design(spark, "one.nii")[1].count() == 1
    one = tmp_path / "one.csv"
    one.write_text("a|b\n1|2\n")
    for bad, kind in ((pd.DataFrame({"x": ["a"]}), ValueError), (pd.DataFrame({"path;age": ["a;1"]}), ValueError), ([["a"], ["b"]], ValueError), (str(tmp_path / "no.csv"), FileNotFoundError)):
        with pytest.raises(kind):
            design.read_design(spark, bad)
    for bad, kind in (([], ValueError), (["a"], ValueError), (["/no/a", "/no/b"], FileNotFoundError)):
        with pytest.raises(kind):
            design.checked_paths(spark.createDataFrame([(p,) for p in bad], "path string"))


def test_find_transform(tmp_path):
    anat = tmp_path / "sub-1" / "anat"
    anat.mkdir(parents=True)
    with pytest.raises(FileNotFoundError, match="transform"):
        design.find_transform(str(tmp_path / "sub-1"))
    (anat / "sub-1_from-T1w_to-MNI152NLin2009cAsym_mode-image_xfm.h5").touch()
    with pytest.raises(FileNotFoundError, match="reference"):
        design.find_transform(str(tmp_path / "sub-1"))
    assert design.find_transform(str(tmp_path / "sub-1"), "t.nii")[1] == "t.nii"
    for n in ("res-1", "res-2"):
        (anat / f"sub-1_space-MNI152NLin2009cAsym_{n}_T1w.nii.gz").touch()
    assert "res-2" in design.find_transform(str(tmp_path / "sub-1"))[1]


def test_group_analysis(spark, study, tmp_path):
    root, paths = study
    s = Settings(mask=str(root / "mask" / "mask.nii"), cluster_threshold=2, transformation="fisherz", min_std=0.01)
    out = group_analysis(spark, str(root), str(tmp_path / "g"), s).first()
    assert os.path.basename(out["thresholded_gt_path"]) == "tmap_fdr_alpha0p05_k2_fisherz_gt_onesided.nii.gz"
    assert os.path.basename(out["t_unc_path"]) == "tmap_unc_fisherz.nii.gz"
    data = np.stack([nifti.read_volume(p)[1] for p in paths])
    z = np.arctanh(np.clip(data, -1 + 1e-7, 1 - 1e-7))
    with np.errstate(all="ignore"):
        t = z.mean(0) / (z.std(0, ddof=1) / np.sqrt(8))
    t[3] = 0  # no spread between images: out of the mask
    unc = nifti.read_volume(out["t_unc_path"])[1]
    assert unc == pytest.approx(t, rel=1e-4, abs=1e-4)
    gt, lt = nifti.read_volume(out["thresholded_gt_path"])[1], nifti.read_volume(out["thresholded_lt_path"])[1]
    assert (gt[:2] > 0).all() and not ((gt > 0) & (lt > 0)).any()
    args = json.loads((tmp_path / "g" / "args.json").read_text())
    assert args["n_maps"] == 8 and args["alpha"] == 0.05
    assert (tmp_path / "g" / "masks" / "analysis_mask_validity_std.nii.gz").exists()
    before = os.path.getmtime(out["t_unc_path"])
    group_analysis(spark, str(root), str(tmp_path / "g"), s)
    assert os.path.getmtime(out["t_unc_path"]) == before


def test_group_analysis_with_covariate_and_permutations(spark, study, tmp_path):
    root, paths = study
    table = tmp_path / "d.tsv"
    table.write_text("path\tage\n" + "\n".join(f"{p}\t{n}" for n, p in enumerate(paths)))
    s = Settings(mask=str(root / "mask" / "mask.nii"), inference="non_parametric", n_perm=19, alpha=0.1)
    got = group_analysis(spark, str(table), str(tmp_path / "g"), s).collect()
    assert [r["regressor"] for r in got] == ["intercept", "age"] and got[1]["group_dir"].endswith("/age")
    assert os.path.basename(got[0]["thresholded_lt_path"]) == "tmap_vfwe_alpha0p1_lt_onesided.nii.gz"
    assert (tmp_path / "g" / "age" / "nonparametric_raw" / "logp_vfwe_alpha0p1_gt.nii.gz").exists()


def test_group_analysis_errors(spark, study, tmp_path):
    root, paths = study
    with pytest.raises(ValueError, match="needs templates"):
        mask_path("mni152", {})
    assert mask_path(None, {"brain_mask": "b"}) == "b" and mask_path("mni_t1w_template", {"template": "t"}) == "t"
    for bad in ({"inference": "x"}, {"min_std": -1.0}, {"min_std": 0.0, "min_images": 0}, {"transformation": "log"}):
        with pytest.raises(ValueError):
            Settings(**bad).check()
    odd = tmp_path / "odd.nii"
    odd.write_bytes(nifti.volume_bytes(np.zeros((2, 2, 2)), np.eye(4)))
    with pytest.raises(ValueError, match="shape"):
        group_analysis(spark, [paths[0], str(odd)], str(tmp_path / "h"), Settings(mask=str(root / "mask" / "mask.nii")))


def test_command_line(spark, study, tmp_path, capsys):
    root, _ = study
    assert cli.parser().parse_args(["second_level", "x", "--alpha", "0.01", "--tfce"]).tfce is True
    assert cli.main(["second_level", str(root), "--out-dir", str(tmp_path / "c"), "--mask", str(root / "mask" / "mask.nii"), "--height-control", "fpr", "--cluster-threshold", "0"]) == 0
    assert (tmp_path / "c" / "tmap_fpr_alpha0p05_k0.nii.gz").exists()


def test_streaming_moments(spark, study, tmp_path):
    from voxlattice.operators.volumes import moments
    from voxlattice.streaming.moments import streaming_moments, voxel_stream

    root, _ = study
    v = nifti.read_volumes(spark, str(root))
    v.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streaming_moments(voxel_stream(spark, str(tmp_path / "in"), v.schema), "live_moments", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    a = spark.table("live_moments").orderBy("i", "j", "k").toPandas()
    b = moments(v).orderBy("i", "j", "k").toPandas()
    assert a["mean"].to_numpy() == pytest.approx(b["mean"].to_numpy()) and a["std"].to_numpy() == pytest.approx(b["std"].to_numpy())


def test_warp_to_template(spark, tmp_path):
    from voxlattice.plans.warping import warp_to_template

    data = np.random.default_rng(3).normal(size=(4, 4, 4))
    (tmp_path / "in.nii").write_bytes(nifti.volume_bytes(data, np.eye(4), "f8"))
    anat = tmp_path / "sub-1" / "anat"
    anat.mkdir(parents=True)
    (anat / "sub-1_space-MNI152NLin2009cAsym_res-2_T1w.nii").write_bytes(nifti.volume_bytes(np.ones((4, 4, 4)), np.eye(4), "f4"))
    move = np.eye(4)
    move[0, 3] = 1.0
    rows = [("affine", move.ravel().tolist(), None, None, None, None, None, None)] + [("field", None, *map(int, c), 0.0, 1.0, 0.0) for c in np.ndindex(4, 4, 4)]
    spark.createDataFrame(rows, "kind string, affine array<double>, i int, j int, k int, dx double, dy double, dz double").write.parquet(str(anat / "sub-1_from-T1w_to-MNI152NLin2009cAsym_mode-image_xfm.parquet"))
    out = warp_to_template(spark, str(tmp_path / "in.nii"), str(tmp_path / "sub-1"), str(tmp_path / "w" / "out.nii.gz"))
    _, got = nifti.read_volume(out)
    assert got[:-1, :-1] == pytest.approx(data[1:, 1:], abs=1e-6) and (tmp_path / "w" / "ref_MNI_1_1_1mm.nii.gz").exists()
    (anat / "sub-1_from-T1w_to-MNI152NLin2009cAsym_mode-image_xfm.parquet").rename(tmp_path / "gone")
    (anat / "sub-1_from-T1w_to-MNI152NLin2009cAsym_mode-image_xfm.h5").touch()
    with pytest.raises(NotImplementedError):
        warp_to_template(spark, str(tmp_path / "in.nii"), str(tmp_path / "sub-1"), str(tmp_path / "w" / "out2.nii.gz"))


def test_volumes_are_written_through_the_file_system_of_the_path(monkeypatch):
    from pyarrow import fs

    from voxlattice.sources import paths

    stub = fs._MockFileSystem()
    monkeypatch.setattr(paths, "filesystem", lambda p: (stub, p.removeprefix("stub://")) if p.startswith("stub://") else (fs.LocalFileSystem(), p))
    writer = nifti.NiftiWriter({"path": "stub://bucket/out/", "shape": "2,2,2"}, False)
    done = writer.write([{"img_id": "a", "i": 0, "j": 1, "k": 1, "value": 5.0}])
    assert done.files == ["stub://bucket/out/a.nii.gz"] and nifti.list_files("stub://bucket/out") == done.files
    assert nifti.read_volume(done.files[0])[1][0, 1, 1] == 5 and nifti.read_header(done.files[0]).shape == (2, 2, 2)
    assert not os.path.exists("stub:")
    writer.abort([done])
    assert not paths.exists(done.files[0]) and paths.is_folder("stub://bucket/out")


def test_no_local_folder_on_a_cluster():
    from voxlattice.sources.shared import shared_folder

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Session(), "x")


def test_thresholds_look_at_the_mask_or_at_all(spark, study, tmp_path):
    root, _ = study
    heights = {}
    for use in (True, False):
        s = Settings(mask=str(root / "mask" / "mask.nii"), cluster_threshold=0, height_control="bonferroni", alpha=0.2, use_mask_in_thresholding=use)
        out = group_analysis(spark, str(root), str(tmp_path / str(use)), s).first()
        t, kept = nifti.read_volume(out["t_unc_path"])[1], nifti.read_volume(out["thresholded_gt_path"])[1]
        heights[use] = (kept > 0).sum()
        inside = nifti.read_volume(str(root / "mask" / "mask.nii"))[1] > 0
        n = inside.sum() if use else inside.size
        from voxlattice.functions.normal import critical_value

        assert (kept > 0).sum() == (t > critical_value(0.2 / n)).sum()


def test_a_run_that_stopped_is_not_used_again(spark, study, tmp_path, monkeypatch):
    """Maps without smoothing, then a run with smoothing that stops in its first write, then that run again."""
    from voxlattice.plans import group_analysis as plan

    root, _ = study
    options = {"mask": str(root / "mask" / "mask.nii"), "cluster_threshold": 0}
    total = lambda m: nifti.read_volumes(spark, m.first()["t_unc_path"]).agg(F.sum(F.abs("value"))).first()[0]
    smooth = Settings(**options, smoothing_fwhm=2.0)
    want = total(group_analysis(spark, str(root), str(tmp_path / "new"), smooth))
    plain = total(group_analysis(spark, str(root), str(tmp_path / "g"), Settings(**options)))
    assert plain != pytest.approx(want)
    whole = plan.write_volumes

    def stops(*_):
        raise OSError("disk full")

    monkeypatch.setattr(plan, "write_volumes", stops)
    with pytest.raises(OSError):
        group_analysis(spark, str(root), str(tmp_path / "g"), smooth)
    monkeypatch.setattr(plan, "write_volumes", whole)
    assert total(group_analysis(spark, str(root), str(tmp_path / "g"), smooth)) == pytest.approx(want)


def test_paths_may_hold_commas(spark, tmp_path):
    for name in ("a,b", "c"):
        (tmp_path / f"{name}.nii").write_bytes(nifti.volume_bytes(np.ones((2, 2, 2)), np.eye(4), "f4"))
    found = nifti.read_volumes(spark, [str(tmp_path / "a,b.nii"), str(tmp_path / "c.nii")])
    assert {r[0] for r in found.select("img_id").distinct().collect()} == {"a,b", "c"}
    assert nifti.read_volumes(spark, str(tmp_path / "a,b.nii")).count() == 8


def test_transforms_are_found_through_the_file_system_of_the_path(monkeypatch):
    from pyarrow import fs

    from voxlattice.sources import design, paths

    stub = fs._MockFileSystem()
    monkeypatch.setattr(paths, "filesystem", lambda p: (stub, p.removeprefix("stub://")) if p.startswith("stub://") else (fs.LocalFileSystem(), p))
    stem = "sub-7_from-T1w_to-MNI152NLin2009cAsym_mode-image_xfm"
    for name in (f"{stem}.h5", f"{stem}.parquet", "sub-7_space-MNI152NLin2009cAsym_res-2_T1w.nii.gz", "sub-7_space-other_T1w.nii.gz"):
        paths.write_bytes(f"stub://b/sub-7/anat/{name}", b"x")
    assert design.find_transform("stub://b/sub-7/") == (f"stub://b/sub-7/anat/{stem}.parquet", "stub://b/sub-7/anat/sub-7_space-MNI152NLin2009cAsym_res-2_T1w.nii.gz")
