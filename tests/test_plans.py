import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from voxelmill import cli
from voxelmill import config as C
from voxelmill.operators.masks import grow
from voxelmill.operators.patch_features import smooth
from voxelmill.plans import extract as X
from voxelmill.plans import latent_report as L
from voxelmill.plans import mask_export as M
from voxelmill.sources import tiff

CHANNELS = ["MAP2", "FLAG"]


@pytest.fixture()
def dataset(tmp_path):
    rng = np.random.default_rng(3)
    stacks, samples = {}, []
    for i, condition in enumerate(["positive", "negative"]):
        stack = rng.integers(0, 900, (2, 5, 40, 48)).astype("uint16")
        y, x = np.mgrid[:40, :48]
        mask = (((y - 20) ** 2 + (x - 20 - i) ** 2) <= 81).astype("uint8") * 255
        text = '<Pixels DimensionOrder="XYZCT" SizeC="2" SizeZ="5" SizeT="1" PhysicalSizeX="0.09" PhysicalSizeZ="0.3"/>'
        (tmp_path / f"s{i}.tif").write_bytes(tiff.written_bytes(stack.reshape(10, 40, 48), text))
        (tmp_path / f"m{i}.tif").write_bytes(tiff.written_bytes(mask[None]))
        stacks[f"s{i}"] = (stack, mask > 0)
        samples.append({"sample_id": f"s{i}", "condition": condition, "experiment_date": "2026-01-01", "coverslip": "c", "culture_batch": "b", "field_of_view": "f", "image_path": f"s{i}.tif", "mask_path": f"m{i}.tif", "channel_names": CHANNELS})
    raw = {
        "dataset_name": "d", "output_dir": "out", "patch": {"width_px": 8, "height_px": 6, "z_window": 3, "stride_px": 4, "max_patches_per_group": 5},
        "sampling": {"groups": list(C.GROUPS), "boundary_width_px": 2, "near_outside_distance_px": 4, "far_background_min_distance_px": 6, "random_seed": 42},
        "cohort": {"channel_schema": "v1", "required_channels": CHANNELS}, "samples": samples,
    }
    path = tmp_path / "d.yaml"
    path.write_text(yaml.safe_dump(raw))
    return path, raw, stacks


def test_tiff_round_trip_and_description():
    stack = np.arange(24, dtype="float32").reshape(2, 3, 4)
    got, text = tiff.planes(tiff.written_bytes(stack, 'PhysicalSizeX="0.5" PhysicalSizeZ="x"'))
    assert (np.stack(got) == stack).all() and tiff.pixel_sizes(text) == (0.5, None) and tiff.pixel_sizes("") == (None, None)
    assert tiff.layout("", 7) == ("ZCT", {"Z": 7, "C": 1, "T": 1})
    with pytest.raises(ValueError):
        tiff.planes(b"nothing here")


def test_extraction_and_report(spark, dataset, tmp_path):
    path, _, stacks = dataset
    config = C.load_dataset(path)
    folders = X.extract(spark, config)
    manifest = spark.read.parquet(folders["manifest"])
    rows = manifest.collect()
    assert len(rows) == len({r.patch_id for r in rows}) and {r.sample_id for r in rows} == {"s0", "s1"}
    assert max(r["count"] for r in manifest.groupBy("sample_id", "patch_group").count().collect()) <= 5
    payload = {(r.patch_id, r.channel): r.v for r in spark.read.parquet(folders["patches"]).collect()}
    for r in rows:
        stack, mask = stacks[r.sample_id]
        z = int(stack[0, :, r.y, r.x].argmax())
        assert r.z_center == z
        box = (slice(r.y - 3, r.y + 3), slice(r.x - 4, r.x + 4))
        assert abs(mask[box].mean() - r.map2_overlap_fraction) < 1e-9
        for k, channel in enumerate(CHANNELS):
            want = stack[k][np.clip(np.arange(z - 1, z + 2), 0, 4)][(slice(None), *box)].astype(float)
            assert np.allclose(payload[r.patch_id, channel], want.ravel())
            assert np.array_equal(np.array(payload[r.patch_id, "map2_mask"]).reshape(6, 8) > 0, mask[box])
            assert abs(r[f"{channel.lower()}_std"] - want.std()) < 1e-6 and r[f"{channel.lower()}_z_peak_index"] == want.mean((1, 2)).argmax()
    X.extract(spark, config)
    assert spark.read.parquet(folders["manifest"]).count() == len(rows)


    (tmp_path / "r.yaml").write_text(yaml.safe_dump({
        "manifest_path": "out/manifest", "output_dir": "rep", "features": {"channels": CHANNELS}, "dimensionality_reduction": {"n_pca_components": 3},
        "clustering": {"method": "kmeans", "n_clusters": 2, "random_seed": 1}, "reporting": {"representatives_per_cluster": 3},
    }))
    assert cli.main(["report", "--config", str(tmp_path / "r.yaml")]) == 0
    read = lambda name: spark.read.parquet(str(tmp_path / "rep" / name))
    full = read("patch_latent_report")
    assert full.count() == len(rows) and full.select("cluster_id").distinct().count() == 2 and len([c for c in full.columns if c.startswith("flag_")]) > 57
    assert not {"x", "y", "z_center", "shard_index"} & set(full.columns)
    assert read("pca_bins").agg(F.sum("count"), F.count(F.lit(1))).first() == (len(rows), 900)
    assert read("pca_max_loadings").count() == 40 and read("redundancy_pairs").count() > 100 and read("redundancy_groups").count() >= 3
    assert abs(read("pca_explained").agg(F.max("cumulative")).first()[0] - read("pca_explained").agg(F.sum("explained")).first()[0]) < 1e-9
    ranges = {r.channel: (r.low, r.high) for r in read("channel_ranges").collect()}
    tops = {c: [np.array(v).reshape(3, -1).max(0) for (_, k), v in payload.items() if k == c] for c in CHANNELS}
    assert ranges == {c: (np.min(t), np.max(t)) for c, t in tops.items()}
    kept = list((tmp_path / "rep" / "feature_cache").iterdir())
    config = C.load_report(tmp_path / "r.yaml")
    same = L.patch_features(spark, manifest.orderBy(F.desc("patch_id")), folders["patches"], config)
    assert same.count() == len(rows) and list((tmp_path / "rep" / "feature_cache").iterdir()) == kept
    L.patch_features(spark, manifest.limit(3), folders["patches"], config)
    assert len(list((tmp_path / "rep" / "feature_cache").iterdir())) == 2


def test_a_report_without_features_or_crops_is_refused(spark, tmp_path):
    spark.createDataFrame([("p", "positive", "in_mask", 1.0)], "patch_id string, condition string, patch_group string, x double").write.parquet(str(tmp_path / "alone" / "manifest"))
    (tmp_path / "r.yaml").write_text(yaml.safe_dump({
        "manifest_path": "alone/manifest", "output_dir": "rep", "features": {"channels": CHANNELS}, "dimensionality_reduction": {"n_pca_components": 2},
        "clustering": {"method": "kmeans", "n_clusters": 2, "random_seed": 1}, "reporting": {"representatives_per_cluster": 3},
    }))
    with pytest.raises(ValueError, match="no table of features"):
        cli.main(["report", "--config", str(tmp_path / "r.yaml")])


def test_patches_with_odd_values_are_listed(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"p{i}", "positive", "in_mask", float(i % 2) * 9 + float(rng.random()), float("nan") if i == 3 else float(rng.random()), None if i in (3, 4) else 1.0 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "patch_id string, condition string, patch_group string, a double, b double, c double")
    config = C.Report("m", "o", [], 2, "gmm", 2, 1, 2)
    tables = L.report(spark, df.select("patch_id", "condition", "patch_group"), df.drop("condition", "patch_group"), config)
    assert {(r.patch_id, r.features_not_finite) for r in tables["patches_left_out"].collect()} == {("p3", 2), ("p4", 1)}
    assert tables["patch_latent_report"].count() == 28


def test_extraction_again_replaces_what_it_wrote(spark, dataset, tmp_path):
    path, raw, _ = dataset
    manifests = []
    for change in ({}, {"sampling": {**raw["sampling"], "random_seed": 7}}, {"patch": {**raw["patch"], "resume": False}}, {"patch": {**raw["patch"], "max_patches_per_group": 2, "shard_by_group": False}}):
        path.write_text(yaml.safe_dump(raw | change))
        folders = X.extract(spark, C.load_dataset(path))
        manifest, payload = (spark.read.parquet(folders[n]) for n in ("manifest", "patches"))
        ids = [r.patch_id for r in manifest.select("patch_id").collect()]
        assert len(ids) == len(set(ids)) and payload.count() == 3 * len(ids) and {r.patch_id for r in payload.select("patch_id").distinct().collect()} == set(ids)
        manifests.append({(r.patch_id, r.y, r.x) for r in manifest.collect()})
    assert manifests[0] != manifests[1] and len(manifests[3]) < len(manifests[2])
    stranger = dict(raw["samples"][0], sample_id="s9", channel_names=["MAP2", "OTHER", "FLAG"])  # names a third channel that the image lacks
    path.write_text(yaml.safe_dump(raw | {"samples": [*raw["samples"], stranger]}))
    with pytest.raises(ValueError, match="s9"):
        X.extract(spark, C.load_dataset(path))
    assert {(r.patch_id, r.y, r.x) for r in spark.read.parquet(folders["manifest"]).collect()} == manifests[3]


def test_channels_without_names_are_numbered(spark, dataset):
    path, raw, _ = dataset
    numbered = {"samples": [{k: v for k, v in s.items() if k != "channel_names"} for s in raw["samples"]], "cohort": {"channel_schema": "v", "required_channels": ["channel_0", "channel_1"]}}
    path.write_text(yaml.safe_dump(raw | numbered))
    folders = X.extract(spark, C.load_dataset(path), center_channel="channel_0")
    assert {r.channel for r in spark.read.parquet(folders["patches"]).select("channel").distinct().collect()} == {"channel_0", "channel_1", "map2_mask"}


def test_shared_folder_is_asked_for_on_clusters():
    from types import SimpleNamespace

    from voxelmill.session import shared_dir

    lone = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(lone)


def test_bad_settings_are_refused(dataset, tmp_path):
    path, raw, _ = dataset
    for change in ({"patch": {**raw["patch"], "width_px": 7}}, {"patch": {**raw["patch"], "z_window": 4}}, {"samples": []}, {"samples": raw["samples"] * 2}, {"cohort": {"channel_schema": "v", "required_channels": ["HA"]}}, {"patch": {}}):
        path.write_text(yaml.safe_dump(raw | change))
        with pytest.raises(ValueError):
            C.load_dataset(path)
    path.write_text("[]")
    with pytest.raises(ValueError):
        C.load_dataset(path)


def test_dry_run_and_missing_masks(spark, dataset, tmp_path, capsys):
    assert cli.main(["extract", "--config", str(dataset[0]), "--dry-run"]) == 0
    assert "2 samples" in capsys.readouterr().out
    (tmp_path / "masks").mkdir()
    (tmp_path / "masks" / "s0_analysismask.ome.tif").write_bytes(b"x")
    got = cli.missing_masks(spark, str(tmp_path / "s*.tif"), str(tmp_path / "masks"), 10).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["s1.tif"]


def direct_mask(stack, s):
    """The mask of one volume, step by step."""
    def scaled(a):
        good = np.isfinite(a)
        if not good.any():
            return np.zeros(a.shape)
        low, high = np.percentile(a[good], [1, 99])
        return np.where(good, np.clip((a - low) / (high - low), 0, 1) if high > low else 1.0, 0.0)

    plane = scaled(stack.max(0))
    plane = smooth(plane[None], s.smoothing)[0] if s.smoothing else plane
    seeds, support = (plane >= np.percentile(plane, p) for p in (s.seed_percentile, s.grow_percentile))
    found = M.dilated(seeds if s.method == "threshold" else grow(seeds, support), s.halo)
    if not s.guided:
        return found
    soft = smooth(found[None].astype(float), s.confidence_smoothing)[0]
    span = np.ptp(soft)
    trust = s.floor + (1 - s.floor) * ((soft - soft.min()) / span if span > 1e-12 else 0 * soft)
    field = scaled(stack * (s.floor + (1 - s.floor) * trust))
    return M.grown_volume(field, *np.percentile(field, [s.volume_seed, s.volume_support, s.thin_seed]), s.thin_width).max(0)


@pytest.mark.parametrize("more", [{"halo": 1}, {"method": "threshold", "smoothing": 0.0}, {"guided": True, "halo": 1}])
def test_exported_masks_equal_single_steps(spark, dataset, tmp_path, more):
    y, x = np.mgrid[:30, :20]
    blob = (900 - np.stack([20 * np.hypot(y - 12, x - 9) + 90 * abs(z - 1) for z in range(3)])).astype("float32")
    blob[0, 0, 0] = np.nan
    (tmp_path / "s7.tif").write_bytes(tiff.written_bytes(blob))
    (tmp_path / "s8.tif").write_bytes(tiff.written_bytes(np.zeros((2, 5, 4), dtype="uint8")))
    stacks = {"s0": dataset[2]["s0"][0][0].astype(float), "s1": dataset[2]["s1"][0][0].astype(float), "s7": blob.astype(float), "s8": np.zeros((2, 5, 4))}
    (tmp_path / "made").mkdir()
    rows = M.export_masks(spark, str(tmp_path / "s*.tif"), str(tmp_path / "made"), M.MaskSettings(**more)).collect()
    assert len(rows) == 4
    for name, stack in stacks.items():
        got, _ = tiff.planes((tmp_path / "made" / f"{name}_analysismask.ome.tif").read_bytes())
        want = direct_mask(stack, M.MaskSettings(**more))
        assert ((got[0] > 0) == want).all() and want.any(), name


def test_mask_export_and_feature_variance(spark, dataset, tmp_path, capsys):
    out = tmp_path / "made"
    assert cli.main(["mask-export", "--images", str(tmp_path / "s*.tif"), "--output", str(out), "--halo", "1"]) == 0
    assert len(list(out.iterdir())) == 2
    assert cli.main(["mask-export", "--images", str(tmp_path / "s*.tif"), "--output", str(out), "--dry-run"]) == 0
    assert "0 images lack" in capsys.readouterr().out
    from voxelmill.plans.mask_export import depth_of, dilated

    rng = np.random.default_rng(0)
    solid = rng.random((4, 5, 6)) < 0.8
    at = np.argwhere(~solid)
    want = [[[0 if not solid[z, y, x] else np.sqrt(((at - (z, y, x)) ** 2).sum(1).min()) for x in range(6)] for y in range(5)] for z in range(4)]
    assert np.allclose(depth_of(solid), want)
    one = np.zeros((5, 7), dtype=bool)
    one[2, 3] = True
    assert dilated(one, 2).sum() == 25
    from voxelmill.plans.mask_export import otsu_of

    assert otsu_of(np.array([[0.0, 0.1], [0.9, 1.0]])) == pytest.approx(0.1, abs=0.01) and otsu_of(np.full((2, 2), 3.0)) == 3
    with pytest.raises(ValueError):
        M.MaskSettings(method="none")

    csv = tmp_path / "sep.csv"
    csv.write_text("feature,between_cluster_var,within_cluster_var,separation_score\n" + "\n".join(f"f{i},{10 ** (i % 2 * 4)},1,{10 ** (i % 2 * 4)}" for i in range(8)))
    assert cli.main(["feature-variance", "--separation-csv", str(csv), "--output", str(tmp_path / "fv")]) == 0
    rows = spark.read.parquet(str(tmp_path / "fv")).collect()
    assert len(rows) == 8 and {r.k for r in rows} == {2} and len({(int(r.feature[1]) % 2, r.feature_variance_cluster) for r in rows}) == 2
    csv.write_text("feature\nx")
    with pytest.raises(ValueError):
        cli.main(["feature-variance", "--separation-csv", str(csv), "--output", str(tmp_path / "fv2")])


def test_missing_masks_has_no_limit_of_its_own(spark, tmp_path, capsys):
    (tmp_path / "images").mkdir()
    (tmp_path / "masks").mkdir()
    for i in range(1005):
        (tmp_path / "images" / f"s{i:04}.tif").write_bytes(b"x")
    (tmp_path / "masks" / "s0000_analysismask.ome.tif").write_bytes(b"x")
    assert cli.main(["missing-masks", "--images", str(tmp_path / "images"), "--masks", str(tmp_path / "masks")]) == 0
    assert sum(".tif" in line for line in capsys.readouterr().out.splitlines()) == 1004


def test_a_batch_runs_every_settings_file(tmp_path, capsys, monkeypatch):
    for name in ("r_1", "r_2", "r_10", "other"):
        (tmp_path / f"{name}.yaml").write_text("x: 1")
    asked = ["report-batch", "--configs-dir", str(tmp_path), "--config-prefix", "r_"]
    assert cli.main([*asked, "--dry-run"]) == 0
    assert [line.rsplit("/", 1)[1] for line in capsys.readouterr().out.splitlines()] == ["r_1.yaml", "r_10.yaml", "r_2.yaml"]
    with pytest.raises(ValueError, match="must be a mapping"):  # the first file has no sections
        cli.main(asked)
    capsys.readouterr()
    assert cli.main([*asked, "--continue-on-error", "--clusters", "2", "1"]) == 1
    assert [line.rsplit("/", 1)[1] for line in capsys.readouterr().out.splitlines()] == ["r_2.yaml", "r_1.yaml"]
    with pytest.raises(ValueError, match="r_7"):
        cli.main([*asked, "--clusters", "7"])
    with pytest.raises(ValueError):
        cli.main([*asked[:-1], "none_"])
