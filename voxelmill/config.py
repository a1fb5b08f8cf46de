"""Settings of datasets and reports: read from YAML, checked before anything runs.

Paths that aren't absolute count from the settings file's folder. Missing keys and values out of range raise ValueError with the key's name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

GROUPS = ("in_mask", "boundary", "near_mask_outside", "far_background")


@dataclass(frozen=True)
class Patch:
    width_px: int
    height_px: int
    z_window: int
    stride_px: int
    max_patches_per_group: int
    save_compressed: bool = False
    resume: bool = True
    use_sample_cache: bool = True
    shard_by_group: bool = True


@dataclass(frozen=True)
class Sampling:
    groups: list[str]
    boundary_width_px: int
    near_outside_distance_px: int
    far_background_min_distance_px: int
    random_seed: int


@dataclass(frozen=True)
class Sample:
    sample_id: str
    condition: str
    experiment_date: str
    coverslip: str
    culture_batch: str
    field_of_view: str
    image_path: str
    mask_path: str
    channel_names: list[str] = field(default_factory=list)  # none: channel_0, channel_1 and so on
    cell_id: str | None = None
    dendrite_id: str | None = None


@dataclass(frozen=True)
class Dataset:
    dataset_name: str
    output_dir: str
    patch: Patch
    sampling: Sampling
    channel_schema: str
    required_channels: list[str]
    samples: list[Sample] = field(default_factory=list)


@dataclass(frozen=True)
class Report:
    manifest_path: str
    output_dir: str
    channels: list[str]
    n_pca_components: int
    method: str
    n_clusters: int
    random_seed: int
    representatives_per_cluster: int
    feature_variance_csv: str | None = None
    feature_variance_cluster: int | None = None
    map2_feature_policy: str = "full"


_KINDS = {"int": int, "str": str, "bool": bool, "list[str]": lambda v: [str(x) for x in v], "str | None": lambda v: None if v is None else str(v), "int | None": lambda v: None if v is None else int(v)}


def _made(kind, raw: dict, where: str):
    """A dataclass of simple fields out of a mapping; fields without a default must be there."""
    if not isinstance(raw, dict):
        raise ValueError(f"{where} must be a mapping")
    lacking = [n for n, f in kind.__dataclass_fields__.items() if n not in raw and f.default is f.default_factory]  # both are the mark of a missing default
    if lacking:
        raise ValueError(f"{where} lacks {', '.join(lacking)}")
    return kind(**{n: _KINDS[f.type](raw[n]) for n, f in kind.__dataclass_fields__.items() if n in raw})


def _part(raw: dict, key: str) -> dict:
    if not isinstance(raw, dict) or not isinstance(raw.get(key), dict):
        raise ValueError(f"{key} must be a mapping")
    return raw[key]


def _read(path: str | Path) -> tuple[dict, Path]:
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, dict):
        raise ValueError("the settings must be a mapping")
    return raw, Path(path).resolve().parent


def _full(base: Path, path) -> str:
    """A path as it counts from ``base``; one that names its file system stays as it is."""
    return str(path) if "://" in str(path) else str((base / str(path)).resolve())


def _there(path: str) -> bool:
    """Whether a local file exists; other file systems are asked when it is read."""
    return "://" in path or Path(path).exists()


def _check(rules: list[tuple[bool, str]]) -> None:
    for good, message in rules:
        if not good:
            raise ValueError(message)


def load_dataset(path: str | Path, must_exist: bool = True) -> Dataset:
    raw, base = _read(path)
    _check([(k in raw, f"the settings lack {k}") for k in ("dataset_name", "output_dir", "samples")])
    patch, sampling, cohort = _made(Patch, _part(raw, "patch"), "patch"), _made(Sampling, _part(raw, "sampling"), "sampling"), _part(raw, "cohort")
    _check([(k in cohort, f"cohort lacks {k}") for k in ("channel_schema", "required_channels")])
    samples = [_made(Sample, s | {k: _full(base, s[k]) for k in ("image_path", "mask_path") if k in s}, f"samples[{i}]") for i, s in enumerate(raw["samples"] or [])]
    needed = [str(c) for c in cohort["required_channels"] or []]
    ids = [s.sample_id for s in samples]
    _check(
        [
            (patch.width_px > 0 and patch.height_px > 0, "patch sizes must be above 0"), (patch.width_px % 2 == 0 and patch.height_px % 2 == 0, "patch sizes must be even"),
            (patch.z_window > 0 and patch.z_window % 2 == 1, "z_window must be odd and above 0"), (patch.stride_px > 0, "stride_px must be above 0"),
            (patch.max_patches_per_group > 0, "max_patches_per_group must be above 0"), (bool(needed), "no required channel"), (bool(samples), "no sample"),
            (len(ids) == len(set(ids)), "a sample_id occurs twice"), (set(sampling.groups) <= set(GROUPS), f"unknown groups; known are {', '.join(GROUPS)}"),
        ]
    )
    for s in samples:
        _check(
            [
                (len(s.channel_names) == len(set(s.channel_names)), f"{s.sample_id}: a channel name occurs twice"),
                (not s.channel_names or set(needed) <= set(s.channel_names), f"{s.sample_id} lacks required channels"),
                (not must_exist or _there(s.image_path), f"{s.sample_id}: no image {s.image_path}"),
                (not must_exist or _there(s.mask_path), f"{s.sample_id}: no mask {s.mask_path}"),
            ]
        )
    return Dataset(str(raw["dataset_name"]), _full(base, raw["output_dir"]), patch, sampling, str(cohort["channel_schema"]), needed, samples)


def load_report(path: str | Path, must_exist: bool = True) -> Report:
    raw, base = _read(path)
    flat = {k: raw[k] for k in ("manifest_path", "output_dir") if k in raw}
    for part in ("features", "dimensionality_reduction", "clustering", "reporting"):
        flat |= _part(raw, part)
    for k in ("manifest_path", "output_dir", "feature_variance_csv"):
        if flat.get(k) is not None:
            flat[k] = _full(base, flat[k])
    for k in ("method", "map2_feature_policy"):
        if k in flat:
            flat[k] = str(flat[k]).lower()
    out = _made(Report, flat, "the settings")
    _check(
        [
            (not must_exist or _there(out.manifest_path), f"no manifest {out.manifest_path}"), (out.n_pca_components > 0, "n_pca_components must be above 0"),
            (out.method in ("gmm", "kmeans"), "method must be gmm or kmeans"), (out.n_clusters > 1, "n_clusters must be above 1"),
            (out.representatives_per_cluster > 0, "representatives_per_cluster must be above 0"), (out.map2_feature_policy in ("full", "prior_only"), "map2_feature_policy must be full or prior_only"),
            ((out.feature_variance_csv is None) == (out.feature_variance_cluster is None), "feature_variance_csv and feature_variance_cluster belong together"),
            (not must_exist or out.feature_variance_csv is None or _there(out.feature_variance_csv), f"no table {out.feature_variance_csv}"),
        ]
    )
    return out
