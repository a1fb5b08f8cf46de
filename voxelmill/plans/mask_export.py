"""Region masks out of image stacks, one file for each image."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.masks import grow
from ..operators.patch_features import smooth
from ..operators.sampling import squared_distance
from ..session import written
from ..sources.tiff import read_lines, written_bytes


@dataclass(frozen=True)
class MaskSettings:
    """``method`` makes the mask of the projection: ``threshold`` (the seed percentile alone) or ``hysteresis``.

    With ``guided`` that mask, widened by ``halo``, only weighs the volume (its smoothed confidence, at least ``floor``), and the result is
    grown in the volume from its brightest and its thin peaks, then projected.
    """

    channel: int = 0
    method: str = "hysteresis"
    smoothing: float = 1.0
    seed_percentile: float = 99.5
    grow_percentile: float = 82.0
    halo: int = 0
    guided: bool = False
    confidence_smoothing: float = 2.5
    floor: float = 0.03
    volume_seed: float = 98.5
    volume_support: float = 82.0
    thin_seed: float = 96.0
    thin_width: float = 2.0

    def __post_init__(self):
        if self.method not in ("threshold", "hysteresis"):
            raise ValueError(f"unknown method {self.method!r}")
        if not 0 <= self.grow_percentile <= self.seed_percentile <= 100 or self.halo < 0 or self.smoothing < 0:
            raise ValueError("percentiles must rise from 0 to 100; halo and smoothing must not be negative")


def otsu_of(plane: np.ndarray, bins: int = 256) -> float:
    """The center of the histogram bin that parts the finite values best, the first among equals; the value itself for a flat plane."""
    good = plane[np.isfinite(plane)]
    if not good.size or good.max() <= good.min():
        return float(good.max()) if good.size else np.inf
    count, edges = np.histogram(good, bins)
    center, w = (edges[1:] + edges[:-1]) / 2, count.cumsum()
    s, rest = (count * center).cumsum(), w[-1] - w
    gap = s / np.maximum(w, 1) - (s[-1] - s) / np.maximum(rest, 1)
    return float(center[(w * rest * gap**2)[:-1].argmax()])


def dilated(mask: np.ndarray, steps: int) -> np.ndarray:
    """All pixels within ``steps``, diagonals included."""
    for _ in range(steps):
        p = np.pad(mask, 1)
        h, w = mask.shape
        mask = np.any([p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
    return mask


def depth_of(mask: np.ndarray) -> np.ndarray:
    """Distance of each true voxel to the nearest false one, 0 on false ones; infinite where none is false.

    Squared distances within slices, then the least over slices.
    """
    flat = np.stack([squared_distance(~one) for one in mask])
    z = np.arange(len(mask))
    out = np.sqrt(np.stack([(flat + ((z - k) ** 2)[:, None, None]).min(0) for k in z]))
    return np.where(mask, out, 0.0)


def grown_volume(field: np.ndarray, seed: float, support: float, thin: float, width: float) -> np.ndarray:
    """Voxels of the support connected by faces with a seed: a very bright voxel, or a bright peak of its slice where the support is thin."""
    bright, wide, fine = (field >= limit for limit in (seed, support, thin))
    fine &= depth_of(wide) <= width
    p = np.pad(field, [(0, 0), (1, 1), (1, 1)], constant_values=-np.inf)
    h, w = field.shape[1:]
    peak = field >= np.max([p[:, dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
    bright = bright | (fine & peak if (fine & peak).any() else fine)
    return grow(bright, wide | bright)


LINES = "path string, y int, v array<double>"


def by_plane(lines: DataFrame, run: Callable[..., np.ndarray], *limits: str) -> DataFrame:
    """``path, y, v`` of ``run`` on each image's plane [y, x], given the image's ``limits`` (columns) too; the unit of work is one plane."""
    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y", ignore_index=True)
        out = run(np.stack(pdf["v"]), *[pdf[c].iloc[0] for c in limits])
        return pdf[["path", "y"]].assign(v=list(out.astype(float)))

    return lines.select("path", "y", "v", *limits).groupBy("path").applyInPandas(over, LINES)


def percentiles(lines: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``path`` and an exact percentile (0 to 100) of all of an image's values for each name."""
    return lines.select("path", F.explode("v").alias("v")).groupBy("path").agg(*[F.percentile("v", F.lit(s / 100)).alias(n) for n, s in shares.items()])


def normalized(lines: DataFrame) -> DataFrame:
    """``lines`` with values between the 1st and 99th percentile of each image's finite ones, cut to 0..1; 1 on finite values where those don't differ, 0 on others."""
    good = lines.withColumn("v", F.filter("v", lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))))
    low, wide = F.col("_low"), F.col("_high") - F.col("_low")
    value = lambda v: F.when(wide > 0, F.least(F.greatest((v - low) / F.when(wide > 0, wide).otherwise(1.0), F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    cut = F.transform("v", lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")) & low.isNotNull(), value(v)).otherwise(0.0))
    return lines.join(percentiles(good, {"_low": 1, "_high": 99}), "path", "left").withColumn("v", cut).drop("_low", "_high")


def projected(lines: DataFrame) -> DataFrame:
    """``path, y, v``: the greatest value of each pixel over the slices."""
    top = F.aggregate(F.collect_list("v"), F.transform(F.first("v"), lambda v: F.lit(float("-inf"))), lambda s, v: F.zip_with(s, v, lambda a, b: F.greatest(a, b)))
    return lines.groupBy("path", "y").agg(top.alias("v"))


def plane_masks(lines: DataFrame, s: MaskSettings) -> DataFrame:
    """``path, y, v``: the mask (0 and 1) of each image's projection."""
    plane = normalized(projected(lines))
    if s.smoothing:
        plane = by_plane(plane, lambda a: smooth(a[None], s.smoothing)[0])
    plane = written(plane, "planes")

    def found(a: np.ndarray, seed: float, support: float) -> np.ndarray:
        seeds, allowed = a >= seed, a >= support
        if not seeds.any():
            seeds = allowed = a >= otsu_of(a)
        return dilated(seeds if s.method == "threshold" else grow(seeds, allowed), s.halo)

    limits = percentiles(plane, {"_seed": s.seed_percentile, "_support": s.grow_percentile})
    return by_plane(plane.join(limits, "path"), found, "_seed", "_support")


def guided_masks(lines: DataFrame, masks: DataFrame, s: MaskSettings) -> DataFrame:
    """``path, y, v``: the masks grown in the volumes, each voxel weighed by the smoothed confidence of its plane's mask, then projected."""
    soft = written(by_plane(masks, lambda a: smooth(a[None], s.confidence_smoothing)[0]), "confidence")
    span = soft.groupBy("path").agg(F.min(F.array_min("v")).alias("_low"), F.max(F.array_max("v")).alias("_high"))
    wide = F.col("_high") - F.col("_low")
    part = lambda v: F.when(wide > 1e-12, (v - F.col("_low")) / F.when(wide > 1e-12, wide).otherwise(1.0)).otherwise(0.0)
    trust = soft.join(span, "path").select("path", "y", F.transform("v", lambda v: s.floor + (1 - s.floor) * part(v)).alias("_trust"))
    weighed = lines.join(trust, ["path", "y"]).select("path", "z", "y", F.zip_with("v", "_trust", lambda v, t: blended_once(v, t, s.floor)).alias("v"))
    field = written(normalized(weighed), "field")
    limits = percentiles(field, {"_seed": s.volume_seed, "_support": s.volume_support, "_thin": s.thin_seed})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        volume = np.zeros((pdf["z"].max() + 1, pdf["y"].max() + 1, len(pdf["v"].iloc[0])))
        volume[pdf["z"], pdf["y"]] = np.stack(pdf["v"])
        mask = grown_volume(volume, *[pdf[c].iloc[0] for c in ("_seed", "_support", "_thin")], s.thin_width).max(0)
        return pd.DataFrame({"path": pdf["path"].iloc[0], "y": np.arange(len(mask), dtype="int32"), "v": list(mask.astype(float))})

    return field.join(limits, "path").groupBy("path").applyInPandas(run, LINES)


def blended_once(value: Column, trust: Column, floor: float) -> Column:
    """A value weighed by a confidence that has the floor already, of which the floor is kept again."""
    return value * (floor + (1 - floor) * trust)


def export_masks(spark: SparkSession, paths: list[str] | str, folder: str, settings: MaskSettings) -> DataFrame:
    """Write ``<name>_analysismask.ome.tif`` for each image into ``folder``, which all executors must have mounted: ``path, mask_path, true_pixels``.

    Projection, percentiles, confidence and weighing are joins and aggregates over pixel rows of all images; a task holds one plane to
    smooth it or to grow its mask, or one channel's volume for growth in three dimensions. A file appears under its name only when it is whole.
    """
    lines = read_lines(spark, paths, [settings.channel]).select("path", "z", "y", F.transform("v", lambda v: v.cast("double")).alias("v"))
    lines = written(lines, "volume-lines")
    masks = plane_masks(lines, settings)
    if settings.guided:
        masks = guided_masks(lines, masks, settings)

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, path = np.stack(pdf.sort_values("y")["v"]) > 0, pdf["path"].iloc[0]
        stem = path.rsplit("/", 1)[-1].removesuffix(".tiff").removesuffix(".tif")
        final = os.path.join(folder, f"{stem}_analysismask.ome.tif")
        with open(f"{final}.{uuid.uuid4().hex}.tmp", "wb") as f:
            f.write(written_bytes((mask * 255).astype("uint8")[None]))
        os.replace(f.name, final)
        return pd.DataFrame({"path": [path], "mask_path": [final], "true_pixels": [int(mask.sum())]})

    return masks.groupBy("path").applyInPandas(put, "path string, mask_path string, true_pixels bigint")
