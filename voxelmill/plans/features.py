"""From crops to the features of each patch: 57 for a channel, 4 about the region, 10 for a pair of channels, 7 over channels.

What needs no neighbours is column expressions over the crops' arrays; stencils and components run on Arrow batches of whole patches. One shuffle
brings the channels of a patch together; it carries their projections, not the crops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.numeric import safe_ratio
from ..operators import patch_features as P

# The pairs of channels that are held against each other.
PAIRS = [("flag", "ha"), ("flag", "shank2"), ("ha", "shank2"), ("map2", "flag"), ("map2", "ha"), ("map2", "shank2")]
#: Features that stencils give.
STENCILS = ["log_response", "dog_response", "gradient_mean", "gradient_std", "high_frequency_power", *P.GEOMETRY, *P.GREY, "lbp_entropy", "lbp_uniform_fraction", *[f"wavelet_energy_scale_{i}" for i in (1, 2, 3)], "z_peak_count", "z_multi_peak_score"]


def stencils(m: np.ndarray, x: np.ndarray, bright: np.ndarray, profile: np.ndarray) -> list[np.ndarray]:
    """The values of ``STENCILS`` for a batch: mean and maximum projections and bright pixels [n, y, x], profiles [n, z]."""
    narrow, slope = P.smooth(m, 1.0), P.gradient(m)
    found = np.array([P.peaks(p) for p in profile], dtype=float)
    return [
        np.abs(P.laplacian_of_gaussian(m, 1.0)).max((1, 2)), np.abs(narrow - P.smooth(m, 2.0)).max((1, 2)), slope.mean((1, 2)), slope.std((1, 2)), ((m - narrow) ** 2).mean((1, 2)),
        *P.component_geometry(bright, x).values(), *P.grey_levels(m), *P.local_patterns(m), *P.scale_energies(m).T, found, np.maximum(found - 1, 0),
    ]


def _with_stencils(rows: DataFrame, height: int, width: int) -> DataFrame:
    """``rows`` (``m, x, k, p``) with the columns of ``STENCILS``."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            flat = {c: b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("m", "x", "k", "p")}
            m, x, k = (flat[c].reshape(n, height, width) for c in ("m", "x", "k"))
            made = stencils(m, x, k.astype(bool), flat["p"].reshape(n, -1))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.asarray(v, dtype=float)) for v in made]], [*b.schema.names, *STENCILS])

    return rows.mapInArrow(over, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], *[f"{c} double" for c in STENCILS]]))


def channel_features(crops: DataFrame, height: int, width: int, depth: int) -> DataFrame:
    """``patch_id, channel, region, m, x, k, total`` and 57 features of every crop ``patch_id, channel, v, region``.

    ``v`` holds the crop slice by slice, ``region`` the mask's pixels as booleans.
    """
    plane = height * width
    a = F.transform("v", lambda e: e.cast("double"))
    rows = crops.select("patch_id", F.lower("channel").alias("channel"), "region", a.alias("a"))
    rows = rows.select(
        "patch_id", "channel", "region", P.z_mean(F.col("a"), depth, plane).alias("m"), P.z_max(F.col("a"), depth, plane).alias("x"), A.total(F.col("a")).alias("total"),
        F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda z: A.mean(F.slice("a", z * plane + 1, plane))).alias("p"),
    )
    rows = rows.withColumn("_limit", P.bright_threshold(F.col("x"))).withColumn("k", P.bright(F.col("x"), F.col("_limit"))).drop("_limit")
    rows = _with_stencils(rows, height, width)
    m, x, k = F.col("m"), F.col("x"), F.col("k")
    area = A.count_if(k, lambda v: v)
    mean, sd = A.mean(m), A.std_pop(m)
    values = {
        "proj_mean": mean, "proj_max": F.array_max(x), "proj_std": sd, "local_contrast": safe_ratio(sd, mean + 1e-6), "dynamic_range": F.array_max(m) - F.array_min(m),
        "bright_pixel_fraction": area / plane, "top_percentile_intensity": A.let(A.percentile(x, 0.99), lambda t: A.mean(F.filter(x, lambda v: v >= t))),
        "intensity_entropy": P.entropy(m), "estimated_punctum_area": area, "neighborhood_variance": A.var_pop(m),
        **P.inside_outside(m, k, F.col("region")), **P.center_surround(m, height, width), **P.z_profile(F.col("p"), depth),
    }
    return rows.select("patch_id", "channel", "region", "m", "x", "k", "total", *STENCILS, *[v.cast("double").alias(n) for n, v in values.items()])


def channel_names() -> list[str]:
    """The 57 features of a channel, without its name."""
    flat = F.array(F.lit(0.0))
    plain = ["proj_mean", "proj_max", "proj_std", "local_contrast", "dynamic_range", "bright_pixel_fraction", "top_percentile_intensity", "intensity_entropy", "estimated_punctum_area", "neighborhood_variance"]
    return [*STENCILS, *plain, *P.inside_outside(flat, flat, flat), *P.center_surround(flat, 4, 4), *P.z_profile(flat, 4)]


def pair_features(a: Column, b: Column, region: Column, width: int) -> dict[str, Column]:
    """The ten measures of two channels, each a struct of :func:`channel_features`."""
    inside = A.let(F.struct(A.where(a["m"], region).alias("a"), A.where(b["m"], region).alias("b")), lambda s: P.pixel_corr(s["a"], s["b"]))
    return {
        "pixel_corr": P.pixel_corr(a["m"], b["m"]), "pixel_corr_in_mask": inside, **P.overlap(a["k"], b["k"]), **P.manders(a["x"], b["x"], a["k"], b["k"]),
        "com_offset": P.com_offset(a["x"], b["x"], width), "compactness_ratio": safe_ratio(a["compactness"], b["compactness"]),
        "spotness_ratio": safe_ratio(a["log_response"], b["log_response"]), "mean_ratio": safe_ratio(a["proj_mean"], b["proj_mean"]),
    }


def engineered_features(patches: DataFrame, crops: DataFrame, channels: list[str], height: int, width: int, depth: int, center_channel: str = "map2") -> DataFrame:
    """``patch_id`` and all features of ``channels`` (299 for map2, flag, ha and shank2).

    ``patches`` has ``patch_id, distance_to_mask_px``; ``crops`` has ``patch_id, channel, v`` with the region as the channel ``map2_mask``. Channels
    that a patch lacks give null; sums over channels take them as 0; pairs with a channel that isn't asked for are left out. Patches without a
    region or a crop give no row.
    """
    wanted = [c.lower() for c in channels]
    if center_channel not in wanted:
        raise ValueError(f"the channel {center_channel} is needed")
    region = crops.where("channel = 'map2_mask'").select("patch_id", F.transform("v", lambda e: e > 0).alias("region"))
    mine = crops.where(F.lower("channel").isin(wanted)).join(region, "patch_id")
    rows = channel_features(mine, height, width, depth)
    names = channel_names()
    each = F.struct(*[c for c in rows.columns if c not in ("patch_id", "channel", "region")])
    wide = rows.groupBy("patch_id").agg(F.first("region").alias("region"), *[F.max(F.when(F.col("channel") == c, F.struct(each.alias("f")))).alias(f"_{c}") for c in wanted])
    wide = wide.join(patches.select("patch_id", F.col("distance_to_mask_px").cast("double").alias("_distance")), "patch_id")
    of = {c: F.col(f"_{c}")["f"] for c in wanted}
    middle = (height // 2) * width + width // 2
    out = {f"{c}_{n}": of[c][n] for c in wanted for n in names}
    out |= {
        "map2_mask_fraction": A.count_if(F.col("region"), lambda v: v) / float(height * width), "distance_to_mask_boundary_px": F.col("_distance"),
        "center_of_patch_map2_intensity": F.get(of[center_channel]["m"], F.lit(middle)), "map2_local_thickness_proxy": thickness_of(height, width),
    }
    for a, b in PAIRS:
        if a in wanted and b in wanted:
            out |= {f"{a}_{b}_{n}": v for n, v in pair_features(of[a], of[b], F.col("region"), width).items()}
    mean = {c: F.coalesce(of[c]["proj_mean"], F.lit(0.0)) if c in wanted else F.lit(0.0) for c in ("flag", "ha", "shank2", "map2")}
    total = {c: F.coalesce(of[c]["total"], F.lit(0.0)) if c in wanted else F.lit(0.0) for c in ("flag", "ha", "shank2")}
    f, h = mean["flag"], mean["ha"]
    out |= {
        "flag_to_ha_mean_ratio": safe_ratio(f, h), "ha_to_flag_mean_ratio": safe_ratio(h, f), "flag_ha_mean_sum": f + h, "flag_ha_mean_product": f * h, "flag_ha_mean_absdiff": F.abs(f - h),
        "shank2_to_map2_mean_ratio": safe_ratio(mean["shank2"], mean["map2"]), "flag_plus_ha_to_shank2_sum_ratio": safe_ratio(total["flag"] + total["ha"], total["shank2"]),
    }
    return wide.select("patch_id", *[v.cast("double").alias(n) for n, v in out.items()])


def thickness_of(height: int, width: int) -> Column:
    return P.thickness(F.col("region"), height, width)
