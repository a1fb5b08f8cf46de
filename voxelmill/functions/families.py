"""Families of feature names, and the policy that keeps or drops them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name parts of each family; a name belongs to the first family of which it holds a part.
FAMILIES = {
    "Cross-Channel Overlap": [
        "_flag_ha_", "_flag_shank2_", "_ha_shank2_", "_map2_flag_", "_map2_ha_", "_map2_shank2_", "flag_to_ha", "ha_to_flag", "flag_ha_",
        "shank2_to_map2", "plus_ha_to_shank2", "_pixel_corr", "_manders_", "_bright_overlap_", "_com_offset", "_spotness_ratio",
        "_compactness_ratio", "_mean_ratio",
    ],
    "MAP2-Aware Spatial": [
        "_inside_mean", "_outside_mean", "_inside_outside_ratio", "_inside_bright_fraction", "_outside_bright_fraction",
        "_inside_bright_outside_bright_ratio", "map2_mask_fraction", "distance_to_mask_boundary_px", "center_of_patch_map2_intensity",
        "map2_local_thickness_proxy", "_center_surround_",
    ],
    "Z-Profile": [
        "_z_peak", "_z_std", "_z_width_halfmax", "_z_slices_above_halfmax", "_z_center_of_mass", "_z_skewness", "_z_kurtosis", "_z_peak_count",
        "_z_multi_peak_score", "_z_peak_symmetry",
    ],
    "Spotness / Morphology": [
        "_estimated_punctum_area", "_component_count", "_largest_area", "_largest_area_fraction", "_eccentricity", "_circularity", "_compactness",
        "_solidity", "_elongation", "_radial_symmetry", "_log_response", "_dog_response", "_dominant_object_fraction",
    ],
}

# The features about the region that the policy ``prior_only`` keeps.
ALLOWED_CONTEXT = ["map2_mask_fraction", "distance_to_mask_boundary_px", "map2_local_thickness_proxy"]


def family_of(name: str) -> str:
    """The family of one feature name."""
    return next((label for label, parts in FAMILIES.items() if any(p in name.lower() for p in parts)), "Other")


def family(name: Column | str) -> Column:
    """The family of a feature name, whatever its case; ``Other`` for names of none, null for null."""
    name = F.lower(F.col(name) if isinstance(name, str) else name)
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for label, parts in FAMILIES.items():
        out = out.when(reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in parts]), F.lit(label))
    return out.otherwise(F.lit("Other"))


def policy_reason(name: Column | str, policy: Column) -> Column:
    """Why a feature stays or goes under ``full`` or ``prior_only``."""
    name = F.lower(F.col(name) if isinstance(name, str) else name)
    prior = F.lower(policy) == "prior_only"
    return (
        F.when(prior & name.isin(ALLOWED_CONTEXT), F.lit("allowed_map2_prior_context"))
        .when(prior & F.contains(name, F.lit("map2")), F.lit("excluded_map2_as_signal"))
        .otherwise(F.lit("kept"))
    )
