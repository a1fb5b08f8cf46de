"""Masks out of projections: normalisation, thresholds, growth, blending. Rows are pixels ``key..., y, x, v``; the unit of work of a kernel is one image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patch_features import smooth


def percentile_normalize(pixels: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``value`` in 0..1 between two exact percentiles of each image; 1 on finite pixels where they don't differ, null for others."""
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    limits = pixels.where(finite).groupBy(*keys).agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("_p"))
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    scaled = F.least(F.greatest((F.col("v") - lo) / F.when(hi > lo, hi - lo).otherwise(1.0), F.lit(0.0)), F.lit(1.0))
    return pixels.join(limits, keys).withColumn("value", F.when(finite, F.when(hi > lo, scaled).otherwise(1.0))).drop("_p")


def threshold(pixels: DataFrame, keys: list[str], share: float) -> DataFrame:
    """``inside``: at or above an exact percentile of its image."""
    limit = pixels.groupBy(*keys).agg(F.percentile("v", F.lit(share)).alias("_t"))
    return pixels.join(limit, keys).withColumn("inside", F.col("v") >= F.col("_t")).drop("_t")


def otsu(pixels: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """The center of the histogram bin that parts the two classes of each image best, the first among equals; null for flat images."""
    span = pixels.groupBy(*keys).agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    place = F.least(F.floor((F.col("v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)).cast("int")
    counts = pixels.join(span.where("_b > _a"), keys).groupBy(*keys, place.alias("bin"), "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    center = F.col("_a") + (F.col("bin") + 0.5) * (F.col("_b") - F.col("_a")) / bins
    part = counts.withColumn("center", center).withColumn("w", F.sum("n").over(upto)).withColumn("s", F.sum(F.col("n") * F.col("center")).over(upto))
    part = part.withColumn("all_w", F.sum("n").over(whole)).withColumn("all_s", F.sum(F.col("n") * F.col("center")).over(whole)).where("w < all_w")
    gap = F.col("s") / F.col("w") - (F.col("all_s") - F.col("s")) / (F.col("all_w") - F.col("w"))
    score = F.round(F.col("w") * (F.col("all_w") - F.col("w")) * gap * gap, 3)
    best = part.groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.col("bin")).alias("bin"), "center")).alias("top"))
    return best.select(*keys, F.col("top.center").alias("threshold"))


def dilate(inside: DataFrame, keys: list[str], steps: int, plane: int) -> DataFrame:
    """``keys..., y, x`` of all pixels at most ``steps`` away from a true one, diagonals included."""
    reach = F.sequence(F.lit(-steps), F.lit(steps))
    wide = inside.where("inside").select(*keys, "x", F.explode(F.transform(reach, lambda s: F.col("y") + s)).alias("y")).distinct()
    wide = wide.select(*keys, "y", F.explode(F.transform(reach, lambda s: F.col("x") + s)).alias("x")).distinct()
    return wide.where(F.col("y").between(0, plane - 1) & F.col("x").between(0, plane - 1)).select(*keys, "y", "x")


def grow(seeds: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The allowed pixels (or voxels) connected with a seed: diagonals count in planes, faces only in volumes."""
    found = seeds & allowed
    while True:
        wide = found.copy()
        for axis in range(found.ndim):
            base = wide if found.ndim == 2 else found
            for ahead in (slice(1, None), slice(None, -1)):
                behind = slice(None, -1) if ahead == slice(1, None) else slice(1, None)
                to, of = [slice(None)] * found.ndim, [slice(None)] * found.ndim
                to[axis], of[axis] = ahead, behind
                shifted = np.zeros_like(found)
                shifted[tuple(to)] = base[tuple(of)]
                wide = wide | shifted
        wide &= allowed
        if (wide == found).all():
            return found
        found = wide


def hysteresis(pixels: DataFrame, keys: list[str], plane: int, seed: float = 0.995, support: float = 0.82) -> DataFrame:
    """``keys..., y, x``: pixels at or above the ``support`` percentile that are connected with one at or above the ``seed`` percentile."""
    limits = pixels.groupBy(*keys).agg(F.percentile("v", F.array(F.lit(support), F.lit(seed))).alias("_p"))
    marked = pixels.join(limits, keys).where(F.col("v") >= F.col("_p")[0]).withColumn("seed", F.col("v") >= F.col("_p")[1])
    schema = ", ".join(f"`{k}` {marked.schema[k].dataType.simpleString()}" for k in keys) + ", y int, x int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        allowed, seeds = np.zeros((plane, plane), dtype=bool), np.zeros((plane, plane), dtype=bool)
        allowed[pdf["y"], pdf["x"]] = True
        seeds[pdf["y"], pdf["x"]] = pdf["seed"]
        y, x = np.nonzero(grow(seeds, allowed))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(y) for k in keys}, "y": y.astype("int32"), "x": x.astype("int32")})

    return marked.select(*keys, "y", "x", "seed").groupBy(*keys).applyInPandas(run, schema)


def connected_support(voxels: DataFrame, key: str, slices: int, plane: int, seed: float = 0.985, support: float = 0.82) -> DataFrame:
    """``key, z, y, x``: voxels at or above the ``support`` percentile connected by faces with one at or above the ``seed`` percentile."""
    limits = voxels.groupBy(key).agg(F.percentile("v", F.array(F.lit(support), F.lit(seed))).alias("_p"))
    marked = voxels.join(limits, key).where(F.col("v") >= F.col("_p")[0]).withColumn("seed", F.col("v") >= F.col("_p")[1])
    kind = voxels.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        allowed, seeds = np.zeros((slices, plane, plane), dtype=bool), np.zeros((slices, plane, plane), dtype=bool)
        at = (pdf["z"], pdf["y"], pdf["x"])
        allowed[at], seeds[at] = True, pdf["seed"]
        z, y, x = (c.astype("int32") for c in np.nonzero(grow(seeds, allowed)))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(z), "z": z, "y": y, "x": x})

    return marked.select(key, "z", "y", "x", "seed").groupBy(key).applyInPandas(run, f"`{key}` {kind}, z int, y int, x int")


def smoothed(pixels: DataFrame, keys: list[str], plane: int, sigma: float) -> DataFrame:
    """``keys..., y, x, v``: each image after a Gaussian filter; pixels that no row gives count as 0."""
    schema = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys) + ", y int, x int, v double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((1, plane, plane))
        image[0, pdf["y"], pdf["x"]] = pdf["v"]
        y, x = np.mgrid[:plane, :plane]
        out = smooth(image, sigma)[0].ravel()
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * out.size for k in keys}, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": out})

    return pixels.select(*keys, "y", "x", "v").groupBy(*keys).applyInPandas(run, schema)


def confidence(pixels: DataFrame, keys: list[str], plane: int, sigma: float = 2.5, floor: float = 0.2) -> DataFrame:
    """``keys..., y, x, value``: the smoothed image between its extremes, raised to at least ``floor``; ``floor`` alone for a flat one."""
    soft = smoothed(pixels, keys, plane, sigma)
    span = soft.groupBy(*keys).agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    wide = F.col("_b") - F.col("_a")
    part = F.when(wide > 1e-12, (F.col("v") - F.col("_a")) / F.when(wide > 1e-12, wide).otherwise(1.0)).otherwise(0.0)
    return soft.join(span, keys).select(*keys, "y", "x", (floor + (1 - floor) * part).alias("value"))


def blended(value: Column, confidence: Column, floor: float) -> Column:
    """A source value weighted by its confidence, of which the floor is kept: once in the confidence, once in the blend."""
    raised = floor + (1 - floor) * confidence
    return value * (floor + (1 - floor) * raised)
