"""Patch centers: grids, signed distances, regions, capped stratified choice, identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def center_grid(planes: DataFrame, keys: list[str], height: Column, width: Column, patch_height: Column, patch_width: Column, stride: Column) -> DataFrame:
    """``keys..., y, x``: each point of the stride grid at which a whole patch fits into its plane."""
    rows = planes.select(*keys, height.alias("_h"), width.alias("_w"), patch_height.alias("_ph"), patch_width.alias("_pw"), stride.alias("_s"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_h") - 1, F.col("_s")))).where("y >= _ph div 2 AND y < _h - _ph div 2")
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_w") - 1, F.col("_s")))).where("x >= _pw div 2 AND x < _w - _pw div 2")
    return rows.select(*keys, "y", "x")


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of each pixel to the nearest true one; infinite where there is none.

    Along rows by running indices, then along columns as the minimum over rows at a growing step, up to the step that nothing is as far away as.
    """
    if not mask.any():
        return np.full(mask.shape, np.inf)
    h, w = mask.shape
    at = np.where(mask, np.arange(w), -np.inf)
    before = np.maximum.accumulate(at, axis=1)
    after = np.minimum.accumulate(np.where(mask, np.arange(w), np.inf)[:, ::-1], axis=1)[:, ::-1]
    along = np.minimum(np.arange(w) - before, after - np.arange(w)) ** 2
    out, step = along.copy(), 1
    while step < h and step**2 < out.max():
        np.minimum(out[step:], along[:-step] + step**2, out=out[step:])
        np.minimum(out[:-step], along[step:] + step**2, out=out[:-step])
        step += 1
    return out


def signed_distance(mask_pixels: DataFrame, key: str, plane: int) -> DataFrame:
    """``key, y, x, distance``: pixels to the nearest opposite pixel, positive inside the mask; null where there is no opposite pixel.

    ``mask_pixels`` has ``key, y, x, inside`` for each pixel of a plane. The unit of work is one image plane.
    """
    kind = mask_pixels.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((plane, plane), dtype=bool)
        mask[pdf["y"], pdf["x"]] = pdf["inside"]
        out = np.where(mask, np.sqrt(squared_distance(~mask)), -np.sqrt(squared_distance(mask)))
        y, x = np.mgrid[:plane, :plane]
        flat = pd.Series(out.ravel())
        return pd.DataFrame({key: pdf[key].iloc[0], "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "distance": flat.where(np.isfinite(flat), None)})

    return mask_pixels.select(key, "y", "x", "inside").groupBy(key).applyInPandas(run, f"`{key}` {kind}, y int, x int, distance double")


def region_groups(distance: Column, boundary: Column, near: Column, far: Column) -> Column:
    """The groups of a signed distance, as an array: none between ``near`` and ``far``, several where the limits overlap.

    A missing distance means that there is no mask: far background.
    """
    inside, away = distance > 0, -distance
    return F.filter(
        F.array(
            F.when(F.abs(distance) <= boundary, F.lit("boundary")),
            F.when(inside & (distance > boundary), F.lit("in_mask")),
            F.when(~inside & (away > boundary) & (away <= near), F.lit("near_mask_outside")),
            F.when(distance.isNull() | (~inside & (away >= far)), F.lit("far_background")),
        ),
        lambda g: g.isNotNull(),
    )


def order_key(y: str, x: str, seed: int) -> Column:
    """An arithmetic shuffle of grid points that any engine reproduces; each seed stretches the places around the circle by another factor."""
    place = (F.col(y).cast("bigint") * 73856093 + F.col(x).cast("bigint") * 19349663) % 1000003
    return (place * (2 * seed % 1000003 + 1) + seed) % 1000003


def stratified_sample(centers: DataFrame, keys: list[str], cap: str, most: int, seed: int, salts: int = 16) -> DataFrame:
    """At most ``cap`` (a column, at most ``most``) centers of each group of ``keys``, in the order of :func:`order_key`, with ``rank``.

    Two-stage: ranks within hashed subgroups first, so a large sample's group is spread over tasks.
    """
    order = [order_key("y", "x", seed), F.col("y"), F.col("x")]
    first = centers.withColumn("_salt", F.pmod(F.hash("y", "x"), F.lit(salts)))
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= most).drop("_r", "_salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= F.col(cap))


def numpy_sample(centers: DataFrame, sample: str, group: str, groups: list[str], cap: int, seed: int) -> DataFrame:
    """The same choice by numpy's generator: one generator for a sample, its groups shuffled one after another in the given order.

    The unit of work is one sample's candidates, as the shared generator demands; for large samples use :func:`stratified_sample`.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in centers.schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, out = np.random.default_rng(seed), []
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        for g in groups:
            mine = np.flatnonzero((pdf[group] == g).to_numpy()).tolist()
            rng.shuffle(mine)
            out.append(pdf.iloc[mine[:cap]])
        return pd.concat(out)

    return centers.groupBy(sample).applyInPandas(run, schema)


def identified(chosen: DataFrame, sample: str, group: str, shard: str | None) -> DataFrame:
    """``patch_id`` with a running number over all groups of a sample, and ``shard_index`` within its shard.

    ``shard`` is the column of the shard key, or None for one shard for each sample. A sample's chosen centers are bounded by the cap.
    """
    order = [F.col(group), F.col("rank")]
    number = F.row_number().over(Window.partitionBy(sample).orderBy(*order)) - 1
    within = F.row_number().over(Window.partitionBy(sample, *([shard] if shard else [])).orderBy(*order)) - 1
    return chosen.withColumn("patch_id", F.format_string("%s_%s_%05d", F.col(sample).cast("string"), F.col(group), number)).withColumn("shard_index", within)


def crop_lines(centers: DataFrame, lines: DataFrame, key: str, ids: list[str], height: int, width: int, depth: int = 1) -> DataFrame:
    """``ids..., key, channel, v``: the pixels of the patch around each center, slice by slice, edge slices repeated.

    ``centers`` has ``ids..., key, y, x, z_center, slices``, ``lines`` the pixel rows ``key, channel, z, y, v`` (an array) of whole images. A band join as an
    equi-join: a center asks for the ``depth * height`` rows that it needs and cuts its part out of each; clamping
    the slice is the same as edge padding.
    """
    half = depth // 2
    wanted = centers.select(*ids, key, "y", F.col("x").alias("_x"), "z_center", "slices", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_dz"))
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("_dy"))
    at = wanted.select(
        *ids, key, "_dz", "_dy", "_x", F.least(F.greatest(F.col("z_center") + F.col("_dz"), F.lit(0)), F.col("slices") - 1).alias("z"), (F.col("y") + F.col("_dy") - height // 2).alias("y")
    )
    cut = at.join(lines, [key, "z", "y"]).select(*ids, key, "channel", "_dz", "_dy", F.slice("v", F.col("_x") - width // 2 + 1, width).alias("_part"))
    rows = F.array_sort(F.collect_list(F.struct("_dz", "_dy", "_part")))
    return cut.groupBy(*ids, key, "channel").agg(F.flatten(F.transform(rows, lambda r: r["_part"])).alias("v"))


def lines_of(pixels: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``keys..., v``: rows of pixels as arrays in the order of ``x``; a row's pixels must all be there."""
    return pixels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", value.alias("v")))), lambda p: p["v"]).alias("v"))


def mask_overlap(centers: DataFrame, mask_lines: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """``key, cy, cx, overlap``: share of true mask pixels in the patch around each center; ``mask_lines`` are rows of 0 and 1 (see :func:`crop_lines`)."""
    flat = centers.select(key, "y", "x", F.col("y").alias("cy"), F.col("x").alias("cx"), F.lit(0).alias("z_center"), F.lit(1).alias("slices"))
    crops = crop_lines(flat, mask_lines, key, ["cy", "cx"], height, width)
    return crops.select(key, "cy", "cx", (F.size(F.filter("v", lambda v: v > 0)) / F.lit(float(height * width))).alias("overlap"))


def z_centers(centers: DataFrame, sparse: DataFrame, key: str, slices: int) -> DataFrame:
    """The slice in which each center's column is brightest, the first among equals; the middle one where the column has no finite value above 0."""
    best = sparse.where(~F.isnan("v") & (F.col("v") != float("inf"))).groupBy(key, "y", "x").agg(F.max(F.struct("v", (-F.col("z")).alias("z"))).alias("top"))
    return centers.join(best, [key, "y", "x"], "left").select(key, "y", "x", F.coalesce(-F.col("top.z"), F.lit(slices // 2)).cast("int").alias("z_center"))


def channel_summary(voxels: DataFrame, keys: list[str], height: int, width: int, depth: int) -> DataFrame:
    """Mean, maximum, sum, population deviation, brightest slice (the first among equals) and occupied slices of each crop and channel.

    ``voxels`` may leave out zeros: the sums are completed by the crop's size.
    """
    n, plane = float(height * width * depth), float(height * width)
    by_slice = voxels.groupBy(*keys, "dz").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.max("v").alias("m"))
    out = by_slice.groupBy(*keys).agg(
        F.sum("s").alias("sum"), F.sum("q").alias("_q"), F.max("m").alias("max"), F.max(F.struct((F.col("s") / plane).alias("m"), (-F.col("dz")).alias("z"))).alias("_top"),
        F.count_if(F.col("s") > 0).alias("z_occupancy"),
    )
    mean = F.col("sum") / n
    peak = F.when(F.col("_top.m") > 0, -F.col("_top.z") + depth // 2).otherwise(0)
    return out.select(*keys, mean.alias("mean"), "max", "sum", F.sqrt(F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0))).alias("std"), peak.cast("int").alias("z_peak_index"), "z_occupancy")


def map_batches(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on each Arrow batch as a pandas frame."""
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield run(batch)

    return rows.mapInPandas(over, schema)
