"""Volumes, masks and patches as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: Size of the planes and number of slices of the derived volumes.
PLANE = 64
SLICES = 7
CHANNELS = ["A", "N", "R"]


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """``sample_id, channel, z, y, x, v``: the voxels above 0 of the volumes derived from ``lineitem``, one for each 50 suppliers."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    at = rows.select(
        F.expr("(l_suppkey - 1) div 50").cast("int").alias("sample_id"), F.col("l_returnflag").alias("channel"), (F.col("l_linenumber") - 1).cast("int").alias("z"),
        (F.col("l_partkey") % PLANE).cast("int").alias("y"), (F.col("l_orderkey") % PLANE).cast("int").alias("x"), "l_quantity",
    )
    return at.groupBy("sample_id", "channel", "z", "y", "x").agg(F.sum("l_quantity").alias("v"))


def projections(sparse: DataFrame, channels: list[str] = CHANNELS, plane: int = PLANE) -> DataFrame:
    """``sample_id, channel, y, x, v``: the maximum over z of every pixel, 0 where no voxel is stored."""
    side = F.sequence(F.lit(0), F.lit(plane - 1))
    grid = sparse.select("sample_id").distinct().select("sample_id", F.explode(F.array(*map(F.lit, channels))).alias("channel"))
    grid = grid.select("*", F.explode(side).alias("y")).select("*", F.explode(side).alias("x"))
    top = sparse.groupBy("sample_id", "channel", "y", "x").agg(F.max("v").alias("v"))
    return grid.join(top, ["sample_id", "channel", "y", "x"], "left").fillna(0.0, ["v"])


def dense_lines(sparse: DataFrame, channels: list[str] = CHANNELS, slices: int = SLICES, plane: int = PLANE) -> DataFrame:
    """``sample_id, channel, z, y, v``: every pixel row of the volumes as an array, 0 where no voxel is stored."""
    grid = sparse.select("sample_id").distinct().select("sample_id", F.explode(F.array(*map(F.lit, channels))).alias("channel"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("z")).select("*", F.explode(F.sequence(F.lit(0), F.lit(plane - 1))).alias("y"))
    held = sparse.groupBy("sample_id", "channel", "z", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("_at"))
    at = F.coalesce("_at", F.create_map().cast("map<int,double>"))
    row = F.transform(F.sequence(F.lit(0), F.lit(plane - 1)), lambda x: F.coalesce(F.try_element_at(at, x), F.lit(0.0)))
    return grid.join(held, ["sample_id", "channel", "z", "y"], "left").select("sample_id", "channel", "z", "y", row.alias("v"))


def image_patches(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, label, a``: each embedding as the 64 values of an 8 x 8 patch or a 4 x 4 x 4 crop, all plus 1."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double") + F.lit(1.0)).alias("a"))
