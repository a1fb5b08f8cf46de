"""From images and masks to patches: one plan over all samples of a dataset.

Images are rows of pixels (``sample_id, channel, z, y, v``), so a crop joins the pixel rows that it needs by (sample, slice, row) and cuts
its part out of each; no voxel is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Dataset
from ..functions import arrays as A
from ..operators import sampling as S
from ..session import hadoop_path, written
from ..sources.tiff import read_lines

def sample_table(spark: SparkSession, config: Dataset) -> DataFrame:
    rows = [(s.sample_id, s.condition, s.experiment_date, s.coverslip, s.culture_batch, s.field_of_view, s.cell_id, s.dendrite_id, s.image_path, s.mask_path, s.channel_names) for s in config.samples]
    return spark.createDataFrame(
        rows,
        "sample_id string, condition string, experiment_date string, coverslip string, culture_batch string, field_of_view string, cell_id string, dendrite_id string, "
        "source_image string, mask_image string, channel_names array<string>",
    )


def located(spark: SparkSession, config: Dataset) -> DataFrame:
    """``sample_id, image, mask``: the samples' files by the names under which Spark lists them, on whatever file system they are."""
    def full(path: str) -> str:
        found, files = hadoop_path(spark, path)
        return files.makeQualified(found).toString()

    return spark.createDataFrame([(s.sample_id, full(s.image_path), full(s.mask_path)) for s in config.samples], "sample_id string, image string, mask string")


def image_lines(spark: SparkSession, samples: DataFrame, config: Dataset) -> DataFrame:
    """``sample_id, channel, z, y, v`` of the required channels of all ``samples``; planes of other channels aren't decoded."""
    number = lambda s, name: s.channel_names.index(name) if s.channel_names else int(name.rsplit("_", 1)[-1])
    wanted = {number(s, name) for s in config.samples for name in config.required_channels}
    where = samples.select("sample_id", "channel_names").join(located(spark, config), "sample_id")
    paths = [r.image for r in where.select("image").collect()]  # one for each sample of the settings
    if not paths:
        return spark.createDataFrame([], "sample_id string, channel string, z int, y int, v array<float>")
    name = F.when(F.size("channel_names") > 0, F.get("channel_names", F.col("channel"))).otherwise(F.concat(F.lit("channel_"), "channel"))
    lines = read_lines(spark, sorted(set(paths)), sorted(wanted)).join(where.withColumnRenamed("image", "path"), "path").withColumn("channel", name)
    return lines.where(F.col("channel").isin(config.required_channels)).select("sample_id", "channel", "z", "y", "v")


def mask_lines(spark: SparkSession, samples: DataFrame, config: Dataset) -> DataFrame:
    """``sample_id, channel, z, y, v``: rows of 0 and 1 as the channel ``map2_mask`` with one slice; 1 where any slice of the mask is above 0."""
    where = samples.select("sample_id").join(located(spark, config), "sample_id")
    paths = [r["mask"] for r in where.select("mask").collect()]
    if not paths:
        return spark.createDataFrame([], "sample_id string, channel string, z int, y int, v array<float>")
    lines = read_lines(spark, sorted(set(paths))).join(where.select("sample_id", F.col("mask").alias("path")), "path")
    any_slice = F.aggregate(F.collect_list("v"), F.transform(F.first("v"), lambda p: F.lit(0.0).cast("float")), lambda s, v: F.zip_with(s, v, lambda a, b: F.when(b > 0, F.lit(1.0)).otherwise(a).cast("float")))
    return lines.groupBy("sample_id", "y").agg(any_slice.alias("v")).select("sample_id", F.lit("map2_mask").alias("channel"), F.lit(0).alias("z"), "y", "v")


def candidate_centers(mask: DataFrame, config: Dataset) -> DataFrame:
    """``sample_id, y, x, patch_group, distance_to_mask_px`` of all valid grid points.

    Signed distances are taken for each image plane; all else is joins and expressions.
    """
    p, s = config.patch, config.sampling
    size = mask.groupBy("sample_id").agg((F.max("y") + 1).alias("h"), F.max(F.size("v")).alias("w"))
    grid = S.center_grid(size, ["sample_id"], F.col("h"), F.col("w"), F.lit(p.height_px), F.lit(p.width_px), F.lit(p.stride_px))

    def run(pdf):
        import numpy as np
        import pandas as pd

        plane = np.stack(pdf.sort_values("y")["v"]) > 0
        far = np.where(plane, np.sqrt(S.squared_distance(~plane)), -np.sqrt(S.squared_distance(plane)))
        y, x = np.mgrid[: plane.shape[0] : p.stride_px, : plane.shape[1] : p.stride_px]
        at = pd.Series(far[y, x].ravel())
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[0], "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "distance_to_mask_px": at.where(np.isfinite(at), None)})

    far = mask.select("sample_id", "y", "v").groupBy("sample_id").applyInPandas(run, "sample_id string, y int, x int, distance_to_mask_px double")
    groups = S.region_groups(F.col("distance_to_mask_px"), F.lit(s.boundary_width_px), F.lit(s.near_outside_distance_px), F.lit(s.far_background_min_distance_px))
    return grid.join(far, ["sample_id", "y", "x"]).withColumn("patch_group", F.explode(groups)).where(F.col("patch_group").isin(s.groups))


def summaries(payload: DataFrame, config: Dataset) -> DataFrame:
    """``patch_id`` and six columns for each channel, named after it in lower case."""
    p = config.patch
    plane = p.width_px * p.height_px
    a = F.transform("v", lambda x: x.cast("double"))
    rows = payload.select("patch_id", F.lower("channel").alias("channel"), a.alias("a"), F.transform(F.sequence(F.lit(0), F.lit(p.z_window - 1)), lambda z: A.mean(F.transform(F.slice("v", z * plane + 1, plane), lambda x: x.cast("double")))).alias("by_z"))
    values = {
        "mean": A.mean(F.col("a")), "max": F.array_max("a"), "sum": A.total(F.col("a")), "std": A.std_pop(F.col("a")),
        "z_peak_index": A.first_of_greatest(F.col("by_z")), "z_occupancy": A.count_if(F.col("by_z"), lambda v: v > 0),
    }
    rows = rows.select("patch_id", "channel", *[v.alias(k) for k, v in values.items()])
    names = [c.lower() for c in config.required_channels]
    one = [F.max(F.when(F.col("channel") == c, F.col(k))).alias(f"{c}_{k}") for c in names for k in values]
    return rows.groupBy("patch_id").agg(*one)


def _drop_samples(spark: SparkSession, folder: str, samples: list[str]) -> None:
    """Delete the samples' partitions of a table, if there are any."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for one in samples:
        path, files = hadoop_path(spark, f"{folder}/sample_id={escape(one)}")
        files.delete(path, True)


def extract(spark: SparkSession, config: Dataset, center_channel: str = "MAP2") -> dict[str, str]:
    """Write the manifest and the crops (with each patch's mask as the channel ``map2_mask``) of a dataset; gives the folder of each.

    With ``resume``, samples of which the manifest has rows are left alone if the settings' fingerprint is theirs too. All others are
    written anew: their old rows go first, the manifest's before the crops', and the manifest comes last, so a run that was broken off is made up for by the
    next one. A sample whose image or mask gives no pixels raises ValueError before anything is deleted.
    """
    out, p = config.output_dir, config.patch
    samples = sample_table(spark, config)
    mark = F.lit(f"{config.patch}{config.sampling}{config.required_channels}{config.channel_schema}{center_channel}")
    samples = samples.withColumn("fingerprint", F.sha2(F.concat_ws("|", mark, "source_image", "mask_image", F.to_json("channel_names")), 256))
    if p.resume and (have := hadoop_path(spark, f"{out}/manifest"))[1].exists(have[0]):
        done = spark.read.parquet(f"{out}/manifest").select("sample_id", "fingerprint").distinct()
        samples = samples.join(done, ["sample_id", "fingerprint"], "left_anti")
    samples = written(samples, "todo")
    todo = [r.sample_id for r in samples.select("sample_id").collect()]  # one for each sample of the settings
    folders = {"manifest": f"{out}/manifest", "patches": f"{out}/patches"}
    if not todo:
        return folders
    lines = written(image_lines(spark, samples, config), "lines")
    mask = written(mask_lines(spark, samples, config), "mask")
    both = lines.select("sample_id", "channel").distinct().groupBy("sample_id").count().where(F.col("count") == len(config.required_channels)).join(mask.select("sample_id").distinct(), "sample_id")
    lacking = sorted(set(todo) - {r.sample_id for r in both.select("sample_id").collect()})
    if lacking:
        raise ValueError(f"no pixels of all required channels and of the mask were read for {', '.join(lacking)}")
    centers = candidate_centers(mask, config).withColumn("cap", F.lit(p.max_patches_per_group))
    chosen = S.stratified_sample(centers, ["sample_id", "patch_group"], "cap", p.max_patches_per_group, config.sampling.random_seed)
    chosen = written(S.identified(chosen, "sample_id", "patch_group", "patch_group" if p.shard_by_group else None), "chosen")
    column = chosen.select("patch_id", "sample_id", "y", "x").join(lines.where(F.col("channel") == center_channel), ["sample_id", "y"]).select("patch_id", "z", F.get("v", F.col("x")).alias("v"))
    finite = ~F.isnan("v") & (F.abs("v") != float("inf"))
    z = column.groupBy("patch_id").agg(F.coalesce(-F.max(F.when(finite, F.struct(F.col("v"), (-F.col("z")).alias("z"))))["z"], F.floor(F.count(F.lit(1)) / 2)).cast("int").alias("z_center"))
    depth = lines.groupBy("sample_id").agg((F.max("z") + 1).alias("slices"))
    chosen = written(chosen.join(z, "patch_id").join(depth, "sample_id"), "centers")
    crops = S.crop_lines(chosen, lines, "sample_id", ["patch_id"], p.height_px, p.width_px, p.z_window)
    regions = S.crop_lines(chosen.withColumn("z_center", F.lit(0)).withColumn("slices", F.lit(1)), mask, "sample_id", ["patch_id"], p.height_px, p.width_px)
    payload = written(crops.unionByName(regions), "payload")
    shard = F.col("patch_group") if p.shard_by_group else F.lit("all_patches")
    overlap = payload.where("channel = 'map2_mask'").select("patch_id", A.mean(F.transform("v", lambda v: v.cast("double"))).alias("map2_overlap_fraction"))
    manifest = (
        chosen.drop("cap", "rank", "slices").withColumn("shard_group", shard).join(overlap, "patch_id").join(samples, "sample_id").join(summaries(payload.where("channel != 'map2_mask'"), config), "patch_id")
        .withColumn("channel_schema", F.lit(config.channel_schema)).withColumn("patch_width_px", F.lit(p.width_px)).withColumn("patch_height_px", F.lit(p.height_px))
        .withColumn("z_window", F.lit(p.z_window)).withColumn("shard_path", F.format_string("%s/patches/sample_id=%s/shard_group=%s", F.lit(out), "sample_id", "shard_group")).withColumn("patch_path", F.col("shard_path"))
    )
    manifest = written(manifest, "manifest")
    for name in ("manifest", "patches"):
        _drop_samples(spark, folders[name], todo)
    codec = "zstd" if p.save_compressed else "uncompressed"
    shards = payload.join(manifest.select("patch_id", "shard_group", "shard_index"), "patch_id")
    shards.repartition("sample_id", "shard_group").sortWithinPartitions("sample_id", "shard_group", "shard_index").write.mode("append").option("compression", codec).partitionBy("sample_id", "shard_group").parquet(folders["patches"])
    manifest.write.mode("append").partitionBy("sample_id").parquet(folders["manifest"])
    return folders
