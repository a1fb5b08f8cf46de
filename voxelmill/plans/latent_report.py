"""From a manifest and a feature table to the tables of a report."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Report
from ..functions.families import family, policy_reason
from ..functions.numeric import finite
from ..operators import feature_variance as V
from ..operators import models as M
from ..operators import report as R
from ..operators.patch_features import z_max
from ..session import hadoop_path, written
from .features import engineered_features


def selected_features(spark: SparkSession, features: list[str], config: Report) -> DataFrame:
    """``feature, reason, kept`` under the chosen subset and policy; ValueError where nothing is left."""
    rows = spark.createDataFrame([(f,) for f in features], "feature string")
    if config.feature_variance_csv:
        table = spark.read.option("header", True).option("inferSchema", True).csv(config.feature_variance_csv)
        lacking = {"feature", "feature_variance_cluster"} - set(table.columns)
        if lacking:
            raise ValueError(f"{config.feature_variance_csv} lacks {', '.join(sorted(lacking))}")
        rows = rows.join(table.where(F.col("feature_variance_cluster") == config.feature_variance_cluster), "feature", "left_semi")
    rows = rows.withColumn("reason", policy_reason("feature", F.lit(config.map2_feature_policy)))
    return rows.withColumn("kept", F.col("reason") != "excluded_map2_as_signal").orderBy("kept", "feature")


#: Counts up when the same crops would give other features, so caches made before aren't used.
FEATURE_VERSION = 1


def patch_features(spark: SparkSession, manifest: DataFrame, patches: str, config: Report) -> DataFrame:
    """The engineered features of the manifest's patches, from the crops in the folder ``patches``; kept in the report's folder.

    The kept table is named after a fingerprint of the channels and of every manifest row that decides what is read (missing values filled in, so that
    different rows differ; their order doesn't matter): a manifest that changes gets a table of its own. Patches of different
    sizes are described size by size.
    """
    place = [F.coalesce(F.col(c).cast("string"), F.lit("-1" if c == "shard_index" else "")) for c in ("patch_id", "shard_path", "shard_index", "patch_path", "fingerprint", "distance_to_mask_px") if c in manifest.columns]
    marks = manifest.select(F.xxhash64(*place).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
    key = hashlib.sha256(f"{FEATURE_VERSION}|{sorted(config.channels)}|{marks[0]}|{marks[1]}".encode()).hexdigest()[:32]
    kept = f"{config.output_dir}/feature_cache/{key}"
    done, files = hadoop_path(spark, f"{kept}/_SUCCESS")
    if not files.exists(done):
        crops, out = spark.read.parquet(patches).select("patch_id", "channel", "v"), None
        sizes = manifest.select("patch_height_px", "patch_width_px", "z_window").distinct().collect()  # a few sizes, no rows
        for h, w, z in sorted(map(tuple, sizes)):
            mine = manifest.where((F.col("patch_height_px") == h) & (F.col("patch_width_px") == w) & (F.col("z_window") == z)).select("patch_id", "distance_to_mask_px")
            one = engineered_features(mine, crops.join(mine.select("patch_id"), "patch_id", "left_semi"), config.channels, h, w, z)
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("the manifest is empty")
        out.write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept)


def report(spark: SparkSession, manifest: DataFrame, features: DataFrame, config: Report, domain: str = "all") -> dict[str, DataFrame]:
    """Every table of the report by its name, not yet written.

    ``manifest`` has ``patch_id, condition, patch_group``, ``features`` a ``patch_id`` and numbers. Names of features are few; rows may be any number.
    Patches with a value that isn't finite among the kept features can't be placed on the axes: they are in no cluster, and listed in ``patches_left_out``.
    """
    names = [f for f, kind in features.dtypes if f != "patch_id" and kind in ("double", "float", "int", "bigint")]
    policy = selected_features(spark, names, config)
    chosen = [r.feature for r in policy.where("kept").select("feature").collect()]  # column names, not rows
    if not chosen:
        raise ValueError("no feature is left by the chosen subset and policy")
    rows = manifest.select("patch_id", "condition", "patch_group").join(features.select("patch_id", *names), "patch_id").withColumn("dataset_name", F.lit(domain))
    rows = written(rows, "report-rows")
    audit = written(R.variance_audit(rows, ["dataset_name"], chosen), "audit")
    kept = [r.feature for r in audit.where("kept").select("feature").collect()]
    if not kept:
        raise ValueError("no feature varies")
    removed = [r.feature for r in policy.where("NOT kept").select("feature").collect()]
    odd = reduce(add, [(~finite(F.col(f).cast("double"))).cast("int") for f in kept])
    left_out = rows.select("patch_id", odd.alias("features_not_finite")).where("features_not_finite > 0")
    axes, loadings = M.principal_axes(rows, kept, config.n_pca_components)
    loadings = written(loadings, "loadings")
    n = loadings.agg(F.max("axis")).first()[0] + 1
    axes = axes.select("patch_id", *[F.get("pca", F.lit(i)).alias(f"pca_{i + 1}") for i in range(n)])
    grouped = M.clusters(written(axes, "report-axes"), [f"pca_{i + 1}" for i in range(n)], config.n_clusters, config.random_seed, config.method)
    full = written(rows.join(grouped, "patch_id"), "report-clusters")
    plane = [f"pca_{i + 1}" for i in range(min(2, n))]
    near = R.distance_to_center(full, "dataset_name", "cluster_id", plane)
    separation = written(R.cluster_separation(full, "dataset_name", "cluster_id", kept).withColumn("family", family("feature")), "separation")
    away = R.cluster_separation(full, "dataset_name", "cluster_id", removed) if removed else separation.drop("family").limit(0)
    by = ["dataset_name", "cluster_id"]
    profiles = written(V.with_groups(V.profiles(separation, loadings.withColumn("dataset_name", F.lit(domain)), "dataset_name", "family"), "dataset_name", "family"), "profiles")
    pairs = written(V.redundant_pairs(profiles, "dataset_name", "family"), "pairs")
    groups = V.redundant_groups(pairs, profiles, "dataset_name", "family")
    clusters = V.variance_clusters(separation, "dataset_name")
    upto = Window.partitionBy(F.lit(0)).orderBy("axis")  # one row for each axis
    by_axis = [F.max(F.when(F.col("axis") == i, F.col("loading"))).alias(f"pc{i + 1}") for i in range(n)]
    binned = R.bins_2d(full, ["dataset_name"], plane[0], plane[-1], 30)
    counts = full.groupBy(*by, "condition", "patch_group").count()
    return {
        "patch_latent_report": full,
        "patches_left_out": left_out,
        "cluster_condition_patchgroup_counts": counts.orderBy("cluster_id", F.desc("count"), "condition", "patch_group"),
        "cluster_composition": counts.orderBy("cluster_id", "condition", "patch_group"),
        "cluster_feature_means": full.where("cluster_id IS NOT NULL").groupBy(*by).agg(*[F.avg(f).alias(f) for f in kept]),
        "feature_policy": policy,
        "feature_variance_audit": audit,
        "feature_variance_audit_overview": R.audit_overview(audit, ["dataset_name"]),
        "pca_loadings": loadings,
        "pca_explained": loadings.groupBy("axis").agg(F.first("explained").alias("explained")).withColumn("cumulative", F.sum("explained").over(upto)),
        "pca_top_loadings": R.ranked(loadings, ["axis"], [F.abs("loading").desc(), F.col("feature")], 20),
        "pca_max_loadings": loadings.groupBy("feature").agg(F.max(F.abs("loading")).alias("max_abs_loading"), *by_axis).orderBy(F.desc("max_abs_loading"), "feature").limit(40),
        "cluster_separation": separation,
        "cluster_separation_removed": away.withColumn("family", family("feature")),
        "feature_variance_clusters": separation.join(clusters, ["dataset_name", "feature"]),
        "feature_variance_removed": V.removed_projection(separation, away, clusters, "dataset_name"),
        "redundancy_pairs": pairs,
        "redundancy_groups": groups,
        "redundancy_families": profiles.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n_features"), F.countDistinct("family").alias("n_families")),
        "condition_enrichment": R.enrichment(full, "dataset_name", "cluster_id", "condition"),
        "patchgroup_enrichment": R.enrichment(full, "dataset_name", "cluster_id", "patch_group"),
        "interpretation_summary": R.cluster_status(full, "dataset_name", "cluster_id", "condition", "patch_group"),
        "representatives": R.ranked(near, by, [F.col("distance"), F.col("patch_id")], config.representatives_per_cluster),
        "extremes": R.ranked(near, by, [F.col("distance").desc(), F.col("patch_id")], min(5, config.representatives_per_cluster)),
        "pca_bins": R.dense_bins(binned, ["dataset_name"], 30, count=F.count(F.lit(1)), positive=F.count_if(F.col("condition") == "positive"), negative=F.count_if(F.col("condition") == "negative")),
    }


def image_tables(full: DataFrame, crops: DataFrame, plane: int, depth: int) -> dict[str, DataFrame]:
    """``channel_ranges`` and ``cluster_images`` of the crops ``patch_id, channel, v`` of clustered patches: least and greatest value of each channel's maxima over
    slices ((0, 1) where they don't differ), and each pixel's mean and median of them over a cluster's patches."""
    mine = crops.where("channel != 'map2_mask'").join(full.select("patch_id", "dataset_name", "cluster_id"), "patch_id")
    top = mine.select("dataset_name", "cluster_id", "channel", z_max(F.transform("v", lambda v: v.cast("double")), depth, plane).alias("x"))
    span = top.groupBy("dataset_name", "channel").agg(F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"))
    flat = ~(F.col("high") > F.col("low"))
    pixels = top.select("dataset_name", "cluster_id", "channel", F.posexplode("x").alias("at", "v"))
    return {
        "channel_ranges": span.select("dataset_name", "channel", F.when(flat, 0.0).otherwise(F.col("low")).alias("low"), F.when(flat, 1.0).otherwise(F.col("high")).alias("high")),
        "cluster_images": pixels.groupBy("dataset_name", "cluster_id", "channel", "at").agg(F.avg("v").alias("mean"), F.median("v").alias("median")),
    }


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table to a Parquet folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
