"""Problem 3: choosing a varied subset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import label_key, newest
from ..session import written
from ..sources.tables import table
from .diversity import core_set, isolated

RADIUS = 0.05
LEAST = 8


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """``patch_id, sample_id, patch_group, map2_mask_fraction`` of every patch with a finite fraction."""
    manifest = table(spark, d, "manifest").select("patch_id", "sample_id", label_key("patch_group").alias("patch_group")).where("patch_id IS NOT NULL AND sample_id IS NOT NULL AND patch_group IS NOT NULL").distinct()
    features = newest(table(spark, d, "patch_features", "patch_id", "computed_at", "map2_mask_fraction"), "patch_id", "computed_at", "map2_mask_fraction")
    return features.where("map2_mask_fraction IS NOT NULL AND NOT isnan(map2_mask_fraction) AND abs(map2_mask_fraction) != double('inf')").join(manifest, "patch_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    groups = ["sample_id", "patch_group"]
    rows = _patches(spark, d)
    rows = written(rows.select("patch_id", "sample_id", "patch_group", "map2_mask_fraction"), "patches")
    rows = rows.join(rows.groupBy(*groups).count().where(F.col("count") >= LEAST).drop("count"), groups, "left_semi")
    core = core_set(rows, groups, "patch_group", "map2_mask_fraction", "patch_id", RADIUS, gain=1.0)
    return isolated(core, rows, groups, "map2_mask_fraction", "patch_id", RADIUS).select("patch_id")


def _by_dataset(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "samples", "sample_id", "dataset_name").distinct()
    size = table(spark, d, "report_config", "dataset_name", "subset_size")
    return written(_patches(spark, d).join(samples, "sample_id").join(size, "dataset_name").select("dataset_name", "patch_group", "patch_id", "map2_mask_fraction", "subset_size").distinct(), "patches")


def _subset(rows: DataFrame) -> DataFrame:
    return core_set(rows, ["dataset_name"], "patch_group", "map2_mask_fraction", "patch_id", RADIUS, size="subset_size", fill=True)


def p3_subset(spark: SparkSession, d: str) -> DataFrame:
    """The varied subset of every dataset's report, in the order of selection."""
    return _subset(_by_dataset(spark, d))


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What each dataset's subset holds: its patches, and how many stand alone in their patch group, in the dataset and in the subset."""
    rows = _by_dataset(spark, d)
    chosen, groups = written(_subset(rows), "subset"), ["dataset_name", "patch_group"]
    core = core_set(rows, groups, "patch_group", "map2_mask_fraction", "patch_id", RADIUS, gain=1.0)
    alone = written(isolated(core, rows, groups, "map2_mask_fraction", "patch_id", RADIUS).withColumn("alone", F.lit(True)), "alone")
    held = chosen.join(alone, [*groups, "patch_id"], "left").groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n_chosen"), F.count_if(F.coalesce("alone", F.lit(False))).alias("n_alone_chosen"))
    every = alone.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n_alone"))
    return held.join(every, "dataset_name", "left").select("dataset_name", "n_chosen", F.coalesce("n_alone", F.lit(0)).alias("n_alone"), "n_alone_chosen")


QUERIES = {"p3_found": p3_found, "p3_subset": p3_subset, "p3_sizes": p3_sizes}

ORACLES = {
    "p3_found": r"""
WITH f AS (SELECT patch_id, map2_mask_fraction AS v FROM patch_features WHERE patch_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY computed_at DESC NULLS LAST) = 1),
m AS (SELECT DISTINCT patch_id, sample_id, regexp_replace(lower(trim(patch_group)), '[\s_-]+', '_', 'g') AS g FROM manifest),
a AS (SELECT patch_id, sample_id, g, v FROM f JOIN m USING (patch_id) WHERE v IS NOT NULL AND isfinite(v) AND sample_id IS NOT NULL AND g IS NOT NULL),
n AS (SELECT patch_id, v, count(*) OVER w AS n, lag(v) OVER (w ORDER BY v) AS before, lead(v) OVER (w ORDER BY v) AS after FROM a WINDOW w AS (PARTITION BY sample_id, g))
SELECT patch_id FROM n WHERE n >= 8 AND (before IS NULL OR v - before >= 0.05) AND (after IS NULL OR after - v >= 0.05)
""",
    "p3_sizes": r"""
WITH f AS (SELECT patch_id, map2_mask_fraction AS v FROM patch_features WHERE patch_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY computed_at DESC NULLS LAST) = 1),
m AS (SELECT DISTINCT patch_id, sample_id, regexp_replace(lower(trim(patch_group)), '[\s_-]+', '_', 'g') AS g FROM manifest),
a AS (SELECT DISTINCT s.dataset_name, g, patch_id, v, subset_size FROM f JOIN m USING (patch_id) JOIN (SELECT DISTINCT sample_id, dataset_name FROM samples) s USING (sample_id) JOIN report_config c ON c.dataset_name = s.dataset_name WHERE v IS NOT NULL AND isfinite(v) AND g IS NOT NULL),
n AS (SELECT *, lag(v) OVER (w ORDER BY v) AS before, lead(v) OVER (w ORDER BY v) AS after FROM a WINDOW w AS (PARTITION BY dataset_name, g)),
o AS (SELECT dataset_name, least(any_value(subset_size), count(*)) AS n_chosen, count(*) FILTER (WHERE (before IS NULL OR v - before >= 0.05) AND (after IS NULL OR after - v >= 0.05)) AS n_alone FROM n GROUP BY 1)
SELECT dataset_name, CAST(n_chosen AS BIGINT) AS n_chosen, n_alone, n_alone AS n_alone_chosen FROM o
""",
}
