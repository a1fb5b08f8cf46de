"""Problem 6: grouping records into similarity clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import newest
from ..session import written
from ..sources.tables import table
from .mixture import assign, fit, linked_sets
from .ranking import top_n

REACH = {"map2_mask_fraction": 0.01, "distance_to_mask_boundary_px": 0.25, "map2_local_thickness_proxy": 0.25}
LEAST = 4
TYPICAL = 5
#: Components that part the rows into the blocks in which alike ones are looked for.
BLOCKS = 6


def _patches(spark: SparkSession, d: str) -> DataFrame:
    features = newest(table(spark, d, "patch_features"), "patch_id", "computed_at", *REACH)
    for f in REACH:
        features = features.where(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(F.col(f)) != float("inf")))
    samples = table(spark, d, "manifest", "patch_id", "sample_id").where("patch_id IS NOT NULL AND sample_id IS NOT NULL").groupBy("patch_id").agg(F.min("sample_id").alias("sample_id"))
    return written(features.join(samples, "patch_id").select("patch_id", "sample_id", *REACH), "patches")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Linked sets within the components of a small mixture: blocks need no more of it than that they are few and overlap little."""
    rows = _patches(spark, d)
    model = fit(rows, list(REACH), starts=1, finalists=1, most=BLOCKS)
    if model is None:
        return spark.createDataFrame([], "first_patch_id string, patch_id string")
    sets = linked_sets(rows, model, "sample_id", "patch_id", list(REACH.values()), LEAST)
    return sets.where("patch_id != root").select(F.col("root").alias("first_patch_id"), "patch_id")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members (highest density) of each component of the mixture."""
    rows = _patches(spark, d)
    model = fit(rows, list(REACH))
    if model is None:
        return spark.createDataFrame([], "component int, size bigint, rank int, patch_id string, log_density double")
    placed = written(assign(rows, model, ["patch_id"]), "placed")
    size = placed.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    typical = top_n(placed, ["component"], "log_density", "patch_id", TYPICAL)
    return typical.join(size, "component").select("component", "size", "rank", "patch_id", "log_density")


QUERIES = {"p6_found": p6_found, "p6_clusters": p6_clusters}

ORACLES = {
    "p6_found": """
WITH RECURSIVE f AS (SELECT patch_id, map2_mask_fraction a, distance_to_mask_boundary_px b, map2_local_thickness_proxy c FROM patch_features
  WHERE patch_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY computed_at DESC NULLS LAST) = 1),
p AS (SELECT f.*, s FROM f JOIN (SELECT patch_id, min(sample_id) AS s FROM manifest GROUP BY 1) USING (patch_id)
  WHERE s IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND isfinite(a) AND isfinite(b) AND isfinite(c)),
e AS (SELECT x.patch_id u, y.patch_id v FROM p x JOIN p y ON x.s = y.s AND x.patch_id != y.patch_id
  AND abs(x.a - y.a) <= 0.01 AND abs(x.b - y.b) <= 0.25 AND abs(x.c - y.c) <= 0.25),
reach AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
root AS (SELECT u AS patch_id, least(u, min(v)) AS first_patch_id FROM reach GROUP BY u)
SELECT first_patch_id, patch_id FROM root WHERE patch_id != first_patch_id
  AND first_patch_id IN (SELECT first_patch_id FROM root GROUP BY 1 HAVING count(*) >= 4)
""",
}
