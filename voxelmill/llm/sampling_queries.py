"""Problem 1: sample matching target category proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import label_key
from ..sources.tables import table
from .sampling import capped, draw


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate centers of each dataset, capped for each sample and group, then drawn to the targets."""
    samples = table(spark, d, "samples").select("sample_id", "dataset_name", label_key("condition").alias("condition")).where("condition IS NOT NULL").distinct()
    caps = table(spark, d, "dataset_config", "dataset_name", "max_patches_per_group")
    targets = table(spark, d, "sampling_targets")
    targets = targets.select("dataset_name", label_key("condition").alias("condition"), label_key("patch_group").alias("patch_group"), "target_share", "sample_size", "min_rows")
    centers = table(spark, d, "patch_centers").select("sample_id", "y", "x", label_key("patch_group").alias("patch_group")).where("patch_group IS NOT NULL").distinct()
    wanted = samples.join(caps, "dataset_name").join(targets.select("dataset_name").distinct(), "dataset_name", "left_semi")
    most = caps.agg(F.max("max_patches_per_group")).first()[0] or 0
    rows = capped(centers.join(wanted, "sample_id"), ["dataset_name", "condition", "sample_id", "patch_group"], ["sample_id", "y", "x"], "max_patches_per_group", max(most, 0))
    return draw(rows, targets, "dataset_name", ["condition", "patch_group"], ["sample_id", "y", "x"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The targets that came out short in the draw."""
    short = _drawn(spark, d)[1].where("short").select("dataset_name", F.col("condition").alias("c"), F.col("patch_group").alias("g"))
    given = table(spark, d, "sampling_targets", "dataset_name", "condition", "patch_group")
    return given.join(short.withColumnRenamed("dataset_name", "n"), (F.col("dataset_name") == F.col("n")) & (label_key("condition") == F.col("c")) & (label_key("patch_group") == F.col("g")), "left_semi")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d)[0]


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d)[1]


QUERIES = {"p1_found": p1_found, "p1_sample": p1_sample, "p1_report": p1_report}

_KEY = r"regexp_replace(lower(trim({0})), '[\s_-]+', '_', 'g')"
ORACLES = {
    "p1_found": f"""
WITH s AS (SELECT DISTINCT sample_id, dataset_name, {_KEY.format('condition')} AS c FROM samples WHERE condition IS NOT NULL),
n AS (SELECT sample_id, g, count(*) AS n FROM (SELECT DISTINCT sample_id, y, x, {_KEY.format('patch_group')} AS g FROM patch_centers WHERE patch_group IS NOT NULL) GROUP BY ALL),
a AS (SELECT s.dataset_name, s.c, n.g, sum(least(n.n, k.max_patches_per_group)) AS available
      FROM s JOIN n USING (sample_id) JOIN dataset_config k USING (dataset_name) GROUP BY ALL)
SELECT t.dataset_name, t.condition, t.patch_group FROM sampling_targets t
LEFT JOIN a ON a.dataset_name = t.dataset_name AND a.c = {_KEY.format('t.condition')} AND a.g = {_KEY.format('t.patch_group')}
WHERE coalesce(a.available, 0) < greatest(round(t.target_share * t.sample_size, 6), t.min_rows)
""",
    "p1_report": f"""
WITH s AS (SELECT DISTINCT sample_id, dataset_name, {_KEY.format('condition')} AS c FROM samples WHERE condition IS NOT NULL),
n AS (SELECT sample_id, g, count(*) AS n FROM (SELECT DISTINCT sample_id, y, x, {_KEY.format('patch_group')} AS g FROM patch_centers WHERE patch_group IS NOT NULL) GROUP BY ALL),
a AS (SELECT s.dataset_name, s.c, n.g, sum(least(n.n, k.max_patches_per_group)) AS held
      FROM s JOIN n USING (sample_id) JOIN dataset_config k USING (dataset_name) GROUP BY ALL),
t AS (SELECT t.dataset_name, {_KEY.format('t.condition')} AS condition, {_KEY.format('t.patch_group')} AS patch_group, round(target_share * sample_size, 6) AS target, min_rows, sample_size, coalesce(a.held, 0) AS held
      FROM sampling_targets t LEFT JOIN a ON a.dataset_name = t.dataset_name AND a.c = {_KEY.format('t.condition')} AND a.g = {_KEY.format('t.patch_group')}),
r AS (SELECT *, unnest(range(1, CAST(least(held, greatest(sample_size, min_rows, ceil(target))) AS BIGINT) + 1)) AS rank FROM t),
p AS (SELECT *, CASE WHEN rank <= min_rows THEN -1.0 / rank WHEN target > 0 THEN (rank - 0.5) / target END AS priority FROM r),
q AS (SELECT *, CASE WHEN priority IS NOT NULL THEN row_number() OVER (PARTITION BY dataset_name ORDER BY priority NULLS LAST, rank, condition, patch_group) END AS seat FROM p),
o AS (SELECT dataset_name, condition, patch_group, count(*) AS available, count(*) FILTER (WHERE rank <= min_rows OR rank - 1 < target) AS claims, count(*) FILTER (WHERE seat <= sample_size) AS drawn FROM q GROUP BY ALL)
SELECT t.dataset_name, t.condition, t.patch_group, greatest(target, min_rows) AS wanted, coalesce(available, 0) AS available, coalesce(claims, 0) AS claims, coalesce(drawn, 0) AS drawn, coalesce(claims, 0) < greatest(target, min_rows) AS short
FROM t LEFT JOIN o USING (dataset_name, condition, patch_group)
""",
}
