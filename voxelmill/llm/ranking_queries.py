"""Problem 5: top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import newest
from ..sources.tables import table
from .ranking import top_n


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The kept patches with their rank and score."""
    report = newest(table(spark, d, "patch_report"), "patch_id", "scored_at", "dataset_name", "cluster_id", "center_score")
    wanted = table(spark, d, "report_config", "dataset_name", "representatives_per_cluster")
    most = wanted.agg(F.max("representatives_per_cluster")).first()[0] or 0
    ranked = top_n(report.join(wanted, "dataset_name"), ["dataset_name", "cluster_id"], "center_score", "patch_id", max(most, 0), limit="representatives_per_cluster")
    return ranked.select("dataset_name", "cluster_id", "patch_id", "center_score", "rank")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_ranked(spark, d).select("dataset_name", "cluster_id", "patch_id")


QUERIES = {"p5_found": p5_found, "p5_ranked": p5_ranked}

_RANKED = """
WITH newest AS (SELECT * FROM patch_report WHERE patch_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY scored_at DESC NULLS LAST) = 1),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_name, cluster_id ORDER BY center_score DESC, patch_id) AS rank FROM newest
  WHERE dataset_name IS NOT NULL AND cluster_id IS NOT NULL AND center_score IS NOT NULL AND NOT isnan(center_score))
SELECT k.dataset_name, k.cluster_id, k.patch_id{more} FROM kept k JOIN report_config c ON k.dataset_name = c.dataset_name
WHERE k.rank <= c.representatives_per_cluster
"""
ORACLES = {"p5_found": _RANKED.format(more=""), "p5_ranked": _RANKED.format(more=", k.center_score, k.rank")}
