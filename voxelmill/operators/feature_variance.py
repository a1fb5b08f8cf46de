"""Features as rows: grouping them by their variance metrics, and finding those that say the same.

A dataset has some hundreds of features; hierarchies refuse more than ``models.MOST_FEATURES``. Datasets are any number, each a group of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import written
from .models import MOST_FEATURES, silhouette, ward_labels
from .report import standardize

METRICS = ["between_cluster_var", "within_cluster_var", "separation_score"]


def load_separation(spark, path: str) -> DataFrame:
    """A separation table in CSV; ValueError where a column is missing."""
    table = spark.read.option("header", True).option("inferSchema", True).csv(path)
    lacking = {"feature", *METRICS} - set(table.columns)
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(sorted(lacking))}")
    return table.select("feature", *[F.col(m).cast("double").alias(m) for m in METRICS])


def _kmeans(x: np.ndarray, k: int, seed: int, starts: int = 10) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of several seeded starts."""
    best = None
    for s in range(starts):
        rng = np.random.default_rng(seed + s)
        centers = x[[rng.integers(len(x))]]
        while len(centers) < k:
            far = ((x[:, None] - centers[None]) ** 2).sum(-1).min(1)
            centers = np.vstack([centers, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]])
        for _ in range(100):
            labels = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
            moved = np.stack([x[labels == j].mean(0) if (labels == j).any() else centers[j] for j in range(k)])
            if np.allclose(moved, centers):
                break
            centers = moved
        cost = float(((x - centers[labels]) ** 2).sum())
        if best is None or cost < best[1] - 1e-12:
            best = labels, cost
    return best


def variance_clusters(metrics: DataFrame, domain: str, k: int | None = None, seed: int = 42, most: int = 8) -> DataFrame:
    """``domain, feature, feature_variance_cluster, k, silhouette``: features grouped by their scaled log metrics.

    Without ``k`` the number of 2 to ``most`` clusters with the first best silhouette is taken. ``k`` is brought into 1..n;
    one cluster gets the id 0 and no silhouette. A missing metric counts as the mean; rows without a domain are left out.
    Each number of clusters of a domain is a task of its own; silhouettes are joins.
    """
    logs = written(metrics.select(domain, "feature", *[F.log10(F.col(m) + 1e-6).alias(m) for m in METRICS]), "metrics")  # read again and again
    points = standardize(logs, [domain], METRICS).fillna(0.0, METRICS)
    n = F.col("_n").cast("int")
    sizes = F.array(F.least(F.lit(max(k, 1)), n)) if k is not None else F.when(n > 2, F.sequence(F.lit(2), F.least(F.lit(most), n - 1))).otherwise(F.array(F.lit(1)))
    tried = points.join(points.groupBy(domain).agg(F.count(F.lit(1)).alias("_n")), domain).withColumn("k", F.explode(sizes)).drop("_n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature")
        return pdf.assign(feature_variance_cluster=_kmeans(pdf[METRICS].to_numpy(), int(pdf["k"].iloc[0]), seed)[0].astype("int32"))

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in tried.schema], "feature_variance_cluster int"])
    labelled = written(tried.groupBy(domain, "k").applyInPandas(run, schema), "feature-groups")
    score = silhouette(labelled.where("k > 1"), [domain, "k"], "feature", "feature_variance_cluster", METRICS).groupBy(domain, "k").agg(F.avg("silhouette").alias("silhouette"))
    scored = labelled.select(domain, "k").distinct().join(score, [domain, "k"], "left")
    best = scored.groupBy(domain).agg(F.max(F.struct(F.round("silhouette", 12).alias("r"), (-F.col("k")).alias("k"), "silhouette")).alias("_b"))
    best = best.select(domain, (-F.col("_b.k")).alias("k"), F.col("_b.silhouette").alias("silhouette"))
    return labelled.join(best, [domain, "k"]).select(domain, "feature", "feature_variance_cluster", "k", "silhouette")


def removed_projection(kept: DataFrame, removed: DataFrame, clusters: DataFrame, domain: str) -> DataFrame:
    """``domain, feature, removed, feature_variance_cluster, pc_1, pc_2``: features on the first two axes of the kept ones' scaled log metrics; the removed
    features are placed by the kept ones' scale and axes, and belong to no cluster."""
    both = kept.select(domain, "feature", *METRICS, F.lit(False).alias("removed")).unionByName(removed.select(domain, "feature", *METRICS, F.lit(True).alias("removed")))
    rows = both.join(clusters.select(domain, "feature", "feature_variance_cluster"), [domain, "feature"], "left")
    schema = f"`{domain}` {rows.schema[domain].dataType.simpleString()}, feature string, removed boolean, feature_variance_cluster int, pc_1 double, pc_2 double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        logs, mine = np.log10(pdf[METRICS].to_numpy(float) + 1e-6), ~pdf["removed"].to_numpy(bool)
        base = logs[mine] if mine.any() else logs
        sd = base.std(0)
        x = (logs - base.mean(0)) / np.where(sd > 0, sd, 1.0)
        axes = np.linalg.eigh(np.cov((x[mine] if mine.any() else x).T, bias=True))[1][:, ::-1][:, :2]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
        return pdf[[domain, "feature", "removed", "feature_variance_cluster"]].assign(pc_1=x @ axes[:, 0], pc_2=x @ axes[:, 1])

    return rows.groupBy(domain).applyInPandas(run, schema)


def profiles(metrics: DataFrame, loadings: DataFrame, domain: str, family: str) -> DataFrame:
    """``domain, family, feature``, the metrics, ``pc`` (a feature's loadings by axis) and ``x``: log metrics and absolute loadings, each scaled over the family.

    ``loadings`` has ``domain, feature, axis, loading``. What doesn't vary in a family is only centred.
    """
    by = F.transform(F.array_sort(F.collect_list(F.struct("axis", "loading"))), lambda p: p["loading"])
    rows = metrics.select(domain, family, "feature", *METRICS).join(loadings.groupBy(domain, "feature").agg(by.alias("pc")), [domain, "feature"])
    every = F.concat(F.array(*[F.log10(F.col(m) + 1e-6) for m in METRICS]), F.transform("pc", lambda v: F.abs(v)))
    long = rows.select(domain, family, "feature", F.posexplode(every).alias("_at", "_v"))
    stats = long.groupBy(domain, family, "_at").agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
    scaled = long.join(stats, [domain, family, "_at"]).withColumn("_z", (F.col("_v") - F.col("_m")) / F.when(F.col("_s") > 1e-12, F.col("_s")).otherwise(1.0))
    x = scaled.groupBy(domain, "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_z"))), lambda p: p["_z"]).alias("x"))
    return rows.join(x, [domain, "feature"])


def with_groups(rows: DataFrame, domain: str, family: str, groups: int = 3) -> DataFrame:
    """:func:`profiles` with ``group_id``: Ward's hierarchy of each family cut into ``groups``, or one less than it has features."""
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (domain, family)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_FEATURES:
            raise ValueError(f"{len(pdf)} features are more than {MOST_FEATURES}")
        pdf = pdf.sort_values("feature", ignore_index=True)
        return pdf[[domain, family, "feature"]].assign(group_id=ward_labels(np.stack(pdf["x"]), max(1, min(groups, len(pdf) - 1))).astype("int32"))

    labels = rows.select(domain, family, "feature", "x").groupBy(domain, family).applyInPandas(run, ", ".join([*kinds, "feature string, group_id int"]))
    return rows.join(labels, [domain, family, "feature"])


def _correlation(a, b):
    """Pearson's correlation of two arrays, null where one of them is constant."""
    ma, mb = A.mean(a), A.mean(b)
    apart = A.let(F.struct(ma.alias("a"), mb.alias("b")), lambda m: F.struct(
        A.total(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"]))).alias("xy"), A.total(F.transform(a, lambda x: (x - m["a"]) ** 2)).alias("xx"), A.total(F.transform(b, lambda y: (y - m["b"]) ** 2)).alias("yy")
    ))
    return A.let(apart, lambda s: F.try_divide(s["xy"], F.sqrt(s["xx"] * s["yy"])))


def redundant_pairs(grouped: DataFrame, domain: str, family: str, corr: float = 0.95, share: float = 0.25) -> DataFrame:
    """All pairs of features of one family, and whether they are redundant: of one group, with metrics and with absolute loadings
    that correlate by ``corr``, and no farther apart than the ``share`` quantile of the family's distances.

    ``grouped`` are :func:`profiles` with a ``group_id``, from :func:`with_groups` or elsewhere. The pairs are of features, within a family. Correlations with a constant
    profile are null and make no pair redundant.
    """
    raw = grouped.select(domain, family, "feature", "group_id", F.array(*METRICS).alias("r"), F.transform("pc", lambda v: F.abs(v)).alias("l"), "x")
    other = raw.select(domain, family, *[F.col(c).alias(f"{c}_b") for c in ("feature", "group_id", "r", "l", "x")])
    met = raw.withColumnRenamed("feature", "feature_a").join(other, [domain, family]).where("feature_a < feature_b")
    met = met.select(
        domain, family, "feature_a", "feature_b", "group_id", (F.col("group_id") == F.col("group_id_b")).alias("same_group"), _correlation(F.col("r"), F.col("r_b")).alias("metric_corr"),
        _correlation(F.col("l"), F.col("l_b")).alias("loading_corr"), F.sqrt(A.total(F.zip_with("x", "x_b", lambda a, b: (a - b) ** 2))).alias("distance"),
    )
    cutoff = met.groupBy(domain, family).agg(F.percentile("distance", F.lit(share)).alias("distance_cutoff"))
    out = met.join(cutoff, [domain, family])
    rule = F.col("same_group") & (F.col("metric_corr") >= corr) & (F.col("loading_corr") >= corr) & (F.col("distance") <= F.col("distance_cutoff"))
    return out.withColumn("redundant", F.coalesce(rule, F.lit(False)))


def redundant_groups(pairs: DataFrame, grouped: DataFrame, domain: str, family: str, corr: float = 0.95) -> DataFrame:
    """Each group of two features or more: its size, mean correlations and distance, whether it counts as redundant (all pairs do, both means at
    least ``corr``), and its representative: the feature of highest separation, then of the highest loadings axis by axis, then the first by name."""
    stats = pairs.where("same_group").groupBy(domain, family, "group_id").agg(
        F.avg("metric_corr").alias("mean_metric_corr"), F.avg("loading_corr").alias("mean_loading_corr"), F.avg("distance").alias("mean_distance"), F.every("redundant").alias("all_redundant")
    )
    order = Window.partitionBy(domain, family, "group_id").orderBy(F.col("separation_score").desc(), F.col("pc").desc(), "feature")
    first = grouped.withColumn("_r", F.row_number().over(order)).withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(domain, family, "group_id"))).where("_r = 1")
    first = first.select(domain, family, "group_id", "group_size", F.col("feature").alias("representative"), F.col("separation_score").alias("representative_separation_score"))
    flag = F.col("all_redundant") & (F.col("mean_metric_corr") >= corr) & (F.col("mean_loading_corr") >= corr)
    return stats.join(first, [domain, family, "group_id"]).withColumn("redundant_group", F.coalesce(flag, F.lit(False)))
