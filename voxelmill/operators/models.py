"""Models of a report: principal axes, clusters with fallback, choice of their number, hierarchy of features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite

#: Most features of a dataset whose distances are compared in pairs: the matrix then takes half a gigabyte of a task. A report has some hundreds.
MOST_FEATURES = 8_000


def standardized(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """``rows`` with finite features, each less its mean over its population deviation; constant features are left out.

    Only two numbers for each feature reach the driver.
    """
    good = rows
    for f in features:
        good = good.where(finite(f))
    stats = good.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    kept = [f for f in features if (stats[f"s_{f}"] or 0.0) > 1e-8]
    return good.withColumns({f: (F.col(f) - stats[f"m_{f}"]) / stats[f"s_{f}"] for f in kept}), kept


def principal_axes(rows: DataFrame, features: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """``(rows with axes, loadings)``: ``pca`` holds each row's coordinates; ``axis, feature, loading, explained`` the axes.

    An axis points so that its largest loading is above 0.
    """
    scaled, kept = standardized(rows, features)
    n = max(1, min(n, len(kept)))
    vectors = VectorAssembler(inputCols=kept, outputCol="_vector").transform(scaled)
    model = PCA(k=n, inputCol="_vector", outputCol="_axes").fit(vectors)
    axes = model.pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(n)])
    flipped = F.transform(vector_to_array("_axes"), lambda v, i: v * F.get(F.array(*[F.lit(float(s)) for s in sign]), i))
    table = [(int(a), f, float(axes[k, a] * sign[a]), float(model.explainedVariance[a])) for a in range(n) for k, f in enumerate(kept)]
    loadings = rows.sparkSession.createDataFrame(table, "axis int, feature string, loading double, explained double")
    return model.transform(vectors).withColumn("pca", flipped).drop("_vector", "_axes"), loadings


def _vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_vector").transform(rows)


def kmeans(rows: DataFrame, features: list[str], k: int, seed: int, starts: int = 10) -> DataFrame:
    """``rows`` with ``cluster_id``: the best of several starts by training cost."""
    data = _vectors(rows, features)
    held = data.select("_vector").persist()
    try:
        fits = [KMeans(k=k, seed=seed + s, featuresCol="_vector", predictionCol="cluster_id").fit(held) for s in range(starts)]
    finally:
        held.unpersist()
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("_vector")


def clusters(rows: DataFrame, features: list[str], k: int, seed: int, method: str = "gmm", ridges: tuple[float, ...] = (0.0, 1e-6, 1e-5, 1e-4, 1e-3)) -> DataFrame:
    """``rows`` with ``cluster_id`` by a Gaussian mixture, or by k-means where that is asked for or no mixture can be fitted.

    ``k`` is brought into 2 to the number of rows. Where a covariance is singular, the mixture is fitted again to rows that a
    seeded noise of the variance ``ridge`` was added to, with rising ridges, before k-means is taken.
    """
    if method not in ("gmm", "kmeans"):
        raise ValueError(f"unknown method {method!r}")
    k = max(2, min(k, rows.count()))
    for ridge in ridges if method == "gmm" else ():
        noisy = rows if not ridge else rows.select("*").withColumns({f: F.col(f) + F.randn(seed + i) * ridge**0.5 for i, f in enumerate(features)})
        try:
            model = GaussianMixture(k=k, seed=seed, featuresCol="_vector", predictionCol="cluster_id", maxIter=30).fit(_vectors(noisy, features))
            return model.transform(_vectors(rows, features)).drop("_vector", "probability")
        except (Py4JJavaError, CapturedException):  # what the solver says of a singular covariance differs by its library
            continue
    return kmeans(rows, features, k, seed)


def choose_k(rows: DataFrame, features: list[str], most: int, seed: int) -> DataFrame:
    """``k, silhouette, inertia, chosen`` for 2 to ``most`` clusters; the first best silhouette is chosen."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    data, found = _vectors(rows, features).select("_vector").persist(), []
    try:
        for k in range(2, min(most, data.count() - 1) + 1):
            model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol="cluster_id").fit(data)
            score = ClusteringEvaluator(featuresCol="_vector", predictionCol="cluster_id").evaluate(model.transform(data))
            found.append((k, float(score), float(model.summary.trainingCost)))
    finally:
        data.unpersist()
    best = max(found, key=lambda r: (r[1], -r[0]))[0] if found else None
    return rows.sparkSession.createDataFrame([(*r, r[0] == best) for r in found], "k int, silhouette double, inertia double, chosen boolean")


def ward_labels(points: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k of Ward's hierarchy cut into ``k`` clusters, numbered by their first points.

    Chains of nearest neighbours give all merges over one matrix of distances, in quadratic time; the ``n - k`` of the least increase are
    carried out. Where increases are equal any of the equal hierarchies may come out.
    """
    n = len(points)
    if n <= max(k, 1):
        return np.arange(1, n + 1)
    square = (points**2).sum(1)
    cost = np.maximum(square[:, None] + square[None] - 2 * points @ points.T, 0.0) / 2
    np.fill_diagonal(cost, np.inf)
    size, merges, chain = np.ones(n), [], []
    alive = np.ones(n, dtype=bool)
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(alive.argmax()))
        a = chain[-1]
        b = int(cost[a].argmin())
        if len(chain) > 1 and cost[a, chain[-2]] <= cost[a, b]:
            b = chain[-2]
            del chain[-2:]
            low, high = min(a, b), max(a, b)
            merges.append((cost[a, b], low, high))
            total = size[low] + size[high] + size
            row = ((size[low] + size) * cost[low] + (size[high] + size) * cost[high] - size * cost[low, high]) / total
            row[~alive] = np.inf
            row[[low, high]] = np.inf
            cost[low], cost[:, low] = row, row
            cost[high], cost[:, high] = np.inf, np.inf
            size[low] += size[high]
            alive[high] = False
        else:
            chain.append(b)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - max(k, 1)]:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1] + 1


def feature_hierarchy(metrics: DataFrame, domain: str, feature: str, columns: list[str], k: int) -> DataFrame:
    """``domain, feature, hierarchical_cluster`` of every domain's features over its standardised ``columns``.

    The rows are features, not patches: some hundreds for each domain; more than ``MOST_FEATURES`` are refused.
    """
    schema = f"`{domain}` {metrics.schema[domain].dataType.simpleString()}, `{feature}` string, hierarchical_cluster int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_FEATURES:
            raise ValueError(f"{len(pdf)} features are more than {MOST_FEATURES}")
        pdf = pdf.sort_values(feature)
        x = pdf[columns].to_numpy(float)
        sd = x.std(0)
        return pdf[[domain, feature]].assign(hierarchical_cluster=ward_labels((x - x.mean(0)) / np.where(sd > 0, sd, 1.0), k).astype("int32"))

    return metrics.select(domain, feature, *columns).groupBy(domain).applyInPandas(run, schema)


def silhouette(points: DataFrame, domains: list[str], item: str, label: str, columns: list[str]) -> DataFrame:
    """``domains..., item, silhouette`` of labelled features: mean distance to the own cluster against the nearest other one, 0 where there is none of either.

    Compares all pairs within a domain, of which each has some hundreds; for patches use :func:`choose_k`.
    """
    other = points.select(*domains, F.col(item).alias("_o"), F.col(label).alias("_l"), *[F.col(c).alias(f"_{c}") for c in columns])
    gap = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in columns), F.lit(0.0)))
    far = points.join(other, domains).where(F.col(item) != F.col("_o")).groupBy(*domains, item, label, "_l").agg(F.avg(gap).alias("_gap"))
    mine = F.col(label) == F.col("_l")
    both = far.groupBy(*domains, item).agg(F.min(F.when(mine, F.col("_gap"))).alias("_own"), F.min(F.when(~mine, F.col("_gap"))).alias("_next"))
    wider = F.greatest("_own", "_next")
    score = F.when(F.col("_own").isNull() | F.col("_next").isNull() | (wider == 0), 0.0).otherwise((F.col("_next") - F.col("_own")) / F.when(wider > 0, wider).otherwise(1.0))
    return both.select(*domains, item, score.alias("silhouette"))
