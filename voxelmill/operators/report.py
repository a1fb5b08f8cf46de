"""The relational core of a cluster report: counts, enrichment, audits, separation, ranking and bins.

All operators take rows keyed by a ``domain`` (a dataset) and a ``cluster``, so that any number of reports is made in
one plan. Null clusters are a cluster of their own in counts and enrichment; means, separation and ranking leave them out.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, log2_enrichment


def long_features(rows: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """``ids..., feature, value``: one row for each feature of each row."""
    return rows.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(ids, features, "feature", "value")


def enrichment(rows: DataFrame, domain: str, cluster: str, level: str) -> DataFrame:
    """Each cluster against each observed level: count, fraction in the cluster, fraction in all, log2 of their ratio.

    Dense: a level that a cluster lacks has count 0. Rows without a level stay in the denominators but are no level.
    Levels are few; the grid is built from each domain's own clusters and levels by an equi-join on the domain.
    """
    counts = rows.groupBy(domain, cluster, level).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(domain, cluster).agg(F.sum("n").alias("cluster_size"))
    levels = counts.groupBy(domain, level).agg(F.sum("n").alias("level_size")).withColumn("total", F.sum("level_size").over(Window.partitionBy(domain))).where(F.col(level).isNotNull())
    held = counts.select(F.col(domain).alias("_d"), F.col(cluster).alias("_c"), F.col(level).alias("_l"), "n")
    grid = sizes.join(levels, domain)
    out = grid.join(held, F.col(domain).eqNullSafe(F.col("_d")) & F.col(cluster).eqNullSafe(F.col("_c")) & (F.col(level) == F.col("_l")), "left")
    count = F.coalesce("n", F.lit(0))
    part, whole = count / F.col("cluster_size"), F.col("level_size") / F.col("total")
    return out.select(domain, cluster, "cluster_size", level, count.alias("count"), part.alias("fraction_within_cluster"), whole.alias("global_fraction"), log2_enrichment(part, whole).alias("log2_enrichment_vs_global"))


def cluster_status(rows: DataFrame, domain: str, cluster: str, condition: str, group: str, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """Each cluster's size, share of both conditions, what it is enriched in, and its dominant group (the first by name among equals)."""
    by_group = rows.groupBy(domain, cluster, group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(condition) == positive).alias("p"), F.count_if(F.col(condition) == negative).alias("q")
    )
    one = by_group.groupBy(domain, cluster).agg(
        F.sum("n").alias("cluster_size"), F.sum("p").alias("p"), F.sum("q").alias("q"), F.min(F.struct((-F.col("n")).alias("n"), F.col(group).isNull().alias("u"), F.col(group).alias("g"))).alias("top")
    )
    p, q = F.col("p") / F.col("cluster_size"), F.col("q") / F.col("cluster_size")
    status = (
        F.when(p.between(0.4, 0.6) & q.between(0.4, 0.6), "mixed").when(p > q, F.lit(positive + "_enriched"))
        .when(q > p, F.lit(negative + "_enriched")).otherwise("mixed")
    )
    return one.select(
        domain, cluster, "cluster_size", p.alias("positive_fraction"), q.alias("negative_fraction"), status.alias("condition_status"),
        F.col("top.g").alias("dominant_patch_group"), (-F.col("top.n") / F.col("cluster_size")).alias("dominant_patch_group_fraction"),
    )


def composition_pivot(rows: DataFrame, keys: list[str], level: str, levels: list[str]) -> DataFrame:
    """Fraction of each of the named levels in every group of ``keys``; 0 where there is none."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(level) == v).alias(v) for v in levels])
    return counted.select(*keys, *[(F.col(v) / F.col("_n")).alias(v) for v in levels])


#: Features whose aggregates share one pass; more in one would outgrow generated code.
FEATURES_A_PASS = 48


def _by_pass(features: list[str]) -> list[list[str]]:
    return [features[i : i + FEATURES_A_PASS] for i in range(0, len(features), FEATURES_A_PASS)]


def feature_stats(rows: DataFrame, keys: list[str], features: list[str], stats: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``keys..., feature, stats...`` over the finite values of each feature.

    Rows stay wide until they are aggregated: what is turned into one row for each feature is the small result, not the table.
    """
    out = None
    for some in _by_pass(features):
        value = {f: F.when(finite(F.col(f).cast("double")), F.col(f).cast("double")) for f in some}
        one = rows.groupBy(*keys).agg(*[F.struct(*[make(value[f]).alias(n) for n, make in stats.items()]).alias(f) for f in some])
        long = one.select(*keys, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("_s")) for f in some]))).select(*keys, "feature", "_s.*")
        out = long if out is None else out.unionByName(long)
    return out


def variance_audit(rows: DataFrame, keys: list[str], features: list[str], tiny: float = 1e-12, near: float = 1e-8, exact_unique: bool = False) -> DataFrame:
    """Statistics of the finite values of each feature, and why it is kept or dropped.

    ``all_zero`` before ``constant`` (least and greatest are equal) before ``near_constant``. A feature without finite values is ``all_zero`` with zero
    statistics. ``n_unique`` is estimated by a sketch unless ``exact_unique`` asks for a count, which shuffles every distinct value.
    """
    stats = feature_stats(rows, keys, features, {
        "n_finite": F.count, "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max,
        "n_unique": (lambda v: F.lit(0).cast("bigint")) if exact_unique else (lambda v: F.approx_count_distinct(v, 0.02)),
    })
    if exact_unique:
        counts = long_features(rows, keys, features).where(finite("value")).select(*keys, "feature", "value").distinct().groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n_unique"))
        stats = stats.drop("n_unique").join(counts, [*keys, "feature"], "left").fillna(0, ["n_unique"])
    stats = stats.fillna(0.0, ["mean", "std", "min", "max"]).withColumn("range", F.col("max") - F.col("min"))
    reason = (
        F.when(F.greatest(F.abs("min"), F.abs("max")) <= tiny, "all_zero").when(F.col("min") == F.col("max"), "constant")
        .when((F.col("std") <= near) | (F.col("range") <= near), "near_constant").otherwise("kept")
    )
    return stats.withColumn("reason", reason).withColumn("kept", F.col("reason") == "kept")


def audit_overview(audit: DataFrame, keys: list[str]) -> DataFrame:
    """How many features an audit keeps and drops, and whether too little information is left."""
    out = audit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("kept"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("all_zero", "constant", "near_constant")]
    )
    low = (F.col("kept") < 2) | (F.col("kept") < F.least(F.lit(10), "total")) | (F.col("kept") / F.col("total") < 0.25)
    return out.withColumn("low_information", low)


def cluster_separation(rows: DataFrame, domain: str, cluster: str, features: list[str]) -> DataFrame:
    """Per feature the sums of squares between and within clusters and their ratio; zeros for fewer than two clusters.

    One shuffle of partial moments for each (domain, cluster); non-finite values and null clusters are left out.
    """
    part = feature_stats(rows.where(F.col(cluster).isNotNull()), [domain, cluster], features, {"n": F.count, "m": F.avg, "v": F.var_pop}).where("n > 0")
    total = part.groupBy(domain, "feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w")
    )
    many = F.col("k") > 1
    between = F.when(many, F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))).otherwise(0.0)
    within = F.when(many, F.col("w")).otherwise(0.0)
    return total.select(domain, "feature", between.alias("between_cluster_var"), within.alias("within_cluster_var"), F.when(many, between / (within + 1e-6)).otherwise(0.0).alias("separation_score"))


def standardize(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``rows`` with each feature less its mean over its population deviation; a constant feature is only centred, a non-finite value is null.

    The statistics, one row for each of ``keys``, join back on them, so no feature is gathered in one task.
    """
    out = rows
    for some in _by_pass(features):
        value = {f: F.when(finite(F.col(f).cast("double")), F.col(f).cast("double")) for f in some}
        stats = rows.groupBy(*keys).agg(*[s for f in some for s in (F.avg(value[f]).alias(f"_m_{f}"), F.stddev_pop(value[f]).alias(f"_s_{f}"))])
        scaled = {f: (value[f] - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0) for f in some}
        out = out.join(stats, keys).withColumns(scaled).drop(*[f"_{s}_{f}" for f in some for s in "ms"])
    return out


def ranked(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark prunes each partition to ``n`` before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def distance_to_center(rows: DataFrame, domain: str, cluster: str, axes: list[str]) -> DataFrame:
    """Rows with ``distance`` to their cluster's mean over ``axes``; null clusters and non-finite coordinates are left out."""
    good = rows.where(F.col(cluster).isNotNull())
    for a in axes:
        good = good.where(finite(a))
    centers = good.groupBy(domain, cluster).agg(*[F.avg(a).alias(f"_c{i}") for i, a in enumerate(axes)])
    square = sum(((F.col(a) - F.col(f"_c{i}")) ** 2 for i, a in enumerate(axes)), F.lit(0.0))
    return good.join(centers, [domain, cluster]).withColumn("distance", F.sqrt(square)).drop(*[f"_c{i}" for i in range(len(axes))])


def bins_2d(rows: DataFrame, keys: list[str], x: str, y: str, bins: int) -> DataFrame:
    """``rows`` with ``bx, by``: the bins of a histogram over each group's own range, its last bins closed on the right."""
    good = rows.where(finite(x) & finite(y))
    span = good.groupBy(*keys).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))

    def place(v: str, low: str, high: str) -> Column:
        wide = F.col(high) - F.col(low)
        return F.when(wide <= 0, 0).otherwise(F.least(F.floor((F.col(v) - F.col(low)) / F.when(wide > 0, wide).otherwise(1.0) * bins), F.lit(bins - 1))).cast("int")

    return good.join(span, keys).withColumn("bx", place(x, "_x0", "_x1")).withColumn("by", place(y, "_y0", "_y1")).drop("_x0", "_x1", "_y0", "_y1")


def dense_bins(binned: DataFrame, keys: list[str], bins: int, **counts: Column) -> DataFrame:
    """``keys..., bx, by`` for every bin of each group's grid, with its ``counts`` (0 where it is empty)."""
    side = F.sequence(F.lit(0), F.lit(bins - 1))
    grid = binned.select(*keys).distinct().select("*", F.explode(side).alias("bx")).select("*", F.explode(side).alias("by"))
    held = binned.groupBy(*keys, "bx", "by").agg(*[v.alias(n) for n, v in counts.items()])
    return grid.join(held, [*keys, "bx", "by"], "left").fillna(0, list(counts))
