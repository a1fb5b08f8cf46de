import pytest

from voxelmill.functions.keys import fresh, label_key, newest, path_key
from voxelmill.operators import report as R


def test_keys(spark):
    df = spark.createDataFrame([(" In-Mask ", ".\\a//b/./c.npz"), ("FAR background", "./x/y/"), (None, None)], "l string, p string")
    assert [tuple(r) for r in df.select(label_key("l"), path_key("p")).collect()] == [("in_mask", "a/b/c.npz"), ("far_background", "x/y"), (None, None)]
    assert fresh(df.withColumnRenamed("l", "_Salt"), "salt") == ["_salt_1"]


def test_newest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", None, 9), (None, 7, 7)], "k string, t int, v int")
    assert [tuple(r) for r in newest(df, "k", "t", "v").collect()] == [("a", 3)]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "d string, c int, l string")
    wide = spark.createDataFrame([], "d string, c int, f double")
    assert R.enrichment(rows, "d", "c", "l").count() == 0
    assert R.cluster_separation(wide, "d", "c", ["f"]).count() == 0
    assert R.variance_audit(wide, ["d"], ["f"]).count() == 0
    assert R.cluster_status(rows, "d", "c", "l", "l").count() == 0


def test_one_cluster_has_no_separation(spark):
    rows = spark.createDataFrame([("d", 1, 1.0), ("d", 1, 2.0), ("d", None, 9.0), ("d", 1, float("nan"))], "d string, c int, f double")
    assert [tuple(r)[1:] for r in R.cluster_separation(rows, "d", "c", ["f"]).collect()] == [("f", 0.0, 0.0, 0.0)]


def test_many_features_take_several_passes(spark):
    from pyspark.sql import functions as F

    names = [f"f{i}" for i in range(100)]
    rows = spark.range(60).select(F.lit("d").alias("d"), (F.col("id") % 3).alias("c"), *[(F.col("id") * (i + 1) % 101 * 1.0).alias(f) for i, f in enumerate(names)])
    got = {r.feature: r.separation_score for r in R.cluster_separation(rows, "d", "c", names).collect()}
    table = rows.toPandas()
    for f in ("f0", "f55", "f99"):
        means, sizes = table.groupby("c")[f].mean(), table.groupby("c")[f].size()
        between = (sizes * (means - table[f].mean()) ** 2).sum()
        within = sum(((g[f] - g[f].mean()) ** 2).sum() for _, g in table.groupby("c"))
        assert abs(got[f] - between / (within + 1e-6)) < 1e-9
    z = R.standardize(rows, ["d"], names).toPandas()[names]
    assert len(got) == 100 and abs(z.mean()).max() < 1e-9 and abs(z.std(ddof=0) - 1).max() < 1e-9


def test_audit_reasons(spark):
    values = {"zero": [0.0, 0.0], "const": [3.5, 3.5], "near": [1.0, 1.0 + 1e-9], "good": [1.0, 2.0], "none": [None, float("inf")]}
    wide = spark.createDataFrame([("d", *[vs[i] for vs in values.values()]) for i in (0, 1)], "d string, " + ", ".join(f"{f} double" for f in values))
    got = {r.feature: r.reason for r in R.variance_audit(wide, ["d"], list(values)).collect()}
    assert got == {r.feature: r.reason for r in R.variance_audit(wide, ["d"], list(values), exact_unique=True).collect()} == {"zero": "all_zero", "const": "constant", "near": "near_constant", "good": "kept", "none": "all_zero"}


def test_null_levels_stay_in_denominators(spark):
    rows = spark.createDataFrame([("d", 0, "a"), ("d", 0, None), ("d", None, "a"), ("d", None, "b")], "d string, c int, l string")
    got = {(r.c, r.l): (r["count"], r.fraction_within_cluster, r.global_fraction) for r in R.enrichment(rows, "d", "c", "l").collect()}
    assert got == {(0, "a"): (1, 0.5, 0.5), (0, "b"): (0, 0.0, 0.25), (None, "a"): (1, 0.5, 0.5), (None, "b"): (1, 0.5, 0.25)}


def test_redundancy_rests_on_all_axes(spark, data):
    from pyspark.sql import functions as F

    from voxelmill.queries import models
    from voxelmill.sources.tables import table

    wanted = {r.dataset_name: r.n_pca_components for r in table(spark, data, "report_config", "dataset_name", "n_pca_components").collect()}
    got = {r.dataset_name: r["n"] for r in models._loadings(spark, data).groupBy("dataset_name").agg(F.countDistinct("axis").alias("n")).collect()}
    assert got and all(n == min(wanted.get(name) or 9, 9) for name, n in got.items()) and max(got.values()) > 2
    corr = [abs(r.loading_corr) for r in models.q_redundancy_rule(spark, data).collect() if r.loading_corr is not None]
    assert any(0 < c < 0.999 for c in corr)


def test_small_families_may_be_redundant(spark):
    from voxelmill.operators import feature_variance as V

    rows = [("d", "two", "a", 4.0, 2.0, 2.0), ("d", "two", "b", 4.0, 2.0, 2.0), ("d", "three", "c", 4.0, 2.0, 2.0), ("d", "three", "e", 4.1, 2.0, 2.05), ("d", "three", "f", 1.0, 9.0, 0.1), ("d", "one", "g", 1.0, 1.0, 1.0)]
    metrics = spark.createDataFrame(rows, "d string, family string, feature string, between_cluster_var double, within_cluster_var double, separation_score double")
    loads = {"a": (0.5, 0.1, 0.2), "b": (0.5, -0.1, 0.2), "c": (0.5, 0.1, 0.2), "e": (0.52, 0.1, 0.2), "f": (0.1, 0.9, 0.0), "g": (1.0, 0.0, 0.0)}
    loadings = spark.createDataFrame([("d", f, i, v) for f, ls in loads.items() for i, v in enumerate(ls)], "d string, feature string, axis int, loading double")
    grouped = V.with_groups(V.profiles(metrics, loadings, "d", "family"), "d", "family").cache()
    pairs = V.redundant_pairs(grouped, "d", "family").cache()
    got = {(r.feature_a, r.feature_b): (r.same_group, r.redundant) for r in pairs.collect()}
    assert got == {("a", "b"): (True, True), ("c", "e"): (True, True), ("c", "f"): (False, False), ("e", "f"): (False, False)}
    groups = {r.family: (r.representative, r.group_size, r.redundant_group) for r in V.redundant_groups(pairs, grouped, "d", "family").collect()}
    assert groups == {"two": ("a", 2, True), "three": ("e", 2, True)}


def test_features_are_grouped_domain_by_domain(spark):
    from voxelmill.operators import feature_variance as V

    rows = [(d, f"f{i}", 10.0 ** (3 * (i % groups)), 1.0, 10.0 ** (3 * (i % groups))) for d, groups in (("two", 2), ("three", 3)) for i in range(9)]
    rows += [("one", "f0", 1.0, 1.0, 1.0), ("pair", "f0", 1.0, 1.0, 1.0), ("pair", "f1", 9.0, 1.0, 9.0), (None, "f0", 1.0, 1.0, 1.0), ("gap", "f0", None, 1.0, 1.0), ("gap", "f1", float("nan"), 2.0, 2.0), ("gap", "f2", 5.0, 2.0, 2.0)]
    metrics = spark.createDataFrame(rows, "d string, feature string, between_cluster_var double, within_cluster_var double, separation_score double")
    got = V.variance_clusters(metrics, "d").collect()
    assert {r.d: r.k for r in got} == {"two": 2, "three": 3, "one": 1, "pair": 1, "gap": 2} and len(got) == 24
    assert all(r.silhouette == pytest.approx(1.0) for r in got if r.d in ("two", "three")) and all(r.silhouette is None and r.feature_variance_cluster == 0 for r in got if r.d in ("one", "pair"))
    for d, groups in (("two", 2), ("three", 3)):
        assert len({(int(r.feature[1]) % groups, r.feature_variance_cluster) for r in got if r.d == d}) == groups
    assert {r.d: r.k for r in V.variance_clusters(metrics, "d", 5).collect()} == {"two": 5, "three": 5, "one": 1, "pair": 2, "gap": 3}
    assert V.variance_clusters(metrics.limit(0), "d").count() == 0
