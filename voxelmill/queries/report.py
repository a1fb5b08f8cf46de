"""Cluster reports over the project's manifest, features and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import ALLOWED_CONTEXT, FAMILIES, family, family_of, policy_reason
from ..functions.keys import label_key, newest, path_key
from ..functions.numeric import finite, guarded_corr, safe_ratio, shown
from ..operators import report as R
from ..sources.tables import table

FEATURES = [
    "map2_mask_fraction", "distance_to_mask_boundary_px", "center_of_patch_map2_intensity", "map2_local_thickness_proxy", "map2_proj_mean",
    "flag_proj_mean", "ha_proj_mean", "shank2_proj_mean", "shank2_local_snr",
]
CHANNELS = ["map2", "flag", "ha", "shank2"]
CHANNEL_FEATURES = [f"{c}_{s}" for c in CHANNELS for s in ("mean", "max", "sum", "std", "z_peak_index", "z_occupancy")]
BINS = 30


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each patch, its labels in comparable form."""
    rows = table(spark, d, "manifest", "patch_id", "loaded_at", "sample_id", "condition", "patch_group")
    rows = rows.withColumn("condition", label_key("condition")).withColumn("patch_group", label_key("patch_group"))
    return newest(rows, "patch_id", "loaded_at", "sample_id", "condition", "patch_group")


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "patch_features"), "patch_id", "computed_at", *FEATURES)


def cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "patch_report"), "patch_id", "scored_at", "dataset_name", "cluster_id", "pca_1", "pca_2", "center_score")


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return cluster_rows(spark, d).join(manifest_rows(spark, d), "patch_id")


def full_rows(spark: SparkSession, d: str) -> DataFrame:
    return cluster_rows(spark, d).join(feature_rows(spark, d), "patch_id")


def long_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.long_features(full_rows(spark, d), ["dataset_name", "cluster_id", "patch_id"], FEATURES)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: shown(n) for n in names})


def q_manifest_join(spark, d):
    return rounded(manifest_rows(spark, d).join(feature_rows(spark, d), "patch_id").select("patch_id", "sample_id", "patch_group", "map2_proj_mean"), "map2_proj_mean")


def q_manifest_union(spark, d):
    rows = table(spark, d, "manifest").select("patch_id", "sample_id", label_key("condition").alias("condition"), "shard_index")
    return rows.where("condition = 'positive'").unionByName(rows.where("condition = 'negative'")).groupBy("sample_id", "condition").agg(F.count(F.lit(1)).alias("n"), F.max("shard_index").alias("last_index"))


def q_missing_files(spark, d):
    """Manifest locations without a stored file."""
    given = table(spark, d, "manifest").select(path_key("patch_path").alias("location")).where("location IS NOT NULL").distinct()
    stored = table(spark, d, "patch_files").select(path_key("file_path").alias("location"))
    return given.join(stored, "location", "left_anti")


def q_resume_skip(spark, d):
    """What a run that is taken up again has to do: registered samples and groups of which the manifest has no patch yet."""
    group = label_key("patch_group").alias("patch_group")
    wanted = table(spark, d, "samples", "sample_id").where("sample_id IS NOT NULL").distinct().select("sample_id", F.explode(F.array(*map(F.lit, GROUPS))).alias("patch_group"))
    return wanted.join(table(spark, d, "manifest").select("sample_id", group), ["sample_id", "patch_group"], "left_anti")


def q_safe_ratio(spark, d):
    f = feature_rows(spark, d)
    return f.select("patch_id", shown(safe_ratio("flag_proj_mean", "ha_proj_mean")).alias("flag_to_ha"), shown(safe_ratio("ha_proj_mean", "map2_local_thickness_proxy", strict=True)).alias("ha_to_thickness")).where(finite("flag_to_ha") & finite("ha_to_thickness"))


def q_channel_ratios(spark, d):
    rows = newest(table(spark, d, "manifest"), "patch_id", "loaded_at", *[f"{c}_{s}" for c in CHANNELS for s in ("mean", "sum")])
    rows = rows.fillna(0.0)
    f, h = F.col("flag_mean"), F.col("ha_mean")
    return rounded(
        rows.select(
            "patch_id", safe_ratio(f, h).alias("flag_to_ha"), safe_ratio(h, f).alias("ha_to_flag"), (f + h).alias("flag_ha_sum"), (f * h).alias("flag_ha_product"),
            F.abs(f - h).alias("flag_ha_absdiff"), safe_ratio("shank2_mean", "map2_mean").alias("shank2_to_map2"),
            safe_ratio(F.col("flag_sum") + F.col("ha_sum"), F.col("shank2_sum")).alias("flag_plus_ha_to_shank2"),
        ),
        "flag_to_ha", "ha_to_flag", "flag_ha_sum", "flag_ha_product", "flag_ha_absdiff", "shank2_to_map2", "flag_plus_ha_to_shank2",
    )


def q_cluster_counts(spark, d):
    return report_rows(spark, d).groupBy("dataset_name", "cluster_id", "condition", "patch_group").count()


def q_cluster_means(spark, d):
    good = [F.avg(F.when(finite(f), F.col(f))).alias(f) for f in FEATURES]
    return rounded(full_rows(spark, d).where("cluster_id IS NOT NULL").groupBy("dataset_name", "cluster_id").agg(*good), *FEATURES)


def _enriched(spark, d, level):
    return rounded(R.enrichment(report_rows(spark, d), "dataset_name", "cluster_id", level), "fraction_within_cluster", "global_fraction", "log2_enrichment_vs_global")


def q_enrichment_condition(spark, d):
    return _enriched(spark, d, "condition")


def q_enrichment_group(spark, d):
    return _enriched(spark, d, "patch_group")


def q_cluster_status(spark, d):
    return rounded(R.cluster_status(report_rows(spark, d), "dataset_name", "cluster_id", "condition", "patch_group"), "positive_fraction", "negative_fraction", "dominant_patch_group_fraction")


GROUPS = ["in_mask", "boundary", "near_mask_outside", "far_background"]


def q_composition_pivot(spark, d):
    return rounded(R.composition_pivot(report_rows(spark, d), ["dataset_name", "cluster_id"], "patch_group", GROUPS), *GROUPS)


def q_variance_audit(spark, d):
    return rounded(R.variance_audit(full_rows(spark, d), ["dataset_name"], FEATURES, exact_unique=True), "mean", "std", "min", "max", "range")


def q_audit_overview(spark, d):
    return R.audit_overview(R.variance_audit(full_rows(spark, d), ["dataset_name"], FEATURES), ["dataset_name"])


def separation(spark, d):
    return R.cluster_separation(full_rows(spark, d), "dataset_name", "cluster_id", FEATURES)


METRICS = ["between_cluster_var", "within_cluster_var", "separation_score"]


def q_cluster_separation(spark, d):
    return rounded(separation(spark, d), *METRICS)


def q_top_separation(spark, d):
    """The three features of every dataset that part its clusters most."""
    return R.ranked(rounded(separation(spark, d), *METRICS), ["dataset_name"], [F.col("separation_score").desc(), F.col("feature")], 3).select("dataset_name", "feature", "separation_score", "rank")


def q_feature_cluster_summary(spark, d):
    """Mean metrics of each family of features in every dataset."""
    return rounded(separation(spark, d).groupBy("dataset_name", family("feature").alias("family")).agg(F.count(F.lit(1)).alias("n_features"), *[F.avg(m).alias(m) for m in METRICS]), *METRICS)


def q_metric_corr(spark, d):
    """Pearson correlation of the log metrics over all datasets' features."""
    logs = separation(spark, d).select(*[F.log10(F.col(m) + 1e-6).alias(m) for m in METRICS])
    pairs = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i:]]
    one = logs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(f"s{i}") for i, m in enumerate(METRICS)], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs])
    c = {m: F.col(f"s{i}") for i, m in enumerate(METRICS)}
    square = lambda a, b: F.col(f"`{a}*{b}`")
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), shown(guarded_corr(F.col("n"), c[a], c[b], square(a, a), square(b, b), square(a, b)), 5).alias("corr")) for a, b in pairs]
    return one.select(F.inline(F.array(*rows)))


def _pairs(spark, d):
    base = separation(spark, d).withColumn("family", family("feature"))
    b = base.select("dataset_name", "family", F.col("feature").alias("feature_b"), *[F.col(m).alias(f"{m}_b") for m in METRICS])
    return base.withColumnRenamed("feature", "feature_a").join(b, ["dataset_name", "family"]).where("feature_a < feature_b")


def q_feature_pairs(spark, d):
    """Pairs of features of one family in every dataset, at most the square of the number of features, with the distance of their metrics."""
    gap = F.sqrt(sum(((F.log10(F.col(m) + 1e-6) - F.log10(F.col(f"{m}_b") + 1e-6)) ** 2 for m in METRICS), F.lit(0.0)))
    return _pairs(spark, d).select("dataset_name", "family", "feature_a", "feature_b", shown(gap, 4).alias("distance"))


def q_redundancy_pairs(spark, d):
    """Pairs of one family whose values correlate by 0.95 or more in absolute value over the patches of their dataset."""
    wide = full_rows(spark, d).select("dataset_name", *[F.when(finite(f), F.col(f)).alias(f) for f in FEATURES])
    pairs = [(a, b) for i, a in enumerate(sorted(FEATURES)) for b in sorted(FEATURES)[i + 1:] if family_of(a) == family_of(b)]

    def sums(a: str, b: str, k: int) -> list:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return [F.count(x).alias(f"n{k}"), F.sum(x).alias(f"x{k}"), F.sum(y).alias(f"y{k}"), F.sum(x * x).alias(f"xx{k}"), F.sum(y * y).alias(f"yy{k}"), F.sum(x * y).alias(f"xy{k}")]

    one = wide.groupBy("dataset_name").agg(*[s for k, (a, b) in enumerate(pairs) for s in sums(a, b, k)])
    col = lambda name, k: F.col(f"{name}{k}")
    rows = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), guarded_corr(*[col(n, k) for n in ("n", "x", "y", "xx", "yy", "xy")]).alias("corr")) for k, (a, b) in enumerate(pairs)]
    long = one.select("dataset_name", F.inline(F.array(*rows)))
    return long.select("dataset_name", "feature_a", "feature_b", shown("corr", 4).alias("corr"), (F.abs("corr") >= 0.95).alias("redundant"))


def q_feature_family(spark, d):
    """Family of each feature column of manifest and features, with its number of finite values."""
    m = R.long_features(newest(table(spark, d, "manifest"), "patch_id", "loaded_at", *CHANNEL_FEATURES), ["patch_id"], CHANNEL_FEATURES)
    f = R.long_features(feature_rows(spark, d), ["patch_id"], FEATURES)
    return m.unionByName(f).where(finite("value")).groupBy("feature").agg(F.count(F.lit(1)).alias("n_finite")).select("feature", family("feature").alias("family"), "n_finite")


def q_feature_policy(spark, d):
    """For every report the features that its policy keeps, with why, and the kept features' finite values."""
    config = table(spark, d, "report_config", "dataset_name", "map2_feature_policy")
    seen = long_rows(spark, d).groupBy("dataset_name", "feature").agg(F.count_if(finite("value")).alias("n_finite"))
    out = seen.join(config, "dataset_name").withColumn("reason", policy_reason("feature", F.col("map2_feature_policy")))
    return out.select("dataset_name", "feature", "reason", (F.col("reason") != "excluded_map2_as_signal").alias("kept"), "n_finite")


def q_feature_subset(spark, d):
    """Values of only those features whose separation is above the mean of their dataset."""
    s = separation(spark, d)
    high = s.join(s.groupBy("dataset_name").agg(F.avg("separation_score").alias("m")), "dataset_name").where("separation_score > m").select("dataset_name", "feature")
    kept = long_rows(spark, d).where(finite("value")).join(high, ["dataset_name", "feature"], "left_semi")
    return kept.groupBy("dataset_name", "feature").agg(F.count(F.lit(1)).alias("n"), shown(F.avg("value")).alias("mean"))


def q_standardize(spark, d):
    z = R.long_features(R.standardize(full_rows(spark, d), ["dataset_name"], FEATURES), ["patch_id"], FEATURES)
    return z.where("value IS NOT NULL").select("patch_id", "feature", shown("value", 4).alias("value"))


def q_representatives(spark, d):
    near = R.distance_to_center(cluster_rows(spark, d), "dataset_name", "cluster_id", ["pca_1", "pca_2"]).withColumn("distance", shown("distance"))
    return R.ranked(near, ["dataset_name", "cluster_id"], [F.col("distance"), F.col("patch_id")], 5).select("dataset_name", "cluster_id", "patch_id", "distance", "rank")


def q_extremes(spark, d):
    far = R.distance_to_center(cluster_rows(spark, d), "dataset_name", "cluster_id", ["pca_1", "pca_2"]).withColumn("distance", shown("distance"))
    return R.ranked(far, ["dataset_name", "cluster_id"], [F.col("distance").desc(), F.col("patch_id")], 5).select("dataset_name", "cluster_id", "patch_id", "distance", "rank")


def q_pca_bins(spark, d):
    """Counts over a 30 x 30 grid, with the share of positive patches and its log2 against the grid's share of negative ones."""
    binned = R.bins_2d(report_rows(spark, d), ["dataset_name"], "pca_1", "pca_2", BINS)
    out = R.dense_bins(binned, ["dataset_name"], BINS, n=F.count(F.lit(1)), p=F.count_if(F.col("condition") == "positive"), q=F.count_if(F.col("condition") == "negative"))
    return out.select("dataset_name", "bx", "by", "n", "p", "q", shown(safe_ratio("p", "n")).alias("positive_fraction"), shown(F.log2((F.col("p") + 1e-6) / (F.col("q") + 1e-6))).alias("log2_ratio"))


def q_pca_bins_group(spark, d):
    binned = R.bins_2d(report_rows(spark, d), ["dataset_name"], "pca_1", "pca_2", BINS)
    out = R.dense_bins(binned, ["dataset_name"], BINS, n=F.count(F.lit(1)), **{g: F.count_if(F.col("patch_group") == g) for g in GROUPS})
    return rounded(out.select("dataset_name", "bx", "by", *[safe_ratio(g, "n").alias(g) for g in GROUPS]), *GROUPS)


def q_channel_ranges(spark, d):
    """Display range of each channel in every sample: least and greatest maximum, (0, 1) where they don't differ."""
    rows = newest(table(spark, d, "manifest"), "patch_id", "loaded_at", "sample_id", *[f"{c}_max" for c in CHANNELS])
    long = R.long_features(rows, ["sample_id"], [f"{c}_max" for c in CHANNELS]).where(finite("value"))
    out = long.groupBy("sample_id", "feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    flat = F.col("low") >= F.col("high")
    return out.select("sample_id", "feature", F.when(flat, 0.0).otherwise(F.col("low")).alias("low"), F.when(flat, 1.0).otherwise(F.col("high")).alias("high"))


def loadings_on(spark: SparkSession, d: str, axes: list[str]) -> DataFrame:
    """``dataset_name, feature, axis, loading``: how each standardised feature goes with each given axis."""
    z = R.standardize(full_rows(spark, d), ["dataset_name"], FEATURES)
    on = [F.when(finite(a), F.col(a)) for a in axes]
    sums = z.groupBy("dataset_name").agg(*[F.array(*[F.avg(F.col(f) * v) for v in on]).alias(f) for f in FEATURES])
    long = sums.select("dataset_name", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("_l")) for f in FEATURES])))
    return long.select("dataset_name", "feature", F.posexplode("_l").alias("axis", "loading")).withColumn("axis", F.col("axis") + 1)


def q_max_loadings(spark, d):
    """Every feature's loading of the greatest absolute value over the given axes, the five greatest of each dataset first."""
    best = loadings_on(spark, d, ["pca_1", "pca_2"]).groupBy("dataset_name", "feature").agg(shown(F.max(F.abs("loading")), 5).alias("max_abs_loading"))
    return R.ranked(best, ["dataset_name"], [F.col("max_abs_loading").desc(), F.col("feature")], 5)


def q_family_counts(spark, d):
    """Number of features and of distinct families of each dataset's features with a separation above 0."""
    return separation(spark, d).where("separation_score > 1e-9").groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n_features"), F.countDistinct(family("feature")).alias("n_families"))


def q_top_loadings(spark, d):
    """Per dataset the three features whose standardised values go most with the first axis."""
    load = loadings_on(spark, d, ["pca_1"]).select("dataset_name", "feature", shown("loading", 5).alias("loading"))
    return R.ranked(load, ["dataset_name"], [F.abs("loading").desc(), F.col("feature")], 3).select("dataset_name", "feature", "loading", "rank")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_KEY = r"regexp_replace(lower(trim({0})), '[\s_-]+', '_', 'g')"
_PATH = r"regexp_replace(regexp_replace(regexp_replace({0}, '[/\\]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '')"
_NEW = "SELECT * FROM {t} WHERE patch_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY {by} DESC NULLS LAST) = 1"


def _fin(x: str) -> str:
    return f"({x} IS NOT NULL AND isfinite({x}))"


def _r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


_M = f"m AS (SELECT patch_id, sample_id, {_KEY.format('condition')} AS condition, {_KEY.format('patch_group')} AS patch_group FROM ({_NEW.format(t='manifest', by='loaded_at')}))"
_F = f"f AS ({_NEW.format(t='patch_features', by='computed_at')})"
_C = f"c AS ({_NEW.format(t='patch_report', by='scored_at')})"
_REP = f"WITH {_M}, {_C}, r AS (SELECT c.patch_id, dataset_name, cluster_id, pca_1, pca_2, sample_id, condition, patch_group FROM c JOIN m USING (patch_id))"
_LONG = (
    f"WITH {_F}, {_C}, w AS (SELECT dataset_name, cluster_id, patch_id, {', '.join(FEATURES)} FROM c JOIN f USING (patch_id)), "
    f"l AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATURES)})))"
)
_SEP = _LONG + f""", g AS (SELECT dataset_name, feature, cluster_id, count(*) n, avg(value) m, var_pop(value) v FROM l WHERE {_fin('value')} AND cluster_id IS NOT NULL GROUP BY ALL),
t AS (SELECT dataset_name, feature, count(*) k, sum(n) n, sum(n*m) s, sum(n*m*m) q, sum(n*v) w FROM g GROUP BY ALL),
sep AS (SELECT dataset_name, feature, CASE WHEN k > 1 THEN greatest(q - s*s/n, 0) ELSE 0 END AS between_cluster_var, CASE WHEN k > 1 THEN w ELSE 0 END AS within_cluster_var,
  CASE WHEN k > 1 THEN greatest(q - s*s/n, 0) / (w + 1e-6) ELSE 0 END AS separation_score FROM t)"""
_FAMILY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({{0}}), {p!r})' for p in parts)} THEN '{label}'" for label, parts in FAMILIES.items()) + " ELSE 'Other' END"
_STATS = _LONG + f""", good AS (SELECT dataset_name, feature, CASE WHEN {_fin('value')} THEN value END v FROM l),
st AS (SELECT dataset_name, feature, count(v) n_finite, coalesce(avg(v), 0) AS mean, coalesce(stddev_pop(v), 0) AS std, coalesce(min(v), 0) AS mn, coalesce(max(v), 0) AS mx, count(DISTINCT v) n_unique FROM good GROUP BY ALL),
au AS (SELECT *, mx - mn AS rg, CASE WHEN greatest(abs(mn), abs(mx)) <= 1e-12 THEN 'all_zero' WHEN n_unique <= 1 THEN 'constant' WHEN std <= 1e-8 OR mx - mn <= 1e-8 THEN 'near_constant' ELSE 'kept' END AS reason FROM st)"""
_BINS = _REP + f""", ok AS (SELECT * FROM r WHERE {_fin('pca_1')} AND {_fin('pca_2')}),
b AS (SELECT *, min(pca_1) OVER w x0, max(pca_1) OVER w x1, min(pca_2) OVER w y0, max(pca_2) OVER w y1 FROM ok WINDOW w AS (PARTITION BY dataset_name)),
p AS (SELECT *, CAST(CASE WHEN x1 <= x0 THEN 0 ELSE least(floor((pca_1-x0)/(x1-x0)*30), 29) END AS INT) AS bx, CAST(CASE WHEN y1 <= y0 THEN 0 ELSE least(floor((pca_2-y0)/(y1-y0)*30), 29) END AS INT) AS by_ FROM b)"""
_NEAR = f"WITH {_C}, ok AS (SELECT * FROM c WHERE cluster_id IS NOT NULL AND {_fin('pca_1')} AND {_fin('pca_2')}), x AS (SELECT *, avg(pca_1) OVER w a, avg(pca_2) OVER w b FROM ok WINDOW w AS (PARTITION BY dataset_name, cluster_id)), y AS (SELECT *, {_r('sqrt((pca_1-a)*(pca_1-a)+(pca_2-b)*(pca_2-b))')} AS distance FROM x) SELECT dataset_name, cluster_id, patch_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name, cluster_id ORDER BY distance {{0}}, patch_id) AS rank FROM y) WHERE rank <= 5"

_GRID = "g AS (SELECT s.dataset_name, CAST(a.r AS INT) AS bx, CAST(b.r AS INT) AS by_ FROM (SELECT DISTINCT dataset_name FROM p) s, range(30) a(r), range(30) b(r))"


def _enrich(level: str) -> str:
    return _REP + f""", n AS (SELECT dataset_name, cluster_id, {level}, count(*) n FROM r GROUP BY ALL), s AS (SELECT dataset_name, cluster_id, sum(n) cs FROM n GROUP BY ALL),
v0 AS (SELECT dataset_name, {level}, sum(n) ls FROM n GROUP BY ALL), v AS (SELECT *, sum(ls) OVER (PARTITION BY dataset_name) tot FROM v0),
x AS (SELECT s.dataset_name, s.cluster_id, cs, v.{level}, coalesce(n.n, 0) c, coalesce(n.n, 0) / cs AS p, ls / tot AS q FROM s JOIN v ON s.dataset_name = v.dataset_name AND v.{level} IS NOT NULL
  LEFT JOIN n ON n.dataset_name = s.dataset_name AND n.cluster_id IS NOT DISTINCT FROM s.cluster_id AND n.{level} = v.{level})
SELECT dataset_name, cluster_id, CAST(cs AS BIGINT) AS cluster_size, {level}, CAST(c AS BIGINT) AS count, {_r('p')} AS fraction_within_cluster, {_r('q')} AS global_fraction, {_r('log2((p + 1e-6) / (q + 1e-6))')} AS log2_enrichment_vs_global FROM x"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} IS NULL OR {b} = 0 OR NOT isfinite({b}) THEN 0 ELSE ({a}) / ({b}) END"


_CORR = "CASE WHEN count(*) < 3 OR sum({x}*{x}) - sum({x})*sum({x})/count(*) <= 1e-12 OR sum({y}*{y}) - sum({y})*sum({y})/count(*) <= 1e-12 THEN 0 ELSE (sum({x}*{y}) - sum({x})*sum({y})/count(*)) / sqrt((sum({x}*{x}) - sum({x})*sum({x})/count(*)) * (sum({y}*{y}) - sum({y})*sum({y})/count(*))) END"
_Z = _LONG + f", zs AS (SELECT dataset_name, feature, avg(value) m, stddev_pop(value) s FROM l WHERE {_fin('value')} GROUP BY ALL), z AS (SELECT l.dataset_name, l.patch_id, l.feature, (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS value FROM l JOIN zs USING (dataset_name, feature) WHERE {_fin('value')})"

ORACLES = {
    "q_manifest_join": f"WITH {_M}, {_F} SELECT patch_id, sample_id, patch_group, {_r('map2_proj_mean')} AS map2_proj_mean FROM m JOIN f USING (patch_id)",
    "q_manifest_union": f"SELECT sample_id, {_KEY.format('condition')} AS condition, count(*) AS n, max(shard_index) AS last_index FROM manifest WHERE {_KEY.format('condition')} IN ('positive', 'negative') GROUP BY ALL",
    "q_missing_files": f"SELECT DISTINCT {_PATH.format('patch_path')} AS location FROM manifest WHERE patch_path IS NOT NULL AND {_PATH.format('patch_path')} NOT IN (SELECT {_PATH.format('file_path')} FROM patch_files WHERE file_path IS NOT NULL)",
    "q_resume_skip": f"SELECT DISTINCT sample_id, g.g AS patch_group FROM samples, (VALUES ('in_mask'), ('boundary'), ('near_mask_outside'), ('far_background')) g(g) WHERE sample_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.sample_id = samples.sample_id AND {_KEY.format('m.patch_group')} = g.g)",
    "q_safe_ratio": f"WITH {_F}, x AS (SELECT patch_id, {_r(_ratio('flag_proj_mean', 'ha_proj_mean'))} AS flag_to_ha, {_r(_ratio('ha_proj_mean', 'map2_local_thickness_proxy'))} AS ha_to_thickness FROM f) SELECT * FROM x WHERE {_fin('flag_to_ha')} AND {_fin('ha_to_thickness')}",
    "q_channel_ratios": f"""WITH a AS ({_NEW.format(t='manifest', by='loaded_at')}), b AS (SELECT patch_id, {', '.join(f'CASE WHEN isnan({c}_{s}) THEN 0 ELSE coalesce({c}_{s}, 0) END AS {c}_{s}' for c in CHANNELS for s in ('mean', 'sum'))} FROM a)
SELECT patch_id, {_r(_ratio('flag_mean', 'ha_mean'))} AS flag_to_ha, {_r(_ratio('ha_mean', 'flag_mean'))} AS ha_to_flag, {_r('flag_mean + ha_mean')} AS flag_ha_sum, {_r('flag_mean * ha_mean')} AS flag_ha_product, {_r('abs(flag_mean - ha_mean)')} AS flag_ha_absdiff, {_r(_ratio('shank2_mean', 'map2_mean'))} AS shank2_to_map2, {_r(_ratio('flag_sum + ha_sum', 'shank2_sum'))} AS flag_plus_ha_to_shank2 FROM b""",
    "q_cluster_counts": _REP + " SELECT dataset_name, cluster_id, condition, patch_group, count(*) AS count FROM r GROUP BY ALL",
    "q_cluster_means": f"WITH {_F}, {_C} SELECT dataset_name, cluster_id, {', '.join(_r(f'avg(CASE WHEN {_fin(x)} THEN {x} END)') + f' AS {x}' for x in FEATURES)} FROM c JOIN f USING (patch_id) WHERE cluster_id IS NOT NULL GROUP BY ALL",
    "q_enrichment_condition": _enrich("condition"),
    "q_enrichment_group": _enrich("patch_group"),
    "q_cluster_status": _REP + f""", s AS (SELECT dataset_name, cluster_id, count(*) n, count(*) FILTER (WHERE condition = 'positive') / count(*) p, count(*) FILTER (WHERE condition = 'negative') / count(*) q FROM r GROUP BY ALL),
t0 AS (SELECT dataset_name, cluster_id, patch_group, count(*) k FROM r GROUP BY ALL), t AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY dataset_name, cluster_id ORDER BY k DESC, patch_group NULLS LAST) = 1)
SELECT s.dataset_name, s.cluster_id, n AS cluster_size, {_r('p')} AS positive_fraction, {_r('q')} AS negative_fraction,
  CASE WHEN p BETWEEN 0.4 AND 0.6 AND q BETWEEN 0.4 AND 0.6 THEN 'mixed' WHEN p > q THEN 'positive_enriched' WHEN q > p THEN 'negative_enriched' ELSE 'mixed' END AS condition_status,
  patch_group AS dominant_patch_group, {_r('k / n')} AS dominant_patch_group_fraction FROM s JOIN t ON s.dataset_name = t.dataset_name AND s.cluster_id IS NOT DISTINCT FROM t.cluster_id""",
    "q_composition_pivot": _REP + " SELECT dataset_name, cluster_id, " + ", ".join(_r(f"count(*) FILTER (WHERE patch_group = '{g}') / count(*)") + f" AS {g}" for g in GROUPS) + " FROM r GROUP BY ALL",
    "q_variance_audit": _STATS + f" SELECT dataset_name, feature, n_finite, {_r('mean')} AS mean, {_r('std')} AS std, {_r('mn')} AS min, {_r('mx')} AS max, n_unique, {_r('rg')} AS range, reason, reason = 'kept' AS kept FROM au",
    "q_audit_overview": _STATS + """ , o AS (SELECT dataset_name, count(*) AS total, count(*) FILTER (WHERE reason = 'kept') AS kept, count(*) FILTER (WHERE reason = 'all_zero') AS all_zero,
  count(*) FILTER (WHERE reason = 'constant') AS constant, count(*) FILTER (WHERE reason = 'near_constant') AS near_constant FROM au GROUP BY ALL)
SELECT *, kept < 2 OR kept < least(10, total) OR kept / total < 0.25 AS low_information FROM o""",
    "q_cluster_separation": _SEP + f" SELECT dataset_name, feature, {', '.join(_r(m) + ' AS ' + m for m in METRICS)} FROM sep",
    "q_top_separation": _SEP + f" SELECT dataset_name, feature, {_r('separation_score')} AS separation_score, row_number() OVER (PARTITION BY dataset_name ORDER BY {_r('separation_score')} DESC, feature) AS rank FROM sep QUALIFY rank <= 3",
    "q_feature_cluster_summary": _SEP + f" SELECT dataset_name, {_FAMILY.format('feature')} AS family, count(*) AS n_features, {', '.join(_r(f'avg({m})') + ' AS ' + m for m in METRICS)} FROM sep GROUP BY ALL",
    "q_metric_corr": _SEP + ", lg AS (SELECT " + ", ".join(f"log10({m} + 1e-6) AS {m}" for m in METRICS) + " FROM sep) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_r(_CORR.format(x=a, y=b), 5)} AS corr FROM lg" for i, a in enumerate(METRICS) for b in METRICS[i:]),
    "q_feature_pairs": _SEP + f", fa AS (SELECT *, {_FAMILY.format('feature')} AS family FROM sep) SELECT x.dataset_name, x.family, x.feature AS feature_a, y.feature AS feature_b, "
    + _r("sqrt(" + " + ".join(f"(log10(x.{m} + 1e-6) - log10(y.{m} + 1e-6)) ** 2" for m in METRICS) + ")", 4) + " AS distance FROM fa x JOIN fa y ON x.dataset_name = y.dataset_name AND x.family = y.family AND x.feature < y.feature",
    "q_redundancy_pairs": _LONG + f", g AS (SELECT x.dataset_name, x.feature fa, y.feature fb, x.value vx, y.value vy FROM l x JOIN l y ON x.patch_id = y.patch_id AND x.feature < y.feature WHERE {_fin('x.value')} AND {_fin('y.value')} AND {_FAMILY.format('x.feature')} = {_FAMILY.format('y.feature')}), k AS (SELECT dataset_name, fa, fb, {_CORR.format(x='vx', y='vy')} AS corr FROM g GROUP BY ALL) SELECT dataset_name, fa AS feature_a, fb AS feature_b, {_r('corr', 4)} AS corr, abs(corr) >= 0.95 AS redundant FROM k",
    "q_feature_family": f"""WITH a AS ({_NEW.format(t='manifest', by='loaded_at')}), {_F}, am AS (SELECT patch_id, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in CHANNEL_FEATURES)} FROM a),
l AS (SELECT feature, value FROM (UNPIVOT am ON {', '.join(CHANNEL_FEATURES)} INTO NAME feature VALUE value) UNION ALL SELECT feature, value FROM (UNPIVOT (SELECT patch_id, {', '.join(FEATURES)} FROM f) ON {', '.join(FEATURES)} INTO NAME feature VALUE value))
SELECT feature, {_FAMILY.format('feature')} AS family, count(*) AS n_finite FROM l WHERE {_fin('value')} GROUP BY ALL""",
    "q_feature_policy": _LONG + f", s AS (SELECT dataset_name, feature, count(*) FILTER (WHERE {_fin('value')}) AS n_finite FROM l GROUP BY ALL), t AS (SELECT s.*, CASE WHEN lower(map2_feature_policy) = 'prior_only' AND feature IN ({', '.join(map(repr, ALLOWED_CONTEXT))}) THEN 'allowed_map2_prior_context' WHEN lower(map2_feature_policy) = 'prior_only' AND contains(feature, 'map2') THEN 'excluded_map2_as_signal' ELSE 'kept' END AS reason FROM s JOIN report_config USING (dataset_name)) SELECT dataset_name, feature, reason, reason != 'excluded_map2_as_signal' AS kept, n_finite FROM t",
    "q_feature_subset": _SEP + f", hi AS (SELECT dataset_name, feature FROM sep QUALIFY separation_score > avg(separation_score) OVER (PARTITION BY dataset_name)) SELECT dataset_name, feature, count(*) AS n, {_r('avg(value)')} AS mean FROM l JOIN hi USING (dataset_name, feature) WHERE {_fin('value')} GROUP BY ALL",
    "q_standardize": _Z + f" SELECT patch_id, feature, {_r('value', 4)} AS value FROM z",
    "q_representatives": _NEAR.format("ASC"),
    "q_extremes": _NEAR.format("DESC"),
    "q_pca_bins": _BINS + f" , h AS (SELECT dataset_name, bx, by_, count(*) AS n, count(*) FILTER (WHERE condition = 'positive') AS p, count(*) FILTER (WHERE condition = 'negative') AS q FROM p GROUP BY ALL), {_GRID}, o AS (SELECT g.dataset_name, g.bx, g.by_ AS by, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM g LEFT JOIN h USING (dataset_name, bx, by_)) SELECT *, {_r('CASE WHEN n = 0 THEN 0 ELSE p / n END')} AS positive_fraction, {_r('log2((p + 1e-6) / (q + 1e-6))')} AS log2_ratio FROM o",
    "q_pca_bins_group": _BINS + f", h AS (SELECT dataset_name, bx, by_, " + ", ".join(f"count(*) FILTER (WHERE patch_group = '{g}') / count(*) AS {g}" for g in GROUPS) + f" FROM p GROUP BY ALL), {_GRID} SELECT g.dataset_name, g.bx, g.by_ AS by, " + ", ".join(_r(f"coalesce({g}, 0)") + f" AS {g}" for g in GROUPS) + " FROM g LEFT JOIN h USING (dataset_name, bx, by_)",
    "q_channel_ranges": f"""WITH a AS ({_NEW.format(t='manifest', by='loaded_at')}), l AS (UNPIVOT (SELECT sample_id, {', '.join(f'{c}_max' for c in CHANNELS)} FROM a) ON {', '.join(f'{c}_max' for c in CHANNELS)} INTO NAME feature VALUE value),
o AS (SELECT sample_id, feature, min(value) lo, max(value) hi FROM l WHERE {_fin('value')} GROUP BY ALL) SELECT sample_id, feature, CASE WHEN lo >= hi THEN 0.0 ELSE lo END AS low, CASE WHEN lo >= hi THEN 1.0 ELSE hi END AS high FROM o""",
    "q_max_loadings": _Z + f", lo AS (SELECT z.dataset_name, feature, {_r('greatest(abs(avg(CASE WHEN ' + _fin('pca_1') + ' THEN value * pca_1 END)), abs(avg(CASE WHEN ' + _fin('pca_2') + ' THEN value * pca_2 END)))', 5)} AS max_abs_loading FROM z JOIN c USING (patch_id) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY max_abs_loading DESC, feature) AS rank FROM lo QUALIFY rank <= 5",
    "q_family_counts": _SEP + f" SELECT dataset_name, count(*) AS n_features, count(DISTINCT {_FAMILY.format('feature')}) AS n_families FROM sep WHERE separation_score > 1e-9 GROUP BY 1",
    "q_top_loadings": _Z + f", lo AS (SELECT z.dataset_name, feature, {_r('avg(value * pca_1)', 5)} AS loading FROM z JOIN c USING (patch_id) WHERE {_fin('pca_1')} GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY abs(loading) DESC, feature) AS rank FROM lo QUALIFY rank <= 3",
}
