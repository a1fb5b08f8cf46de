"""Models over the project's features, and what hangs on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import family
from ..functions.keys import newest, path_key
from ..functions.numeric import finite, shown
from ..operators import feature_variance as V
from ..operators import models as M
from ..operators import report as R
from ..session import written
from ..sources.tables import table
from .report import _FAMILY, _NEW, _PATH, _SEP, FEATURES, METRICS, _r, feature_rows, full_rows, loadings_on, separation

SEED = 42


def _reduced(spark: SparkSession, d: str) -> DataFrame:
    axes, _ = M.principal_axes(feature_rows(spark, d), FEATURES, 3)
    return written(axes.select("patch_id", *[F.get("pca", F.lit(i)).alias(f"pca_{i + 1}") for i in range(3)]), "axes")


AXES = ["pca_1", "pca_2", "pca_3"]


def q_pca(spark, d):
    """Loadings and explained share of the first three axes of all patches' standardised features, summed up as they go on."""
    _, loadings = M.principal_axes(feature_rows(spark, d), FEATURES, 3)
    total = loadings.groupBy("axis").agg(F.first("explained").alias("e"))
    upto = total.select(F.col("axis").alias("_a"), "e")
    cumulative = total.select("axis").join(upto, F.col("_a") <= F.col("axis")).groupBy("axis").agg(F.sum("e").alias("cumulative"))
    return loadings.join(cumulative, "axis").select("axis", "feature", shown("loading").alias("loading"), shown("explained").alias("explained"), shown("cumulative").alias("cumulative"))


def q_kmeans(spark, d):
    return M.kmeans(_reduced(spark, d), AXES, 6, SEED).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), *[shown(F.avg(a)).alias(a) for a in AXES])


def q_gmm(spark, d):
    return M.clusters(_reduced(spark, d), AXES, 4, SEED).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), *[shown(F.avg(a)).alias(a) for a in AXES])


def q_k_selection(spark, d):
    return M.choose_k(_reduced(spark, d), AXES, 5, SEED)


def q_ward(spark, d):
    """Hierarchy of each dataset's features by their log metrics, cut into three."""
    logs = separation(spark, d).select("dataset_name", "feature", *[F.log10(F.col(m) + 1e-6).alias(m) for m in METRICS])
    return M.feature_hierarchy(logs, "dataset_name", "feature", METRICS, 3)


def q_silhouette(spark, d):
    """How well the families part each dataset's features by their log metrics."""
    logs = separation(spark, d).select("dataset_name", "feature", family("feature").alias("family"), *[F.log10(F.col(m) + 1e-6).alias(m) for m in METRICS])
    out = M.silhouette(written(logs, "metrics"), ["dataset_name"], "feature", "family", METRICS)
    return out.select("dataset_name", "feature", shown("silhouette", 4).alias("silhouette"))


def q_feature_variance(spark, d):
    """Every dataset's features grouped by their log metrics, with the number of groups that part them best."""
    return V.variance_clusters(separation(spark, d), "dataset_name")


def _loadings(spark: SparkSession, d: str) -> DataFrame:
    """``dataset_name, feature, axis, loading``: each dataset's own axes, its ``n_pca_components`` (all axes where none is given).

    Spark sums the products of the standardised features, missing values at their mean; a task gets one row for each dataset.
    """
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    wide = R.standardize(full_rows(spark, d), ["dataset_name"], FEATURES).fillna(0.0, FEATURES)
    sums = wide.groupBy("dataset_name").agg(F.array(*[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs]).alias("products"))
    wanted = table(spark, d, "report_config", "dataset_name", "n_pca_components").groupBy("dataset_name").agg(F.max("n_pca_components").alias("n"))

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, products, n in zip(batch["dataset_name"], batch["products"], batch["n"], strict=True):
                spread = np.zeros((len(FEATURES), len(FEATURES)))
                for (i, j), v in zip(pairs, products, strict=True):
                    spread[i, j] = spread[j, i] = v
                vectors = np.linalg.eigh(spread)[1][:, ::-1]
                vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(FEATURES))])
                count = len(FEATURES) if pd.isna(n) else max(1, min(int(n), len(FEATURES)))
                yield pd.DataFrame([(name, f, a + 1, float(vectors[k, a])) for a in range(count) for k, f in enumerate(FEATURES)], columns=["dataset_name", "feature", "axis", "loading"])

    return sums.join(wanted, "dataset_name", "left").mapInPandas(axes, "dataset_name string, feature string, axis int, loading double")


def _profiles(spark: SparkSession, d: str, loadings: DataFrame) -> DataFrame:
    return V.profiles(separation(spark, d).withColumn("family", family("feature")), loadings, "dataset_name", "family")


PAIR = ["dataset_name", "family", "feature_a", "feature_b", "same_group", "metric_corr", "loading_corr", "distance", "redundant"]
GROUP = ["dataset_name", "family", "group_id", "group_size", "mean_metric_corr", "mean_loading_corr", "mean_distance", "representative", "redundant_group"]


def q_redundancy_rule(spark, d):
    """Pairs of one family that are redundant by metrics, loadings and distance, over Ward groups and the datasets' own axes."""
    grouped = written(V.with_groups(_profiles(spark, d, _loadings(spark, d)), "dataset_name", "family"), "profiles")
    return V.redundant_pairs(grouped, "dataset_name", "family")


def q_redundancy_groups(spark, d):
    grouped = written(V.with_groups(_profiles(spark, d, _loadings(spark, d)), "dataset_name", "family"), "profiles")
    return V.redundant_groups(V.redundant_pairs(grouped, "dataset_name", "family"), grouped, "dataset_name", "family")


def _given_groups(spark: SparkSession, d: str) -> DataFrame:
    """Profiles over the report's given axes, in groups that anyone can tell: at or above the family's mean separation, or below."""
    rows = _profiles(spark, d, loadings_on(spark, d, ["pca_1", "pca_2", "center_score"]))
    mean = rows.groupBy("dataset_name", "family").agg(F.avg("separation_score").alias("_m"))
    return written(rows.join(mean, ["dataset_name", "family"]).withColumn("group_id", F.when(F.col("separation_score") >= F.col("_m"), 1).otherwise(2)).drop("_m"), "profiles")


def q_redundancy_given(spark, d):
    """The rule for pairs, over given groups and axes."""
    pairs = V.redundant_pairs(_given_groups(spark, d), "dataset_name", "family", share=0.5)
    return pairs.select(*PAIR).withColumns({c: shown(c, 4) for c in ("metric_corr", "loading_corr", "distance")})


def q_redundancy_given_groups(spark, d):
    """The rule for groups, over given groups and axes."""
    grouped = _given_groups(spark, d)
    out = V.redundant_groups(V.redundant_pairs(grouped, "dataset_name", "family", share=0.5), grouped, "dataset_name", "family")
    return out.select(*GROUP).withColumns({c: shown(c, 4) for c in ("mean_metric_corr", "mean_loading_corr", "mean_distance")})


def q_shard_lookup(spark, d):
    """Each manifest patch fetched from its stored file by path and entry: the mask's true pixels, null where the file doesn't hold it."""
    given = newest(table(spark, d, "manifest", "patch_id", "patch_path", "loaded_at"), "patch_id", "loaded_at", "patch_path").select("patch_id", path_key("patch_path").alias("location"))
    files = table(spark, d, "patch_files").where("size_bytes > 0 AND octet_length(map2_mask) = 64 * size(patch_ids)")
    entry = files.select(path_key("file_path").alias("location"), F.hex("map2_mask").alias("h"), "written_at", F.posexplode(F.transform("patch_ids", lambda i: F.lower(F.trim(i)))).alias("entry", "patch_id"))
    ones = F.length(F.regexp_replace(F.substring(F.col("h"), F.col("entry") * 128 + 1, F.lit(128)), "00", "")) / 2
    held = entry.groupBy("location", "patch_id").agg(F.max(F.struct("written_at", ones.alias("n"))).alias("b")).select("location", "patch_id", F.col("b.n").cast("int").alias("true_pixels"))
    return given.join(held, ["location", "patch_id"], "left").select("patch_id", "true_pixels")


def q_spatial_context(spark, d):
    """Mask fraction and center of every stored patch's 8 x 8 mask, its newest copy, beside the recorded fraction."""
    files = table(spark, d, "patch_files").where("size_bytes > 0 AND octet_length(map2_mask) = 64 * size(patch_ids)")
    entry = files.select(F.hex("map2_mask").alias("h"), "written_at", path_key("file_path").alias("location"), F.posexplode(F.transform("patch_ids", lambda i: F.lower(F.trim(i)))).alias("entry", "patch_id")).where("patch_id IS NOT NULL")
    mine = F.substring(F.col("h"), F.col("entry") * 128 + 1, F.lit(128))
    ones = F.length(F.regexp_replace(mine, "00", "")) / 2
    one = entry.select("patch_id", (ones / 64).alias("fraction"), (F.substring(mine, 2 * (4 * 8 + 4) + 1, 2) == "01").alias("center_inside"), "written_at", "location", (-F.col("entry")).alias("place"))
    best = one.groupBy("patch_id").agg(F.max(F.struct("written_at", "location", "place", "fraction", "center_inside")).alias("b")).select("patch_id", "b.fraction", "b.center_inside")
    given = newest(table(spark, d, "patch_features"), "patch_id", "computed_at", "map2_mask_fraction").where(finite("map2_mask_fraction"))
    return best.join(given, "patch_id").select("patch_id", shown("fraction").alias("fraction"), "center_inside", shown("map2_mask_fraction").alias("recorded"))


def q_fingerprint(spark, d):
    """An order-free fingerprint of each dataset's manifest rows: their number and the sum of a hash of each, missing values filled in."""
    filled = [F.coalesce("patch_id", F.lit("")), F.coalesce("shard_path", F.lit("")), F.coalesce(F.col("shard_index").cast("string"), F.lit("-1")), F.coalesce("patch_path", F.lit(""))]
    rows = table(spark, d, "manifest").select("sample_id", F.conv(F.substring(F.md5(F.concat_ws("|", *filled)), 1, 12), 16, 10).cast("decimal(38,0)").alias("h"))
    return rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("h").cast("string").alias("sum"))


def q_event_sample(spark, d):
    """At most five events of each user and type, in the order of an arithmetic hash."""
    rows = table(spark, d, "events", "event_id", "user_id", "event_type").withColumn("key", (F.col("event_id") * 73856093 + 42) % 1000003)
    return R.ranked(rows, ["user_id", "event_type"], [F.col("key"), F.col("event_id")], 5).select("event_id", "user_id", "event_type", "rank")


def q_event_bins(spark, d):
    rows = table(spark, d, "events", "event_type", "value", "ts").select("event_type", "value", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double").alias("second"))
    return R.bins_2d(rows, ["event_type"], "value", "second", 10).groupBy("event_type", "bx", "by").count()


def q_pixel_size(spark, d):
    """Pixel sizes out of image descriptions in XML; null where a description can't be read."""
    xml = F.concat(F.lit('<Image><Pixels PhysicalSizeX="'), F.coalesce(F.col("pixel_size_xy_um").cast("string"), F.lit("?")), F.lit('" PhysicalSizeZ="'), F.coalesce(F.col("pixel_size_z_um").cast("string"), F.lit("?")), F.lit('"/></Image>'))
    rows = table(spark, d, "manifest", "patch_id", "shard_index", "pixel_size_xy_um", "pixel_size_z_um").withColumn("xml", xml)
    read = lambda name: F.expr(f"try_cast(xpath_string(xml, '/Image/Pixels/@PhysicalSize{name}') AS double)")
    return rows.select("patch_id", "shard_index", read("X").alias("x_um"), read("Z").alias("z_um")).distinct()


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_FAM = "CASE WHEN contains(feature, 'flag_ha_') OR contains(feature, '_mean_ratio') THEN 'Cross' WHEN feature IN ('map2_mask_fraction', 'distance_to_mask_boundary_px', 'center_of_patch_map2_intensity', 'map2_local_thickness_proxy') THEN 'Spatial' ELSE 'Other' END"
_AXES = ", ".join(f"avg(CASE WHEN isfinite({a}) THEN value * {a} END) AS l{i}" for i, a in enumerate(("pca_1", "pca_2", "center_score")))
_GIVEN = _SEP + f""", zs AS (SELECT dataset_name, feature, avg(value) m, stddev_pop(value) s FROM l WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL),
z AS (SELECT l.dataset_name, l.patch_id, l.feature, (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS value FROM l JOIN zs USING (dataset_name, feature) WHERE value IS NOT NULL AND isfinite(value)),
ld AS (SELECT z.dataset_name, feature, {_AXES} FROM z JOIN c USING (patch_id) GROUP BY ALL),
pr AS (SELECT sep.*, l0, l1, l2, {_FAMILY.format('feature')} AS family FROM sep JOIN ld USING (dataset_name, feature)), gr AS (SELECT *, CASE WHEN separation_score >= avg(separation_score) OVER (PARTITION BY dataset_name, family) THEN 1 ELSE 2 END AS group_id FROM pr),
v AS (SELECT dataset_name, family, feature, unnest(range(6)) AS pos, unnest([{', '.join(f'log10({m} + 1e-6)' for m in METRICS)}, abs(l0), abs(l1), abs(l2)]) AS v, unnest([{', '.join(METRICS)}, abs(l0), abs(l1), abs(l2)]) AS r FROM gr),
vs AS (SELECT *, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 1e-12 THEN stddev_pop(v) OVER w ELSE 1 END AS x FROM v WINDOW w AS (PARTITION BY dataset_name, family, pos)),
pa AS (SELECT a.dataset_name, a.family, a.feature AS fa, b.feature AS fb, sqrt(sum((a.x - b.x) ** 2)) AS distance,
  CASE WHEN var_pop(a.r) FILTER (WHERE a.pos < 3) > 0 AND var_pop(b.r) FILTER (WHERE a.pos < 3) > 0 THEN corr(a.r, b.r) FILTER (WHERE a.pos < 3) END AS mc, CASE WHEN var_pop(a.r) FILTER (WHERE a.pos > 2) > 0 AND var_pop(b.r) FILTER (WHERE a.pos > 2) > 0 THEN corr(a.r, b.r) FILTER (WHERE a.pos > 2) END AS lc
  FROM vs a JOIN vs b ON a.dataset_name = b.dataset_name AND a.family = b.family AND a.pos = b.pos AND a.feature < b.feature GROUP BY ALL),
pq AS (SELECT pa.*, x.group_id, x.group_id = y.group_id AS sg, quantile_cont(distance, 0.5) OVER (PARTITION BY pa.dataset_name, pa.family) AS cut FROM pa JOIN gr x ON x.dataset_name = pa.dataset_name AND x.feature = fa JOIN gr y ON y.dataset_name = pa.dataset_name AND y.feature = fb),
pf AS (SELECT *, coalesce(sg AND mc >= 0.95 AND lc >= 0.95 AND distance <= cut, false) AS red FROM pq)"""

def _axis(n: int, before: str) -> str:
    """SQL of the ``n``-th axis of the matrix ``before.a``: squared often enough, a matrix is the product of its first axis with itself. What is left without it is ``d{n}.a``."""
    return f"""
p{n} AS (SELECT a, 0 AS i FROM {before} UNION ALL SELECT [[list_dot_product(r, c) / list_sum([list_dot_product(s, s) for s in a]) for c in a] for r in a], i + 1 FROM p{n} WHERE i < 60),
m{n} AS (SELECT a AS m, list_position([a[j][j] for j in range(1, {len(FEATURES) + 1})], list_max([a[j][j] for j in range(1, {len(FEATURES) + 1})])) AS j FROM p{n} WHERE i = 60),
v{n} AS (SELECT [x / sqrt(m[j][j]) for x in m[j]] AS v FROM m{n}),
e{n} AS (SELECT v, list_dot_product(v, [list_dot_product(r, v) for r in a]) AS e FROM v{n}, {before}),
d{n} AS (SELECT [[a[r][c] - e * v[r] * v[c] for c in range(1, {len(FEATURES) + 1})] for r in range(1, {len(FEATURES) + 1})] AS a FROM e{n}, {before})"""


_GOOD = " AND ".join(f"isfinite({f}) AND {f} IS NOT NULL" for f in FEATURES)
_PCA = f"""WITH RECURSIVE f AS (SELECT {', '.join(FEATURES)} FROM ({_NEW.format(t='patch_features', by='computed_at')}) WHERE {_GOOD}),
d0 AS (SELECT [{', '.join('[' + ', '.join(f'corr({a}, {b})' if a != b else '1.0' for b in FEATURES) + ']' for a in FEATURES)}] AS a FROM f),{','.join(_axis(n, f'd{n - 1}') for n in (1, 2, 3))},
x AS (SELECT 0 AS axis, * FROM e1 UNION ALL SELECT 1, * FROM e2 UNION ALL SELECT 2, * FROM e3)
SELECT axis, unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature, unnest([{_r('y')} for y in v]) AS loading, {_r(f'e / {len(FEATURES)}')} AS explained, {_r(f'sum(e) OVER (ORDER BY axis) / {len(FEATURES)}')} AS cumulative FROM x"""

ORACLES = {
    "q_pca": _PCA,
    "q_redundancy_given": _GIVEN + f" SELECT dataset_name, family, fa AS feature_a, fb AS feature_b, sg AS same_group, {_r('mc', 4)} AS metric_corr, {_r('lc', 4)} AS loading_corr, {_r('distance', 4)} AS distance, red AS redundant FROM pf",
    "q_redundancy_given_groups": _GIVEN + f""", st AS (SELECT dataset_name, family, group_id, avg(mc) AS m, avg(lc) AS l, avg(distance) AS d, bool_and(red) AS a FROM pf WHERE sg GROUP BY ALL),
rp AS (SELECT dataset_name, family, group_id, feature, count(*) OVER (PARTITION BY dataset_name, family, group_id) AS n FROM gr QUALIFY row_number() OVER (PARTITION BY dataset_name, family, group_id ORDER BY separation_score DESC, l0 DESC, l1 DESC, l2 DESC, feature) = 1)
SELECT st.dataset_name, st.family, st.group_id, n AS group_size, {_r('m', 4)} AS mean_metric_corr, {_r('l', 4)} AS mean_loading_corr, {_r('d', 4)} AS mean_distance, feature AS representative, coalesce(a AND m >= 0.95 AND l >= 0.95, false) AS redundant_group FROM st JOIN rp USING (dataset_name, family, group_id)""",
    "q_silhouette": _SEP + f""", lg AS (SELECT dataset_name, feature, {_FAM} AS f, {', '.join(f'log10({m} + 1e-6) AS {m}' for m in METRICS)} FROM sep),
far AS (SELECT a.dataset_name, a.feature, a.f, b.f AS g, avg(sqrt({' + '.join(f'(a.{m} - b.{m}) ** 2' for m in METRICS)})) AS d FROM lg a JOIN lg b ON a.dataset_name = b.dataset_name AND a.feature != b.feature GROUP BY ALL),
ab AS (SELECT dataset_name, feature, min(d) FILTER (WHERE f = g) AS a, min(d) FILTER (WHERE f != g) AS b FROM far GROUP BY ALL)
SELECT dataset_name, feature, {_r('CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END', 4)} AS silhouette FROM ab""",
    "q_spatial_context": f"""WITH e AS (SELECT hex(map2_mask) AS h, written_at, {_PATH.format('file_path')} AS loc, lower(trim(unnest(patch_ids))) AS patch_id, unnest(range(len(patch_ids))) AS i FROM patch_files WHERE size_bytes > 0 AND octet_length(map2_mask) = 64 * len(patch_ids)),
o AS (SELECT patch_id, written_at, loc, i, len(list_filter(range(64), lambda k: substring(h, i * 128 + k * 2 + 1, 2) != '00')) / 64 AS fraction, substring(h, i * 128 + 73, 2) = '01' AS center_inside FROM e WHERE patch_id IS NOT NULL),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY written_at DESC NULLS LAST, loc DESC NULLS LAST, i, fraction DESC, center_inside DESC) = 1),
g AS (SELECT patch_id, map2_mask_fraction AS m FROM patch_features QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY computed_at DESC NULLS LAST) = 1) SELECT patch_id, {_r('fraction')} AS fraction, center_inside, {_r('m')} AS recorded FROM b JOIN g USING (patch_id) WHERE m IS NOT NULL AND isfinite(m)""",
    "q_shard_lookup": f"""WITH g AS (SELECT patch_id, {_PATH.format('patch_path')} AS loc FROM manifest WHERE patch_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY loaded_at DESC NULLS LAST, patch_path DESC) = 1),
e AS (SELECT {_PATH.format('file_path')} AS loc, hex(map2_mask) AS h, written_at, unnest(patch_ids) AS id, unnest(range(len(patch_ids))) AS i FROM patch_files WHERE size_bytes > 0 AND octet_length(map2_mask) = 64 * len(patch_ids)),
n AS (SELECT loc, lower(trim(id)) AS patch_id, CAST(len(list_filter(range(64), lambda k: substring(h, i * 128 + k * 2 + 1, 2) != '00')) AS INT) AS n, written_at FROM e),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY loc, patch_id ORDER BY written_at DESC NULLS LAST, n DESC) = 1)
SELECT g.patch_id, b.n AS true_pixels FROM g LEFT JOIN b ON g.loc = b.loc AND g.patch_id = b.patch_id""",
    "q_fingerprint": "SELECT sample_id, count(*) AS n, CAST(sum(CAST('0x' || substring(md5(concat_ws('|', coalesce(patch_id, ''), coalesce(shard_path, ''), coalesce(CAST(shard_index AS VARCHAR), '-1'), coalesce(patch_path, ''))), 1, 12) AS HUGEINT)) AS VARCHAR) AS sum FROM manifest GROUP BY 1",
    "q_event_sample": "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_id * 73856093 + 42) % 1000003, event_id) AS rank FROM events QUALIFY rank <= 5",
    "q_event_bins": """WITH e AS (SELECT event_type, value, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS s FROM events WHERE value IS NOT NULL AND isfinite(value)), b AS (SELECT *, min(value) OVER w a, max(value) OVER w b, min(s) OVER w c, max(s) OVER w d FROM e WINDOW w AS (PARTITION BY event_type))
SELECT event_type, CAST(CASE WHEN b <= a THEN 0 ELSE least(floor((value - a) / (b - a) * 10), 9) END AS INT) AS bx, CAST(CASE WHEN d <= c THEN 0 ELSE least(floor((s - c) / (d - c) * 10), 9) END AS INT) AS by, count(*) AS count FROM b GROUP BY ALL""",
    "q_pixel_size": "SELECT DISTINCT patch_id, shard_index, pixel_size_xy_um AS x_um, pixel_size_z_um AS z_um FROM manifest",
}
