"""Sampling, cropping and mask building over volumes derived from ``lineitem``, and over the project's candidate centers."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import label_key
from ..functions.numeric import shown
from ..operators import masks, sampling
from ..sources.tables import table
from ..sources.volumes import PLANE, SLICES, dense_lines, projections, voxels

PATCH, DEPTH, STRIDE, SEED = 8, 3, 4, 42


def _mip(spark: SparkSession, d: str) -> DataFrame:
    return projections(voxels(spark, d))


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return masks.threshold(_mip(spark, d).where("channel = 'A'"), ["sample_id"], 0.82)


def _centers(spark: SparkSession, d: str) -> DataFrame:
    planes = voxels(spark, d).select("sample_id").distinct()
    side, patch = F.lit(PLANE), F.lit(PATCH)
    return sampling.center_grid(planes, ["sample_id"], side, side, patch, patch, F.lit(STRIDE))


def q_mip(spark, d):
    return _mip(spark, d)


def q_mask_load(spark, d):
    """A mask of any depth is the pixels of which any slice is above 0."""
    top = voxels(spark, d).where("channel = 'R'").groupBy("sample_id", "y", "x").agg((F.max("v") > 0).alias("inside"))
    return top.where("inside").select("sample_id", "y", "x")


def q_percentile_normalize(spark, d):
    return masks.percentile_normalize(_mip(spark, d), ["sample_id", "channel"]).select("sample_id", "channel", "y", "x", shown("value").alias("value"))


def q_otsu(spark, d):
    return masks.otsu(_mip(spark, d), ["sample_id", "channel"]).select("sample_id", "channel", shown("threshold").alias("threshold"))


def q_hysteresis(spark, d):
    return masks.hysteresis(_mip(spark, d), ["sample_id", "channel"], PLANE)


def q_dilate(spark, d):
    top = masks.threshold(_mip(spark, d).where("channel = 'A'"), ["sample_id"], 0.99)
    return masks.dilate(top, ["sample_id"], 2, PLANE)


def q_connected_support(spark, d):
    return masks.connected_support(voxels(spark, d).where("channel = 'A'"), "sample_id", SLICES, PLANE).groupBy("sample_id", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


def q_confidence_blend(spark, d):
    conf = masks.percentile_normalize(_mip(spark, d).where("channel = 'N'"), ["sample_id"]).select("sample_id", "y", "x", "value")
    source = voxels(spark, d).where("channel = 'A'")
    return source.join(conf, ["sample_id", "y", "x"]).select("sample_id", "z", "y", "x", shown(masks.blended(F.col("v"), F.col("value"), 0.2)).alias("v"))


def q_mask_confidence(spark, d):
    """Confidence of each pixel of the masks' channel, from its smoothed projection."""
    return masks.confidence(_mip(spark, d).where("channel = 'A'"), ["sample_id"], PLANE).withColumn("value", shown("value"))


def q_smoothed_mask(spark, d):
    """The hysteresis mask of the smoothed projection."""
    return masks.hysteresis(masks.smoothed(_mip(spark, d).where("channel = 'A'"), ["sample_id"], PLANE, 1.0), ["sample_id"], PLANE)


def q_edt(spark, d):
    top = masks.threshold(_mip(spark, d).where("channel = 'A'"), ["sample_id"], 0.99)
    return sampling.signed_distance(top, "sample_id", PLANE).select("sample_id", "y", "x", shown("distance").alias("distance"))


def q_region_volume(spark, d):
    """Pixels of each region of every derived volume."""
    top = masks.threshold(_mip(spark, d).where("channel = 'A'"), ["sample_id"], 0.99)
    groups = sampling.region_groups(F.col("distance"), F.lit(2), F.lit(4), F.lit(5))
    return sampling.signed_distance(top, "sample_id", PLANE).select("sample_id", F.explode_outer(groups).alias("region")).groupBy("sample_id", "region").count()


def q_center_grid(spark, d):
    """Valid grid points of every dataset's planes of 512 x 512."""
    config = table(spark, d, "dataset_config", "dataset_name", "height_px", "width_px", "stride_px")
    return sampling.center_grid(config, ["dataset_name"], F.lit(512), F.lit(512), F.col("height_px"), F.col("width_px"), F.col("stride_px"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "samples", "sample_id", "dataset_name").where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min("dataset_name").alias("dataset_name"))
    config = table(spark, d, "dataset_config", "dataset_name", "max_patches_per_group", "boundary_width_px", "near_outside_distance_px", "far_background_min_distance_px")
    rows = table(spark, d, "patch_centers").select("sample_id", "y", "x", label_key("patch_group").alias("patch_group"), "distance_to_mask_px").where("patch_group IS NOT NULL")
    rows = rows.groupBy("sample_id", "y", "x", "patch_group").agg(F.min("distance_to_mask_px").alias("distance"))
    return rows.join(samples.join(config, "dataset_name"), "sample_id")


def q_region_groups(spark, d):
    """How the candidate centers' recorded groups agree with the groups of their signed distance."""
    groups = sampling.region_groups(F.col("distance"), F.col("boundary_width_px"), F.col("near_outside_distance_px"), F.col("far_background_min_distance_px"))
    rows = _candidates(spark, d).where("distance IS NOT NULL").select("dataset_name", "patch_group", F.explode_outer(groups).alias("computed"))
    return rows.groupBy("dataset_name", "patch_group", "computed").count()


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    most = table(spark, d, "dataset_config", "max_patches_per_group").agg(F.max("max_patches_per_group")).first()[0] or 0
    return sampling.stratified_sample(_candidates(spark, d), ["sample_id", "patch_group"], "max_patches_per_group", most, SEED)


def q_stratified_sample(spark, d):
    return _chosen(spark, d).select("sample_id", "patch_group", "y", "x", "rank")


def q_patch_ids(spark, d):
    return sampling.identified(_chosen(spark, d), "sample_id", "patch_group", "patch_group").select("patch_id", "sample_id", "y", "x")


def q_shard_index(spark, d):
    """Place of each chosen patch in its sample's only shard, and in the shard of its group."""
    one = sampling.identified(_chosen(spark, d), "sample_id", "patch_group", None).withColumnRenamed("shard_index", "index_in_sample")
    return one.select("patch_id", "index_in_sample", (F.col("rank") - 1).alias("index_in_group"))


def q_group_counts(spark, d):
    return _chosen(spark, d).groupBy("sample_id", "patch_group").count()


def q_mask_overlap(spark, d):
    lines = sampling.lines_of(_mask(spark, d), ["sample_id", "y"], F.col("inside").cast("int")).select("sample_id", F.lit("mask").alias("channel"), F.lit(0).alias("z"), "y", "v")
    return sampling.mask_overlap(_centers(spark, d), lines, "sample_id", PATCH, PATCH).select("sample_id", "cy", "cx", shown("overlap").alias("overlap"))


def _z(spark: SparkSession, d: str) -> DataFrame:
    return sampling.z_centers(_centers(spark, d), voxels(spark, d).where("channel = 'A'"), "sample_id", SLICES)


def q_z_center(spark, d):
    return _z(spark, d)


def q_crop_patches(spark, d):
    """The voxels above 0 of the crop around each center."""
    centers = _z(spark, d).select("*", F.col("y").alias("cy"), F.col("x").alias("cx"), F.lit(SLICES).alias("slices"))
    crops = sampling.crop_lines(centers, dense_lines(voxels(spark, d)), "sample_id", ["cy", "cx"], PATCH, PATCH, DEPTH)
    at = crops.select("sample_id", "cy", "cx", "channel", F.posexplode("v").alias("at", "v")).where("v > 0")
    place = [F.expr(f"CAST(at div {PATCH * PATCH} - {DEPTH // 2} AS INT)").alias("dz"), F.expr(f"CAST(at div {PATCH} % {PATCH} AS INT)").alias("dy"), F.expr(f"CAST(at % {PATCH} AS INT)").alias("dx")]
    return at.select("sample_id", "cy", "cx", "channel", *place, "v")


def q_channel_summary(spark, d):
    out = sampling.channel_summary(q_crop_patches(spark, d), ["sample_id", "cy", "cx", "channel"], PATCH, PATCH, DEPTH)
    return out.withColumns({c: shown(c) for c in ("mean", "max", "sum", "std")})


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_R = "round({0}, 6) + 0.0"
_KEY = r"regexp_replace(lower(trim({0})), '[\s_-]+', '_', 'g')"
_V = """WITH RECURSIVE vox AS (SELECT CAST((l_suppkey - 1) // 50 AS INT) AS sample_id, l_returnflag AS channel, CAST(l_linenumber - 1 AS INT) AS z, CAST(l_partkey % 64 AS INT) AS y, CAST(l_orderkey % 64 AS INT) AS x, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
top AS (SELECT sample_id, channel, y, x, max(v) AS v FROM vox GROUP BY ALL),
grid AS (SELECT s.sample_id, c.channel, CAST(gy.r AS INT) AS y, CAST(gx.r AS INT) AS x FROM (SELECT DISTINCT sample_id FROM vox) s, (VALUES ('A'), ('N'), ('R')) c(channel), range(64) gy(r), range(64) gx(r)),
mip AS (SELECT g.*, coalesce(t.v, 0.0) AS v FROM grid g LEFT JOIN top t USING (sample_id, channel, y, x)),
cen AS (SELECT DISTINCT sample_id, y, x FROM grid WHERE y % 4 = 0 AND x % 4 = 0 AND y BETWEEN 4 AND 59 AND x BETWEEN 4 AND 59)"""
_T = ", thr AS (SELECT sample_id, quantile_cont(v, {q}) AS t FROM mip WHERE channel = 'A' GROUP BY 1), msk AS (SELECT m.sample_id, y, x, v >= t AS inside FROM mip m JOIN thr USING (sample_id) WHERE channel = 'A')"
_N = ", lim AS (SELECT sample_id, channel, quantile_cont(v, 0.01) lo, quantile_cont(v, 0.99) hi FROM mip GROUP BY ALL), nrm AS (SELECT m.*, CASE WHEN hi > lo THEN least(greatest((v - lo) / (hi - lo), 0), 1) ELSE 1 END AS value FROM mip m JOIN lim USING (sample_id, channel))"
_EDT = _T.format(q=0.99) + ", d2 AS (SELECT a.sample_id, a.y, a.x, a.inside, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS q FROM msk a JOIN msk b ON a.sample_id = b.sample_id AND a.inside != b.inside GROUP BY ALL), dst AS (SELECT *, sqrt(q) * CASE WHEN inside THEN 1 ELSE -1 END AS distance FROM d2)"
_CAND = f"""WITH c AS (SELECT sample_id, y, x, {_KEY.format('patch_group')} AS patch_group, min(distance_to_mask_px) AS distance FROM patch_centers WHERE patch_group IS NOT NULL GROUP BY ALL),
s AS (SELECT sample_id, min(dataset_name) AS dataset_name FROM samples GROUP BY 1), cand AS (SELECT c.*, k.* EXCLUDE (dataset_name), s.dataset_name FROM c JOIN s USING (sample_id) JOIN dataset_config k USING (dataset_name)),
cho AS (SELECT sample_id, patch_group, y, x, max_patches_per_group AS cap, row_number() OVER (PARTITION BY sample_id, patch_group ORDER BY ((CAST(y AS BIGINT) * 73856093 + CAST(x AS BIGINT) * 19349663) % 1000003 * 85 + 42) % 1000003, y, x) AS rank FROM cand QUALIFY rank <= cap),
ids AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY patch_group, rank) - 1 AS i FROM cho)"""
_ZC = ", zc AS (SELECT c.sample_id, c.y, c.x, coalesce(b.z, 3) AS z_center FROM cen c LEFT JOIN (SELECT sample_id, y, x, arg_min(z, (-v, z)) AS z FROM vox WHERE channel = 'A' GROUP BY ALL) b USING (sample_id, y, x))"
_CROP = _ZC + ", off AS (SELECT CAST(a.r - 1 AS INT) dz, CAST(b.r AS INT) dy, CAST(c.r AS INT) dx FROM range(3) a(r), range(8) b(r), range(8) c(r)), crp AS (SELECT q.sample_id, q.y AS cy, q.x AS cx, v.channel, dz, dy, dx, v.v FROM zc q CROSS JOIN off JOIN vox v ON v.sample_id = q.sample_id AND v.y = q.y + dy - 4 AND v.x = q.x + dx - 4 AND v.z = least(greatest(q.z_center + dz, 0), 6))"


def _smoothed(sigma: float) -> str:
    """The projection of channel A after a Gaussian filter whose borders mirror the edge pixel."""
    r = int(4 * sigma + 0.5)
    w = [exp(-0.5 * (t / sigma) ** 2) for t in range(-r, r + 1)]
    taps = ", ".join(f"({t}, {v / sum(w)!r})" for t, v in zip(range(-r, r + 1), w, strict=True))
    back = "CASE WHEN {0} % 128 < 64 THEN {0} % 128 ELSE 127 - {0} % 128 END"
    return f""", tap AS (SELECT * FROM (VALUES {taps}) t(t, w)), pla AS (SELECT sample_id, y, x, v FROM mip WHERE channel = 'A'),
alo AS (SELECT p.sample_id, p.y, p.x, sum(w * q.v) AS v FROM pla p, tap, pla q WHERE q.sample_id = p.sample_id AND q.y = p.y AND q.x = {back.format('(p.x + t + 128)')} GROUP BY ALL),
smo AS (SELECT p.sample_id, p.y, p.x, sum(w * q.v) AS v FROM alo p, tap, alo q WHERE q.sample_id = p.sample_id AND q.x = p.x AND q.y = {back.format('(p.y + t + 128)')} GROUP BY ALL)"""


ORACLES = {
    "q_mask_confidence": _V + _smoothed(2.5) + f", spa AS (SELECT sample_id, min(v) AS a, max(v) AS b FROM smo GROUP BY 1) SELECT sample_id, y, x, {_R.format('0.2 + 0.8 * CASE WHEN b - a > 1e-12 THEN (v - a) / (b - a) ELSE 0 END')} AS value FROM smo JOIN spa USING (sample_id)",
    "q_smoothed_mask": _V + _smoothed(1.0) + """, lim AS (SELECT sample_id, quantile_cont(v, 0.82) lo, quantile_cont(v, 0.995) hi FROM smo GROUP BY ALL), ok AS (SELECT sample_id, y, x, v >= hi AS seed FROM smo JOIN lim USING (sample_id) WHERE v >= lo),
grown AS (SELECT sample_id, y, x FROM ok WHERE seed UNION SELECT o.sample_id, o.y, o.x FROM grown g JOIN ok o ON o.sample_id = g.sample_id AND abs(o.y - g.y) <= 1 AND abs(o.x - g.x) <= 1) SELECT * FROM grown""",
    "q_mip": _V + " SELECT * FROM mip",
    "q_mask_load": _V + " SELECT DISTINCT sample_id, y, x FROM vox WHERE channel = 'R' AND v > 0",
    "q_percentile_normalize": _V + _N + f" SELECT sample_id, channel, y, x, {_R.format('value')} AS value FROM nrm",
    "q_otsu": _V + f""", sp AS (SELECT sample_id, channel, min(v) a, max(v) b FROM mip GROUP BY ALL HAVING max(v) > min(v)), h AS (SELECT sample_id, channel, a, b, CAST(least(floor((v - a) / (b - a) * 256), 255) AS INT) AS bin, count(*) n FROM mip JOIN sp USING (sample_id, channel) GROUP BY ALL),
k AS (SELECT *, a + (bin + 0.5) * (b - a) / 256 AS c FROM h), u AS (SELECT *, sum(n) OVER o w, sum(n * c) OVER o s, sum(n) OVER (PARTITION BY sample_id, channel) ww, sum(n * c) OVER (PARTITION BY sample_id, channel) ss FROM k WINDOW o AS (PARTITION BY sample_id, channel ORDER BY bin)),
e AS (SELECT *, round(w * (ww - w) * (s / w - (ss - s) / (ww - w)) ** 2, 3) AS score FROM u WHERE w < ww)
SELECT sample_id, channel, {_R.format('c')} AS threshold FROM e QUALIFY row_number() OVER (PARTITION BY sample_id, channel ORDER BY score DESC, bin) = 1""",
    "q_hysteresis": _V + """, lim AS (SELECT sample_id, channel, quantile_cont(v, 0.82) lo, quantile_cont(v, 0.995) hi FROM mip GROUP BY ALL), ok AS (SELECT m.sample_id, m.channel, y, x, v >= hi AS seed FROM mip m JOIN lim USING (sample_id, channel) WHERE v >= lo),
grown AS (SELECT sample_id, channel, y, x FROM ok WHERE seed UNION SELECT o.sample_id, o.channel, o.y, o.x FROM grown g JOIN ok o ON o.sample_id = g.sample_id AND o.channel = g.channel AND abs(o.y - g.y) <= 1 AND abs(o.x - g.x) <= 1) SELECT * FROM grown""",
    "q_dilate": _V + _T.format(q=0.99) + ", rr AS (SELECT CAST(r - 2 AS INT) r FROM range(5) t(r)) SELECT DISTINCT sample_id, y + a.r AS y, x + b.r AS x FROM msk, rr a, rr b WHERE inside AND y + a.r BETWEEN 0 AND 63 AND x + b.r BETWEEN 0 AND 63",
    "q_connected_support": _V + """, lim AS (SELECT sample_id, quantile_cont(v, 0.82) lo, quantile_cont(v, 0.985) hi FROM vox WHERE channel = 'A' GROUP BY ALL), ok AS (SELECT m.sample_id, z, y, x, v >= hi AS seed FROM vox m JOIN lim USING (sample_id) WHERE channel = 'A' AND v >= lo),
grown AS (SELECT sample_id, z, y, x FROM ok WHERE seed UNION SELECT o.sample_id, o.z, o.y, o.x FROM grown g JOIN ok o ON o.sample_id = g.sample_id AND abs(o.y - g.y) + abs(o.x - g.x) + abs(o.z - g.z) = 1) SELECT sample_id, z, count(*) AS n, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x FROM grown GROUP BY ALL""",
    "q_confidence_blend": _V + _N + f" SELECT s.sample_id, s.z, s.y, s.x, {_R.format('s.v * (0.2 + 0.8 * (0.2 + 0.8 * c.value))')} AS v FROM vox s JOIN nrm c ON c.sample_id = s.sample_id AND c.y = s.y AND c.x = s.x AND c.channel = 'N' WHERE s.channel = 'A'",
    "q_edt": _V + _EDT + f" SELECT sample_id, y, x, {_R.format('distance')} AS distance FROM dst",
    "q_region_volume": _V + _EDT + """, g AS (SELECT sample_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS region FROM (SELECT sample_id, list_filter([CASE WHEN abs(distance) <= 2 THEN 'boundary' END, CASE WHEN distance > 2 THEN 'in_mask' END,
CASE WHEN distance < -2 AND distance >= -4 THEN 'near_mask_outside' END, CASE WHEN distance <= -5 THEN 'far_background' END], lambda x: x IS NOT NULL) AS l FROM dst)) SELECT sample_id, region, count(*) AS count FROM g GROUP BY ALL""",
    "q_center_grid": "SELECT dataset_name, CAST(gy.r AS INT) AS y, CAST(gx.r AS INT) AS x FROM dataset_config, range(512) gy(r), range(512) gx(r) WHERE gy.r % stride_px = 0 AND gx.r % stride_px = 0 AND gy.r >= height_px // 2 AND gy.r < 512 - height_px // 2 AND gx.r >= width_px // 2 AND gx.r < 512 - width_px // 2",
    "q_region_groups": _CAND + """, g AS (SELECT dataset_name, patch_group, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS computed FROM (SELECT dataset_name, patch_group, list_filter([CASE WHEN abs(distance) <= boundary_width_px THEN 'boundary' END, CASE WHEN distance > 0 AND distance > boundary_width_px THEN 'in_mask' END,
CASE WHEN distance <= 0 AND -distance > boundary_width_px AND -distance <= near_outside_distance_px THEN 'near_mask_outside' END, CASE WHEN distance <= 0 AND -distance >= far_background_min_distance_px THEN 'far_background' END], lambda x: x IS NOT NULL) AS l FROM cand WHERE distance IS NOT NULL)) SELECT dataset_name, patch_group, computed, count(*) AS count FROM g GROUP BY ALL""",
    "q_stratified_sample": _CAND + " SELECT sample_id, patch_group, y, x, rank FROM cho",
    "q_patch_ids": _CAND + " SELECT sample_id || '_' || patch_group || '_' || lpad(CAST(i AS VARCHAR), 5, '0') AS patch_id, sample_id, y, x FROM ids",
    "q_shard_index": _CAND + " SELECT sample_id || '_' || patch_group || '_' || lpad(CAST(i AS VARCHAR), 5, '0') AS patch_id, i AS index_in_sample, rank - 1 AS index_in_group FROM ids",
    "q_group_counts": _CAND + " SELECT sample_id, patch_group, count(*) AS count FROM cho GROUP BY ALL",
    "q_mask_overlap": _V + _T.format(q=0.82) + f" SELECT c.sample_id, c.y AS cy, c.x AS cx, {_R.format('count(*) FILTER (WHERE m.inside) / 64.0')} AS overlap FROM cen c JOIN msk m ON m.sample_id = c.sample_id AND m.y >= c.y - 4 AND m.y < c.y + 4 AND m.x >= c.x - 4 AND m.x < c.x + 4 GROUP BY ALL",
    "q_z_center": _V + _ZC + " SELECT * FROM zc",
    "q_crop_patches": _V + _CROP + " SELECT * FROM crp",
    "q_channel_summary": _V + _CROP + f""", sl AS (SELECT sample_id, cy, cx, channel, dz, sum(v) s, sum(v * v) q, max(v) m FROM crp GROUP BY ALL)
SELECT sample_id, cy, cx, channel, {_R.format('sum(s) / 192')} AS mean, {_R.format('max(m)')} AS max, {_R.format('sum(s)')} AS sum, {_R.format('sqrt(greatest(sum(q) / 192 - (sum(s) / 192) ** 2, 0))')} AS std, CAST(arg_min(dz, (-s, dz)) + 1 AS INT) AS z_peak_index, count(*) FILTER (WHERE s > 0) AS z_occupancy FROM sl GROUP BY ALL""",
}
