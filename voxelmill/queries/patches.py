"""Features of the patches that ``embeddings`` hold: 8 x 8 images, or 4 x 4 x 4 crops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.numeric import safe_ratio, shown
from ..operators import patch_features as P
from ..operators.sampling import map_batches
from ..sources.volumes import image_patches

SIDE, SLICES, PLANE = 8, 4, 16


def _shown(rows: DataFrame, columns: dict) -> DataFrame:
    return rows.select("vec_id", *[shown(c).alias(n) for n, c in columns.items()])


def _crops(spark: SparkSession, d: str) -> DataFrame:
    """``m`` and ``x``: each crop's mean and maximum over its slices."""
    rows = image_patches(spark, d)
    return rows.select("vec_id", "label", "a", P.z_mean(F.col("a"), SLICES, PLANE).alias("m"), P.z_max(F.col("a"), SLICES, PLANE).alias("x"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each patch (channel a) with the patch of the next id (channel b), and both channels' bright pixels."""
    rows = image_patches(spark, d).select("vec_id", "a")
    both = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    both = both.select("*", P.bright_threshold(F.col("a")).alias("ta"), P.bright_threshold(F.col("b")).alias("tb"))
    return both.select("vec_id", "a", "b", P.bright(F.col("a"), F.col("ta")).alias("ba"), P.bright(F.col("b"), F.col("tb")).alias("bb"))


def q_proj_stats(spark, d):
    m, x = F.col("m"), F.col("x")
    return _shown(_crops(spark, d), {
        "proj_mean": A.mean(m), "proj_max": F.array_max(x), "proj_std": A.std_pop(m), "dynamic_range": F.array_max(m) - F.array_min(m),
        "neighborhood_variance": A.var_pop(m), "local_contrast": A.std_pop(m) / (A.mean(m) + 1e-6),
    })


def q_inside_outside(spark, d):
    """Means and bright shares in and out of a region; the region of a crop are the pixels whose maximum is at least 1.1."""
    rows = _crops(spark, d).withColumn("r", F.transform("x", lambda v: v >= 1.1)).withColumn("t", P.bright_threshold(F.col("x")))
    return _shown(rows, P.inside_outside(F.col("m"), P.bright(F.col("x"), F.col("t")), F.col("r")))


def q_thickness(spark, d):
    """Local thickness at the center of the region of values of at least 0.9."""
    return _shown(image_patches(spark, d).withColumn("r", F.transform("a", lambda v: v >= 0.9)), {"map2_local_thickness_proxy": P.thickness(F.col("r"), SIDE, SIDE)})


def q_bright_mask(spark, d):
    x = F.col("x")
    rows = _crops(spark, d).withColumn("k", P.bright(x, P.bright_threshold(x))).withColumn("p99", A.percentile(x, 0.99))
    area = A.count_if(F.col("k"), lambda v: v)
    return _shown(rows, {"bright_pixel_fraction": area / PLANE, "estimated_punctum_area": area, "top_percentile_intensity": A.let(F.col("p99"), lambda t: A.mean(F.filter(x, lambda v: v >= t)))})


def q_entropy(spark, d):
    return _shown(image_patches(spark, d), {"intensity_entropy": P.entropy(F.col("a"))})


def q_center_surround(spark, d):
    return _shown(image_patches(spark, d), P.center_surround(F.col("a"), SIDE, SIDE))


def q_z_profile(spark, d):
    p = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda z: A.mean(F.slice("a", z * PLANE + 1, PLANE)))
    return _shown(image_patches(spark, d).withColumn("p", p), P.z_profile(F.col("p"), SLICES))


def q_pixel_corr(spark, d):
    return _shown(_pairs(spark, d), {"pixel_corr": P.pixel_corr(F.col("a"), F.col("b"))})


def q_bright_jaccard(spark, d):
    return _shown(_pairs(spark, d), P.overlap(F.col("ba"), F.col("bb")))


def q_manders(spark, d):
    return _shown(_pairs(spark, d), P.manders(F.col("a"), F.col("b"), F.col("ba"), F.col("bb")))


def q_cross_channel(spark, d):
    """All measures of a pair of channels; the region are the pixels at which channel a is at least 1."""
    a, b = F.col("a"), F.col("b")
    rows = _pairs(spark, d).withColumn("k", F.transform(a, lambda v: v >= 1.0))
    inside = A.let(F.struct(A.where(a, F.col("k")).alias("a"), A.where(b, F.col("k")).alias("b")), lambda s: P.pixel_corr(s["a"], s["b"]))
    return _shown(rows, {"pixel_corr": P.pixel_corr(a, b), "pixel_corr_in_mask": inside, **P.overlap(F.col("ba"), F.col("bb")), **P.manders(a, b, F.col("ba"), F.col("bb"))})


def q_com_offset(spark, d):
    return _shown(_pairs(spark, d), {"com_offset": P.com_offset(F.col("a"), F.col("b"), SIDE), "mean_ratio": safe_ratio(A.mean(F.col("a")), A.mean(F.col("b")))})


def q_cluster_summary_image(spark, d):
    """Mean and median of each pixel over the patches of a cluster."""
    pixels = image_patches(spark, d).select("label", F.posexplode("a").alias("at", "v"))
    return pixels.groupBy("label", "at").agg(shown(F.avg("v")).alias("mean"), shown(F.median("v")).alias("median"))


def _images(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["a"].to_numpy()).reshape(len(pdf), SIDE, SIDE) if len(pdf) else np.zeros((0, SIDE, SIDE))


def _kernel(spark: SparkSession, d: str, names: list[str], run, rounded: bool = True) -> DataFrame:
    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"vec_id": pdf["vec_id"], **dict(zip(names, run(_images(pdf)), strict=True))})

    out = map_batches(image_patches(spark, d).select("vec_id", "a"), over, "vec_id bigint, " + ", ".join(f"{n} double" for n in names))
    return _shown(out, {n: F.col(n) for n in names}) if rounded else out


def q_gradient(spark, d):
    def run(batch):
        g = P.gradient(batch)
        return g.mean((1, 2)), g.std((1, 2))

    return _kernel(spark, d, ["gradient_mean", "gradient_std"], run)


def q_glcm(spark, d):
    """Measures of neighbours at distance 1 in four directions, over 16 grey levels."""
    return _kernel(spark, d, P.GREY, P.grey_levels)


def q_log_dog(spark, d):
    def run(batch):
        narrow, wide = P.smooth(batch, 1.0), P.smooth(batch, 2.0)
        return np.abs(P.laplacian_of_gaussian(batch, 1.0)).max((1, 2)), np.abs(narrow - wide).max((1, 2)), ((batch - narrow) ** 2).mean((1, 2))

    return _kernel(spark, d, ["log_response", "dog_response", "high_frequency_power"], run)


def q_lbp(spark, d):
    return _kernel(spark, d, ["lbp_entropy", "lbp_uniform_fraction"], P.local_patterns)


def q_wavelet(spark, d):
    return _kernel(spark, d, ["wavelet_energy_scale_1", "wavelet_energy_scale_2", "wavelet_energy_scale_3"], lambda batch: P.scale_energies(batch).T)


def _shapes(batch: np.ndarray) -> dict[str, np.ndarray]:
    flat = batch.reshape(len(batch), -1)
    limit = np.maximum(np.percentile(flat, 97, axis=1), flat.mean(1) + flat.std(1)) if len(batch) else np.zeros(0)
    return P.component_geometry(batch >= limit[:, None, None], batch)


def q_components(spark, d):
    """Shape of the largest component of each patch's bright pixels."""
    return _kernel(spark, d, P.GEOMETRY, lambda batch: list(_shapes(batch).values()))


def q_pair_ratios(spark, d):
    """Compactness and spotness of each patch against the patch of the next id."""
    names = ["compactness", "log_response"]
    one = _kernel(spark, d, names, lambda batch: [_shapes(batch)["compactness"], np.abs(P.laplacian_of_gaussian(batch, 1.0)).max((1, 2))], rounded=False)
    other = one.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(n).alias(f"_{n}") for n in names])
    return _shown(one.join(other, "vec_id"), {"compactness_ratio": safe_ratio("compactness", "_compactness"), "spotness_ratio": safe_ratio("log_response", "_log_response")})


def q_z_peaks(spark, d):
    def run(batch):
        n = np.array([P.peaks(p) for p in batch.reshape(len(batch), 16, 4).mean(2)], dtype=float)
        return n, np.maximum(n - 1, 0)

    return _kernel(spark, d, ["z_peak_count", "z_multi_peak_score"], run)


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


_P = "WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE + 1.0 AS v, CAST(unnest(range(64)) AS INT) AS i FROM embeddings)"
_MX = _P + ", c AS (SELECT vec_id, i % 16 AS i, sum(v) / 4 AS m, max(v) AS x FROM p GROUP BY vec_id, i % 16)"
_SAFE = "CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END"
_AB = _P + ", th AS (SELECT vec_id, greatest(quantile_cont(v, 0.97), avg(v) + stddev_pop(v)) AS t FROM p GROUP BY 1), b AS (SELECT p.*, v >= t AS k FROM p JOIN th USING (vec_id)), ab AS (SELECT x.vec_id, x.i, x.v AS a, y.v AS b, x.k AS ka, y.k AS kb FROM b x JOIN b y ON y.vec_id = x.vec_id + 1 AND x.i = y.i)"


def _weights(sigma: float, reach: int = 16) -> list[float]:
    """A normalised Gaussian over -16..16, cut at four deviations."""
    r = int(4 * sigma + 0.5)
    w = [np.exp(-0.5 * (t / sigma) ** 2) if abs(t) <= r else 0.0 for t in range(-reach, reach + 1)]
    return [v / sum(w) for v in w]


_TAPS = ", ".join(f"({t}, {a!r}, {a * (t * t - 1)!r}, {b!r}, {c!r})" for t, a, b, c in zip(range(-16, 17), *[list(map(float, _weights(s))) for s in (1.0, 2.0, 4.0)], strict=True))
_BACK = "CASE WHEN {0} % 16 < 8 THEN {0} % 16 ELSE 15 - {0} % 16 END"
_SMOOTH = _P + f""", w AS (SELECT * FROM (VALUES {_TAPS}) t(t, a, l, b, c)),
h AS (SELECT p.vec_id, p.i, sum(a * q.v) AS a, sum(l * q.v) AS l, sum(b * q.v) AS b, sum(c * q.v) AS c FROM p, w, p q WHERE q.vec_id = p.vec_id AND q.i = p.i // 8 * 8 + {_BACK.format('(p.i % 8 + t + 32)')} GROUP BY ALL),
g AS (SELECT h.vec_id, h.i, sum(w.a * k.a) AS s1, sum(w.a * k.l + w.l * k.a) AS lap, sum(w.b * k.b) AS s2, sum(w.c * k.c) AS s4 FROM h, w, h k WHERE k.vec_id = h.vec_id AND k.i = {_BACK.format('(h.i // 8 + t + 32)')} * 8 + h.i % 8 GROUP BY ALL),
s AS (SELECT g.*, p.v FROM g JOIN p USING (vec_id, i))"""
_SHAPE = "WITH RECURSIVE" + _P.removeprefix("WITH") + """, th AS (SELECT vec_id, greatest(quantile_cont(v, 0.97), avg(v) + stddev_pop(v)) AS t FROM p GROUP BY 1), k AS (SELECT p.vec_id, i, v FROM p JOIN th USING (vec_id) WHERE v >= t),
n AS (SELECT a.vec_id, a.i, b.i AS j FROM k a JOIN k b ON a.vec_id = b.vec_id AND abs(a.i // 8 - b.i // 8) + abs(a.i % 8 - b.i % 8) = 1),
r AS (SELECT vec_id, i, i AS j FROM k UNION SELECT r.vec_id, r.i, n.j FROM r JOIN n ON n.vec_id = r.vec_id AND n.i = r.j), lab AS (SELECT vec_id, i, min(j) AS l FROM r GROUP BY ALL),
ar AS (SELECT vec_id, l, count(*) AS n FROM lab GROUP BY ALL), co AS (SELECT vec_id, count(*) AS cnt, sum(n) AS whole FROM ar GROUP BY 1), big AS (SELECT vec_id, l, n FROM ar QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, l) = 1),
px AS (SELECT lab.vec_id, lab.i, i // 8 AS y, i % 8 AS x FROM lab JOIN big USING (vec_id, l)),
mo AS (SELECT vec_id, count(*) AS n, avg(y) AS cy, avg(x) AS cx, coalesce(var_samp(y), 0) AS vy, coalesce(var_samp(x), 0) AS vx, coalesce(covar_samp(y, x), 0) AS vyx, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS box FROM px GROUP BY 1),
ev AS (SELECT *, (vy + vx) / 2 + sqrt(((vy - vx) / 2) ** 2 + vyx ** 2) AS major, CASE WHEN (vy + vx) / 2 - sqrt(((vy - vx) / 2) ** 2 + vyx ** 2) > 1e-12 THEN (vy + vx) / 2 - sqrt(((vy - vx) / 2) ** 2 + vyx ** 2) ELSE 0 END AS minor FROM mo),
ed AS (SELECT vec_id, count(*) AS e FROM (SELECT k.vec_id, k.i, count(n.j) AS c FROM k LEFT JOIN n ON n.vec_id = k.vec_id AND n.i = k.i GROUP BY ALL) WHERE c < 4 GROUP BY 1),
ds AS (SELECT p.vec_id, p.i, p.v, px.i IS NOT NULL AS inb, sqrt((p.i // 8 - cy) ** 2 + (p.i % 8 - cx) ** 2) AS d FROM p JOIN mo USING (vec_id) LEFT JOIN px ON px.vec_id = p.vec_id AND px.i = p.i),
lm AS (SELECT vec_id, min(d) AS lo, max(d) AS hi FROM ds GROUP BY 1), uv AS (SELECT vec_id, CASE WHEN inb THEN v ELSE 0 END AS u, CASE WHEN inb THEN 1 - (d - lo) / (hi - lo) ELSE 0 END AS w FROM ds JOIN lm USING (vec_id)),
ra AS (SELECT vec_id, CASE WHEN var_pop(u) > 1e-14 AND var_pop(w) > 1e-14 THEN greatest(corr(u, w), 0) ELSE 0 END AS radial FROM uv GROUP BY 1),
fin AS (SELECT vec_id, cnt, ev.n, whole, major, minor, box, radial, 4 * pi() * whole / greatest(coalesce(e, 0) ** 2, 1) AS circ FROM ev JOIN co USING (vec_id) JOIN ra USING (vec_id) LEFT JOIN ed USING (vec_id))"""

ORACLES = {
    "q_components": _SHAPE + f""" SELECT vec_id, {_r('CAST(cnt AS DOUBLE)')} AS component_count, {_r('CAST(n AS DOUBLE)')} AS largest_area, {_r('n / 64')} AS largest_area_fraction, {_r('CASE WHEN major > 1e-12 THEN sqrt(greatest(1 - minor / major, 0)) ELSE 0 END')} AS eccentricity,
{_r('circ')} AS circularity, {_r('circ')} AS compactness, {_r('n / box')} AS solidity, {_r('CASE WHEN minor > 0 THEN sqrt(major / minor) ELSE 0 END')} AS elongation, {_r('radial')} AS radial_symmetry, {_r('cnt / 64')} AS microstructure_density, {_r('CAST(n / whole AS DOUBLE)')} AS dominant_object_fraction FROM fin""",
    "q_pair_ratios": _SHAPE + ", " + _SMOOTH[_SMOOTH.index("w AS (SELECT * FROM (VALUES") :] + f""", o AS (SELECT vec_id, circ AS c, m FROM fin JOIN (SELECT vec_id, max(abs(lap)) AS m FROM s GROUP BY 1) USING (vec_id))
SELECT x.vec_id, {_r(_SAFE.format(a='x.c', b='y.c'))} AS compactness_ratio, {_r(_SAFE.format(a='x.m', b='y.m'))} AS spotness_ratio FROM o x JOIN o y ON y.vec_id = x.vec_id + 1""",
    "q_log_dog": _SMOOTH + f" SELECT vec_id, {_r('max(abs(lap))')} AS log_response, {_r('max(abs(s1 - s2))')} AS dog_response, {_r('avg((v - s1) ** 2)')} AS high_frequency_power FROM s GROUP BY 1",
    "q_wavelet": _SMOOTH + f" SELECT vec_id, {_r('avg((v - s1) ** 2)')} AS wavelet_energy_scale_1, {_r('avg((s1 - s2) ** 2)')} AS wavelet_energy_scale_2, {_r('avg((s2 - s4) ** 2)')} AS wavelet_energy_scale_3 FROM s GROUP BY 1",
    "q_z_peaks": _P + f""", z AS (SELECT vec_id, CAST(i // 4 AS INT) AS z, avg(v) AS p FROM p GROUP BY ALL), m AS (SELECT vec_id, max(p) AS mx FROM z GROUP BY 1),
k AS (SELECT a.vec_id, a.z, a.p FROM z a JOIN z b ON b.vec_id = a.vec_id AND b.z = a.z - 1 AND b.p < a.p JOIN z c ON c.vec_id = a.vec_id AND c.z = a.z + 1 AND c.p < a.p),
h AS (SELECT k.vec_id, k.z, k.p, coalesce(max(o.z) FILTER (WHERE o.z < k.z AND o.p > k.p), -1) AS l, coalesce(min(o.z) FILTER (WHERE o.z > k.z AND o.p > k.p), 16) AS r FROM k JOIN z o USING (vec_id) GROUP BY ALL),
b AS (SELECT h.vec_id, h.z, h.p, min(o.p) FILTER (WHERE o.z > l AND o.z < h.z) AS bl, min(o.p) FILTER (WHERE o.z > h.z AND o.z < r) AS br FROM h JOIN z o USING (vec_id) GROUP BY ALL),
c AS (SELECT vec_id, count(*) AS n FROM b JOIN m USING (vec_id) WHERE p - greatest(bl, br) >= greatest(0.1 * mx, 1e-6) GROUP BY 1)
SELECT vec_id, {_r('CAST(coalesce(n, 0) AS DOUBLE)')} AS z_peak_count, {_r('CAST(greatest(coalesce(n, 0) - 1, 0) AS DOUBLE)')} AS z_multi_peak_score FROM m LEFT JOIN c USING (vec_id)""",
    "q_lbp": _P + f""", o AS (SELECT * FROM (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,1),(4,1,1),(5,1,0),(6,1,-1),(7,0,-1)) t(k, dy, dx)),
b AS (SELECT p.vec_id, p.i, k, CAST(q.v >= p.v AS INT) AS b FROM p, o, p q WHERE q.vec_id = p.vec_id AND q.i = least(greatest(p.i // 8 + dy, 0), 7) * 8 + least(greatest(p.i % 8 + dx, 0), 7)),
u AS (SELECT x.vec_id, x.i, sum(x.b) AS ones, count(*) FILTER (WHERE x.b != y.b) AS turns FROM b x JOIN b y ON x.vec_id = y.vec_id AND x.i = y.i AND y.k = (x.k + 7) % 8 GROUP BY ALL),
c AS (SELECT vec_id, CASE WHEN turns <= 2 THEN ones ELSE 9 END AS code, count(*) / 64.0 AS f, count(*) FILTER (WHERE turns <= 2) AS n FROM u GROUP BY ALL) SELECT vec_id, {_r('-sum(f * log2(f))')} AS lbp_entropy, {_r('sum(n) / 64.0')} AS lbp_uniform_fraction FROM c GROUP BY 1""",
    "q_proj_stats": _MX + f" SELECT vec_id, {_r('avg(m)')} AS proj_mean, {_r('max(x)')} AS proj_max, {_r('stddev_pop(m)')} AS proj_std, {_r('max(m) - min(m)')} AS dynamic_range, {_r('var_pop(m)')} AS neighborhood_variance, {_r('stddev_pop(m) / (avg(m) + 1e-6)')} AS local_contrast FROM c GROUP BY 1",
    "q_inside_outside": _MX + f""", t AS (SELECT vec_id, greatest(quantile_cont(x, 0.97), avg(x) + stddev_pop(x)) AS t FROM c GROUP BY 1),
g AS (SELECT vec_id, coalesce(avg(m) FILTER (WHERE x >= 1.1), avg(m)) AS i, coalesce(avg(m) FILTER (WHERE x < 1.1), avg(m)) AS o, coalesce(avg(CAST(x >= t AS INT)) FILTER (WHERE x >= 1.1), 0) AS p, coalesce(avg(CAST(x >= t AS INT)) FILTER (WHERE x < 1.1), 0) AS q FROM c JOIN t USING (vec_id) GROUP BY 1)
SELECT vec_id, {_r('i')} AS inside_mean, {_r('o')} AS outside_mean, {_r(_SAFE.format(a='i', b='o'))} AS inside_outside_ratio, {_r('p')} AS inside_bright_fraction, {_r('q')} AS outside_bright_fraction, {_r(_SAFE.format(a='p', b='q'))} AS inside_bright_outside_bright_ratio FROM g""",
    "q_thickness": _P + f""", q AS (SELECT vec_id, bool_or(i = 36 AND v >= 0.9) AS c, min((i // 8 - 4) ** 2 + (i % 8 - 4) ** 2) FILTER (WHERE v < 0.9) AS d FROM p GROUP BY 1)
SELECT vec_id, {_r('CASE WHEN c THEN 2 * sqrt(coalesce(d, 16)) ELSE 0 END')} AS map2_local_thickness_proxy FROM q""",
    "q_bright_mask": _MX + f", t AS (SELECT vec_id, greatest(quantile_cont(x, 0.97), avg(x) + stddev_pop(x)) AS t, quantile_cont(x, 0.99) AS u FROM c GROUP BY 1) SELECT vec_id, {_r('count(*) FILTER (WHERE x >= t) / 16.0')} AS bright_pixel_fraction, {_r('CAST(count(*) FILTER (WHERE x >= t) AS DOUBLE)')} AS estimated_punctum_area, {_r('avg(x) FILTER (WHERE x >= u)')} AS top_percentile_intensity FROM c JOIN t USING (vec_id) GROUP BY 1",
    "q_entropy": _P + f", s AS (SELECT vec_id, min(v) a, max(v) b FROM p GROUP BY 1), h AS (SELECT vec_id, least(floor((v - a) / (b - a) * 32), 31) AS bin, count(*) * 32.0 / 64 AS h FROM p JOIN s USING (vec_id) WHERE b > a GROUP BY ALL) SELECT vec_id, {_r('sum(-h * log2(h))')} AS intensity_entropy FROM h GROUP BY 1",
    "q_center_surround": _P + f""", k AS (SELECT vec_id, v, i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5 AS c FROM p), g AS (SELECT vec_id, avg(v) FILTER (WHERE c) cm, avg(v) FILTER (WHERE NOT c) sm, median(v) FILTER (WHERE NOT c) md, stddev_pop(v) FILTER (WHERE NOT c) sd FROM k GROUP BY 1)
SELECT vec_id, {_r('cm')} AS center_mean, {_r('sm')} AS surround_mean, {_r('cm - sm')} AS center_surround_diff, {_r(_SAFE.format(a='cm', b='sm'))} AS center_surround_ratio, {_r('md')} AS local_background_estimate, {_r('(cm - sm) / (sd + 1e-6)')} AS local_snr FROM g""",
    "q_z_profile": _P + f""", z AS (SELECT vec_id, i // 16 AS z, avg(v) AS p FROM p GROUP BY ALL), m AS (SELECT vec_id, avg(p) m, stddev_pop(p) s, max(p) t, arg_min(z, (-p, z)) AS k FROM z GROUP BY 1), e AS (SELECT *, least(k, 3 - k) AS c FROM m),
y AS (SELECT e.vec_id, avg(abs(a.p - b.p)) AS d FROM e JOIN z a ON a.vec_id = e.vec_id JOIN z b ON b.vec_id = e.vec_id AND b.z = a.z + c + 1 WHERE a.z BETWEEN k - c AND k - 1 GROUP BY 1)
SELECT vec_id, {_r('CAST(any_value(k) AS DOUBLE)')} AS z_peak, {_r('any_value(s)')} AS z_std, {_r('CAST(count(*) FILTER (WHERE p >= t / 2) AS DOUBLE)')} AS z_width_halfmax, {_r('CAST(count(*) FILTER (WHERE p >= t / 2) AS DOUBLE)')} AS z_slices_above_halfmax, {_r('sum(z * p) / greatest(sum(p), 1e-6)')} AS z_center_of_mass,
{_r('avg(((p - m) / s) ** 3)')} AS z_skewness, {_r('avg(((p - m) / s) ** 4) - 3')} AS z_kurtosis, {_r('CASE WHEN any_value(c) = 0 THEN 0 ELSE 1 - any_value(d) / any_value(t) END')} AS z_peak_symmetry FROM z JOIN e USING (vec_id) LEFT JOIN y USING (vec_id) GROUP BY 1""",
    "q_pixel_corr": _AB + f" SELECT vec_id, {_r('corr(a, b)')} AS pixel_corr FROM ab GROUP BY 1",
    "q_cross_channel": _AB + f""", g AS (SELECT vec_id, corr(a, b) AS c, CASE WHEN count(*) FILTER (WHERE a >= 1) < 3 THEN 0 ELSE corr(a, b) FILTER (WHERE a >= 1) END AS d, count(*) FILTER (WHERE ka AND kb) AS i, count(*) FILTER (WHERE ka OR kb) AS u,
  least(count(*) FILTER (WHERE ka), count(*) FILTER (WHERE kb)) AS l, coalesce(sum(a) FILTER (WHERE ka AND kb), 0) / sum(a) FILTER (WHERE ka) AS m1, coalesce(sum(b) FILTER (WHERE ka AND kb), 0) / sum(b) FILTER (WHERE kb) AS m2 FROM ab GROUP BY 1)
SELECT vec_id, {_r('c')} AS pixel_corr, {_r('d')} AS pixel_corr_in_mask, {_r(_SAFE.format(a='i', b='u'))} AS bright_overlap_jaccard, {_r(_SAFE.format(a='i', b='l'))} AS bright_overlap_coef, {_r('m1')} AS manders_m1, {_r('m2')} AS manders_m2 FROM g""",
    "q_bright_jaccard": _AB + f", g AS (SELECT vec_id, count(*) FILTER (WHERE ka AND kb) AS i, count(*) FILTER (WHERE ka OR kb) AS u, least(count(*) FILTER (WHERE ka), count(*) FILTER (WHERE kb)) AS l FROM ab GROUP BY 1) SELECT vec_id, {_r(_SAFE.format(a='i', b='u'))} AS bright_overlap_jaccard, {_r(_SAFE.format(a='i', b='l'))} AS bright_overlap_coef FROM g",
    "q_manders": _AB + f" SELECT vec_id, {_r('coalesce(sum(a) FILTER (WHERE ka AND kb), 0) / sum(a) FILTER (WHERE ka)')} AS manders_m1, {_r('coalesce(sum(b) FILTER (WHERE ka AND kb), 0) / sum(b) FILTER (WHERE kb)')} AS manders_m2 FROM ab GROUP BY 1",
    "q_com_offset": _AB + f", g AS (SELECT vec_id, sum(a * (i // 8)) / sum(a) ya, sum(a * (i % 8)) / sum(a) xa, sum(b * (i // 8)) / sum(b) yb, sum(b * (i % 8)) / sum(b) xb, avg(a) ma, avg(b) mb FROM ab GROUP BY 1) SELECT vec_id, {_r('sqrt((ya - yb) ** 2 + (xa - xb) ** 2)')} AS com_offset, {_r('ma / mb')} AS mean_ratio FROM g",
    "q_cluster_summary_image": _P + f" SELECT label, i AS at, {_r('avg(v)')} AS mean, {_r('median(v)')} AS median FROM p GROUP BY ALL",
    "q_gradient": _P + f""", k AS (SELECT * FROM (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)) t(dy, dx, wx, wy)),
n AS (SELECT p.vec_id, p.i, sum(wx * q.v) AS gx, sum(wy * q.v) AS gy FROM p, k, p q WHERE q.vec_id = p.vec_id AND q.i = least(greatest(p.i // 8 + dy, 0), 7) * 8 + least(greatest(p.i % 8 + dx, 0), 7) GROUP BY ALL)
SELECT vec_id, {_r('avg(sqrt(gx * gx + gy * gy))')} AS gradient_mean, {_r('stddev_pop(sqrt(gx * gx + gy * gy))')} AS gradient_std FROM n GROUP BY 1""",
    "q_glcm": _P + f""", s AS (SELECT vec_id, min(v) a, max(v) b FROM p GROUP BY 1), l AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(least(floor((v - a) / CASE WHEN b > a THEN b - a ELSE 1 END * 15), 15) AS INT) AS g FROM p JOIN s USING (vec_id)),
o AS (SELECT * FROM (VALUES (0, 1), (1, 1), (1, 0), (1, -1)) t(dy, dx)), e AS (SELECT u.vec_id, dy, dx, u.g AS g, w.g AS h FROM l u, o, l w WHERE w.vec_id = u.vec_id AND w.y = u.y + dy AND w.x = u.x + dx),
b AS (SELECT * FROM e UNION ALL SELECT vec_id, dy, dx, h, g FROM e), t AS (SELECT vec_id, dy, dx, g, h, count(*) AS n FROM b GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY vec_id, dy, dx) AS f FROM t),
r AS (SELECT vec_id, dy, dx, sum(f * (g - h) * (g - h)) c, sum(f / (1 + (g - h) * (g - h))) m, sqrt(sum(f * f)) e, CASE WHEN sum(f * g * g) - sum(f * g) ** 2 > 1e-12 THEN (sum(f * g * h) - sum(f * g) ** 2) / (sum(f * g * g) - sum(f * g) ** 2) ELSE 1 END AS k FROM q GROUP BY ALL)
SELECT vec_id, {_r('avg(c)')} AS glcm_contrast, {_r('avg(m)')} AS glcm_homogeneity, {_r('avg(e)')} AS glcm_energy, {_r('avg(k)')} AS glcm_correlation FROM r GROUP BY 1""",
}
