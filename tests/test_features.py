"""All features of crops against direct sums over single patches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import patch_features as P
from voxelmill.plans import features as E

H, W, Z = 8, 6, 5
CHANNELS = ["MAP2", "FLAG", "HA", "SHANK2"]


def ratio(a, b):
    return a / b if b and np.isfinite(b) else 0.0


def corr(a, b):
    return float(np.corrcoef(a, b)[0, 1]) if len(a) >= 3 and a.std() > 1e-9 and b.std() > 1e-9 else 0.0


def channel(crop, mask):
    """One channel of one patch, pixel by pixel where that is what is to be checked."""
    m, x, p = crop.mean(0), crop.max(0), crop.mean((1, 2))
    bright = x >= max(np.percentile(x, 97), x.mean() + x.std())
    inside, outside = (m[s] if s.any() else m.ravel() for s in (mask, ~mask))
    box = np.zeros((H, W), dtype=bool)
    box[H // 4 : H - H // 4, W // 4 : W - W // 4] = True
    c, s = m[box], m[~box]
    share = [bright[k].mean() if k.any() else 0.0 for k in (mask, ~mask)]
    flat = m.max() <= m.min()
    hist = np.histogram((m - m.min()) / (np.ptp(m) or 1.0), 32, (0, 1), density=True)[0]
    hist = np.array([32.0]) if flat else hist[hist > 0]
    k, sd = int(p.argmax()), p.std()
    side = min(k, Z - 1 - k)
    z = (p - p.mean()) / (sd or 1.0)
    out = {
        "proj_mean": m.mean(), "proj_max": x.max(), "proj_std": m.std(), "local_contrast": ratio(m.std(), m.mean() + 1e-6), "dynamic_range": np.ptp(m), "bright_pixel_fraction": bright.mean(),
        "top_percentile_intensity": x[x >= np.percentile(x, 99)].mean(), "intensity_entropy": 0.0 if flat else -(hist * np.log2(hist)).sum(), "estimated_punctum_area": bright.sum(), "neighborhood_variance": m.var(),
        "inside_mean": inside.mean(), "outside_mean": outside.mean(), "inside_outside_ratio": ratio(inside.mean(), outside.mean()),
        "inside_bright_fraction": share[0], "outside_bright_fraction": share[1], "inside_bright_outside_bright_ratio": ratio(*share),
        "center_mean": c.mean(), "surround_mean": s.mean(), "center_surround_diff": c.mean() - s.mean(), "center_surround_ratio": ratio(c.mean(), s.mean()), "local_background_estimate": np.median(s), "local_snr": (c.mean() - s.mean()) / (s.std() + 1e-6),
        "z_peak": k, "z_std": sd, "z_width_halfmax": (p >= p.max() / 2).sum(), "z_slices_above_halfmax": (p >= p.max() / 2).sum(), "z_center_of_mass": (np.arange(Z) * p).sum() / max(p.sum(), 1e-6),
        "z_skewness": (z**3).mean() if sd > 1e-12 else 0.0, "z_kurtosis": (z**4).mean() - 3 if sd > 1e-12 else 0.0,
        "z_peak_symmetry": 1 - np.abs(p[k - side : k] - p[k + 1 : k + 1 + side]).mean() / (p.max() if p.max() > 0 else 1.0) if side else 0.0,
        "z_peak_count": P.peaks(p), "z_multi_peak_score": max(0, P.peaks(p) - 1),
    }
    stencil = P.smooth(m[None], 1.0)[0], P.smooth(m[None], 2.0)[0], P.smooth(m[None], 4.0)[0]
    wide, slope = np.pad(m, 1, mode="symmetric"), np.zeros((H, W))
    for y in range(H):
        for q in range(W):
            w = wide[y : y + 3, q : q + 3]
            slope[y, q] = np.hypot((w[:, 2] - w[:, 0]) @ [1, 2, 1], (w[2] - w[0]) @ [1, 2, 1])
    energies = [((a - b) ** 2).mean() for a, b in ((m, stencil[0]), stencil[:2], stencil[1:])]
    lap = P.laplacian_of_gaussian(m[None], 1.0)[0]
    out |= {"log_response": np.abs(lap).max(), "dog_response": np.abs(stencil[0] - stencil[1]).max(), "gradient_mean": slope.mean(), "gradient_std": slope.std(), "high_frequency_power": energies[0]}
    out |= {f"wavelet_energy_scale_{i + 1}": e for i, e in enumerate(energies)}
    ring, codes = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)], []
    for y in range(H):
        for q in range(W):
            bits = [wide[y + 1 + a, q + 1 + b] >= m[y, q] for a, b in ring]
            codes.append(sum(bits) if sum(a != b for a, b in zip(bits, [bits[-1], *bits[:-1]])) <= 2 else 9)
    f = np.bincount(codes, minlength=10) / len(codes)
    out |= {"lbp_entropy": -(f[f > 0] * np.log2(f[f > 0])).sum(), "lbp_uniform_fraction": 1 - f[9]}
    level = np.floor((m - m.min()) / (np.ptp(m) or 1.0) * 15).astype(int)
    grey = []
    for a, b in ((0, 1), (1, 1), (1, 0), (1, -1)):
        pairs = [(level[y, q], level[y + a, q + b]) for y in range(H) for q in range(W) if 0 <= y + a < H and 0 <= q + b < W]
        i, j = np.array(pairs + [t[::-1] for t in pairs], dtype=float).T
        cells = np.unique(np.stack([i, j]), axis=1, return_counts=True)[1] / len(i)
        grey.append((((i - j) ** 2).mean(), (1 / (1 + (i - j) ** 2)).mean(), np.sqrt((cells**2).sum()), corr(i, j) if i.std() > 1e-9 else 1.0))
    out |= dict(zip(P.GREY, np.mean(grey, 0)))
    todo, parts = set(map(tuple, np.argwhere(bright))), []
    for at in sorted(todo):
        if at in todo:
            todo.discard(at)
            part, stack = [], [at]
            while stack:
                y, q = stack.pop()
                part.append((y, q))
                for t in ((y - 1, q), (y + 1, q), (y, q - 1), (y, q + 1)):
                    if t in todo:
                        todo.discard(t)
                        stack.append(t)
            parts.append(part)
    big = max(parts, key=len)
    y, q = np.array(big).T
    low, high = np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(y, q)), 0)) if len(big) > 1 else (0.0, 0.0)
    low = low if low > 1e-6 else 0.0
    edge = sum(not all(0 <= a < H and 0 <= b < W and bright[a, b] for a, b in ((r - 1, t), (r + 1, t), (r, t - 1), (r, t + 1))) for r, t in np.argwhere(bright))
    near = np.hypot(*(np.indices((H, W)) - np.array([y.mean(), q.mean()])[:, None, None]))
    near = 1 - (near - near.min()) / (np.ptp(near) or 1.0)
    only = np.zeros((H, W))
    only[y, q] = 1
    circle = 4 * np.pi * bright.sum() / max(edge**2, 1)
    out |= {
        "component_count": len(parts), "largest_area": len(big), "largest_area_fraction": len(big) / (H * W), "eccentricity": np.sqrt(1 - (low / high) ** 2) if high else 0.0, "circularity": circle, "compactness": circle,
        "solidity": len(big) / (np.ptp(y) + 1) / (np.ptp(q) + 1), "elongation": ratio(high, low), "radial_symmetry": max(0.0, corr((x * only).ravel(), (near * only).ravel())), "microstructure_density": len(parts) / (H * W),
        "dominant_object_fraction": len(big) / bright.sum(),
    }
    return out, m, x, bright


def patch(crops, mask, distance):
    out, parts = {}, {}
    for name, crop in crops.items():
        parts[name] = channel(crop, mask)
        out |= {f"{name}_{k}": v for k, v in parts[name][0].items()}
    holes = np.argwhere(~mask) - [H // 2, W // 2]
    away = np.sqrt((holes**2).sum(1).min()) if len(holes) else min(H // 2 + 1, H - H // 2, W // 2 + 1, W - W // 2)
    out |= {"map2_mask_fraction": mask.mean(), "distance_to_mask_boundary_px": distance, "center_of_patch_map2_intensity": parts["map2"][1][H // 2, W // 2], "map2_local_thickness_proxy": 2 * away if mask[H // 2, W // 2] else 0.0}
    for a, b in E.PAIRS:
        if a not in parts or b not in parts:
            continue
        (fa, ma, xa, ka), (fb, mb, xb, kb) = parts[a], parts[b]
        com = [np.array([(np.indices((H, W))[i] * v).sum() / v.sum() if v.sum() > 0 else 0.0 for i in (0, 1)]) for v in (xa, xb)]
        both = ka & kb
        values = (
            corr(ma.ravel(), mb.ravel()), corr(ma[mask], mb[mask]) if mask.any() else 0.0, ratio(both.sum(), (ka | kb).sum()), ratio(both.sum(), min(ka.sum(), kb.sum())), ratio(xa[both].sum(), xa[ka].sum()), ratio(xb[both].sum(), xb[kb].sum()),
            np.hypot(*(com[0] - com[1])), ratio(fa["compactness"], fb["compactness"]), ratio(fa["log_response"], fb["log_response"]), ratio(fa["proj_mean"], fb["proj_mean"]),
        )
        names = ("pixel_corr", "pixel_corr_in_mask", "bright_overlap_jaccard", "bright_overlap_coef", "manders_m1", "manders_m2", "com_offset", "compactness_ratio", "spotness_ratio", "mean_ratio")
        out |= {f"{a}_{b}_{n}": v for n, v in zip(names, values)}
    mean = {c: parts[c][0]["proj_mean"] if c in parts else 0.0 for c in ("map2", "flag", "ha", "shank2")}
    total = {c: crops[c].sum() if c in crops else 0.0 for c in mean}
    return out | {
        "flag_to_ha_mean_ratio": ratio(mean["flag"], mean["ha"]), "ha_to_flag_mean_ratio": ratio(mean["ha"], mean["flag"]), "flag_ha_mean_sum": mean["flag"] + mean["ha"], "flag_ha_mean_product": mean["flag"] * mean["ha"],
        "flag_ha_mean_absdiff": abs(mean["flag"] - mean["ha"]), "shank2_to_map2_mean_ratio": ratio(mean["shank2"], mean["map2"]), "flag_plus_ha_to_shank2_sum_ratio": ratio(total["flag"] + total["ha"], total["shank2"]),
    }


@pytest.fixture(scope="module")
def made():
    rng, out = np.random.default_rng(4), {}
    for i in range(7):
        crops = {c.lower(): rng.gamma(1.0, 100, (Z, H, W)).astype("float32") for c in CHANNELS}
        mask = rng.random((H, W)) < 0.5
        if i == 1:
            mask[:] = False
        if i == 2:
            mask[:] = True
        if i == 3:
            crops["ha"][:] = 7.0
        if i == 4:
            crops["flag"][:] = 0.0
        if i == 5:
            crops["map2"][:, 2:6, 2:5] += 900
        out[f"p{i}"] = ({k: v.astype(float) for k, v in crops.items()}, mask, float(i) - 3)
    return out


@pytest.mark.parametrize("channels", [CHANNELS, ["MAP2", "HA"]])
def test_every_feature_equals_direct_sums(spark, made, channels):
    rows = [(k, c.upper(), v.ravel().tolist()) for k, (crops, _, _) in made.items() for c, v in crops.items()]
    rows += [(k, "map2_mask", mask.astype(float).ravel().tolist()) for k, (_, mask, _) in made.items()]
    rows += [("alone", "MAP2", [1.0] * (Z * H * W)), ("gone", "map2_mask", [1.0] * (H * W))]
    crops = spark.createDataFrame(rows, "patch_id string, channel string, v array<float>")
    patches = spark.createDataFrame([(k, d) for k, (_, _, d) in made.items()] + [("alone", 0.0)], "patch_id string, distance_to_mask_px double").withColumn("m", F.lit("clash"))
    got = {r.patch_id: r.asDict() for r in E.engineered_features(patches, crops, channels, H, W, Z).collect()}
    wanted = [c.lower() for c in channels]
    assert set(got) == set(made) and (len(channels) < 4 or len(next(iter(got.values()))) == 300)
    for k, (held, mask, distance) in made.items():
        want = patch({c: v for c, v in held.items() if c in wanted}, mask, distance)
        assert set(want) == set(got[k]) - {"patch_id"}
        bad = {n: (got[k][n], v) for n, v in want.items() if not np.isclose(got[k][n], v, rtol=1e-6, atol=1e-7)}
        assert not bad, (k, bad)
    assert E.engineered_features(patches.limit(0), crops.limit(0), channels, H, W, Z).count() == 0
    with pytest.raises(ValueError):
        E.engineered_features(patches, crops, ["HA"], H, W, Z)
