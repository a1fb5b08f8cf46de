"""Features of patches held as arrays: everything that needs no neighbours stays in column expressions, stencils run on Arrow batches of whole patches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.numeric import safe_ratio


def z_mean(a: Column, slices: int, plane: int) -> Column:
    """The mean over slices of each pixel of a crop stored slice by slice."""
    return F.transform(F.sequence(F.lit(0), F.lit(plane - 1)), lambda i: A.total(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda z: F.get(a, z * plane + i))) / slices)


def z_max(a: Column, slices: int, plane: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(plane - 1)), lambda i: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda z: F.get(a, z * plane + i))))


def bright_threshold(x: Column) -> Column:
    """The greater of the 97th percentile and the mean plus one deviation."""
    return F.greatest(A.percentile(x, 0.97), A.mean(x) + A.std_pop(x))


def bright(x: Column, limit: Column) -> Column:
    return A.let(limit, lambda t: F.transform(x, lambda v: v >= t))


def entropy(m: Column, bins: int = 32) -> Column:
    """Sum of -h log2 h over the density values h > 0 of the histogram of the min-max normalised values; 0 for a flat patch."""
    ends = F.struct(F.array_min(m).alias("low"), (F.array_max(m) - F.array_min(m)).alias("span"))
    place = lambda e: F.transform(m, lambda v: F.least(F.floor((v - e["low"]) / F.when(e["span"] > 0, e["span"]).otherwise(1.0) * bins), F.lit(bins - 1)).cast("int"))
    dense = lambda at: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda p: p == b)) * F.lit(float(bins)) / F.size(m))
    sums = lambda at: A.total(F.transform(F.filter(dense(at), lambda h: h > 0), lambda h: -h * F.log2(h)))
    return F.when(F.array_max(m) > F.array_min(m), A.let(A.let(ends, place), sums)).otherwise(0.0)


def center_box(height: int, width: int):
    """Whether a place of a patch lies in its central box, a quarter of each side away from the border."""
    return lambda i: F.floor(i / width).between(height // 4, height - height // 4 - 1) & (i % width).between(width // 4, width - width // 4 - 1)


def center_surround(a: Column, height: int, width: int) -> dict[str, Column]:
    inside = center_box(height, width)
    c, s = A.places(a, inside), A.places(a, lambda i: ~inside(i))
    cm, sm = A.mean(c), A.mean(s)
    return {
        "center_mean": cm, "surround_mean": sm, "center_surround_diff": cm - sm, "center_surround_ratio": safe_ratio(cm, sm),
        "local_background_estimate": A.percentile(s, 0.5), "local_snr": (cm - sm) / (A.std_pop(s) + 1e-6),
    }


def z_profile(p: Column, n: int) -> dict[str, Column]:
    """Shape of the mean intensity over ``n`` slices; skewness and kurtosis of a flat profile (or of less than 3 or 4 slices) are 0.

    Symmetry holds the slices before the peak against those behind it, as many as there are on both sides, in their order.
    """
    top, sd, peak = F.array_max(p), A.std_pop(p), A.first_of_greatest(p)
    level = F.struct(A.mean(p).alias("m"), F.when(sd > 1e-12, sd).otherwise(1.0).alias("s"))
    moment = lambda k: A.let(level, lambda e: A.mean(F.transform(p, lambda v: ((v - e["m"]) / e["s"]) ** k)))
    wide = A.let(top, lambda t: A.count_if(p, lambda v: v >= t / 2))
    sides = F.least(peak, F.lit(n - 1) - peak)
    apart = A.mean(F.zip_with(F.slice(p, peak - sides + 1, sides), F.slice(p, peak + 2, sides), lambda a, b: F.abs(a - b)))
    return {
        "z_peak": peak, "z_std": sd, "z_width_halfmax": wide, "z_slices_above_halfmax": wide,
        "z_center_of_mass": A.dot(p, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda z: z.cast("double"))) / F.greatest(A.total(p), F.lit(1e-6)),
        "z_skewness": F.when(sd > 1e-12, moment(3)).otherwise(0.0) if n >= 3 else F.lit(0.0),
        "z_kurtosis": F.when(sd > 1e-12, moment(4) - 3).otherwise(0.0) if n >= 4 else F.lit(0.0),
        "z_peak_symmetry": F.when(sides > 0, 1 - apart / F.when(top > 0, top).otherwise(1.0)).otherwise(0.0),
    }


def pixel_corr(a: Column, b: Column, least: int = 3) -> Column:
    means = F.struct(A.mean(a).alias("a"), A.mean(b).alias("b"))
    cov = A.let(means, lambda m: A.mean(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"]))))
    flat = (F.size(a) < least) | (A.std_pop(a) <= 1e-9) | (A.std_pop(b) <= 1e-9)
    return F.when(flat, F.lit(0.0)).otherwise(cov / F.when(flat, F.lit(1.0)).otherwise(A.std_pop(a) * A.std_pop(b)))


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """Jaccard index of two boolean arrays, and their common area against the smaller one; 0 where a side is empty."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: x & y), lambda v: v)).cast("double")
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: x | y), lambda v: v)).cast("double")
    least = F.least(A.count_if(a, lambda v: v), A.count_if(b, lambda v: v)).cast("double")
    return {"bright_overlap_jaccard": safe_ratio(both, either), "bright_overlap_coef": safe_ratio(both, least)}


def manders(a: Column, b: Column, bright_a: Column, bright_b: Column) -> dict[str, Column]:
    """Share of each channel's bright intensity that lies where the other is bright too."""
    both = F.zip_with(bright_a, bright_b, lambda x, y: x & y)
    share = lambda v, mine: safe_ratio(A.total(A.where(v, both)), A.total(A.where(v, mine)))
    return {"manders_m1": share(a, bright_a), "manders_m2": share(b, bright_b)}


def center_of_mass(a: Column, width: int) -> tuple[Column, Column]:
    """``(y, x)``; (0, 0) for a total of 0 or less."""
    s = A.total(a)
    at = lambda f: A.total(F.transform(a, lambda v, i: v * f(i)))
    some = F.when(s > 0, s).otherwise(1.0)
    return F.when(s > 0, at(lambda i: F.floor(i / width)) / some).otherwise(0.0), F.when(s > 0, at(lambda i: i % width) / some).otherwise(0.0)


def com_offset(a: Column, b: Column, width: int) -> Column:
    (ya, xa), (yb, xb) = center_of_mass(a, width), center_of_mass(b, width)
    return F.sqrt((ya - yb) ** 2 + (xa - xb) ** 2)


def inside_outside(m: Column, bright_: Column, region: Column) -> dict[str, Column]:
    """Means of a patch and its bright shares in and out of a region: of all pixels, or 0, where one side is empty."""
    out = F.transform(region, lambda v: ~v)
    i, o = A.mean(A.where_or_all(m, region)), A.mean(A.where_or_all(m, out))
    part = lambda side: F.coalesce(A.count_if(A.where(bright_, side), lambda v: v) / F.nullif(A.count_if(side, lambda v: v), F.lit(0)), F.lit(0.0))
    bi, bo = part(region), part(out)
    return {
        "inside_mean": i, "outside_mean": o, "inside_outside_ratio": safe_ratio(i, o),
        "inside_bright_fraction": bi, "outside_bright_fraction": bo, "inside_bright_outside_bright_ratio": safe_ratio(bi, bo),
    }


def thickness(region: Column, height: int, width: int) -> Column:
    """Twice the distance from the patch's center to the nearest pixel out of the region, 0 for a center that is out of it itself.

    A region that fills the patch ends at the pixels around it.
    """
    cy, cx = height // 2, width // 2
    outside = F.filter(F.transform(region, lambda v, i: F.when(~v, (F.floor(i / width) - cy) ** 2 + (i % width - cx) ** 2)), lambda q: q.isNotNull())
    edge = float(min(cy + 1, height - cy, cx + 1, width - cx)) ** 2
    return F.when(F.get(region, F.lit(cy * width + cx)), 2 * F.sqrt(F.coalesce(F.array_min(outside), F.lit(edge)))).otherwise(0.0)


# Stencils: numpy over a batch of patches [n, y, x]; borders mirror the edge pixel.


def smooth(batch: np.ndarray, sigma: float, derivative: int = 0, reach: float = 4.0) -> np.ndarray:
    """Separable Gaussian filter along both axes, its kernel cut at ``reach`` deviations."""
    return _along(_along(batch, sigma, 1, 0, reach), sigma, 2, derivative, reach)


def _along(batch: np.ndarray, sigma: float, axis: int, derivative: int, reach: float) -> np.ndarray:
    r = int(reach * sigma + 0.5)
    t = np.arange(-r, r + 1)
    weight = np.exp(-0.5 * (t / sigma) ** 2)
    weight /= weight.sum()
    if derivative == 2:
        weight = weight * (t**2 / sigma**4 - 1 / sigma**2)
    wide = np.pad(batch, [(r, r) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
    n = batch.shape[axis]
    return sum(w * np.take(wide, np.arange(i, i + n), axis=axis) for i, w in enumerate(weight))


def laplacian_of_gaussian(batch: np.ndarray, sigma: float) -> np.ndarray:
    return _along(_along(batch, sigma, 1, 2, 4.0), sigma, 2, 0, 4.0) + _along(_along(batch, sigma, 1, 0, 4.0), sigma, 2, 2, 4.0)


def gradient(batch: np.ndarray) -> np.ndarray:
    """Magnitude of the Sobel derivatives."""
    p = np.pad(batch, [(0, 0), (1, 1), (1, 1)], mode="symmetric")
    h, w = batch.shape[1:]
    part = lambda dy, dx: p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = sum(k * (part(d, 1) - part(d, -1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (part(1, d) - part(-1, d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    return np.hypot(gx, gy)


def label(masks: np.ndarray) -> np.ndarray:
    """The place of the first pixel of each true pixel's component by faces, over a batch of masks [n, y, x]; the mask's size for false pixels."""
    n, h, w = masks.shape
    size = h * w
    now = np.where(masks, np.arange(size).reshape(h, w), size)
    base = np.arange(n)[:, None] * (size + 1)
    while True:
        p = np.pad(now, [(0, 0), (1, 1), (1, 1)], constant_values=size)
        low = np.minimum.reduce([now, p[:, :-2, 1:-1], p[:, 2:, 1:-1], p[:, 1:-1, :-2], p[:, 1:-1, 2:]])
        low = np.where(masks, low, size).reshape(n, size)
        followed = np.pad(low, [(0, 0), (0, 1)], constant_values=size).ravel()[low + base].reshape(n, h, w)
        if (followed == now).all():
            return now
        now = followed


GEOMETRY = ["component_count", "largest_area", "largest_area_fraction", "eccentricity", "circularity", "compactness", "solidity", "elongation", "radial_symmetry", "microstructure_density", "dominant_object_fraction"]


def component_geometry(masks: np.ndarray, images: np.ndarray) -> dict[str, np.ndarray]:
    """Shape of the largest component (the first among equals) of each bright mask of a batch, and how it stands in the whole mask; all 0 for an empty mask.

    Circularity (compactness is the same) holds the whole mask's area against its edge, solidity the component's area against its box; radial
    symmetry is the correlation of the component's intensities with the nearness to its center, taken over the patch, not below 0.
    """
    n, h, w = masks.shape
    size = h * w
    if not n:
        return {name: np.zeros(0) for name in GEOMETRY}
    labels = label(masks).reshape(n, size)
    areas = np.bincount((labels + np.arange(n)[:, None] * (size + 1)).ravel(), minlength=n * (size + 1)).reshape(n, size + 1)[:, :size]
    area, whole, count = areas.max(1).astype(float), masks.sum((1, 2)).astype(float), (areas > 0).sum(1).astype(float)
    some = whole > 0
    largest = (labels == areas.argmax(1)[:, None]).reshape(n, h, w) & masks
    y, x = np.mgrid[:h, :w]
    one = np.maximum(area, 1.0)
    sums = lambda v: (largest * v).sum((1, 2))
    cy, cx = sums(y) / one, sums(x) / one
    dy, dx = y - cy[:, None, None], x - cx[:, None, None]
    free = np.maximum(area - 1, 1.0)
    a, b, c = sums(dy * dy) / free, sums(dy * dx) / free, sums(dx * dx) / free
    half, root = (a + c) / 2, np.hypot((a - c) / 2, b)
    major, minor = half + root, np.where(half - root > 1e-12, half - root, 0.0)
    p = np.pad(masks, [(0, 0), (1, 1), (1, 1)])
    inner = masks & p[:, :-2, 1:-1] & p[:, 2:, 1:-1] & p[:, 1:-1, :-2] & p[:, 1:-1, 2:]
    rounded = 4 * np.pi * whole / np.maximum((masks & ~inner).sum((1, 2)).astype(float) ** 2, 1.0)
    span = lambda hit: hit.shape[1] - hit.argmax(1) - hit[:, ::-1].argmax(1)
    box = span(largest.any(2)) * span(largest.any(1))
    far = np.hypot(dy, dx).reshape(n, size)
    low, wide = far.min(1, keepdims=True), np.ptp(far, 1, keepdims=True)
    near = 1 - np.where(wide > 0, (far - low) / np.where(wide > 0, wide, 1.0), 0.0)
    flat = largest.reshape(n, size)
    u, v = images.reshape(n, size) * flat, near * flat
    u, v = u - u.mean(1, keepdims=True), v - v.mean(1, keepdims=True)
    spread = np.sqrt((u * u).sum(1) * (v * v).sum(1))
    radial = np.where(spread > 1e-12, (u * v).sum(1) / np.where(spread > 1e-12, spread, 1.0), 0.0) if size > 2 else np.zeros(n)
    values = (
        count, area, area / size, np.where(major > 1e-12, np.sqrt(np.maximum(1 - minor / np.where(major > 1e-12, major, 1.0), 0.0)), 0.0), rounded, rounded, area / np.maximum(box, 1),
        np.where(minor > 0, np.sqrt(major / np.where(minor > 0, minor, 1.0)), 0.0), np.maximum(radial, 0.0), count / size, area / np.maximum(whole, 1.0),
    )
    return {name: np.where(some, v, 0.0) for name, v in zip(GEOMETRY, values, strict=True)}


GREY = ["glcm_contrast", "glcm_homogeneity", "glcm_energy", "glcm_correlation"]


def grey_levels(batch: np.ndarray, levels: int = 16) -> np.ndarray:
    """Contrast, homogeneity, energy and correlation [4, n] of neighbours at distance 1, the mean of four directions, over grey levels of each patch's own range.

    The correlation of a patch of one level is 1.
    """
    n, h, w = batch.shape
    low, high = batch.min((1, 2), keepdims=True), batch.max((1, 2), keepdims=True)
    level = np.floor((batch - low) / np.where(high > low, high - low, 1.0) * (levels - 1)).astype(int)
    i, j = np.mgrid[:levels, :levels]
    out = np.zeros((4, n))
    for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1)):
        a = level[:, : h - dy, max(0, -dx) : w - max(0, dx)].reshape(n, -1)
        b = level[:, dy:, max(0, dx) : w - max(0, -dx)].reshape(n, -1)
        at = (np.arange(n)[:, None] * levels + a) * levels + b
        table = np.bincount(at.ravel(), minlength=n * levels * levels).reshape(n, levels, levels).astype(float)
        table += table.transpose(0, 2, 1)
        table /= np.maximum(table.sum((1, 2), keepdims=True), 1.0)
        mean = (table * i).sum((1, 2))
        spread = (table * i * i).sum((1, 2)) - mean**2
        joint = (table * i * j).sum((1, 2)) - mean**2
        linked = np.where(spread > 1e-12, joint / np.where(spread > 1e-12, spread, 1.0), 1.0)
        out += np.stack([(table * (i - j) ** 2).sum((1, 2)), (table / (1 + (i - j) ** 2)).sum((1, 2)), np.sqrt((table**2).sum((1, 2))), linked]) / 4
    return out


def local_patterns(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy (bits) of the uniform local binary patterns of eight neighbours, and the share of uniform ones."""
    p = np.pad(batch, [(0, 0), (1, 1), (1, 1)], mode="symmetric")
    h, w = batch.shape[1:]
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    bits = np.stack([p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] >= batch for dy, dx in ring], -1)
    uniform = (bits != np.roll(bits, 1, -1)).sum(-1) <= 2
    code = np.where(uniform, bits.sum(-1), 9).reshape(len(batch), -1)
    share = np.stack([(code == k).mean(1) for k in range(10)], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = -np.where(share > 0, share * np.log2(share), 0.0).sum(1)
    return spread, uniform.reshape(len(batch), -1).mean(1)


def scale_energies(batch: np.ndarray, sigmas: tuple[float, ...] = (1.0, 2.0, 4.0)) -> np.ndarray:
    """Mean square of what each wider Gaussian takes away, [n, scale]."""
    out, now = [], batch
    for s in sigmas:
        wide = smooth(batch, s)
        out.append(((now - wide) ** 2).mean((1, 2)))
        now = wide
    return np.stack(out, 1)


def peaks(profile: np.ndarray, share: float = 0.1) -> int:
    """Inner peaks (a plateau counts once) whose prominence is at least ``share`` of the maximum."""
    need, n, found = max(share * profile.max(), 1e-6), len(profile), 0
    i = 1
    while i < n - 1:
        j = i
        while j < n - 1 and profile[j + 1] == profile[i]:
            j += 1
        if profile[i - 1] < profile[i] and j < n - 1 and profile[j + 1] < profile[i]:
            left, right = profile[:i], profile[j + 1 :]
            higher_l, higher_r = np.flatnonzero(left > profile[i]), np.flatnonzero(right > profile[i])
            base_l = left[higher_l[-1] + 1 if higher_l.size else 0 :].min()
            base_r = right[: higher_r[0] if higher_r.size else None].min()
            found += profile[i] - max(base_l, base_r) >= need
        i = j + 1
    return int(found)
