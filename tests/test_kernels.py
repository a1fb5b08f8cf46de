import numpy as np
import pytest

from voxelmill.operators import masks, models, sampling
from voxelmill.operators import patch_features as P

rng = np.random.default_rng(5)


@pytest.mark.parametrize("shape", [(13, 17), (1, 9), (9, 1), (40, 6)])
@pytest.mark.parametrize("share", [0.01, 0.1, 1.0])
def test_distance_equals_brute_force(shape, share):
    mask = rng.random(shape) < share
    mask[-1, 0] = True
    y, x = np.nonzero(mask)
    want = ((np.arange(shape[0])[:, None, None] - y) ** 2 + (np.arange(shape[1])[None, :, None] - x) ** 2).min(-1)
    assert (sampling.squared_distance(mask) == want).all()
    assert np.isinf(sampling.squared_distance(np.zeros((3, 3), dtype=bool))).all()


@pytest.mark.parametrize("shape", [(12, 12), (5, 8, 8)])
def test_growth_equals_search(shape):
    allowed = rng.random(shape) < 0.45
    seeds = allowed & (rng.random(shape) < 0.05)
    faces = [s for s in np.ndindex(*(3,) * len(shape)) if sum(abs(k - 1) for k in s) == 1 or (len(shape) == 2 and s != (1, 1))]
    found, stack = set(map(tuple, np.argwhere(seeds))), list(map(tuple, np.argwhere(seeds)))
    while stack:
        at = stack.pop()
        for s in faces:
            to = tuple(a + k - 1 for a, k in zip(at, s, strict=True))
            if all(0 <= t < n for t, n in zip(to, shape, strict=True)) and allowed[to] and to not in found:
                found.add(to)
                stack.append(to)
    assert set(map(tuple, np.argwhere(masks.grow(seeds, allowed)))) == found


def test_smoothing_equals_direct_sum():
    image = rng.random((1, 9, 9))
    r, s = 4, 1.0
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
    k = np.outer(k, k) / k.sum() ** 2
    wide = np.pad(image[0], r, mode="symmetric")
    want = [[(wide[y : y + 9, x : x + 9] * k).sum() for x in range(9)] for y in range(9)]
    assert np.allclose(P.smooth(image, s)[0], want)
    assert np.allclose(P.laplacian_of_gaussian(np.ones((1, 9, 9)), 1.0), P.laplacian_of_gaussian(2 * np.ones((1, 9, 9)), 1.0) / 2)


def test_components():
    mask = np.array([[1, 1, 0, 1], [0, 0, 0, 1], [1, 0, 0, 1]], dtype=bool)
    got = {k: v[0] for k, v in P.component_geometry(mask[None], np.ones((1, 3, 4))).items()}
    assert (got["component_count"], got["largest_area"], got["solidity"]) == (3, 3, 1)
    assert got["elongation"] == 0 and got["eccentricity"] == 1 and abs(got["circularity"] - 4 * np.pi * 6 / 36) < 1e-12
    assert all((v == 0).all() for v in P.component_geometry(np.zeros((2, 2, 2), dtype=bool), np.ones((2, 2, 2))).values())
    assert all(len(v) == 0 for v in P.component_geometry(np.zeros((0, 2, 2), dtype=bool), np.ones((0, 2, 2))).values())


def test_labels_equal_search():
    masks_ = rng.random((40, 9, 7)) < 0.55
    for mask, got in zip(masks_, P.label(masks_), strict=True):
        seen = {}
        for start in map(tuple, np.argwhere(mask)):
            stack = [] if start in seen else [start]
            first = start[0] * 7 + start[1]
            while stack:
                y, x = stack.pop()
                if 0 <= y < 9 and 0 <= x < 7 and mask[y, x] and (y, x) not in seen:
                    seen[y, x] = first
                    stack += [(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)]
        assert all(got[at] == seen.get(at, 63) for at in np.ndindex(9, 7))


def test_patterns_and_energies():
    flat = np.ones((2, 8, 8))
    entropy, uniform = P.local_patterns(flat)
    assert (entropy == 0).all() and (uniform == 1).all()
    assert np.allclose(P.scale_energies(flat), 0)
    assert P.scale_energies(rng.random((3, 8, 8))).shape == (3, 3)


def test_peaks():
    assert P.peaks(np.array([0, 3, 1, 5, 5, 0.0])) == 2
    assert P.peaks(np.array([0, 3, 2.9, 5, 0.0])) == 1
    assert P.peaks(np.array([1, 2, 3.0])) == 0


def test_ward_parts_clear_groups():
    points = np.concatenate([rng.normal(c, 0.01, (5, 2)) for c in ((0, 0), (5, 5), (9, 0))])
    labels = models.ward_labels(points, 3)
    assert [len(set(labels[i : i + 5])) for i in (0, 5, 10)] == [1, 1, 1] and len(set(labels)) == 3


def test_numpy_sample_is_seeded(spark):
    df = spark.createDataFrame([("s", g, y, x) for g in ("a", "b") for y in range(6) for x in range(6)], "sample string, grp string, y int, x int")
    one, two = (sorted(map(tuple, sampling.numpy_sample(df, "sample", "grp", ["a", "b"], 5, 42).collect())) for _ in range(2))
    assert one == two and len(one) == 10


def test_reduced_axes(spark):
    import pandas as pd

    base = rng.normal(size=(300, 1))
    frame = pd.DataFrame(np.hstack([base, base * 2 + rng.normal(0, 0.1, (300, 1)), rng.normal(size=(300, 1)), np.ones((300, 1))]), columns=list("abcd"))
    axes, loadings = models.principal_axes(spark.createDataFrame(frame), list("abcd"), 3)
    table = loadings.toPandas().pivot(index="axis", columns="feature", values="loading").to_numpy()
    assert table.shape == (3, 3) and np.allclose(table @ table.T, np.eye(3), atol=1e-8)
    explained = loadings.select("axis", "explained").distinct().orderBy("axis").toPandas()["explained"]
    assert explained.is_monotonic_decreasing and abs(explained.sum() - 1) < 1e-9
    labels = models.clusters(axes.select("*", axes["pca"][0].alias("p")), ["p"], 2, 1, "kmeans").select("cluster_id").distinct().count()
    assert labels == 2


def test_confidence_keeps_its_floor(spark):
    rows = [("a", y, x, float(y == 4 and x == 4)) for y in range(8) for x in range(8)] + [("b", y, x, 3.0) for y in range(8) for x in range(8)]
    got = masks.confidence(spark.createDataFrame(rows, "k string, y int, x int, v double"), ["k"], 8, sigma=1.0, floor=0.3).toPandas()
    a, b = got[got.k == "a"], got[got.k == "b"]
    assert abs(a.value.min() - 0.3) < 1e-12 and a.value.max() == 1 and len(a) == 64
    assert (a.loc[a.value.idxmax()][["y", "x"]] == [4, 4]).all() and np.allclose(b.value, 0.3)
