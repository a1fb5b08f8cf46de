"""Gaussian mixtures fitted by expectation-maximisation, and similarity sets linked within their components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .batches import Kept, map_groups
from .components import components

#: Distinct points of a cell from which only its outermost points are kept for links to other cells.
DENSE = 8
#: Most points of a cell that are searched for the outermost in one go.
PART_POINTS = 5_000
#: Cells of the summary on which the number of components is searched for.
CELLS = 4_096


@dataclass(frozen=True)
class Mixture:
    """``weights[k]``, ``means[k]`` and ``covariances[k]`` of the reduced features ``axes @ (x - centre)``.

    ``tried`` holds the information criterion of each number of components as the search estimated it, ``converged`` whether the
    steps over all rows came to rest.
    """

    features: tuple[str, ...]
    centre: np.ndarray
    axes: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    criterion: float
    tried: dict[int, float]
    converged: bool

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each row of ``x`` under each component."""
        return _log_densities((x - self.centre) @ self.axes.T, self.weights, self.means, self.covariances)

    def rivals(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The component of each row, which others a row within ``reach`` of it could have, and the log density.

        The log ratio of two components is quadratic in ``x``; over the box of half-widths ``reach`` it falls by at
        most ``|gradient| . reach + 1/2 reach' |curvature| reach``.
        """
        logs = self.log_densities(x)
        own, z = logs.argmax(1), (x - self.centre) @ self.axes.T
        precise = [np.linalg.inv(c) for c in self.covariances]
        slope = np.stack([(m - z) @ p @ self.axes for m, p in zip(self.means, precise, strict=True)], 1)
        bend = np.stack([self.axes.T @ p @ self.axes for p in precise])
        curve = 0.5 * np.einsum("i,lkij,j->lk", reach, np.abs(bend[:, None] - bend[None]), reach)
        at = np.arange(len(x))
        fall = np.abs(slope[at, own][:, None] - slope) @ reach + curve[own]
        gap = logs[at, own][:, None] - logs
        near = gap <= fall * (1 + 1e-9) + 1e-9
        near[at, own] = False
        return own, near, logs[at, own]


def _log_densities(z: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    out = np.empty((len(z), len(weights)))
    for k, (w, m, c) in enumerate(zip(weights, means, covariances, strict=True)):
        root = np.linalg.cholesky(c)
        off = (z - m) @ np.linalg.inv(root).T
        out[:, k] = np.log(w) - 0.5 * np.einsum("ij,ij->i", off, off) - np.log(np.diag(root)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
    return out


def _shares(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities of each row, and its log likelihood."""
    top = logs.max(1)
    share = np.exp(logs - top[:, None])
    norm = share.sum(1)
    return share / norm[:, None], top + np.log(norm)


def _updated(count: np.ndarray, first: np.ndarray, second: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances out of the components' sums."""
    count = np.maximum(count, 1e-9)
    means = first / count[:, None]
    r = means.shape[1]
    return count / count.sum(), means, second.reshape(-1, r, r) / count[:, None, None] - means[:, :, None] * means[:, None, :] + ridge * np.eye(r)


def _penalty(k: int, r: int, n: int) -> float:
    return (k - 1 + k * r + k * r * (r + 1) / 2) * np.log(n)


def _cell_fit(n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int, seed: int, ridge: float, gain: float, steps: int = 200) -> tuple[float, tuple]:
    """Log likelihood (a lower bound) and parameters of ``k`` components over cells with counts, sums and products.

    Means start at cells drawn one after another, each far from those before it. Rows of a cell share its responsibilities.
    """
    rng, z = np.random.default_rng(seed), s / n[:, None]
    r = z.shape[1]
    inner = q / n[:, None] - (z[:, :, None] * z[:, None, :]).reshape(len(z), r * r)
    means, far = z[[rng.choice(len(z), p=n / n.sum())]], None
    while len(means) < k:
        gap = ((z - means[-1]) ** 2).sum(1)
        far = gap if far is None else np.minimum(far, gap)
        odds = far * n
        means = np.vstack([means, z[rng.choice(len(z), p=odds / odds.sum()) if odds.sum() > 0 else rng.integers(len(z))]])
    now, last = (np.full(k, 1 / k), means, np.stack([np.eye(r) * max(float((n @ (z - n @ z / n.sum()) ** 2).sum() / n.sum() / r / k), ridge)] * k)), -np.inf
    for _ in range(steps):
        logs = _log_densities(z, *now) - 0.5 * inner @ np.linalg.inv(now[2]).reshape(k, r * r).T
        share, each = _shares(logs)
        likely = float(n @ each)
        if likely - last < gain:
            break
        last = likely
        now = _updated(share.T @ n, share.T @ s, share.T @ q, ridge)
    return likely, now


def fit(
    rows: DataFrame, features: list[str], kept_variance: float = 0.95, cells: int = CELLS, starts: int = 3, finalists: int = 2, steps: int = 30, gain: float = 0.05, ridge: float = 1e-3,
    most: int | None = None,
) -> Mixture | None:
    """The mixture with the smallest Bayesian information criterion over all rows; None for no rows.

    Features are standardised and reduced to the principal axes that hold ``kept_variance`` of them. How many components there are, and where
    they start, is searched for on a summary of all rows: Spark adds up counts, sums and products in at most ``cells`` cells of
    a grid over the axes (rows far out fall into its outermost cells), and tasks fit every number of components from ``starts`` seeded starts
    to it. Numbers are tried in runs of eight for as long as the last run holds the best one, so none is the largest by decree, unless ``most`` says so (for a
    mixture that only has to part the rows, not to describe them). The ``finalists``
    then take expectation-maximisation steps over all rows: each is one job, every task adds up its responsibilities, and only
    sums (one row for each component) reach the driver. Steps end where one gains less than ``gain`` times the
    criterion's penalty of a component; a fit that hasn't by then is given out with ``converged`` false. ``ridge`` is added to the diagonal of each
    covariance. Seeds are fixed, so the fit is the same on every run up to the order of sums. Rows with null or non-finite
    features must have been removed. The rows are packed once into blocks of Arrow batches, which each step reads.
    """
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    first = rows.agg(F.count(F.lit(1)), *[F.avg(f) for f in features], *[F.covar_pop(features[i], features[j]) for i, j in pairs]).first()
    n = first[0]
    if not n:
        return None
    centre, spread = np.array(first[1 : d + 1], dtype=float), np.zeros((d, d))
    for (i, j), v in zip(pairs, first[d + 1 :], strict=True):
        spread[i, j] = spread[j, i] = v
    scale = np.sqrt(np.diag(spread))
    scale[scale <= 0] = 1.0
    values, vectors = np.linalg.eigh(spread / np.outer(scale, scale))
    values, vectors = values[::-1], vectors[:, ::-1]
    r = min(1 + int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), kept_variance - 1e-12)), d)
    axes = vectors[:, :r].T / scale

    doubles = rows.select(*[F.col(f).cast("double").alias(f) for f in features])
    blocks = written(doubles.mapInArrow(_pack, ", ".join(f"`{f}` array<double>" for f in features)), "blocks")
    moments = [(i, j) for i in range(r) for j in range(r)]
    names = [*[f"s{i}" for i in range(r)], *[f"m{i}{j}" for i, j in moments]]

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x in (np.stack([c[i].values.to_numpy() for c in b.columns], 1) for b in batches for i in range(b.num_rows)):
            z = (x - centre) @ axes.T
            yield z, (z[:, :, None] * z[:, None, :]).reshape(len(z), r * r)

    side = max(2, int(cells ** (1 / r) + 1e-9))
    width = np.sqrt(np.maximum(values[:r], 1e-12)) * 8 / side

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side**r, 1 + r + r * r))
        for z, square in reduced(batches):
            place = np.clip(np.floor(z / width) + side // 2, 0, side - 1).astype(int) @ (side ** np.arange(r))
            for i, column in enumerate([np.ones(len(z)), *z.T, *square.T]):
                total[:, i] += np.bincount(place, column, minlength=len(total))
        held = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(held.astype("int32")), *[pa.array(c) for c in total[held].T]], ["cell", "n", *names])

    table = blocks.mapInArrow(summed, "cell int, n double, " + ", ".join(f"{c} double" for c in names)).groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).toPandas().sort_values("cell")
    summary = (table["n"].to_numpy(), table[names[:r]].to_numpy(), table[names[r:]].to_numpy())
    least = gain * (_penalty(2, r, max(n, 2)) - _penalty(1, r, max(n, 2)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, start in zip(batch["k"], batch["start"], strict=True):
                likely, (w, m, c) = _cell_fit(*summary, int(k), int(start), ridge, least)
                yield pd.DataFrame({"k": [int(k)], "likely": [likely], "parts": [[*map(float, w), *map(float, m.ravel()), *map(float, c.ravel())]]})

    spark, tried, models, upto = rows.sparkSession, {}, {}, 0
    most = min(n, len(table), most or n)
    while upto < most and (not tried or min(tried, key=tried.get) > upto - 8):
        wanted = [(k, start) for k in range(upto + 1, min(upto + 8, most) + 1) for start in range(starts if k > 1 else 1)]
        upto = wanted[-1][0]
        found = spark.createDataFrame(wanted, "k int, start int").repartition(min(len(wanted), spark.sparkContext.defaultParallelism)).mapInPandas(search, "k int, likely double, parts array<double>")
        for one in sorted(found.collect(), key=lambda o: (o["k"], o["likely"], o["parts"])):  # a few numbers for each start
            k, parts = one["k"], np.array(one["parts"])
            tried[k] = float(_penalty(k, r, n) - 2 * one["likely"])
            models[k] = (parts[:k], parts[k : k + k * r].reshape(k, r), parts[k + k * r :].reshape(k, r, r))
    last = sorted(tried, key=lambda k: (tried[k], k))[:finalists]
    likely, active = {}, set(last)
    for _ in range(steps):
        now = {k: models[k] for k in active}

        def step(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros((k, 2 + r + r * r)) for k in now}
            for z, square in reduced(batches):
                for k, model in now.items():
                    share, each = _shares(_log_densities(z, *model))
                    total[k][:, 0] += share.sum(0)
                    total[k][0, 1] += each.sum()
                    total[k][:, 2 : 2 + r] += share.T @ z
                    total[k][:, 2 + r :] += share.T @ square
            made = pd.concat([pd.DataFrame(t, columns=["n", "ll", *names]).assign(k=np.int32(k), component=np.arange(k, dtype="int32")) for k, t in total.items()])
            yield pa.RecordBatch.from_pandas(made[["k", "component", "n", "ll", *names]], preserve_index=False)

        sums = blocks.mapInArrow(step, "k int, component int, " + ", ".join(f"{c} double" for c in ("n", "ll", *names))).groupBy("k", "component").agg(*[F.sum(c).alias(c) for c in ("n", "ll", *names)])
        for k, t in sums.toPandas().sort_values(["k", "component"]).groupby("k"):
            ll, before = float(t["ll"].sum()), likely.get(k, -np.inf)
            likely[k] = ll
            if ll - before < least:
                active.discard(k)
            else:
                models[k] = _updated(t["n"].to_numpy(), t[names[:r]].to_numpy(), t[names[r:]].to_numpy(), ridge)
        if not active:
            break
    score = {k: float(_penalty(k, r, n) - 2 * likely[k]) for k in last}
    best = min(last, key=lambda k: (score[k], k))
    return Mixture(tuple(features), centre, axes, *models[best], score[best], tried, best not in active)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row of lists."""
    for b in batches:
        if b.num_rows:
            ends = pa.array([0, b.num_rows], type=pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in b.columns], b.schema.names)


def assign(rows: DataFrame, model: Mixture, identity: list[str], reach: list[float] | None = None) -> DataFrame:
    """``identity..., features..., component, log_density``, and with ``reach`` the ``rivals`` (see :meth:`Mixture.rivals`)."""
    features = list(model.features)
    kept = rows.select(*identity, *[F.col(f).cast("double").alias(f) for f in features])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    wide = np.array(reach if reach is not None else [0.0] * len(features))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(float)
            own, near, dense = model.rivals(x, wide)
            out = batch.assign(component=own.astype("int32"), log_density=dense)
            if reach is not None:
                out["rivals"] = [np.flatnonzero(r).astype("int32") for r in near]
            yield out

    return kept.mapInPandas(run, schema + ", component int, log_density double" + (", rivals array<int>" if reach is not None else ""))


def outermost(points: np.ndarray) -> np.ndarray:
    """Which points no other point passes in all directions of some octant (the union of its Pareto fronts)."""
    keep = np.zeros(len(points), dtype=bool)
    for signs in itertools.product((1.0, -1.0), repeat=points.shape[1]):
        p = points * signs
        order = np.lexsort(p.T)[::-1]
        front = np.empty((0, p.shape[1]))
        for i in order:
            if not len(front) or not (front >= p[i]).all(1).any():
                front = np.vstack([front, p[i]])
                keep[i] = True
    return keep


def linked_sets(rows: DataFrame, model: Mixture, group: str, identity: str, reach: list[float], least: int, dense: int = DENSE) -> DataFrame:
    """``identity, root``: rows of one ``group`` joined by likeness, directly or through others, in sets of ``least`` or more.

    Two rows are alike if each feature differs by at most its ``reach``. The mixture's components divide a group
    into blocks: a row also enters every component that a row alike to it could have, so each alike pair meets in a
    block, however large a group is. In a block, cells as wide as the reach hold mutually alike rows, which
    hang on the smallest identity of the cell; between cells only the outermost points of a cell can matter,
    so copies and crowds are never expanded into pairs. Row and cell links then give the sets as connected components.
    ``root`` is the smallest identity of its set. ``identity`` must be unique; differences within one rounding step
    of the reach may count either way.
    """
    features, d = list(model.features), len(reach)
    values = [f"_v{i}" for i in range(d)]
    placed = assign(rows, model, [identity, group], reach)
    members = placed.select(
        F.col(identity).alias("_id"), F.col(group).alias("_group"), *[F.col(f).alias(v) for f, v in zip(features, values, strict=True)],
        F.posexplode(F.concat(F.array("component"), "rivals")).alias("_away", "_block"),
    )
    cells = [f"_c{i}" for i in range(d)]
    members = members.select("*", *[F.floor(F.col(v) / float(t)).alias(c) for v, t, c in zip(values, reach, cells, strict=True)])
    members = written(members, "members")
    block = ["_group", "_block", *cells]
    reps = members.groupBy(*block).agg(F.min("_id").alias("_rep"))
    members = written(members.join(reps, block).select("_id", "_away", "_rep", *block, *values), "cells")

    points = members.select(*block, "_rep", *values).distinct()
    crowd = points.groupBy(*block).agg(F.count(F.lit(1)).alias("_points"))
    held = points.join(crowd, block)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)

    def outer(*columns: np.ndarray) -> Kept:
        return np.flatnonzero(outermost(np.column_stack(columns))), {}

    crowded = held.where(F.col("_points") > dense).withColumn("_part", F.pmod(F.xxhash64(*values), F.ceil(F.col("_points") / PART_POINTS)))
    fronts = map_groups(crowded, [*block, "_part"], [], values, outer, schema, drop=("_part",))
    large = F.col("_points") > PART_POINTS
    fronts = fronts.where(~large).unionByName(map_groups(fronts.where(large), block, [], values, outer, schema))
    fronts = held.where(F.col("_points") <= dense).unionByName(fronts)

    wide = [F.array_distinct(F.array(F.floor(F.col(v) / (2.0 * t)), F.floor((F.col(v) + float(t) * (1 + 1e-9)) / (2.0 * t)))) for v, t in zip(values, reach, strict=True)]
    met = fronts.select("_group", "_rep", *values, *[w.alias(f"_w{i}") for i, w in enumerate(wide)], "_block")
    for i in range(d):
        met = met.withColumn(f"_w{i}", F.explode(f"_w{i}"))
    met = met.select(F.xxhash64("_group", "_block", *[f"_w{i}" for i in range(d)]).alias("_key"), "_group", "_rep", *values)
    left, right = met.alias("l"), met.alias("r")
    alike = (F.col("l._group") == F.col("r._group")) & (F.col("l._rep") < F.col("r._rep"))
    for v, t in zip(values, reach, strict=True):
        alike = alike & (F.abs(F.col(f"l.{v}") - F.col(f"r.{v}")) <= float(t))
    across = left.join(right, F.col("l._key") == F.col("r._key")).where(alike).select(F.col("l._rep").alias("a"), F.col("r._rep").alias("b")).distinct()

    of = members.select("_id", "_away", "_rep")
    home = of.where("_away = 0").select("_id", F.col("_rep").alias("_home"))
    stitched = of.where("_away > 0").join(home, "_id").where("_home != _rep").select(F.col("_home").alias("a"), F.col("_rep").alias("b"))
    joined = components(across.unionByName(stitched))
    rooted = home.join(joined, F.col("_home") == F.col("node"), "left").select("_id", F.coalesce("root", "_home").alias("root"))
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("root")
    return rooted.join(sizes, "root").select(F.col("_id").alias(identity), "root")
