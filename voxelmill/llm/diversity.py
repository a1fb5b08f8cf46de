"""A varied subset by determinantal greedy selection over composable core-sets."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .batches import Kept, map_groups
from .ranking import salted_rank

#: Most rows of a kind of a group that meet in one part.
PART_ROWS = 20_000


def greedy(value: np.ndarray, kind: np.ndarray, radius: float, size: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order in which they raise the kernel's determinant most, and their gains.

    The kernel of two rows of one ``kind`` is ``max(0, 1 - |a - b| / radius)`` (positive definite in one
    dimension), 0 for rows of different kinds. Each step takes the largest remaining variance (the factor by
    which the determinant grows; the first row among equals) and updates all others by one new row of the
    Cholesky factor. Stops at ``size`` rows or where the largest variance is below ``gain`` (at least 1e-9, below which
    a row is taken for a copy).
    """
    n = len(value)
    size = min(size, n)
    left = np.ones(n)
    factor = np.zeros((min(size, 64), n))
    order, gains = [], []
    while len(order) < size:
        j = int(np.argmax(left))
        if left[j] < max(gain, 1e-9):
            break
        t = len(order)
        if t == len(factor):
            factor = np.vstack([factor, np.zeros((min(size - t, t), n))])
        near = np.flatnonzero((np.abs(value - value[j]) < radius) & (kind == kind[j]))
        row = np.maximum(0.0, (radius - np.abs(value[near] - value[j])) / radius) - factor[:t, j] @ factor[:t, near]
        row /= np.sqrt(left[j])
        factor[t, near] = row
        order.append(j)
        gains.append(left[j])
        left[near] -= row * row
        left[j] = -np.inf
    return np.array(order, dtype=int), np.array(gains, dtype=float)


def core_set(
    rows: DataFrame, groups: list[str], kind: str, value: str, identity: str, radius: float, size: str | int | None = None, gain: float = 0.0, fill: bool = False, part_rows: int = PART_ROWS
) -> DataFrame:
    """Per group of ``groups`` the rows that greedy selection keeps: ``groups..., kind, value, identity, gain``, with a size also ``place``.

    ``size`` is a column of ``rows`` (the same all over a group), a number, or None for no bound but ``gain``. The kernel is 0 between
    kinds, so each kind of a group is selected from by itself and the kinds' rows are merged by their gains, which is the order of a joint
    selection. A kind with more than ``part_rows`` rows is split by the hash of ``identity``; each part gives its greedy core-set, and
    the core-sets are split and reduced again, level by level, until one part is left: no task holds more than a part. (A size near
    ``part_rows`` doubles the parts, for a selection can't be made from less than itself.) A row that is ``radius``
    or more from all others of its kind keeps the full gain of 1 in every pass: with ``gain=1`` and no bound on the size
    no such row is ever left out. With ``fill`` seats that no row with a gain is left for go to the first other rows by identity.

    Rows with a null group, a null or non-finite value, a null identity or a null size take no part; a null kind
    is a kind of its own. An empty table gives an empty result. Equal gains go by smaller identity. ``rows`` is read once for each level.
    """
    mine = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")) & F.col(identity).isNotNull())
    bound = 1 << 40
    wanted = F.lit(bound if size is None else size) if size is None or isinstance(size, int) else F.col(size)
    blocks = list(dict.fromkeys([*groups, kind]))
    mine = mine.select(*blocks, F.col(value).cast("double").alias(value), F.col(identity), wanted.cast("bigint").alias("_size")).where("_size > 0")
    for g in groups:
        mine = mine.where(F.col(g).isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mine.schema.fields) + ", gain double"

    def pick(values: np.ndarray, sizes: np.ndarray) -> Kept:
        order, gains = greedy(values, np.zeros(len(values), dtype=int), radius, int(sizes[0]), gain)
        return order, {"gain": gains}

    def reduced(df: DataFrame, *part: str) -> DataFrame:
        return map_groups(df, [*blocks, *part], [identity], [value, "_size"], pick, schema, drop=part)

    now, most = mine, part_rows + 1
    while True:
        counts = now.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n"))
        last, most = most, counts.agg(F.max("_n")).first()[0] or 0
        if most <= part_rows:
            break
        if most > 0.7 * last and now is not mine:
            part_rows *= 2
            continue
        same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in blocks])
        parts = counts.select(*[F.col(b).alias(f"_{b}") for b in blocks], F.ceil(F.col("_n") / part_rows).alias("_parts"))
        laid = now.join(parts, same).withColumn("_part", F.pmod(F.xxhash64(identity), F.col("_parts"))).select(*mine.columns, "_part")
        now = written(reduced(laid, "_part").drop("gain"), "core-sets")
    chosen = reduced(now)
    if size is None:
        return chosen.drop("_size")
    top = mine.agg(F.max("_size")).first()[0] or 0
    order = [F.col("gain").desc(), F.col(identity)]
    if fill:
        chosen = written(chosen, "chosen")
        got = chosen.groupBy(*groups).agg(F.count(F.lit(1)).alias("_got"))
        free = mine.join(got, groups, "left").withColumn("_free", F.greatest(F.col("_size") - F.coalesce("_got", F.lit(0)), F.lit(0))).where("_free > 0")
        rest = free.join(chosen.select(*groups, identity), [*groups, identity], "left_anti")
        rest = salted_rank(rest, groups, [F.col(identity)], [identity], top, "_place", limit="_free").withColumn("gain", F.lit(0.0))
        chosen = chosen.unionByName(rest.select(*chosen.columns))
    placed = salted_rank(chosen, groups, order, [identity], top, "_place", limit="_size")
    return placed.withColumn("place", (F.col("_place") - 1).cast("int")).drop("_size", "_place")


def isolated(core: DataFrame, rows: DataFrame, groups: list[str], value: str, identity: str, radius: float) -> DataFrame:
    """Of the rows of ``core`` those that are ``radius`` or more from every other row of their group in ``rows``.

    The exact check behind a core-set taken with ``gain=1``: candidates meet the rows of the three buckets of width
    ``radius`` around them, in which fewer than two mutually distant candidates fit. Equal values of a group are joined before, so
    a value that very many rows share meets a candidate once.
    """
    bucket = F.floor(F.col(value) / radius)
    mine = core.select(*groups, F.col(identity).alias("_mine"), F.col(value).alias("_at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"))
    others = rows.groupBy(*groups, F.col(value).alias("_value")).agg(F.min(identity).alias("_first"), F.max(identity).alias("_last"))
    others = others.withColumn("_bucket", F.floor(F.col("_value") / radius))
    other = (F.col("_first") != F.col("_mine")) | (F.col("_last") != F.col("_mine"))
    near = other & (F.abs(F.col("_at") - F.col("_value")) < radius)
    met = mine.join(others, [*groups, "_bucket"], "left").groupBy(*groups, "_mine").agg(F.max(F.coalesce(near, F.lit(False))).alias("_near"))
    return met.where("NOT _near").select(*groups, F.col("_mine").alias(identity))
