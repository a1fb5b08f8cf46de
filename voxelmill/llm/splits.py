"""Splits that keep related records together, balanced by largest differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components, star_edges

#: Equal bins that the groups are packed into, groups that one task packs, and packings that one task combines.
BINS = 100
TASK_GROUPS = 10_000
FAN = 64


def related(rows: DataFrame, identity: str, keys: list[str]) -> DataFrame:
    """``identity, group_id``: records that share a non-null value of any of ``keys``, directly or through others.

    ``group_id`` is the smallest identity of the group. Records related to no other are groups of their own;
    null identities take no part; repeated rows count once.
    """
    edges = None
    for key in keys:
        one = star_edges(rows, identity, key)
        edges = one if edges is None else edges.unionByName(one)
    found = components(edges).select(F.col("node").alias(identity), F.col("root").alias("group_id"))
    every = rows.where(F.col(identity).isNotNull()).select(identity).distinct()
    return every.join(found, identity, "left").select(identity, F.coalesce("group_id", identity).alias("group_id"))


def combine_packings(loads: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The final bin of each bin of each packing (``loads[packing, bin]``; -1 where a bin isn't ``used``).

    Largest differencing: the two packings of the widest spread are combined again and again, the heaviest bin of one with
    the lightest of the other.
    """
    n, bins = loads.shape
    out = np.full((n, bins), -1)
    if not n:
        return out
    heap, contents = [], []
    for i in range(n):
        order = np.argsort(loads[i], kind="stable")
        contents.append((loads[i][order], [(i, int(k)) if used[i, k] else None for k in order]))
        heap.append((-float(loads[i].max() - loads[i].min()), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        (x, xs), (y, ys) = contents[i], contents[j]
        contents[j] = None
        load = x + y[::-1]
        order = np.argsort(load, kind="stable")
        held = [a if b is None else b if a is None else [a, b] for a, b in zip(xs, ys[::-1], strict=True)]
        contents[i] = (load[order], [held[k] for k in order])
        heapq.heappush(heap, (-float(load.max() - load.min()), i))
    for k, top in enumerate(contents[heap[0][1]][1]):
        stack = [] if top is None else [top]
        while stack:
            one = stack.pop()
            if isinstance(one, list):
                stack.extend(one)
            else:
                out[one] = k
    return out


def largest_differencing(weights: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each weight: :func:`combine_packings` of packings that hold one weight each."""
    loads = np.zeros((len(weights), bins))
    loads[:, -1] = weights
    used = np.zeros(loads.shape, dtype=bool)
    used[:, -1] = True
    return combine_packings(loads, used)[:, -1]


def pack(groups: DataFrame, group: str, weight: str, bins: int = BINS, task_groups: int = TASK_GROUPS, fan: int = FAN) -> DataFrame:
    """``group, weight, bin``: whole groups packed into ``bins`` of nearly equal weight by largest differencing.

    Buckets of about ``task_groups`` groups are packed by themselves. A packing is then one item of the same differencing: ``fan``
    of them are combined in a task, and so on level by level until one is left, so no task holds more than one bucket's
    groups or ``fan`` packings of ``bins`` loads. ``groups`` is read twice and should be a written table.
    """
    buckets = max(1, -(-groups.count() // task_groups))
    laid = groups.select(group, F.col(weight).cast("double").alias(weight), F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int").alias("_bucket"))
    kind = laid.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(group, ignore_index=True)
        return pdf.assign(_bin=largest_differencing(pdf[weight].to_numpy(), bins).astype("int32"))

    packed = laid.groupBy("_bucket").applyInPandas(one, f"`{group}` {kind}, `{weight}` double, _bucket int, _bin int")
    if buckets == 1:
        return packed.select(group, weight, F.col("_bin").alias("bin"))
    packed = written(packed, "packed")
    now = packed.groupBy("_bucket", "_bin").agg(F.sum(weight).alias("_load")).select("_bucket", "_bin", F.col("_bucket").alias("_node"), F.col("_bin").alias("_at"), "_load")

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(pdf["_node"].to_numpy(), return_inverse=True)
        loads, used = np.zeros((len(nodes), bins)), np.zeros((len(nodes), bins), dtype=bool)
        loads[at, pdf["_at"]], used[at, pdf["_at"]] = pdf["_load"], True
        return pdf.assign(_to=combine_packings(loads, used)[at, pdf["_at"]].astype("int32"))

    while buckets > 1:
        now = written(now, "packings")
        buckets = -(-buckets // fan)
        sums = now.groupBy("_node", "_at").agg(F.sum("_load").alias("_load")).withColumn("_next", F.floor(F.col("_node") / fan).cast("int"))
        moved = sums.groupBy("_next").applyInPandas(level, "_node int, _at int, _load double, _next int, _to int").select("_node", "_at", "_next", "_to")
        now = now.join(moved, ["_node", "_at"]).select("_bucket", "_bin", F.col("_next").alias("_node"), F.col("_to").alias("_at"), "_load")
    return packed.join(now, ["_bucket", "_bin"]).select(group, weight, F.col("_at").alias("bin"))


def grouped_split(rows: DataFrame, identity: str, keys: list[str], targets: DataFrame, name: str = "split_name", share: str = "target_share", bins: int = BINS) -> DataFrame:
    """``identity, group_id, bin, split``: every record with its group, whole groups in one split.

    Groups of related records are packed into equal bins, heaviest bins first go to the split that is furthest
    below its target. A group heavier than a bin stays whole, so shares can be met only to its weight. Targets are
    few (their number is that of the splits); null names and shares take no part, shares are scaled to sum to 1.
    """
    goals = [(r[0], float(r[1])) for r in targets.where(F.col(name).isNotNull() & (F.col(share) > 0)).select(name, share).orderBy(F.col(share).desc(), name).collect()]
    if not goals:
        raise ValueError("no split has a target above 0")
    members = written(related(rows, identity, keys), "members")
    packed = written(pack(members.groupBy("group_id").agg(F.count(F.lit(1)).alias("weight")), "group_id", "weight", bins), "bins")
    load = {r["bin"]: r["w"] for r in packed.groupBy("bin").agg(F.sum("weight").alias("w")).collect()}  # one row for each of the bins
    whole, filled, to = sum(load.values()) or 1.0, {g: 0.0 for g, _ in goals}, {}
    scale = sum(s for _, s in goals)
    for k in sorted(load, key=lambda k: (-load[k], k)):
        best = max(goals, key=lambda g: (g[1] / scale * whole - filled[g[0]]))[0]
        filled[best] += load[k]
        to[k] = best
    splits = rows.sparkSession.createDataFrame([(k, v) for k, v in to.items()], f"bin int, split {targets.schema[name].dataType.simpleString()}")
    return members.join(packed.join(splits, "bin").select("group_id", "bin", "split"), "group_id").select(identity, "group_id", "bin", "split")


def together(placed: DataFrame, identity: str, salt_rows: int = 1_000) -> DataFrame:
    """``identity_a, identity_b``: all pairs of records that :func:`grouped_split` keeps in one group and one split, the smaller identity first.

    The result has a row for each pair, so it grows with the square of a group. One side of a large group is spread over salts of about
    ``salt_rows`` records, so no task joins a whole group with itself.
    """
    place = ["group_id", "split"]
    sizes = placed.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / salt_rows).alias("_salts"))
    every = placed.select(identity, *place).join(sizes, place)
    left = every.withColumn("_salt", F.pmod(F.xxhash64(identity), F.col("_salts"))).drop("_salts").withColumnRenamed(identity, f"{identity}_a")
    right = every.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts").withColumnRenamed(identity, f"{identity}_b")
    pairs = left.join(right, [*place, "_salt"]).where(F.col(f"{identity}_a") < F.col(f"{identity}_b"))
    return pairs.select(f"{identity}_a", f"{identity}_b")
