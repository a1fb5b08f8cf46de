"""A sample that matches target category proportions, drawn by divisor-method priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .ranking import SALTS, salted_rank

#: Buckets (as a power of two) that the hashes of a stratum, and bins that the scores of a domain are parted into.
BUCKET_BITS = 10
BINS = 4096


def capped(rows: DataFrame, keys: list[str], identity: list[str], cap: str, most: int, seed: int = 0, salts: int = SALTS) -> DataFrame:
    """At most ``cap`` (a column; at most ``most``) rows of each group of ``keys``, chosen by a seeded hash of ``identity``."""
    order = [F.xxhash64(F.lit(seed), *identity), *map(F.col, identity)]
    return salted_rank(rows, keys, order, identity, most, "_place", salts, limit=cap).drop("_place")


def hash_ranked(rows: DataFrame, keys: list[str], identity: list[str], limit: str, rank: str, seed: int, bits: int = BUCKET_BITS) -> DataFrame:
    """The first ``limit`` (a column) rows of each group in the order of a seeded hash, with their ``rank`` from 1.

    Hashes are spread evenly, so their upper ``bits`` part any group, however large, into equal buckets: buckets are counted, their running
    sums give each one's first rank, and rows are numbered within their bucket only. Buckets beyond the limit are left out
    before anything is sorted. ``rows`` is read twice and should be a written table.
    """
    key = F.xxhash64(F.lit("draw"), F.lit(seed), *identity)
    hashed = rows.withColumn("_key", key).withColumn("_bucket", F.shiftrightunsigned("_key", 64 - bits))
    counts = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")
    starts = counts.withColumn("_before", before).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_key", *identity)
    kept = hashed.join(starts, [*keys, "_bucket"]).where(F.col("_before") < F.col(limit))
    return kept.withColumn(rank, F.col("_before") + F.row_number().over(inside)).where(F.col(rank) <= F.col(limit)).drop("_key", "_bucket", "_before")


def seated(rows: DataFrame, keys: list[str], size: str, score: str, order: list[str], flag: str, bins: int = BINS, rounds: int = 2) -> DataFrame:
    """Every row with ``flag``: whether it is among the ``size`` (a column) smallest scores of its group; equal scores go by ``order``.

    The cut-off is found by counts: the scores of a group are binned, and running sums over the bins tell which bins lie wholly within the
    size, which wholly beyond, and which single one the cut-off falls into; its rows are binned again. Only what then shares
    the cut-off's bin is ranked, so a group that wants a billion rows ranks some hundreds in one task. Null scores are never seated.
    """
    if rounds == 0:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(score, *order))
        return rows.withColumn(flag, place <= F.col(size))
    span = rows.groupBy(*keys).agg(F.min(score).alias("_low"), (F.max(score) - F.min(score)).alias("_wide"))
    part = F.coalesce(F.try_divide(F.col(score) - F.col("_low"), F.col("_wide")), F.lit(0.0))
    binned = rows.join(span, keys).withColumn("_bin", F.when(F.col(score).isNotNull(), F.least(F.floor(part * bins), F.lit(bins - 1)))).drop("_low", "_wide")
    counts = binned.where("_bin IS NOT NULL").groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_n"))
    placed = binned.join(counts, [*keys, "_bin"], "left").drop("_bin")
    within = F.col("_before") + F.col("_n") <= F.col(size)
    edge = ~within & (F.col("_before") < F.col(size))
    clear = placed.where(~F.coalesce(edge, F.lit(False))).withColumn(flag, F.coalesce(within, F.lit(False)))
    inner = placed.where(edge).withColumn(size, F.col(size) - F.col("_before")).drop("_n", "_before")
    return clear.drop("_n", "_before").unionByName(seated(inner, keys, size, score, order, flag, bins, rounds - 1))


def draw(
    rows: DataFrame,
    targets: DataFrame,
    domain: str,
    strata: list[str],
    identity: list[str],
    share: str = "target_share",
    size: str = "sample_size",
    floor: str = "min_rows",
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """``(sample, report)`` of ``rows`` for the ``targets`` of every ``domain`` and its ``strata``.

    Rows get a random ``row_number`` in their stratum and the priority ``(rank - 0.5) / target``; the first
    ``floor`` rows of a stratum come before all others, and the ``size`` smallest priorities of a domain are kept.
    Where a stratum runs out, its seats fall to the next priorities of the others by themselves. A target
    of 0 gives no seats beyond the floor.

    The draw is written once, each candidate with its priority and whether it has a seat; sample and report both read it. The
    report has a row for each target: ``wanted`` (the larger of target and floor), ``available`` (candidates, counted up to the most
    that the target could take), ``claims`` (seats that the stratum fills of its own right: floor rows and ranks within the target), ``drawn`` (seats it
    got in the end) and ``short`` (fewer claims than wanted).

    The order is hashed apart from that of :func:`capped`, or the rows that it kept of a hot group would all come first.
    No task ranks a whole stratum or domain, see :func:`hash_ranked` and :func:`seated`.
    Rows or targets with a null domain or stratum take no part; repeated rows must be removed before.
    """
    on = [domain, *strata]
    known: Column = F.lit(True)
    for k in on:
        known = known & F.col(k).isNotNull()
    goals = targets.where(known).select(*on, F.col(share).cast("double").alias("_share"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"), F.coalesce(F.col(floor), F.lit(0)).cast("bigint").alias("_floor"))
    goals = goals.withColumn("_target", F.round(F.coalesce("_share", F.lit(0.0)) * F.col("_size"), 6)).drop("_share")
    goals = goals.withColumn("_most", F.greatest("_size", "_floor", F.ceil("_target")))
    others = [c for c in identity if c not in on]
    mine = written(rows.where(known).select(*on, *others).join(goals, on), "candidates")
    ranked = hash_ranked(mine, on, identity, "_most", "_rank", seed)
    score = F.when(F.col("_rank") <= F.col("_floor"), -1.0 / F.col("_rank")).when(F.col("_target") > 0, (F.col("_rank") - 0.5) / F.col("_target"))
    priorities = written(ranked.withColumn("_priority", score), "priorities")
    claim = (F.col("_rank") <= F.col("_floor")) | (F.col("_rank") - 1 < F.col("_target"))
    seats = written(seated(priorities.withColumn("_claim", claim), [domain], "_size", "_priority", ["_rank", *strata], "_seated").select(*on, *others, "_rank", "_priority", "_claim", "_seated"), "seats")
    sample = seats.where("_seated").select(*on, *others, F.col("_rank").alias("rank"), F.col("_priority").alias("priority"))

    counts = seats.groupBy(*on).agg(F.count(F.lit(1)).alias("available"), F.count_if("_claim").alias("claims"), F.count_if("_seated").alias("drawn"))
    held = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("available", "claims", "drawn")}
    report = goals.join(counts, on, "left").select(*on, F.greatest("_target", "_floor").alias("wanted"), *held.values())
    return sample, report.withColumn("short", F.col("claims") < F.col("wanted"))
