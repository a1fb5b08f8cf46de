"""Top N of every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import fresh

#: Subgroups into which the hash of its identifier puts each row of a group.
SALTS = 32


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], identity: list[str], most: int, rank: str, salts: int = SALTS, limit: str | None = None) -> DataFrame:
    """The first ``most`` rows of each group in ``order``, with their rank in the column ``rank``.

    ``limit`` names a column with the group's own number, at most ``most``; then no group sends more than ``salts`` times that to stage two.

    Stage one ranks within ``salts`` subgroups of a group (by the hash of ``identity``), so a group with a
    third of all rows is spread over as many tasks; stage two ranks the at most ``salts * most`` survivors.
    ``order`` must be total, or ties take any order. Null keys form a group of their own, as in SQL.
    """
    salt, first = fresh(df.withColumn(rank, F.lit(0)), "salt", "first")
    near = Window.partitionBy(*keys, salt).orderBy(*order)
    far = Window.partitionBy(*keys).orderBy(*order)
    own = F.lit(most) if limit is None else F.col(limit)
    kept = (
        df.withColumn(salt, F.pmod(F.xxhash64(*identity), F.lit(salts)))
        .withColumn(first, F.row_number().over(near)).where((F.col(first) <= most) & (F.col(first) <= own)).drop(salt, first)
    )
    return kept.withColumn(rank, F.row_number().over(far)).where((F.col(rank) <= most) & (F.col(rank) <= own))


def top_n(df: DataFrame, keys: list[str], score: str, tie: str, n: int, rank: str = "rank", salts: int = SALTS, limit: str | None = None) -> DataFrame:
    """The ``n`` rows with the highest ``score`` of every group; equal scores go by smaller ``tie``.

    With ``limit``, a column with each group's own number (null for none), at most that many of the ``n`` are kept.

    Rows with a null key, a null or NaN score or a null ``tie`` are never kept; infinite scores rank as numbers.
    Smaller groups keep all they have; rows equal in key, score and tie are kept as rows of their own. An
    empty table gives an empty result. Other columns are kept, whatever their names; a column named like
    ``rank`` is replaced.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    whole = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(tie).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return salted_rank(df.where(whole), keys, [F.col(score).desc(), F.col(tie).asc()], [tie], n, rank, salts, limit)
