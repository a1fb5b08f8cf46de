"""Comparable forms of labels, paths and identifiers, as column expressions.

Every function keeps null as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_key(col: Column | str) -> Column:
    """A category label without case and outer blanks; ``-`` and blanks inside count as ``_``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"^\s+|\s+$", ""), r"[\s_-]+", "_")


def path_key(col: Column | str) -> Column:
    """A path's location: one kind of separator, none repeated, no ``.`` steps."""
    col = F.col(col) if isinstance(col, str) else col
    one = F.regexp_replace(col, r"[/\\]+", "/")
    return F.regexp_replace(F.regexp_replace(one, r"(?<=/)(\./)+|/\.?$", ""), r"^(\./)+", "")


def entry_key(col: Column | str) -> Column:
    """An identifier without case and outer blanks."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(col), r"^\s+|\s+$", "")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever extra columns it brings."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, n = f"_{base}", 0
        while name.lower() in taken:
            n += 1
            name = f"_{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def newest(df: DataFrame, key: str, moment: str, *columns: str) -> DataFrame:
    """The row with the greatest ``moment`` for each non-null ``key``, reduced to ``columns``.

    Aggregates with a map-side combine, so a key with very many versions never meets in one task
    unreduced. Null moments lose against any other; among equal moments the greatest values win.
    """
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(moment, *[c for c in columns if c != moment])).alias("_best"))
    return best.select(key, *[F.col("_best")[c].alias(c) for c in columns])
