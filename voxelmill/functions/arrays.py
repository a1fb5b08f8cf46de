"""Statistics of array columns of doubles, without exploding or shuffling them. Empty arrays give null unless stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row, also where a lambda uses it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def var_pop(a: Column) -> Column:
    m = F.aggregate(a, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda t, v: F.struct((t["s"] + v).alias("s"), (t["q"] + v * v).alias("q")))
    return F.when(F.size(a) > 0, F.greatest(m["q"] / F.size(a) - (m["s"] / F.size(a)) ** 2, F.lit(0.0)))


def std_pop(a: Column) -> Column:
    return F.sqrt(var_pop(a))


def percentile(a: Column, share: float) -> Column:
    """Linear interpolation between order statistics."""
    at = (F.size(a) - 1) * F.lit(share)
    between = lambda s: F.get(s, F.floor(at).cast("int")) + (F.get(s, F.ceil(at).cast("int")) - F.get(s, F.floor(at).cast("int"))) * (at - F.floor(at))
    return F.when(F.size(a) > 0, let(F.array_sort(a), between))


def where(a: Column, m: Column) -> Column:
    """The values of ``a`` at the places where the boolean array ``m`` is true."""
    return F.transform(F.filter(F.arrays_zip(a.alias("v"), m.alias("m")), lambda p: p["m"]), lambda p: p["v"])


def where_or_all(a: Column, m: Column) -> Column:
    """Like :func:`where`, but all values if none is chosen."""
    chosen = where(a, m)
    return F.when(F.size(chosen) > 0, chosen).otherwise(a)


def places(a: Column, keep: Callable[[Column], Column]) -> Column:
    """The values at the places ``i`` for which ``keep(i)``."""
    return F.transform(F.filter(F.transform(a, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda p: keep(p["i"])), lambda p: p["v"])


def first_of_greatest(a: Column) -> Column:
    """The place of the greatest value, the first among equals."""
    return let(F.array_max(a), lambda m: (F.array_position(a, m) - 1).cast("int"))


def count_if(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(a, test))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))
