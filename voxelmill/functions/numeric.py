"""Guarded arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite (never null)."""
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def safe_ratio(top: Column | str, bottom: Column | str, strict: bool = True) -> Column:
    """``top / bottom``, 0 where ``bottom`` is 0 or null, and with ``strict`` also where it isn't finite."""
    top, bottom = _c(top), _c(bottom)
    bad = bottom.isNull() | (bottom == 0)
    if strict:
        bad = bad | ~finite(bottom)
    return F.when(bad, F.lit(0.0)).otherwise(top / F.when(bad, F.lit(1.0)).otherwise(bottom))


def shown(x: Column | str, digits: int = 6) -> Column:
    """A double rounded for output, without negative zero."""
    return F.round(_c(x).cast("double"), digits) + F.lit(0.0)


def log2_enrichment(part: Column, whole: Column, epsilon: float = 1e-6) -> Column:
    return F.log2((part + epsilon) / (whole + epsilon))


def guarded_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, least: int = 3) -> Column:
    """Pearson's correlation from sums; 0 for fewer than ``least`` pairs or a constant side."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    flat = (n < least) | (vx <= 1e-12) | (vy <= 1e-12)
    return F.when(flat, F.lit(0.0)).otherwise((sxy - sx * sy / n) / F.sqrt(F.when(flat, F.lit(1.0)).otherwise(vx * vy)))
