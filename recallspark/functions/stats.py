"""Column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054  # 95 % of a normal distribution


def _wilson(k: Column, n: Column) -> tuple[Column, Column]:
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, Z * Z
    middle, width = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (middle - width) / (1 + z2 / n), (middle + width) / (1 + z2 / n)


def wilson_open(k: Column, n: Column) -> tuple[Column, Column]:
    """Interval of k of n; (0, 1) without observations, not clamped."""
    low, high = _wilson(k, n)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 1.0).otherwise(high)


def wilson_report(k: Column, n: Column) -> tuple[Column, Column]:
    """Interval of k of n; NULL without observations, clamped, three places."""
    low, high = _wilson(k, n)
    return (F.when(n > 0, F.round(F.greatest(F.lit(0.0), low), 3)), F.when(n > 0, F.round(F.least(F.lit(1.0), high), 3)))


def verdict(false_accepts: Column, recall: Column, least: float, threshold: float) -> tuple[Column, Column]:
    """(verdict, threshold): enabled without false accepts at `least` recall; else 2, which no score reaches."""
    fine = (false_accepts == 0) & (recall >= least)
    return F.when(fine, "ENABLED").otherwise("DISABLED"), F.when(fine, threshold).otherwise(2.0)
