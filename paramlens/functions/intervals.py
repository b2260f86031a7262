"""Interval and test statistics as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel

#: Fewer rows than this: a value is withheld.
MIN_N = 30
ALPHA = 0.05


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Score interval of a rate, within 0 and 1; null without rows."""
    z2 = kernel.Z95**2
    p, scale = F.try_divide(k, n), 1 + F.try_divide(F.lit(z2), n)
    mid = p + F.try_divide(F.lit(z2), 2 * n)
    half = kernel.Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n))
    low, high = F.try_divide(mid - half, scale), F.try_divide(mid + half, scale)
    return F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)


def variance(n: Column, s: Column, ss: Column) -> Column:
    """Sample variance from sums; null below two rows."""
    return F.when(n >= 2, F.greatest(F.lit(0.0), ss - s * s / n) / (n - 1))


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def with_q(tests, p: str = "p", *within: str):
    """Adds Benjamini-Hochberg ``q`` and ``detectable``; rows without a p-value take no part.

    The rows are the tests of one question, not facts; ``within`` splits families.
    """
    family = W.partitionBy(*(within or (F.lit(1),)), F.col(p).isNull())
    ranked = tests.withColumn("_r", F.row_number().over(family.orderBy(p))).withColumn("_m", F.count(p).over(family))
    onwards = family.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, W.currentRow)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(onwards))
    out = ranked.withColumn("q", F.when(F.col(p).isNotNull(), q))
    return out.withColumn("detectable", F.coalesce(F.col("q") < ALPHA, F.lit(False))).drop("_r", "_m")
