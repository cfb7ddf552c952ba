"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MLB_EXPONENT = 1.83


def expectation(rs: Column, ra: Column, x: Column | float) -> Column:
    """Win expectation RS^x / (RS^x + RA^x); callers keep RS + RA > 0."""
    e = x if isinstance(x, Column) else F.lit(float(x))
    a, b = F.pow(rs, e), F.pow(ra, e)
    return F.try_divide(a, a + b)


def share_of(c: Column) -> Column:
    """A share from 0 to 1 that may be given in per cent (above 1) or per mille (above 100); null beyond."""
    return F.when(c <= 1, c).when(c <= 100, c / 100).when(c <= 1000, c / 1000)


def rmse(actual: Column, predicted: Column) -> Column:
    """Root mean squared error over the pairs without null; null if there are none."""
    return F.sqrt(F.avg(F.pow(actual - predicted, 2)))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.when(b != 0, a / b)


def round_even(c: Column, k: int) -> Column:
    """Round half to even, as Python does."""
    return F.bround(c, k)


def improvement_pct(base: Column, best: Column) -> Column:
    """Relative improvement of ``best`` on ``base`` in per cent."""
    return F.try_divide(base - best, base) * 100


def corr_or_null(a: Column, b: Column) -> Column:
    """Pearson correlation, null for constant input (plain ``corr`` raises there under ANSI)."""
    pair = a.isNotNull() & b.isNotNull()
    x, y = F.when(pair, a), F.when(pair, b)
    cov = F.covar_pop(x, y)
    return F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y))
