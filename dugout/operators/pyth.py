"""Fitting the exponent of the win expectation by grid search, over all rows or per group.

The grid is a generator on each row followed by a partial aggregation, so a group of any size is reduced on the
map side to one row per exponent; no join, no group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions.numeric import MLB_EXPONENT, expectation, improvement_pct, rmse
from dugout.sources.files import exponent_grid


def usable_seasons(df: DataFrame, rs: str, ra: str, wpct: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows with the three numbers (as rs, ra, wpct), in the years asked for, and with at least one run."""
    out = df.withColumns({"rs": F.col(f"`{rs}`"), "ra": F.col(f"`{ra}`"), "wpct": F.col(f"`{wpct}`")})
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    out = out.where(ok("rs") & ok("ra") & ok("wpct")).where(F.col("rs") + F.col("ra") > 0)
    return out if first is None else out.where(F.col("year").between(first, last))


def fit_exponent(df: DataFrame, keys: list[str], min_n: int = 10, base: float = MLB_EXPONENT) -> DataFrame:
    """(keys..., n, best_x, best_rmse, mlb_rmse, improvement_pct) of groups of at least ``min_n`` rows; ties go to the smaller exponent."""
    d = df
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    slim = d.select(*keys, "rs", "ra", "wpct")
    grid = slim.withColumn("x", F.explode(exponent_grid())).groupBy(*keys, "x").agg(
        rmse(F.col("wpct"), expectation(F.col("rs"), F.col("ra"), F.col("x"))).alias("e"), F.count(F.lit(1)).alias("n"))
    best = grid.groupBy(*keys).agg(
        F.max("n").alias("n"), F.min(F.struct("e", "x")).alias("b"), F.max(F.when(F.col("x") == base, F.col("e"))).alias("mlb_rmse")).where(F.col("n") >= min_n)
    return best.select(*keys, "n", F.col("b.x").alias("best_x"), F.col("b.e").alias("best_rmse"), "mlb_rmse",
                       improvement_pct(F.col("mlb_rmse"), F.col("b.e")).alias("improvement_pct"))


def most_deviating(fits: DataFrame, keys: list[str], base: float = MLB_EXPONENT) -> DataFrame:
    """The fit farthest from the base exponent; the first in key order of equals."""
    return fits.withColumn("deviation", F.abs(F.col("best_x") - base)).orderBy(F.desc("deviation"), *keys).limit(1)
