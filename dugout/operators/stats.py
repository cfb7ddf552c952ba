"""Summaries, correlation, regression, histograms, ranks and missingness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions.numeric import corr_or_null
from dugout.operators.relational import q
from dugout.session import cut


def summary(c: str) -> list[Column]:
    """mean, sample standard deviation, min and max of a column; for the median see ``medians``."""
    return [F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]


def medians(df: DataFrame, c: str, by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """(by..., median): the exact median of a column, nulls left out; with ``by`` for every group that has a value.

    Distinct values are counted, dealt out by range of (group, value) and summed within each range; the ranges' totals
    (one row a group and partition) give the offsets, so no task holds a whole group."""
    by = by or []
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = [q(k).alias(f"_g{i}") for i, k in enumerate(by)]
    keys = [f"_g{i}" for i in range(len(by))]
    counts = df.where(q(c).isNotNull()).groupBy(*g, q(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = cut(counts.repartitionByRange(n, *keys, "_v").withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "_p").agg(F.sum("_n").alias("_t"))
    whole = Window.partitionBy(*keys)
    before = totals.select(*[F.col(k).alias(f"{k}b") for k in keys], F.col("_p").alias("_pb"), F.sum("_t").over(whole).alias("_all"),
                           (F.sum("_t").over(whole.orderBy("_p")) - F.col("_t")).alias("_before"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys], F.col("_p") == F.col("_pb"))
    upto = F.sum("_n").over(Window.partitionBy("_p", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.col("_before") + F.col("_u")
    at = placed.withColumn("_u", upto).join(before, on).withColumns({"_hi": last, "_lo": last - F.col("_n")})
    # the values at positions (n + 1) // 2 and n // 2 + 1, which are one for odd n
    holds = lambda k: (F.col("_lo") < k) & (F.col("_hi") >= k)
    a, b = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    two = F.max(F.when(holds(a), F.col("_v"))).cast("double") + F.max(F.when(holds(b), F.col("_v"))).cast("double")
    return at.where(holds(a) | holds(b)).groupBy(*keys).agg((two / 2).alias("median")).select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "median")


def regression(y: Column, x: Column) -> list[Column]:
    """slope, intercept and r of simple least squares; null for a constant x."""
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), corr_or_null(x, y).alias("r")]


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of equal-width bins over the column's range, empty ones included; the maximum is in the last bin."""
    v = df.where(q(c).isNotNull()).select(q(c).cast("double").alias("v"))
    span = v.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    edges = span.where("a is not null").select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    r = cut(span).first()
    lo, hi = (r["a"], r["b"]) if r and r["a"] is not None else (0.0, 0.0)
    width = (hi - lo) / bins
    b = F.when(F.lit(width == 0), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / F.lit(width or 1.0)))).cast("int")
    n = v.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = (F.col("b") - F.col("a")) / bins
    return edges.join(n, "bin", "left").select("bin", (F.col("a") + F.col("bin") * w).alias("lo"), (F.col("a") + (F.col("bin") + 1) * w).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def average_rank(df: DataFrame, c: str, out: str, partitions: int | None = None) -> DataFrame:
    """The frame with the average-tie rank of a column over all rows; nulls have none.

    Distinct values are counted, dealt out by range, and summed within each range; the ranges' totals (one row a
    partition) give the offsets. No single task sees all rows."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(q(c).isNotNull()).groupBy(q(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = cut(counts.repartitionByRange(n, "_v").withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy("_p").agg(F.sum("_n").alias("_t"))
    before = totals.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = placed.withColumn("_u", upto).join(before, "_p").select("_v", (F.col("_before") + F.col("_u") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, q(c) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``rho``: the correlation of average ranks over rows with both values."""
    d = df.where(q(a).isNotNull() & q(b).isNotNull()).select(q(a).alias("_a"), q(b).alias("_b"))
    r = average_rank(average_rank(d, "_a", "ra"), "_b", "rb")
    return r.agg(corr_or_null(F.col("ra"), F.col("rb")).alias("rho"))


def missingness(df: DataFrame, k: int) -> DataFrame:
    """(column_name, missing) of the k columns with the largest share of nulls above 0; NaN counts as null."""
    gone = lambda c, t: (q(c).isNull() | F.isnan(q(c))) if t in ("double", "float") else q(c).isNull()
    agg = df.agg(*[F.avg(gone(c, t).cast("double")).alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("missing")) for i, c in enumerate(df.columns)])
    return agg.select(F.inline(rows)).where("missing > 0").orderBy(F.desc("missing"), "column_name").limit(k)
