"""Sinks and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header, overwriting; one file only for a small export."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, the default between stages; partitioned by a low-cardinality column such as the season."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def overview(df: DataFrame) -> DataFrame:
    """(column_name, type, n_rows, n_values) of each column, from one pass."""
    cols = [(c, t, f"c{i}") for i, (c, t) in enumerate(df.dtypes)]
    agg = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(a) for c, _, a in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("type"), F.col("n").alias("n_rows"), F.col(a).alias("n_values")) for c, t, a in cols])
    return agg.select(F.inline(rows))
