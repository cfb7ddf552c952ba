"""Readers of the parquet tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a directory of tables."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of every float column become null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            c = F.when(~bad, c).alias(name)
        out.append(c)
    return df.select(*out)
