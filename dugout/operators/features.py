"""Feature preparation."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.operators.relational import q


#: The features that an earlier selection by L1 penalty kept, and those that repeat others.
SELECTED = [
    "age", "fip", "K/9", "WHIP", "so", "g", "L", "hr/9", "wp", "l", "ER", "HRPG", "SF", "babip", "SHO", "A", "bk", "BB (Pitching)", "PE", "3B",
    "ip", "FPCT", "CS", "w", "HB", "DPPG", "SH", "T", "SO", "BBPG (Pitching)", "SBPG", "cg", "RPG", "k-bb%", "HBP", "2BPG", "sho", "e-f", "lob%", "sv", "E",
]
REDUNDANT = ["k%", "bb%", "K/BB", "k/bb"]


def without(features: list[str], gone: list[str]) -> list[str]:
    """The features that are not listed as gone, in their order."""
    return [f for f in features if f not in gone]


def one_hot(df: DataFrame, column: str, categories: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """0/1 columns for all categories but the first in order; null is all zeros. Categories not given are read from the
    data and have to be few: more than 1,000 are refused."""
    cats = categories
    if cats is None:
        cats = [r[0] for r in df.where(q(column).isNotNull()).select(q(column)).distinct().limit(1001).collect()]
        if len(cats) > 1000:
            raise ValueError(f"{column} has more than 1,000 categories")
    p = prefix if prefix is not None else f"{column}_"
    new = [F.coalesce((q(column) == c).cast("int"), F.lit(0)).alias(f"{p}{c}") for c in sorted(cats)[1:]]
    return df.select(*[q(c) for c in df.columns if c != column], *new)


def target_encode(df: DataFrame, column: str, label: str, out: str) -> DataFrame:
    """The mean label of the row's category; null categories get the mean of all."""
    m = df.groupBy(q(column).alias("_c")).agg(F.avg(q(label).cast("double")).alias("_m"))
    overall = df.agg(F.avg(q(label).cast("double"))).first()[0]
    return df.join(m.where("_c is not null"), q(column) == F.col("_c"), "left").withColumn(out, F.coalesce("_m", F.lit(overall))).drop("_c", "_m")


def class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight negatives / positives for rows of label 1, 1 for the others."""
    n = df.agg(F.count_if(q(label) == 0).alias("neg"), F.count_if(q(label) == 1).alias("pos")).first()
    ratio = n["neg"] / n["pos"] if n["pos"] else 1.0
    return df.withColumn(out, F.when(q(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def assemble(df: DataFrame, features: list[str], out: str = "features", fill: str = "median") -> DataFrame:
    """A feature vector without gaps: nulls and NaN filled by the median (or 0), and a missing indicator each."""
    safe = [f"_f{i}" for i in range(len(features))]
    num = lambda c: F.when(~F.isnan(q(c).cast("double")), q(c).cast("double"))
    d = df.withColumns({s: num(f) for s, f in zip(safe, features, strict=True)})
    d = d.withColumns({s + "_gone": F.col(s).isNull().cast("double") for s in safe})
    if fill == "median":
        some = d.agg(*[F.count(s).alias(s) for s in safe]).first()
        use = [s for s in safe if some[s]]
        if use:
            d = Imputer(strategy="median", inputCols=use, outputCols=[s + "_i" for s in use]).fit(d).transform(d)
            d = d.withColumns({s: F.col(s + "_i") for s in use}).drop(*[s + "_i" for s in use])
    d = d.na.fill(0.0, safe)
    return VectorAssembler(inputCols=safe + [s + "_gone" for s in safe], outputCol=out).transform(d).drop(*safe, *[s + "_gone" for s in safe])


def standardise(df: DataFrame, column: str = "features", out: str = "scaled") -> DataFrame:
    """Mean 0 and (sample) deviation 1."""
    return StandardScaler(inputCol=column, outputCol=out, withMean=True).fit(df).transform(df)


def values_of(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """``df`` with the first values of a vector as columns."""
    return df.withColumn("_v", vector_to_array(vector)).select(*[q(c) for c in df.columns], *[F.get("_v", F.lit(i)).alias(n) for i, n in enumerate(names)])
