"""Evaluation and explanation as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.operators.relational import q


def accuracy(label: str, pred: str):
    return F.avg((q(label) == q(pred)).cast("double"))


def mae(y: str, p: str):
    return F.avg(F.abs(q(y) - q(p)))


def r2(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row ``mae``, ``r2``: 1 - residual over total sum of squares, null for a constant y."""
    d = df.where(q(y).isNotNull() & q(p).isNotNull())
    total = F.var_pop(q(y)) * F.count(F.lit(1))
    return d.agg(mae(y, p).alias("mae"), (1 - F.try_divide(F.sum(F.pow(q(y) - q(p), 2)), total)).alias("r2"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(class, precision, recall, f1, support) of each class, and the rows ``macro avg`` and ``weighted avg``."""
    kind = df.schema[label].dataType  # models predict doubles whatever the label's type
    cells = df.groupBy(q(label).cast("string").alias("y"), q(pred).cast(kind).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, o: cells.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(o), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    by = side("y", "support").join(side("p", "claimed").select("class", "claimed"), "class", "full").select(
        "class", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("claimed", F.lit(0)).alias("claimed"), F.coalesce("tp", F.lit(0)).alias("tp"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    one = by.select("class", z(F.col("tp"), F.col("claimed")).alias("precision"), z(F.col("tp"), F.col("support")).alias("recall"), "support")
    one = one.withColumn("f1", z(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = ["precision", "recall", "f1"]
    macro = one.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *cols, "support")
    weighted = one.agg(*[z(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support")).select(
        F.lit("weighted avg").alias("class"), *cols, "support")
    return one.select("class", *cols, "support").unionByName(macro).unionByName(weighted)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row ``auc`` from average ranks; null if a class is missing."""
    from dugout.operators.stats import average_rank

    r = average_rank(df.where(q(label).isNotNull() & q(score).isNotNull()).select(q(label).alias("y"), q(score).alias("s")), "s", "r")
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") != 1)
    return r.agg(F.try_divide(F.sum(F.when(F.col("y") == 1, F.col("r"))) - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def importance(spark, model, features: list[str], k: int = 20) -> DataFrame:
    """(feature, importance) of the k most important features that were split on; missing indicators count for their feature."""
    v = [float(x) for x in model.featureImportances.toArray()]
    n = len(features)
    rows = [(f, v[i] + (v[n + i] if n + i < len(v) else 0.0)) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double").where("importance > 0").orderBy(F.desc("importance"), "feature").limit(k)


def coefficients(spark, model, features: list[str]) -> DataFrame:
    """(feature, coefficient, magnitude) of a linear model."""
    c = [float(x) for x in model.coefficients.toArray()]
    return spark.createDataFrame([(f, c[i], abs(c[i])) for i, f in enumerate(features)], "feature string, coefficient double, magnitude double")
