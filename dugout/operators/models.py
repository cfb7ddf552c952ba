"""Models: the reference's parameters are the defaults, callers shrink them where time counts."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.operators import boosting
from dugout.operators.forest import Forest
from dugout.session import cut


def forest(label: str, trees: int = 200, depth: int = 30, seed: int = 42, features: str = "features") -> Forest:
    """Random forest, binary or multiclass."""
    return Forest(label, features, trees, depth, seed)


def boosted_classifier(label: str, trees: int = 500, depth: int = 6, rate: float = 0.05, rows: float = 0.8, columns: float = 0.8,
                       weight: str | None = None, seed: int = 42, features: str = "features") -> GBTClassifier:
    m = GBTClassifier(labelCol=label, featuresCol=features, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=rows,
                      featureSubsetStrategy=str(columns), seed=seed)
    return m.setWeightCol(weight) if weight else m


def boosted_regressor(label: str, trees: int = 1000, depth: int = 6, rate: float = 0.05, rows: float = 0.8, columns: float = 0.7,
                      seed: int = 42, features: str = "features") -> GBTRegressor:
    return GBTRegressor(labelCol=label, featuresCol=features, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=rows,
                        featureSubsetStrategy=str(columns), seed=seed)


def logistic(label: str, n: int, features: str = "scaled", iterations: int = 5000) -> LogisticRegression:
    """L2 with C = 1: the penalty is 1 / n a row."""
    return LogisticRegression(labelCol=label, featuresCol=features, maxIter=iterations, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False)


def search(train: DataFrame, label: str, n_iter: int = 10, folds: int = 3, trees: int = 20, seed: int = 8, features: str = "features"):
    """Cross-validated random search over depth, learning rate, row and column shares and the least gain; scored by ROC-AUC."""
    rng = random.Random(seed)
    est = boosted_classifier(label, trees=trees, features=features, seed=seed)
    maps = [{
        est.maxDepth: rng.randint(2, 8), est.stepSize: 10 ** rng.uniform(-3, 0), est.subsamplingRate: rng.uniform(0.5, 1.0),
        est.featureSubsetStrategy: f"{rng.uniform(0.5, 1.0):.2f}", est.minInfoGain: rng.uniform(0, 10) / 1000,
    } for _ in range(n_iter)]
    cv = CrossValidator(estimator=Pipeline(stages=[est]), estimatorParamMaps=maps, numFolds=folds, seed=seed,
                        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"))
    return cv.fit(train)


#: Nine dimensions: depth, learning rate (log-uniform), row share, three column shares, two penalties, least gain.
SPACE = [("depth", 2, 8), ("rate", 1e-3, 1.0), ("rows", 0.5, 1.0), ("by_tree", 0.5, 1.0), ("by_level", 0.5, 1.0), ("by_node", 0.5, 1.0),
         ("alpha", 0.0, 10.0), ("lambda", 0.0, 10.0), ("gamma", 0.0, 10.0)]


def in_space(u: np.ndarray) -> dict[str, float]:
    """The values of a point of the unit cube."""
    out = {}
    for x, (name, lo, hi) in zip(u, SPACE, strict=True):
        out[name] = math.exp(math.log(lo) + x * (math.log(hi) - math.log(lo))) if name == "rate" else lo + x * (hi - lo)
    out["depth"] = int(round(out["depth"]))
    return out


def next_point(tried: np.ndarray, scores: np.ndarray, rng: np.random.Generator, width: float = 0.6, noise: float = 1e-3) -> np.ndarray:
    """The point of largest expected improvement under a Gaussian process through the scores, among 2,000 random ones."""
    kernel = lambda a, b: np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) / (2 * width * width))
    mean, dev = scores.mean(), scores.std() or 1.0
    y = (scores - mean) / dev
    inverse = np.linalg.inv(kernel(tried, tried) + noise * np.eye(len(tried)))
    at = rng.random((2000, tried.shape[1]))
    k = kernel(at, tried)
    m, v = k @ inverse @ y, np.sqrt(np.maximum(1e-12, 1 - np.einsum("ij,jk,ik->i", k, inverse, k)))
    z = (m - y.max()) / v
    cdf = 0.5 * (1 + np.array([math.erf(x / math.sqrt(2)) for x in z]))
    gain = (m - y.max()) * cdf + v * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return at[int(gain.argmax())]


def encoder(label: str, categories: list[str], numbers: list[str]) -> list:
    """Stages that give ``encoded``: target-encoded categories and numbers; categories not seen in training get the mean of all. The encoder
    marks its means as nominal, and trees would take them for numbers of categories; as plain sums they are numbers."""
    indexed, encoded, plain = [f"{c}_index" for c in categories], [f"{c}_mean" for c in categories], [f"{c}_number" for c in categories]
    numeric = ", ".join(f"`{e}` + 0D AS `{x}`" for e, x in zip(encoded, plain, strict=True))
    return [
        StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep"),
        TargetEncoder(inputCols=indexed, outputCols=encoded, labelCol=label, targetType="binary", handleInvalid="keep"),
        SQLTransformer(statement=f"SELECT *, {numeric} FROM __THIS__"),
        VectorAssembler(inputCols=plain + numbers, outputCol="encoded", handleInvalid="keep"),
    ]


def encoder_pipeline(label: str, categories: list[str], numbers: list[str], trees: int = 100, depth: int = 6, rate: float = 0.3, seed: int = 8, **more) -> Pipeline:
    """``encoder`` into boosted trees."""
    return Pipeline(stages=[
        *encoder(label, categories, numbers),
        boosted_classifier(label, trees=trees, depth=depth, rate=rate, rows=more.pop("rows", 1.0), columns=more.pop("columns", 1.0), features="encoded", seed=seed),
    ])


def boosted_at(v: dict[str, float], label: str, trees: int = 100, seed: int = 8) -> GBTClassifier:
    """Boosted trees over ``encoded`` with the values of a point of ``SPACE``. Spark's trees know no penalties and one column share: the three shares are multiplied, ``alpha`` is
    taken as the least rows of a leaf, ``lambda`` and ``gamma`` as thousandths of the least weight of a leaf and of the least gain."""
    m = boosted_classifier(label, trees=trees, depth=v["depth"], rate=v["rate"], rows=v["rows"], columns=round(v["by_tree"] * v["by_level"] * v["by_node"], 3), features="encoded", seed=seed)
    return m.setMinInstancesPerNode(1 + int(v["alpha"])).setMinWeightFractionPerNode(v["lambda"] / 1000).setMinInfoGain(v["gamma"] / 1000)


def bayes_search(train: DataFrame, label: str, categories: list[str], numbers: list[str], n_iter: int = 10, folds: int = 3, trees: int = 100,
                 random_first: int = 4, seed: int = 8) -> tuple[dict[str, float], float]:
    """(best values, its score) of a model-based search over ``SPACE`` for the encoder pipeline, scored by ROC-AUC in ``folds``
    folds. What the encoder makes of a fold is the same for every point and made once; each fit is a task, and fits that do not wait for each other run side by side."""
    rng = np.random.default_rng(seed)
    points: list[np.ndarray] = []
    scores: list[float] = []
    parts = train.randomSplit([1.0] * folds, seed)
    made = []
    for i in range(folds):
        rest = _union([p for j, p in enumerate(parts) if j != i])
        enc = Pipeline(stages=encoder(label, categories, numbers)).fit(rest)
        made.append(boosting.Sent(label, "encoded", *[enc.transform(t) for t in (rest, parts[i])]))
    while len(points) < n_iter:
        if len(points) < random_first:
            new = [rng.random(len(SPACE)) for _ in range(min(random_first, n_iter))]
        else:
            new = [next_point(np.array(points), np.array(scores), rng)]
        points += new
        scores += [float(np.mean(s)) for s in boosting.judged(train.sparkSession, made, [boosting.Values.of(boosted_at(in_space(u), label, trees, seed)) for u in new])]
    best = int(np.argmax(scores))
    return in_space(points[best]), scores[best]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def predict(model, df: DataFrame, out: str = "predicted", threshold: float | None = None, where: Column | None = None) -> DataFrame:
    """``df`` with the prediction, and for classifiers the probability of class 1 (``{out}_p1``); with a threshold the
    label is whether that probability is above it. A forest scores only the rows of ``where``, if given; the others get nulls."""
    d = model.transform(df) if where is None else model.transform(df, where)
    if "probability" in d.columns:
        p = F.col("probability") if isinstance(d.schema["probability"].dataType, T.ArrayType) else vector_to_array("probability")
        d = d.withColumn(f"{out}_p1", F.try_element_at(p, F.lit(2)))
    label = F.col("prediction") if threshold is None else (F.col(f"{out}_p1") > threshold).cast("double")
    return d.withColumn(out, label).drop("prediction", "probability", "rawPrediction")
