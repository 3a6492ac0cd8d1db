"""Learned costs: robust and sign-constrained regressions, sibling ratios, and the empty-output classifier."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide(long: DataFrame, names: list[str]) -> DataFrame:
    """(node, feature, value) to one column for each name, 0 where missing."""
    return long.groupBy("node").pivot("feature", names).agg(F.sum("value")).na.fill(0.0)


class HuberModel:
    """Huber regression on log1p of the target, over columns scaled by their population deviation."""

    def __init__(self, names: list[str], scale: list[float], model):
        self.names, self.scale, self.model = names, scale, model

    def line(self, df: DataFrame, out: str) -> DataFrame:
        """The prediction as fitted, on the target's own scale or its logarithm's."""
        return self.model.transform(_vectors(df, self.names, self.scale)).drop("features").withColumnRenamed("log_prediction", out)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """expm1 of the prediction, clamped to [0, expm1(20)]."""
        raw = self.line(df, "log_prediction")
        top = float(np.expm1(20))
        return raw.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(top), F.expm1(F.least(F.lit(20.0), "log_prediction"))))).drop("log_prediction")


def _vectors(df: DataFrame, names: list[str], scale: list[float]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*[F.col(n).cast("double") / F.lit(s) for n, s in zip(names, scale)])))


def fit_huber(df: DataFrame, names: list[str], target: str, epsilon: float = 1.35, alpha: float = 1e-4, rounds: int = 2000, log: bool = True) -> HuberModel:
    """The target's log1p is fitted, or with ``log`` off the target. ``alpha`` is the ridge of the summed objective, so Spark's ``regParam`` is alpha / n. Needs 5 rows."""
    df = df.dropna(subset=[*names, target])
    n = df.count()
    if n < 5:
        raise ValueError(f"{n} rows are too few to fit")
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in names]).first()
    scale = [spread[c] or 1.0 for c in names]
    y = F.col(target).cast("double")
    rows = _vectors(df, names, scale).withColumn("label", F.log1p(y) if log else y)
    lr = LinearRegression(loss="huber", epsilon=epsilon, regParam=alpha / n, standardization=False, maxIter=rounds, predictionCol="log_prediction")
    return HuberModel(names, scale, lr.fit(rows))


def fit_constrained_huber(x: np.ndarray, y: np.ndarray, lower: np.ndarray, upper: np.ndarray, epsilon: float = 1.35, alpha: float = 1e-3, rounds: int = 5000) -> tuple[np.ndarray, float]:
    """Mean Huber loss plus half ``alpha`` |w|^2 with bounds on coefficients, by projected accelerated gradient."""
    n, d = x.shape
    full = np.hstack([x, np.ones((n, 1))])
    low, high = np.append(lower, -np.inf), np.append(upper, np.inf)
    step = 1.0 / (np.linalg.norm(full, 2) ** 2 / n + alpha)
    w = v = np.clip(np.zeros(d + 1), low, high)
    t = 1.0
    for _ in range(rounds):
        r = full @ v - y
        g = full.T @ np.clip(r, -epsilon, epsilon) / n + alpha * np.append(v[:-1], 0)
        new, t2 = np.clip(v - step * g, low, high), (1 + np.sqrt(1 + 4 * t * t)) / 2
        if np.abs(new - w).max() < 1e-12 and t > 10:
            w = new
            break
        v, w, t = np.clip(new + (t - 1) / t2 * (new - w), low, high), new, t2
    return w[:-1], float(w[-1])


def sibling_pairs(similar: DataFrame, rows: DataFrame, least: float = 0.2, most: int = 100) -> DataFrame:
    """(a, b, score, ratio) of similar models, at most ``most`` for each ``a``; both empty are left out."""
    both = similar.select("a", "b", "score").union(similar.select(F.col("b"), F.col("a"), "score")).filter(F.col("score") >= least)
    ra, rb = (rows.select(F.col("node").alias(k), F.col("rows").alias(f"r{k}")) for k in "ab")
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return (
        both.join(ra, "a").join(rb, "b").filter("ra > 0 or rb > 0").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
        .select("a", "b", "score", (F.log1p("ra") - F.log1p("rb")).alias("ratio"))
    )


def pair_differences(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(a, b, feature, value): by how much the features (node, feature, value) of ``a`` exceed those of ``b``; equal ones are left out."""
    p = pairs.select("a", "b").distinct()
    one = p.join(features.withColumnRenamed("node", "a"), "a").select("a", "b", "feature", F.col("value").cast("double").alias("value"))
    two = p.join(features.withColumnRenamed("node", "b"), "b").select("a", "b", "feature", (-F.col("value").cast("double")).alias("value"))
    return one.union(two).groupBy("a", "b", "feature").agg(F.sum("value").alias("value")).filter("value <> 0")


def fit_sibling_difference(pairs: DataFrame, features: DataFrame, names: list[str], alpha: float = 1e-3) -> HuberModel:
    """Huber regression of the pairs' log ratio of rows (``sibling_pairs``) on differences of the named features."""
    node = F.concat_ws("\x01", "a", "b").alias("node")
    x = wide(pair_differences(pairs, features).select(node, "feature", "value"), names)
    return fit_huber(pairs.select(node, "ratio").join(x, "node", "left").na.fill(0.0, names), names, "ratio", alpha=alpha, log=False)


def predict_by_siblings(anchors: DataFrame, top: int = 5) -> DataFrame:
    """(node, rows): median over the best anchors (node, anchor, score, rows, ratio) of log1p(rows) + ratio, back-transformed."""
    w = Window.partitionBy("node").orderBy(F.desc("score"), "anchor")
    best = anchors.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top)
    return best.groupBy("node").agg(F.greatest(F.lit(0.0), F.expm1(F.median(F.log1p("rows") + F.col("ratio")))).alias("rows"))


def fit_elastic_net(df: DataFrame, inputs: list[str], target: str, alpha: float = 1e-3, l1_ratio: float = 0.5, cells: int = 1 << 16):
    """Two-part elastic net: hashed features of the named columns, target on the log scale."""
    hasher = FeatureHasher(inputCols=inputs, outputCol="features", numFeatures=cells)
    rows = hasher.transform(df).withColumn("label", F.log1p(F.col(target).cast("double")))
    return hasher, LinearRegression(regParam=alpha, elasticNetParam=l1_ratio, maxIter=500).fit(rows)


def predict_elastic_net(df: DataFrame, fitted, out: str = "prediction") -> DataFrame:
    """expm1 of what ``fit_elastic_net`` predicts, not below 0."""
    hasher, model = fitted
    got = model.transform(hasher.transform(df)).drop("features")
    return got.withColumn(out, F.greatest(F.lit(0.0), F.expm1(F.col(model.getPredictionCol()))))


def fit_empty_classifier(df: DataFrame, inputs: list[str], empty: str, cells: int = 1 << 16):
    """Balanced logistic regression on hashed features; the threshold has the largest training F1."""
    hasher = FeatureHasher(inputCols=inputs, outputCol="features", numFeatures=cells)
    rows = hasher.transform(df).withColumn("label", F.col(empty).cast("double"))
    share = rows.agg(F.avg("label")).first()[0]
    rows = rows.withColumn("w", F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    model = LogisticRegression(weightCol="w", maxIter=200, regParam=1e-3).fit(rows)
    best = model.summary.fMeasureByThreshold.orderBy(F.desc("F-Measure"), "threshold").first()
    return hasher, model, float(best["threshold"]), float(best["F-Measure"])


def align(predicted: DataFrame, measured: DataFrame) -> DataFrame:
    """Rows of both by node; a node measured without a prediction is an error."""
    lost = measured.join(predicted.select("node"), "node", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"no prediction for {[r['node'] for r in lost]}")
    return predicted.join(measured, "node")


