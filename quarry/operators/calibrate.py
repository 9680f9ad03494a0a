"""Support vector classifier with probabilities: a logistic curve through the margins of rows that a fit has not seen.

Every row belongs to one fold. For each fold a classifier is fitted on the others and gives the fold's rows their margins; two
numbers a class (slope and offset of the curve) are then fitted to all those margins by Newton steps whose sums Spark takes.
The classifier that is kept is fitted on all rows. More than two classes: one against the rest, probabilities divided by
their sum.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin
from .margin import packed, summed


def margin_of(features: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    value = F.lit(float(bias))
    for f, w in zip(features, weights):
        value = value + F.lit(float(w)) * F.col(f)
    return value


def chance(margin: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(slope * margin + offset, -700, 700)))


@dataclass
class Calibrated:
    """``transform`` adds ``prediction`` (by margin) and ``probability`` (one number a class) as plain expressions."""

    features: list[str]
    weights: list[list[float]]
    biases: list[float]
    curves: list[tuple[float, float]]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Calibrated:
        return cls(**json.loads(spark.read.text(path).first()[0]))

    def transform(self, df: DataFrame) -> DataFrame:
        margins = [margin_of(self.features, w, b) for w, b in zip(self.weights, self.biases)]
        each = [1 / (1 + F.exp(-(F.lit(float(a)) * m + F.lit(float(b))))) for m, (a, b) in zip(margins, self.curves)]
        if len(margins) == 1:
            return df.select("*", (margins[0] > 0).cast("double").alias("prediction"), F.array(1 - each[0], each[0]).alias("probability"))
        total = sum(each[1:], each[0])
        # the first class of the largest margin
        best = F.array_position(F.array(*margins), F.greatest(*margins)) - 1
        return df.select("*", best.cast("double").alias("prediction"), F.array(*[e / total for e in each]).alias("probability"))


def fit_curve(rows: DataFrame, margin: str = "margin", label: str = "y", steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the curve: least cross entropy against targets drawn in by one row a side."""
    yes, n = rows.agg(F.sum(label), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("no rows to fit on")
    high, low = (yes + 1) / (yes + 2), 1 / (n - yes + 2)

    def sums(ws):
        def told(block):
            m, t = block[:, 0], np.where(block[:, 1] > 0, high, low)
            p = chance(m, *ws[0])
            q, r = p - t, p * (1 - p)
            cost = []
            for a, b in ws:
                s = a * m + b
                cost.append((np.logaddexp(0, s) - t * s).sum())
            return np.array([(q * m).sum(), q.sum(), (r * m * m).sum(), (r * m).sum(), r.sum(), *cost])
        return told

    blocks = packed(rows, [margin, label])
    w = np.array([0.0, np.log((yes + 1) / (n - yes + 1))])
    for _ in range(steps):
        got = summed(blocks, None, sums([w]))
        g, h = got[:2], np.array([[got[2], got[3]], [got[3], got[4]]]) + np.eye(2) * 1e-9
        p = -np.linalg.solve(h, g)
        tried = [w + p * 0.5 ** i for i in range(12)]
        costs = summed(blocks, None, sums(tried))[5:]
        best = int(np.argmin(costs))
        gain = got[5] - costs[best]
        if gain <= 0:
            break
        w = tried[best]
        if gain <= 1e-9 * abs(got[5]):
            break
    return float(w[0]), float(w[1])


def fit_calibrated(train: DataFrame, features: Sequence[str], classes: int, label: str = "label", folds: int = 3,
                   most: int = 100, seed: int = 42) -> Calibrated:
    """Linear support vector classifier and its curves. Rows with a null in a feature or the label are left out; no row at
    all is an error. A fold whose other rows hold one class only gives no margins; if none gives any, the curve is flat."""
    features = list(features)
    rows = pin(VectorAssembler(inputCols=features, outputCol="_features").transform(
        train.select(*[F.col(c).cast("double").alias(c) for c in (*features, label)]).dropna()).withColumn(
        "_fold", F.floor(F.rand(seed) * folds)))
    if rows.isEmpty():
        raise ValueError("no rows to fit on")
    weights, biases, curves = [], [], []
    for c in ([1] if classes <= 2 else range(classes)):
        one = rows.withColumn("_y", (F.col(label) == c).cast("double"))
        counts = {(r["_fold"], r["_y"]): r["count"] for r in one.groupBy("_fold", "_y").count().collect()}
        seen = lambda f, y: sum(v for (g, z), v in counts.items() if z == y and g != f)
        svc = LinearSVC(featuresCol="_features", labelCol="_y", maxIter=most)
        # a fit is hundreds of short jobs one after the other: those of the folds and of all rows run side by side
        fits = [f for f in range(folds) if seen(f, 0.0) and seen(f, 1.0)] + [None] * (seen(None, 0.0) > 0 and seen(None, 1.0) > 0)
        with ThreadPoolExecutor(max(len(fits), 1)) as pool:
            fit = inheritable_thread_target(train.sparkSession)(lambda f: svc.fit(one if f is None else one.where(F.col("_fold") != f)))
            models = dict(zip(fits, pool.map(fit, fits)))
        held = None
        for f, m in models.items():
            if f is None:
                weights.append([float(x) for x in m.coefficients.toArray()])
                biases.append(float(m.intercept))
            else:
                part = one.where(F.col("_fold") == f).select(
                    margin_of(features, m.coefficients.toArray(), m.intercept).alias("margin"), F.col("_y").alias("y"))
                held = part if held is None else held.unionByName(part)
        if None not in models:
            weights.append([0.0] * len(features))
            biases.append(1.0 if seen(None, 1.0) else -1.0)
        held = None if held is None else pin(held)
        yes, n = seen(None, 1.0), seen(None, 1.0) + seen(None, 0.0)
        curves.append(fit_curve(held) if held is not None and not held.isEmpty() else (0.0, float(np.log((yes + 1) / (n - yes + 1)))))
    return Calibrated(features, weights, biases, curves)
