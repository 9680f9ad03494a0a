"""Neural-network classifier: one layer of rectified units and a softmax, fitted by Adam on mini-batches.

Every row belongs to one of ``batches`` mini-batches, each pinned as packed blocks of its own. A step reads one of them: each task
adds up the gradients of its blocks, the tasks' sums are added up on a fixed number of tasks, and the driver gets as many
gradients as those, whatever the rows. Rows with a null in a feature or the label are not learned from; in scoring a null
counts as the feature's mean.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin
from .margin import packed, summed


def layers(w: np.ndarray, d: int, hidden: int, k: int) -> tuple[np.ndarray, ...]:
    """Weights and biases of both layers, as views of one vector."""
    at = np.cumsum([d * hidden, hidden, hidden * k])
    w1, b1, w2, b2 = np.split(w, at)
    return w1.reshape(d, hidden), b1, w2.reshape(hidden, k), b2


def forward(z: np.ndarray, w: np.ndarray, hidden: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Units after rectification, class probabilities."""
    w1, b1, w2, b2 = layers(w, z.shape[1], hidden, k)
    units = np.maximum(z @ w1 + b1, 0.0)
    s = units @ w2 + b2
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return units, e / e.sum(axis=1, keepdims=True)


def gradient(z: np.ndarray, y: np.ndarray, w: np.ndarray, hidden: int, k: int) -> np.ndarray:
    """[loss, rows, gradient...] summed over the rows of a block."""
    units, p = forward(z, w, hidden, k)
    rows = np.arange(len(y))
    loss = -np.log(np.maximum(p[rows, y], 1e-300)).sum()
    p[rows, y] -= 1.0
    back = (p @ layers(w, z.shape[1], hidden, k)[2].T) * (units > 0)
    return np.concatenate([[loss, len(y)], (z.T @ back).ravel(), back.sum(axis=0), (units.T @ p).ravel(), p.sum(axis=0)])


@dataclass
class Network:
    """A fitted network: ``transform`` adds ``prediction`` and ``probability`` (one number a class)."""

    features: list[str]
    mean: list[float]
    std: list[float]
    hidden: int
    classes: int
    weights: list[float]
    losses: list[float]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        return cls(**json.loads(spark.read.text(path).first()[0]))

    def transform(self, df: DataFrame) -> DataFrame:
        features, hidden, k = self.features, self.hidden, self.classes
        mean, std, w = np.array(self.mean), np.array(self.std), np.array(self.weights)
        keep = [c for c in df.columns if c not in ("prediction", "probability")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(features))])
                z = np.where(np.isnan(x), 0.0, (x - mean) / std)
                p = forward(z, w, hidden, k)[1]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(keep)], pa.array(p.argmax(axis=1).astype(np.float64)), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.ravel()))],
                    [*keep, "prediction", "probability"])

        schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("prediction", T.DoubleType()),
                               T.StructField("probability", T.ArrayType(T.DoubleType()))])
        return df.select(*keep, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]).mapInArrow(run, schema)


def fit_network(train: DataFrame, features: Sequence[str], classes: int, label: str = "label", hidden: int = 50,
                batches: int = 4, rounds: int = 30, rate: float = 0.02, alpha: float = 1e-4, tolerance: float = 1e-4,
                patience: int = 5, seed: int = 42, width: int = 16) -> Network:
    """At most ``rounds`` times through the rows; ends when the mean loss gained less than ``tolerance`` for ``patience`` rounds.

    A table without rows to learn from is an error. Repeated rows count as often as they stand there; a constant feature tells
    nothing; a single class is always predicted.
    """
    features, d, k = list(features), len(features), max(classes, 1)
    columns = [*features, label]
    rows = pin(train.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna().withColumn(
        "_batch", F.floor(F.rand(seed) * batches)))
    told = rows.agg(F.count(F.lit(1)), *[f(c) for c in features for f in (F.avg, F.stddev_pop)]).first()
    n = told[0]
    if not n:
        raise ValueError("no rows to fit on")
    mean, std = np.array(told[1::2], float), np.array(told[2::2], float)
    std = np.where(std > 0, std, 1.0)
    parts = [packed(rows.where(F.col("_batch") == i), columns) for i in range(batches)]
    few = rows.rdd.getNumPartitions() <= width  # of a written table: nothing is computed for it

    rng = np.random.default_rng(seed)
    wide = [np.sqrt(6.0 / (a + b)) for a, b in ((d, hidden), (hidden, k))]
    w = np.concatenate([rng.uniform(-wide[0], wide[0], d * hidden), np.zeros(hidden), rng.uniform(-wide[1], wide[1], hidden * k), np.zeros(k)])
    decays = np.concatenate([np.ones(d * hidden), np.zeros(hidden), np.ones(hidden * k), np.zeros(k)]) * alpha
    first, second, step, losses, still = np.zeros(len(w)), np.zeros(len(w)), 0, [], 0

    def at(w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        return lambda block: gradient((block[:, :d] - mean) / std, block[:, d].astype(int), w, hidden, k)

    for _ in range(rounds):
        lost = 0.0
        for part in parts:
            got = summed(part, None, at(w), width, few)
            if np.ndim(got) == 0:  # no row fell into this one
                continue
            lost += got[0]
            g = got[2:] / got[1] + decays * w / got[1]
            step += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        losses.append(lost / n)
        still = still + 1 if len(losses) > 1 and losses[-2] - losses[-1] < tolerance else 0
        if still >= patience:
            break
    return Network(features, mean.tolist(), std.tolist(), hidden, k, w.tolist(), losses)
