"""Support vector regression: linear, epsilon-insensitive loss, fitted by Newton steps whose sums Spark takes.

The fit minimises ``|w|^2 / 2 + C * sum(max(0, |y - xw - b| - epsilon))``. The corner of the loss is rounded over a width
that shrinks fivefold from stage to stage; within a stage every step is one pass for gradient and curvature and one for
the loss at several step lengths at once (a third where the shortest of them is best). Each task adds its rows to one small matrix, and the tasks' matrices are added up on
``width`` tasks, so the driver adds ``width`` matrices of (columns + 1) squared numbers a pass, whatever the rows. The rounding of the last stage changes
the mean loss by at most half its width, which ``Margin.slack`` tells.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.merge import PART, merged, part
from ..session import pin

STEPS = 4.0 ** -np.arange(16)
FIRST = 4  # step lengths whose losses are taken first
BLOCK = 1 << 16
CODEC = "zstd"


@dataclass
class Margin:
    """A fitted line: ``transform`` adds ``prediction`` to a table that has the features, in one expression."""

    features: list[str]
    weights: list[float]
    bias: float
    objective: float
    slack: float
    passes: int

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Margin:
        return cls(**json.loads(spark.read.text(path).first()[0]))

    def transform(self, df: DataFrame) -> DataFrame:
        value = F.lit(self.bias)
        for f, w in zip(self.features, self.weights):
            value = value + F.lit(w) * F.col(f)
        return df.withColumn("prediction", value)


def _blocks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            # column by column, so that like bytes stand together
            data = pa.compress(np.concatenate(held, axis=1).tobytes(), CODEC, asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([len(columns)], pa.int32()), pa.array([data], pa.binary())],
                                              ["n", "wide", "block"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return rows.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "n long, wide int, block binary")


def packed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, in pinned, compressed blocks of about ``BLOCK`` rows: a pass reads bytes, and no row on its own."""
    return pin(_blocks(rows, columns))


def summed(rows: DataFrame, columns: Sequence[str] | None, told: Callable[[np.ndarray], np.ndarray], width: int = 16,
           few: bool = False) -> np.ndarray:
    """The sum of ``told(block of rows)`` over all rows. ``columns``: None for rows that are ``packed``. ``few``: the rows lie in
    ``width`` partitions at most, whose sums the driver can add up as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, wide, block in zip(*batch.columns):
                n, wide = n.as_py(), wide.as_py()
                values = np.frombuffer(pa.decompress(block.as_buffer(), n * wide * 8, CODEC), np.float64).reshape(wide, n)
                for at in range(0, n, 8192):
                    x = told(np.ascontiguousarray(values[:, at:at + 8192].T))
                    total = x if total is None else total + x
        if total is not None:
            yield part(0, TaskContext.get().partitionId() % width, total)

    some = (rows if columns is None else _blocks(rows, columns)).mapInArrow(run, PART)
    some = some if few else merged(some)
    return np.sum([np.frombuffer(r["m"], np.float64) for r in sorted(some.collect(), key=lambda r: r["task"])], axis=0)


def fit_svr(train: DataFrame, features: Sequence[str], label: str = "label", c: float = 1.0, epsilon: float = 0.1,
            stages: int = 7, most: int = 12, tolerance: float = 1e-5) -> Margin:
    """The line of least regularised epsilon-insensitive loss. ``train`` is read twice, and packed for the passes.

    A row with a null in a feature or the label is left out. A table without such rows is an error; one row or a constant
    feature is none. Repeated rows count as often as they stand there.
    """
    features, d = list(features), len(features)
    train = train.select(*features, label).dropna()
    moments = train.agg(F.count(F.lit(1)), *[f(x) for x in (*features, label) for f in (F.avg, F.stddev_pop)]).first()
    n = moments[0]
    if not n:
        raise ValueError("no rows to fit on")
    mean, std = np.array(moments[1::2]), np.array(moments[2::2])
    spread = std[-1] or 1.0
    std = np.where(std > 0, std, 1.0)[:-1]
    centre, base = mean[:-1], mean[-1]
    penalty = np.append(1 / (c * n * std ** 2), 0.0)  # of the scaled weights; the bias has none
    ridge = np.append(np.full(d, 1e-12), 1e-12)

    def design(block):
        z = np.ones((len(block), d + 1))
        z[:, :d] = (block[:, :d] - centre) / std
        return z, block[:, d] - base

    def rounded(t, delta):
        return np.where(t <= 0, 0.0, np.where(t < delta, t * t / (2 * delta), t - delta / 2))

    def slopes(w, delta):
        def told(block):
            z, y = design(block)
            r = z @ w - y
            t = np.abs(r) - epsilon
            g = z.T @ (np.sign(r) * np.clip(t / delta, 0, 1))
            band = z[(t > 0) & (t < delta)]
            return np.concatenate([g, (band.T @ band / delta).ravel()])
        return told

    def losses(w, p, delta, steps):
        def told(block):
            z, y = design(block)
            r, dr = z @ w - y, z @ p
            return np.array([rounded(np.abs(r + s * dr) - epsilon, delta).sum() for s in steps])
        return told

    def objectives(w, p, delta, steps):
        return summed(blocks, None, losses(w, p, delta, steps)) / n + np.array([(penalty * (w + s * p) ** 2).sum() / 2 for s in steps])

    def exact(w):
        def told(block):
            z, y = design(block)
            return np.array([np.maximum(np.abs(z @ w - y) - epsilon, 0).sum()])
        return told

    w, passes, delta = np.zeros(d + 1), 0, 4.0 * spread
    blocks = packed(train, [*features, label])
    for stage in range(stages):
        value = None
        for _ in range(most):
            got = summed(blocks, None, slopes(w, delta)) / n
            g = got[:d + 1] + penalty * w
            h = got[d + 1:].reshape(d + 1, d + 1) + np.diag(penalty + ridge)
            p = -np.linalg.solve(h, g)
            tried = objectives(w, p, delta, STEPS[:FIRST])
            passes += 2
            if np.argmin(tried) == FIRST - 1:  # else the loss, being convex, only grows over the shorter steps
                tried = np.concatenate([tried, objectives(w, p, delta, STEPS[FIRST:])])
                passes += 1
            best = int(np.argmin(tried))
            if value is not None and tried[best] >= value:
                break
            w = w + STEPS[best] * p
            gain = np.inf if value is None else value - tried[best]
            value = tried[best]
            if gain <= tolerance * max(abs(value), delta / 100):
                break
        delta /= 5.0
    weights = w[:d] / std
    loss = float(summed(blocks, None, exact(w))[0])
    return Margin(features, weights.tolist(), float(w[d] + base - weights @ centre),
                  float((weights ** 2).sum() / 2 + c * loss), float(c * n * delta * 5 / 2), passes + 1)
