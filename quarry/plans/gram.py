"""Pairwise-complete co-moments of many columns as blocked matrix products.

One aggregate expression a pair of columns does not scale: 200 columns are 20,100 expressions in one plan. Here every
task keeps, for a pair of column blocks, five matrices and adds to them batch by batch: with X the values (nulls as zero)
and M the mask of values, M'M (rows that hold both columns), X'M and M'X (sums of either column over those rows), X'X
(products), and the same of squares. The plan has a fixed size per pair of blocks, and the work is matrix products.

Columns are shifted by their mean and divided by their deviation first (one aggregate, linear in the columns), which changes
no correlation and keeps sums of squares from cancelling. Partial matrices are merged in two rounds (by pair of blocks and
task number modulo about the root of the task count, then by pair), each streaming over its sorted partition with one
accumulator in memory, so no task or driver ever holds more than the matrices of a pair of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import PART, merged, part

def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """6 x columns of x x columns of y: counts, sums of x, of y, products, squares of x, of y, over rows with both."""
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(np.float64), my.astype(np.float64)
    return np.stack([mx.T @ my, x.T @ my, mx.T @ y, x.T @ y, (x * x).T @ my, mx.T @ (y * y)])


def correlations(df: DataFrame, cols: Sequence[str], block: int = 256) -> DataFrame:
    """col_a, col_b, r: pairwise-complete Pearson correlation of every ordered pair of ``cols``.

    Null where fewer than two rows hold both columns or either is constant over them. NaN counts as null. Task memory is 6
    x ``block`` x ``block`` doubles and a batch of two blocks of columns.
    """
    spark, cols = df.sparkSession, list(cols)
    n_blocks = -(-len(cols) // block)
    wide = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    own = [F.nanvl(f"c{i}", F.lit(None).cast("double")) for i in range(len(cols))]
    row = wide.agg(*[e for i, x in enumerate(own) for e in (F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"))]).first()
    number = lambda v, other: float(v) if v is not None and np.isfinite(v) and v != 0 else other
    mean = np.array([number(row[2 * i], 0.0) for i in range(len(cols))])
    scale = np.array([number(row[2 * i + 1], 1.0) for i in range(len(cols))])
    spans = [(b * block, min(len(cols), (b + 1) * block)) for b in range(n_blocks)]

    def sums(bi: int, bj: int):
        (i0, i1), (j0, j1) = spans[bi], spans[bj]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((6, i1 - i0, j1 - j0))
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    rows = batch.slice(at, 4096)
                    x = np.stack([c.to_numpy(zero_copy_only=False) for c in rows.columns], axis=1).astype(np.float64, copy=False)
                    with np.errstate(invalid="ignore", over="ignore"):
                        x = (x - own_mean) / own_scale
                        total += _moments(x[:, :i1 - i0], x if bi == bj else x[:, i1 - i0:])
            yield part(bi * n_blocks + bj, TaskContext.get().partitionId(), total)

        own_mean = mean[i0:i1] if bi == bj else np.concatenate([mean[i0:i1], mean[j0:j1]])
        own_scale = scale[i0:i1] if bi == bj else np.concatenate([scale[i0:i1], scale[j0:j1]])
        names = [f"c{i}" for i in [*range(i0, i1), *(range(j0, j1) if bi != bj else ())]]
        return wide.select(*names).mapInArrow(run, PART)

    parts = None
    for bi in range(n_blocks):
        for bj in range(bi, n_blocks):
            p = sums(bi, bj)
            parts = p if parts is None else parts.unionAll(p)
    fan = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # a few slots with large arrays: by pair of blocks and about the root of the task count, then by pair
    total = merged(merged(parts.withColumn("task", F.pmod("task", F.lit(fan)).cast("int"))).withColumn("task", F.lit(0)))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                bi, bj = divmod(slot, n_blocks)
                (i0, i1), (j0, j1) = spans[bi], spans[bj]
                n, sx, sy, xy, xx, yy = np.frombuffer(m, np.float64).reshape(6, i1 - i0, j1 - j0)
                with np.errstate(all="ignore"):
                    vx, vy = xx - sx * sx / n, yy - sy * sy / n
                    r = np.clip((xy - sx * sy / n) / np.sqrt(vx * vy), -1.0, 1.0)
                    # a variance that is only rounding of its sum of squares is none
                    empty = ~((n > 1) & (vx > 1e-14 * xx) & (vy > 1e-14 * yy) & np.isfinite(r))
                if bi == bj:
                    r[np.diag_indices(len(r))] = 1.0
                ia, ib = (v.ravel() for v in np.meshgrid(np.arange(i0, i1), np.arange(j0, j1), indexing="ij"))
                pairs = [(ia, ib)] if bi == bj else [(ia, ib), (ib, ia)]
                for a, b in pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([cols[k] for k in a.tolist()], pa.string()),
                                                      pa.array([cols[k] for k in b.tolist()], pa.string()),
                                                      pa.array(r.ravel(), mask=empty.ravel())], ["col_a", "col_b", "r"])

    return total.mapInArrow(result, "col_a string, col_b string, r double")
