"""Nearest neighbours through a partitioned index: coarse cells, exact distances inside the probed ones.

``ml.knn`` compares every test row with every train row. Here the train rows are dealt to the cells of a coarse clustering
(fitted on a bounded sample; every row is indexed), and a test row is compared, exactly, with the rows of its nearest cells.
How many cells it probes is not a guess: for a bounded sample of test rows the true neighbours come from the exact way, and
the probes are as many as it takes for the wanted share of them to lie in a probed cell. With probes equal to the number
of cells the answer is the exact one.

A cell that holds many rows is cut into blocks by the hash of the key, so no task holds more than two blocks; a cell's rows are
never dropped. Ties are as in ``ml.knn``: smaller distance, then smaller train key; votes to the smaller label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import seeded_order
from ..session import pin
from .ml import SEED, nearest_rows, vote


def _stack(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows by a seeded hash of the key, the same in every run."""
    return df.orderBy(seeded_order(SEED, F.col(key)), key).limit(n)


def cluster(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's centres of a sample, started from rows spread by distance; empty cells keep their centre."""
    r = np.random.default_rng(SEED)
    centres = x[np.sort(r.permutation(len(x))[:cells])].copy()
    for _ in range(rounds):
        near = order_cells(x, centres, 1)[:, 0]
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def order_cells(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """For each row its nearest cells, nearest first."""
    if x.shape[1] != centres.shape[1]:  # no row, or no train row to take centres from
        return np.zeros((len(x), probes), np.int64)
    d = (centres ** 2).sum(axis=1)[None, :] - 2 * x @ centres.T
    if probes < len(centres):
        first = np.argpartition(d, probes - 1, axis=1)[:, :probes]
    else:
        first = np.tile(np.arange(len(centres)), (len(x), 1))
    return np.take_along_axis(first, np.argsort(np.take_along_axis(d, first, axis=1), axis=1, kind="stable"), axis=1)


class VectorIndex:
    """Train rows (tk, y, v, cell) and the centres of their cells."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, sizes: dict[int, int]):
        self.rows, self.centres, self.sizes = rows, centres, sizes

    @classmethod
    def fit(cls, train: DataFrame, key: str, vector: str, label: str = "label", cells: int | None = None,
            per_cell: int = 64, most: int = 4096) -> VectorIndex:
        """About the root of the row count cells, at most ``most``; the centres come from ``per_cell`` rows a cell."""
        train = train.select(F.col(key).alias("tk"), F.col(label).cast("double").alias("y"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
        n = train.count()
        cells = max(1, min(n, cells or min(most, math.isqrt(n))))
        taken = [r["v"] for r in sample_rows(train, "tk", cells * per_cell).select("v").collect()]
        centres = cluster(np.array(taken, np.float64), cells) if taken else np.zeros((1, 1))
        rows = pin(_assigned(train, centres, 1, "cell").withColumn("cell", F.element_at("cell", 1)))
        sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # one row a cell
        return cls(rows, centres, sizes)

    def candidates(self, test: DataFrame, k: int, probes: int, block_rows: int = 20000) -> DataFrame:
        """qk, tk, y, d: the k nearest of every probed block, for test rows (qk, v)."""
        spark, key_type = test.sparkSession, dict(self.rows.dtypes)["tk"]
        cut = {c: math.ceil(n / block_rows) for c, n in self.sizes.items()}
        blocks = F.create_map(*[F.lit(x) for c, b in cut.items() if b > 1 for x in (c, b)]) if any(b > 1 for b in cut.values()) else None
        of = lambda c: F.coalesce(F.element_at(blocks, c), F.lit(1)) if blocks is not None else F.lit(1)
        train = self.rows.select("tk", "y", "v", "cell").withColumn("b", F.pmod(F.xxhash64("tk"), of(F.col("cell"))))
        asked = _assigned(test.select("qk", "v"), self.centres, probes, "cells").select("qk", "v", F.explode("cells").alias("cell"))
        asked = asked.select("qk", "v", "cell", F.explode(F.sequence(F.lit(0).cast("long"), (of(F.col("cell")) - 1).cast("long"))).alias("b"))
        # a cell that many test rows probe is dealt over tasks too: its train block is sent to each part of the queries
        parts = max(1, spark.sparkContext.defaultParallelism // max(1, sum(cut.values())))
        asked = asked.withColumn("p", F.pmod(F.xxhash64("qk"), F.lit(parts)))
        train = train.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        on = ["cell", "b", "p"]
        return asked.groupBy(*on).cogroup(train.groupBy(*on)).applyInPandas(
            lambda q, t: nearest_rows(q, t, k), f"qk {key_type}, tk {key_type}, y double, d double")

    def probes_for(self, test: DataFrame, k: int, recall: float, queries: int = 200) -> int:
        """Cells to probe so that ``recall`` of the true neighbours of ``queries`` sampled test rows are found."""
        sample = pin(sample_rows(test.select("qk", "v"), "qk", queries))
        exact = best(self.candidates(sample, k, len(self.centres)), k).select("qk", "tk")
        cells = exact.join(self.rows.select("tk", "cell"), "tk").groupBy("qk").agg(F.collect_list("cell").alias("cells"))
        rank = []
        for r in sample.join(cells, "qk").collect():  # k cells for each of a bounded number of rows
            order = order_cells(np.array([r["v"]], np.float64), self.centres, len(self.centres))[0]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            rank += place[r["cells"]].tolist()
        if not rank:
            return len(self.centres)
        return 1 + int(np.sort(rank)[min(len(rank) - 1, math.ceil(recall * len(rank)) - 1)])


def _assigned(df: DataFrame, centres: np.ndarray, probes: int, name: str) -> DataFrame:
    """``df`` with the nearest cells of its column v; the centres are bounded by the number of cells."""
    schema = df.withColumn(name, F.lit(None).cast("array<int>")).schema
    at = df.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                rows = batch.slice(lo, 2048)
                cells = order_cells(_stack(rows.column(at)), centres, probes).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(cells), pa.list_(pa.int32()))], schema.names)

    return df.mapInArrow(run, schema)


def best(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qk").orderBy("d", "tk")
    return candidates.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def knn_indexed(train: DataFrame, test: DataFrame, key: str, vector: str, k: int = 3, mode: str = "classify",
                recall: float = 0.95, probes: int | None = None, cells: int | None = None) -> DataFrame:
    """key, prediction for every test row from its neighbours found through the index.

    ``probes``: cells to search; by default found by measuring ``recall``. A null vector is not indexed and gets no
    prediction; an empty train table gives none.
    """
    index = VectorIndex.fit(train, key, vector, cells=cells)
    test = pin(test.select(F.col(key).alias("qk"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull()))
    probes = min(len(index.centres), probes or index.probes_for(test, k, recall))
    return vote(best(index.candidates(test, k, probes), k), mode).withColumnRenamed("qk", key)


def auto_knn(train: DataFrame, test: DataFrame, key: str, vector: str, k: int = 3, mode: str = "classify",
             pairs: int = 10 ** 11, **index) -> DataFrame:
    """``ml.knn`` up to ``pairs`` pairs of train and test rows, the index beyond."""
    from .ml import knn
    if train.count() * test.count() <= pairs:
        return knn(train, test, key, vector, k, mode)
    return knn_indexed(train, test, key, vector, k, mode, **index)
