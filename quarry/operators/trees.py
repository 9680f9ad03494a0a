"""Decision trees and second-order gradient boosting on quantile histograms.

Features are cut once at exact quantiles (all distinct values where they are few) and kept as one byte each, in blocks of about
half a million rows in the order of their cells (the bins of all features; equal labels of a cell are kept once, with their number).
A level of all trees of a round is one pass: every task routes the cells of its blocks, not their rows, through the trees so
far, adds up statistics by cell, and those by (tree, node, feature, bin); the arrays are summed by a shuffle, and the driver,
which holds only these histograms (trees x nodes x features x bins numbers, whatever the rows), takes the best split of each node. A child's sums are those of its side of the split, so leaves
need no pass of their own.

Statistics are whole numbers (gradients and second derivatives in units of 2**-20), so sums do not depend on the order
of rows, tasks or merges, and a lost executor changes nothing. Sums fit 64 bits up to about 2**42 rows.

A node's score is the sum of S**2 / (W + l2) over its statistics S with weight W. Boosting: S is the gradient and W the
second derivative of the loss (squares; logistic for two classes; softmax with one tree a class and round for more). A single
tree: S are the counts of the classes (so the gain is that of the Gini impurity) or the sum of the target, W the rows. Ties go to
the first feature, then the smallest cut. Rows with x <= cut go left. Missing features count as the smallest value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.merge import PART, merged, part
from ..plans.ranking import counts, long_values, ranked
from ..session import pin

UNIT = 1 << 20


def cut_points(df: DataFrame, features: Sequence[str], bins: int = 64) -> list[np.ndarray]:
    """For each feature at most ``bins`` - 1 values after which to cut: all but the largest if there are no more distinct values
    than bins, else those in which the count of rows passes a multiple of n / bins."""
    rk = pin(ranked(counts(long_values(df, features), ["column"]), ["column"]))
    few = rk.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.max("v").alias("top"))
    step = lambda c: F.floor(c * bins / F.col("n"))
    passes = step(F.col("cum_before")) < step(F.col("cum_before") + F.col("k"))
    # a row or two of statistics a column: bounded by the schema
    kept = rk.join(F.broadcast(few), "column").where((F.col("v") < F.col("top")) & ((F.col("d") <= bins) | passes))
    found: dict[str, list[float]] = {c: [] for c in features}
    for r in kept.select("column", "v").collect():  # at most bins values a column
        found[r["column"]].append(r["v"])
    return [np.array(sorted(found[c]), np.float64) for c in features]


CELLS = "cells binary, held binary, y binary, times binary"
BLOCK = 1 << 19


def _block(held: list[tuple[np.ndarray, np.ndarray]], n_bins: int) -> pa.RecordBatch:
    """Rows in the order of their cells, a cell being the bins of all features: trees tell the rows of a cell apart by nothing.

    Of every cell its bins and number of labels; of every label in it the value and how often it is there.
    """
    x, y = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    if x.shape[1] * np.log2(n_bins) < 62:
        code = np.zeros(len(x), np.int64)
        for c in x.T:
            code = code * n_bins + c
        order = np.lexsort((y, code))
        x, y, code = x[order], y[order], code[order]
        new = code[1:] != code[:-1]
    else:
        order = np.lexsort((y, *x.T))
        x, y = x[order], y[order]
        new = (x[1:] != x[:-1]).any(axis=1)
    label = np.flatnonzero(np.append(True, new | (y[1:] != y[:-1])))
    cell = np.flatnonzero(np.append(True, new))
    held_ = np.diff(np.append(np.searchsorted(label, cell), len(label)))
    values = x[cell], held_.astype(np.int64), y[label], np.diff(np.append(label, len(y))).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["cells", "held", "y", "times"])


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in features]
    return np.nan_to_num(np.stack(cols, axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf) if cols else np.zeros((batch.num_rows, 0))


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, x[:, i], side="left")
    return out


class Tree:
    """Nodes 1, 2, 3, ... (children of i: 2 i and 2 i + 1): feature (-1: a leaf) and bin of the split; value, rows and gain."""

    def __init__(self, depth: int, channels: int):
        n = 1 << (depth + 1)
        self.feature, self.bin = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.value, self.rows, self.gain = np.zeros((n, channels)), np.zeros(n, np.int64), np.zeros(n)
        self.depth = depth

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        at = np.ones(len(bins), np.int64)
        row = np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[at]
            right = bins[row, np.maximum(f, 0)] > self.bin[at] if bins.shape[1] else np.zeros(len(bins), bool)
            at = np.where(f >= 0, 2 * at + right, at)
        return at


class Trees:
    """A fitted ensemble; ``transform`` adds ``prediction`` (and ``probability``) to a table that has the features."""

    def __init__(self, kind: str, features: Sequence[str], cuts: list[np.ndarray], base: np.ndarray, rate: float, classes: int):
        self.kind, self.features, self.cuts = kind, list(features), cuts
        self.base, self.rate, self.classes, self.rounds = base, rate, classes, []

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                value = self.rate * tree.value[tree.route(bins)]
                if len(trees) == out.shape[1]:
                    out[:, k] += value[:, 0]
                else:
                    out += value
        return out

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        if self.kind == "tree":
            return margin
        if margin.shape[1] == 1:
            p = 1 / (1 + np.exp(-margin[:, 0]))
            return np.stack([1 - p, p], axis=1)
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame) -> DataFrame:
        fields = [T.StructField("prediction", T.DoubleType())]
        if self.classes:
            fields.append(T.StructField("probability", T.ArrayType(T.DoubleType())))
        schema = T.StructType([*df.schema.fields, *fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margin = self.margins(_binned(_matrix(batch, self.features), self.cuts))
                if self.classes:
                    p = self.probabilities(margin)
                    ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
                    new = [pa.array(p.argmax(axis=1).astype(np.float64)), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))]
                else:
                    new = [pa.array(margin[:, 0])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

        return df.mapInArrow(run, schema)

    def importances(self) -> np.ndarray:
        """Share of the gain of each feature."""
        out = np.zeros(len(self.features))
        for tree in (t for trees in self.rounds for t in trees):
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    out[f] += g
        return out / out.sum() if out.sum() else out

    def splits(self) -> list[tuple]:
        """(round, tree, node, feature, threshold, rows, gain) of every inner node."""
        return [(r, k, i, self.features[f], float(self.cuts[f][tree.bin[i]]), int(tree.rows[i]), float(tree.gain[i]))
                for r, trees in enumerate(self.rounds) for k, tree in enumerate(trees) for i, f in enumerate(tree.feature.tolist()) if f >= 0]

    def save(self, spark: SparkSession, path: str) -> None:
        value = {"kind": self.kind, "features": self.features, "cuts": [c.tolist() for c in self.cuts], "base": self.base.tolist(),
                 "rate": self.rate, "classes": self.classes,
                 "rounds": [[{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in t.__dict__.items()} for t in r] for r in self.rounds]}
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trees:
        v = json.loads(spark.read.text(path).first()[0])
        out = cls(v["kind"], v["features"], [np.array(c, np.float64) for c in v["cuts"]], np.array(v["base"]), v["rate"], v["classes"])
        for r in v["rounds"]:
            trees = []
            for t in r:
                tree = Tree(t["depth"], 1)
                for k in ("feature", "bin", "rows"):
                    setattr(tree, k, np.array(t[k], np.int64))
                tree.value, tree.gain = np.array(t["value"]), np.array(t["gain"])
                trees.append(tree)
            out.rounds.append(trees)
        return out


def _statistics(model: Trees, margin: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every tree of a round the statistics (rows x channels) and weights of rows, in whole numbers."""
    whole = lambda v: np.rint(v * UNIT).astype(np.int64)
    if model.kind == "tree":
        if model.classes:
            return [((y[:, None] == np.arange(model.classes)).astype(np.int64), np.ones(len(y), np.int64))]
        return [(whole(y / model.scale)[:, None], np.ones(len(y), np.int64))]
    if not model.classes:
        return [(whole((y - margin[:, 0]) / model.scale)[:, None], np.full(len(y), UNIT))]
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-margin[:, 0]))
        return [(whole(y - p)[:, None], whole(p * (1 - p)))]
    p = model.probabilities(margin)
    return [(whole((y == k) - p[:, k])[:, None], whole(p[:, k] * (1 - p[:, k]))) for k in range(model.classes)]


def _score(s: np.ndarray, w: np.ndarray, l2: float) -> np.ndarray:
    """Sum over channels (last axis) of S**2 / (W + l2)."""
    below = w + l2
    return np.divide((s.astype(np.float64) ** 2).sum(axis=-1), below, out=np.zeros(w.shape), where=below > 0)


def best_split(h: np.ndarray, l2: float, least: int) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """From features x bins x (channels, weight, rows): gain, feature, bin, and the sums of either side. None: no gain."""
    total = h[0].sum(axis=0)
    if total[-1] < least:
        return None
    left = np.cumsum(h, axis=1)[:, :-1]
    right = total - left
    gain = (_score(left[..., :-2], left[..., -2], l2) + _score(right[..., :-2], right[..., -2], l2)
            - _score(total[:-2], total[-2], l2))
    gain[(left[..., -1] == 0) | (right[..., -1] == 0)] = -np.inf
    if not gain.size or not gain.max() > 1e-9 * max(1.0, float(_score(total[:-2], total[-2], l2))):
        return None
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b), left[f, b], right[f, b]


def fit(df: DataFrame, features: Sequence[str], label: str = "label", kind: str = "boost", classes: int = 0, rounds: int = 20,
        depth: int = 3, rate: float = 0.1, l2: float = 0.0, least: int = 2, bins: int = 64) -> Trees:
    """``kind``: 'boost' or 'tree' (one tree, ``rounds`` and ``rate`` unused). ``classes``: 0 for a number. ``least``: rows a node needs
    to be split. Labels of classes are 0 .. classes - 1; rows with a null label are left out."""
    classes = max(classes, 2) if classes else 0
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    df = df.where(F.col(label).isNotNull())
    cuts = cut_points(df, features, bins)
    width, n_bins = len(features), max([1, *(len(c) + 1 for c in cuts)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            x = _binned(_matrix(batch, features), cuts)
            held.append((x, batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False).astype(np.float64)))
            n += len(x)
            if n >= BLOCK:
                yield _block(held, n_bins)
                held, n = [], 0
        if n:
            yield _block(held, n_bins)

    whole = df.select(*features, F.col(label).cast("double").alias("_y"))
    rows = pin(whole.mapInArrow(pack, CELLS))
    n, mean, far, *share = whole.agg(F.count(F.lit(1)), F.avg("_y"), F.max(F.abs("_y")), *[
        F.count_if(F.col("_y") == k) for k in range(classes)]).first()
    if kind == "tree":
        base, rate, rounds = np.zeros(classes or 1), 1.0, 1
    elif not classes:
        base = np.array([mean or 0.0])
    else:
        p = np.clip(np.array(share, np.float64) / max(n, 1), 1e-9, 1 - 1e-9)
        base = np.array([np.log(p[1] / p[0])]) if classes == 2 else np.log(p)
    model = Trees(kind, features, cuts, base, rate, classes)
    model.scale = 1.0 if classes else float(far or 1.0) or 1.0  # the largest number: a unit is 2**-20 of it
    if n:
        for _ in range(rounds):
            _grow(rows, model, depth, l2, least)
    return model


def _grow(rows: DataFrame, model: Trees, depth: int, l2: float, least: int) -> None:
    """One round: all its trees, level by level."""
    width, n_bins = len(model.features), max([1, *(len(c) + 1 for c in model.cuts)])
    channels = model.classes if model.kind == "tree" and model.classes else 1
    n_trees = 1 if model.kind == "tree" else len(model.base)
    trees = [Tree(depth, channels) for _ in range(n_trees)]
    open_ = [{1} for _ in trees]
    unit = 1 if model.kind == "tree" and model.classes else UNIT
    for level in range(depth):
        here = [sorted(o) for o in open_]
        if not any(here) or not width:
            break

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {(k, i): np.zeros((width, n_bins, channels + 2), np.int64) for k, nodes in enumerate(here) for i in nodes}
            for cells, held, y, times in (r.values() for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                x = np.frombuffer(cells, np.uint8).reshape(-1, width)
                held, y, times = np.frombuffer(held, np.int64), np.frombuffer(y), np.frombuffer(times, np.int64)
                first = np.cumsum(held) - held
                rows_in = np.add.reduceat(times, first)
                margin = np.repeat(model.margins(x), held, axis=0)
                for k, (s, w) in enumerate(_statistics(model, margin, y)):
                    at = trees[k].route(x)
                    # the sums of a block's cells are exact in doubles
                    values = [*(np.add.reduceat(c * times, first) for c in (*s.T, w)), rows_in]
                    for i in here[k]:
                        mine = np.flatnonzero(at == i)
                        for f in range(width):
                            b = x[mine, f]
                            for c, v in enumerate(values):
                                sums[k, i][f, :, c] += np.bincount(b, weights=v[mine], minlength=n_bins).astype(np.int64)
            for (k, i), h in sums.items():
                yield part(k << 32 | i, 0, h)

        total = {r["slot"]: np.frombuffer(r["m"], np.int64).reshape(width, n_bins, channels + 2)
                 for r in merged(rows.mapInArrow(collect, PART), np.int64).collect()}
        for k, tree in enumerate(trees):
            for i in here[k]:
                h = total[k << 32 | i]
                whole = h[0].sum(axis=0)
                tree.rows[i] = whole[-1]
                if level == 0:
                    tree.value[i] = _leaf(whole, l2 * unit, model, unit)
                open_[k].discard(i)
                got = best_split(h, l2 * unit, least)
                if got is None:
                    continue
                tree.gain[i], tree.feature[i], tree.bin[i], left, right = got
                for child, side in ((2 * i, left), (2 * i + 1, right)):
                    tree.value[child], tree.rows[child] = _leaf(side, l2 * unit, model, unit), side[-1]
                    if level + 1 < depth:
                        open_[k].add(child)
    model.rounds.append(trees)


def _leaf(sums: np.ndarray, l2: float, model: Trees, unit: int) -> np.ndarray:
    """The value of a leaf from its sums: S / (W + l2), back in the units of the target."""
    if model.kind == "tree":
        return sums[:-2] / sums[-1] * (1.0 if model.classes else model.scale / UNIT)
    below = sums[-2] + l2
    value = sums[:-2] / below if below > 0 else np.zeros(len(sums) - 2)
    return value * (1.0 if model.classes else model.scale)
