"""Hard negatives by Strassen products of integer tiles and bounded heaps.

Components become floor(scale * x). Anchors and candidates are dealt out as tiles (blocks of rows by the hash of their key,
vectors of one length together); a tile's scores are one int64 matrix product by Strassen's recursion: operands are halved in
every direction (padded with zeros to even sizes), seven products of sums replace eight, and operands of at most ``LEAF`` are
multiplied plainly. All additions are of integers, so scores are exact; where the sizes of the components do not prove that
all scores fit 64 bits, the tile is worked out with Python's integers instead.

Two rounds over tiles. In the first a row meets anchors of its own label only, and a heap an anchor keeps its best ``positives``
rows. In the second a heap for each anchor and positive keeps the best ``negatives`` rows of other labels in the positive's
window: low * positive score <= 100 * score <= high * positive score. Heaps are bounded, and merging those of two
tiles and keeping the best again gives the heap of both, so each task hands on its heaps only and Spark merges them.

Rows with a null label, a null or empty vector, or a null or non-finite component take no part. Vectors of different
lengths do not meet. Of rows with equal ids one counts (that with the smallest label, then vector hash); a null id is
left out. Ties are by smaller id. A score beyond 64 bits is an error, not a wrong number. An anchor without positives, or a
positive with an empty window (so every negative positive score), gives no rows; nor does an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

LEAF = 32


def plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x b of integers, row by row of b (no floating point anywhere)."""
    return a @ b


def _pad(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    out = np.zeros((rows, cols), x.dtype)
    out[:x.shape[0], :x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a x b for integer matrices of any sizes."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return plain(a, b)
    even = lambda x: x + x % 2
    if (n, k, m) != (even(n), even(k), even(m)):
        return strassen(_pad(a, even(n), even(k)), _pad(b, even(k), even(m)), leaf)[:n, :m]
    n, k, m = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * n, 2 * m), p1.dtype)
    out[:n, :m], out[:n, m:] = p1 + p4 - p5 + p7, p3 + p5
    out[n:, :m], out[n:, m:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and of b, exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    # sums inside the recursion may wrap around: modulo 2**64 all of it stays exact, so only the result has to fit
    most = max(map(abs, (int(a.min()), int(a.max())))) * max(map(abs, (int(b.min()), int(b.max())))) * a.shape[1]
    if a.dtype != object and b.dtype != object and most < 1 << 63:
        return strassen(a, b.T)
    out = strassen(a.astype(object), b.T.astype(object))
    if max(abs(int(out.min())), abs(int(out.max()))) >= 1 << 63:
        raise OverflowError("an inner product does not fit 64 bits")
    return out.astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each group: larger scores first, then smaller keys."""
    order = np.lexsort((key, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python's integers where that is not enough."""
    y = np.floor(scale * x)
    if np.isfinite(y).all() and (np.abs(y) < 2.0 ** 62).all():
        return y.astype(np.int64)
    from fractions import Fraction
    exact = [[int(v) if np.isfinite(v) else int(Fraction(float(u)) * scale) for u, v in zip(p, q)] for p, q in zip(x, y)]
    return np.array(exact, object).reshape(x.shape)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in col.to_pylist()])


def mine(table: DataFrame, anchor, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, tile: int = 4096, side: int = 512) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchor``: a condition on the key.

    A tile is ``side`` anchors by ``tile`` rows at most, on average.
    """
    spark = table.sparkSession

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                rows = batch.slice(part, 2000)
                keep, body, dim = [], [], []
                for i, v in enumerate(rows.column(1).to_pylist()):
                    if v and None not in v:
                        x = np.array(v, np.float64)
                        if np.isfinite(x).all():
                            keep.append(i)
                            body.append(x.tobytes())
                            dim.append(len(x))
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(2).take(at), pa.array(dim, pa.int32()),
                                                  pa.array(body, pa.binary())], ["id", "lab", "dim", "vec"])

    types = table.select(key, label).schema
    kind, lab = (types[i].dataType.simpleString() for i in (0, 1))
    rows = (table.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, vector, label)
            .mapInArrow(prepare, f"id {kind}, lab {lab}, dim int, vec binary"))
    # of rows with equal ids one
    rows = save(rows.groupBy("id").agg(F.min_by(F.struct("lab", "dim", "vec"), F.struct("lab", F.xxhash64("vec"), "vec")).alias("s"))
                .select("id", "s.*").withColumn("anchor", anchor(F.col("id"))), "mine-rows")

    def tiles(rows: DataFrame, anchors: DataFrame, same: list[str]) -> tuple[DataFrame, DataFrame]:
        """Rows and anchors with the numbers of every tile they are in; tiles hold rows that agree in ``same``."""
        n = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"), F.count_if("anchor").alias("_a")).select(
            *same, F.ceil(F.col("_n") / tile).alias("_r"), F.ceil(F.col("_a") / side).alias("_s")).where("_s > 0")
        right = (rows.join(n, same).withColumn("r", F.pmod(F.xxhash64("id"), F.col("_r")))
                 .withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1))))
        left = (anchors.join(n, same).withColumn("s", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_s")))
                .withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1))))
        left = left.drop("_r", "_s")
        return left.toDF(*left.columns), right.drop("_r", "_s")  # columns of their own on either side

    def product(a: pa.Table, b: pa.Table) -> np.ndarray:
        return scores(quantise(_matrix(a.column("vec")), scale), quantise(_matrix(b.column("vec")), scale))

    def first(a: pa.Table, b: pa.Table) -> pa.Table:
        """Heaps of positives."""
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], f.type) for f in heap], schema=heap)
        ids, own, s = b.column("id").to_numpy(), a.column("id").to_numpy(), product(a, b)
        i, j = np.nonzero(_reach(s, positives + 1))
        i, j = _without(i, j, ids[j] != own[i])
        at = best(i, s[i, j], ids[j], positives)
        i, j = i[at], j[at]
        return pa.table([a.column("id").take(pa.array(i)), b.column("id").take(pa.array(j)), pa.array(s[i, j])], schema=heap)

    from pyspark.sql.pandas.types import to_arrow_schema
    heap_type = f"anchor_id {kind}, positive_id {kind}, positive_score long"
    heap = to_arrow_schema(spark.createDataFrame([], heap_type).schema)
    same = ["dim", "lab"]
    left, right = tiles(rows, rows.where("anchor"), same)
    on = [*same, "s", "r"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(first, heap_type)
    by = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= positives)
    # an anchor with its positives (at most as many as asked for)
    chosen = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("p"))
    anchors = save(rows.where("anchor").join(chosen.withColumnRenamed("anchor_id", "id"), "id"), "mine-positives")

    result_type = f"anchor_id {kind}, positive_id {kind}, negative_id {kind}, positive_score long, negative_score long"
    result = to_arrow_schema(spark.createDataFrame([], result_type).schema)

    def second(a: pa.Table, b: pa.Table) -> pa.Table:
        """Heaps of every window."""
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], f.type) for f in result], schema=result)
        ids, s = b.column("id").to_numpy(), product(a, b)
        mine, labels = np.array(a.column("lab").to_pylist(), object), np.array(b.column("lab").to_pylist(), object)
        known, code = np.unique(np.concatenate([mine, labels]), return_inverse=True)
        out: list[list] = [[], [], [], []]
        for i, heaps in enumerate(a.column("p").to_pylist()):
            other = np.flatnonzero(code[len(mine):] != code[i])
            order = other[np.lexsort((ids[other], -s[i, other]))]
            falling = -s[i, order]
            for p in heaps:
                score = p["positive_score"]
                floor, top = -(-low * score // 100), high * score // 100  # in integers of any size
                if floor > top:
                    continue
                lo, hi = np.searchsorted(falling, -top), np.searchsorted(falling, -floor, side="right")
                take = order[lo:min(hi, lo + negatives)]
                out[0] += [i] * len(take)
                out[1] += [p] * len(take)
                out[2].append(take)
        at, j = pa.array(out[0], pa.int64()), np.concatenate([*out[2], np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table([a.column("id").take(at), pa.array([p["positive_id"] for p in out[1]], result.field(1).type),
                         b.column("id").take(pa.array(j)), pa.array([p["positive_score"] for p in out[1]], pa.int64()),
                         pa.array(s[np.array(out[0], np.int64), j])], schema=result)

    left, right = tiles(rows, anchors, ["dim"])
    on = ["dim", "s", "r"]
    heaps = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(second, result_type)
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return heaps.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _reach(s: np.ndarray, k: int) -> np.ndarray:
    """Entries not below the k-th largest of their row."""
    if s.shape[1] <= k:
        return np.ones(s.shape, bool)
    return s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]


def _without(i: np.ndarray, j: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return i[keep], j[keep]
