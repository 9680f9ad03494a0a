"""Nearest neighbours by largest inner product with collision-counting hashing.

Vectors are scaled so that the longest has length 1 and get one more component that fills each up to length 1; queries get a
zero there. The larger the inner product, the smaller then the Euclidean distance. ``projections`` random directions (rows of
random rotations) give single-projection hashes. Every block of about ``block`` vectors keeps one sorted array a projection.

A query opens a window around its own projection in each array and counts for each vector in how many arrays it lies in the
window. The half-width is ``width`` times a radius; a vector at that radius or nearer collides in ``need`` of the arrays but for
a chance of ``miss`` (worked out by simulation for the dimension). Vectors with so many collisions are verified by their exact
inner product. Virtual rehashing widens the windows by a factor of ``grow`` a level, counting only what is new (or, where
that is less, what is still outside), until enough vectors are verified; their distance then is the last radius, so that
all within it are found at the same chance. Nothing is capped: every vector that exceeds the threshold is verified, and if the
widest windows leave a query short, it is compared with the whole block.

A query starts in one block, and takes the radius found there to all the others, where one level is enough. Equal vectors are
one class with its smallest ids (as many as can be asked for); a class that is asked for often is searched once.
The queries against all rows are dealt out as pairs of blocks; a task returns a query's best of its block.

Inner products are in double precision on the original vectors, summed in the same order for every pair. Vectors that are null,
empty, zero, or hold null or non-finite components take no part; nor do vectors of different lengths meet. Of rows with
equal ids one counts (by vector hash); a null id is left out. Ties are by smaller id. With fewer other rows than asked
for, all are returned; a query alone in its length, or an empty table, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cap_filters import unit
from .common import save


@functools.cache
def directions(dim: int, projections: int) -> np.ndarray:
    """dim x projections: columns of random rotations, scaled so that components of a unit vector have variance 1."""
    r = np.random.default_rng(7)
    turns = [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-projections // dim))]
    return np.concatenate(turns, axis=1)[:, :projections] * np.sqrt(dim)


@functools.cache
def threshold(dim: int, projections: int, width: float, miss: float) -> int:
    """Collisions that a vector at the radius reaches but for a chance of ``miss``."""
    x = np.random.default_rng(8).standard_normal((20_000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = (np.abs(x @ directions(dim, projections)) <= width).sum(axis=1)
    return int(np.sort(hits)[int(miss * len(hits))])


class Block:
    """Sorted projections of a block of vectors (unit length, with the filling component), and the originals."""

    def __init__(self, x: np.ndarray, lifted: np.ndarray, copies: np.ndarray, projections: int):
        self.x, self.lifted, self.copies, self.n = x, lifted, copies, len(x)
        h = lifted @ directions(lifted.shape[1], projections)
        self.order = np.ascontiguousarray(np.argsort(h, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.sort(h, axis=0).T)

    def windows(self, h: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every query's (row's) window in every array."""
        lo = np.stack([np.searchsorted(s, v) for s, v in zip(self.sorted, (h - half[:, None]).T)], axis=1)
        hi = np.stack([np.searchsorted(s, v, side="right") for s, v in zip(self.sorted, (h + half[:, None]).T)], axis=1)
        return lo, hi

    def widen(self, counts: np.ndarray, lo0: np.ndarray, hi0: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Collisions in the windows lo to hi, from those in lo0 to hi0 inside them."""
        if (lo + self.n - hi).sum() < (lo0 - lo + hi - hi0).sum():
            out = [a for o, i, j in zip(self.order, lo.tolist(), hi.tolist()) for a in (o[:i], o[j:])]
            return len(self.order) - np.bincount(np.concatenate(out), minlength=self.n)
        ring = [a for o, i, i0, j0, j in zip(self.order, lo.tolist(), lo0.tolist(), hi0.tolist(), hi.tolist())
                for a in (o[i:i0], o[j0:j])]
        return counts + np.bincount(np.concatenate(ring), minlength=self.n)

    def search(self, lifted: np.ndarray, k: int, radius: np.ndarray | None, width: float, miss: float, grow: float,
               start: float) -> list[tuple[np.ndarray, float]]:
        """For each query (row) the places of verified vectors and the distance within which ``k`` rows are known.

        ``radius``: such distances known from elsewhere; then one level is enough.
        """
        m, all_ = len(self.order), np.arange(self.n)
        out: list = [None] * len(lifted)
        if self.copies.sum() <= k:
            far = np.inf if radius is None else radius
            return [(all_, float(f)) for f in np.broadcast_to(far, len(lifted))]
        need = threshold(self.lifted.shape[1], m, width, miss)
        h = lifted @ directions(self.lifted.shape[1], m)
        last = np.full(len(lifted), radius is not None)
        reach = np.full(len(lifted), start) if radius is None else radius.astype(np.float64).copy()
        counts = np.zeros((len(lifted), self.n), np.int16)
        spans = self.windows(h, np.zeros(len(lifted)))
        spans = spans[0], spans[0]
        active = np.arange(len(lifted))
        for i in active[np.isinf(reach)]:
            out[i] = all_, np.inf
        active = active[~np.isinf(reach)]
        while len(active):
            wide = self.windows(h[active], width * reach[active])
            go_on = []
            for w, i in enumerate(active.tolist()):
                lo, hi = wide[0][w], wide[1][w]
                counts[i] = self.widen(counts[i], spans[0][i], spans[1][i], lo, hi)
                spans[0][i], spans[1][i] = lo, hi
                at = np.flatnonzero(counts[i] >= need)
                if radius is not None:
                    out[i] = at, float(reach[i])
                    continue
                # any k rows bound the distance: those with most collisions give a close bound
                likely = at if len(at) <= 8 * k else at[np.argpartition(-counts[i][at], 8 * k)[:8 * k]]
                known = self.kth(likely, lifted[i], k)
                if known <= reach[i] or last[i]:
                    out[i] = at, known
                elif np.isfinite(known):  # the windows of that distance find all within it
                    reach[i], last[i] = known, True
                    go_on.append(i)
                elif reach[i] > 2:
                    out[i] = all_, self.kth(all_, lifted[i], k)
                else:
                    reach[i] *= grow
                    go_on.append(i)
            active = np.array(go_on, np.int64)
        return out

    def kth(self, at: np.ndarray, lifted: np.ndarray, k: int) -> float:
        """The distance of the k-th nearest row of these places (infinite if they are fewer)."""
        copies = self.copies[at]
        if copies.sum() < k:
            return np.inf
        far = np.sqrt(((self.lifted[at] - lifted) ** 2).sum(axis=1))
        order = np.argsort(far)
        return float(far[order][np.searchsorted(np.cumsum(copies[order]), k)])

    def products(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (self.x[at] * q).sum(axis=1)


def lift(x: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Unit vectors times ``share`` (lengths as shares of the longest), filled up to length 1."""
    share = np.minimum(share, 1.0)
    return np.concatenate([unit(x) * share[:, None], np.sqrt(1 - share ** 2)[:, None]], axis=1)


def _stack(col: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in col.to_pylist()])


def search(table: DataFrame, query, k: int = 20, key: str = "vec_id", vector: str = "embedding", projections: int = 128,
           width: float = 1.7, miss: float = 0.01, grow: float = 1.4, start: float = 0.3, block: int = 16384,
           side: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows found for every row that meets ``query`` (a condition on the key).

    The block that a query starts in is a sample of about ``block`` rows; every row is indexed and searched.
    """
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                rows = batch.slice(part, 2000)
                keep, body, dim, length, h1, h2 = [], [], [], [], [], []
                for i, v in enumerate(rows.column(1).to_pylist()):
                    if not v or None in v:
                        continue
                    x = np.array(v, np.float64) + 0.0  # one zero
                    if not np.isfinite(x).all() or not x.any():
                        continue
                    top, raw = np.abs(x).max(), x.tobytes()
                    h = xxhash.xxh3_128_intdigest(raw)
                    keep.append(i)
                    body.append(raw)
                    dim.append(len(x))
                    length.append(float(np.log(top) + np.log(np.linalg.norm(x / top))))
                    h1.append((h >> 64) - (1 << 63))
                    h2.append((h & ((1 << 64) - 1)) - (1 << 63))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(keep, pa.int64())), pa.array(dim, pa.int32()), pa.array(h1, pa.int64()),
                     pa.array(h2, pa.int64()), pa.array(length, pa.float64()), pa.array(body, pa.binary())],
                    ["id", "dim", "h1", "h2", "len", "vec"])

    kind = table.schema[key].dataType.simpleString()
    rows = save(table.where(F.col(key).isNotNull()).select(key, vector).mapInArrow(
        prepare, f"id {kind}, dim int, h1 long, h2 long, len double, vec binary"), "hash-rows")
    same = ["dim", "h1", "h2"]
    ids = rows.groupBy("id").agg(F.min(F.struct(*same)).alias("s")).select("id", "s.*")
    # the smallest ids of every class of equal vectors: one more than can be asked for, as a query leaves itself out
    first = ids.withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy("id"))).where(F.col("n") <= k + 1)
    classes = first.groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = ids.where(query(F.col("id")))
    longest = rows.groupBy("dim").agg(F.max("len").alias("longest"))
    sizes = classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("nb"))
    reps = (rows.groupBy(*same).agg(F.first("vec").alias("vec"), F.first("len").alias("len"))
            .join(classes, same).join(asked.select(*same, F.lit(True).alias("asked")).distinct(), same, "left")
            .join(longest, "dim").join(sizes, "dim")
            .select("dim", F.col("ids")[0].alias("id"), "ids", "vec", F.exp(F.col("len") - F.col("longest")).alias("share"), "nb",
                    F.coalesce("asked", F.lit(False)).alias("asked"))
            .withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb"))))
    reps = save(reps, "hash-classes")
    # queries are dealt out again by another hash
    queries = reps.where("asked").select("dim", "id", "vec", "nb")
    groups = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / side).alias("ns"))
    queries = queries.join(groups, "dim").withColumn("s", F.pmod(F.xxhash64("id", F.lit(1)), F.col("ns"))).drop("ns")
    queries = queries.toDF(*queries.columns)  # columns of their own beside those of the points
    points = reps.join(groups, "dim").select("dim", "b", "id", "ids", "vec", "share", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("ns") - 1)).alias("s"))

    found_type = f"qid {kind}, ids array<{kind}>, score double, reach double"
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(table.sparkSession.createDataFrame([], found_type).schema)

    def look(q: pa.Table, p: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if q.num_rows and p.num_rows:
            x, y = _stack(p.column("vec")), _stack(q.column("vec"))
            here = Block(x, lift(x, p.column("share").to_numpy()), p.column("ids").combine_chunks().value_lengths().to_numpy(),
                         projections)
            radius = q.column("reach").to_numpy() if "reach" in q.schema.names else None
            keys, ids = p.column("id").to_numpy(), p.column("ids").combine_chunks()
            lifted = lift(y, np.ones(len(y)))
            lifted[:, -1] = 0
            for i, (at, reach) in enumerate(here.search(lifted, k + 1, radius, width, miss, grow, start)):
                s = here.products(at, y[i])
                best = np.lexsort((keys[at], -s))[:k + 1]
                out[0] += [i] * len(best)
                out[1].append(at[best])
                out[2].append(s[best])
                out[3] += [reach] * len(best)
            at = pa.array(np.concatenate(out[1]), pa.int64())
            return pa.table([q.column("id").take(pa.array(out[0], pa.int64())), ids.take(at), pa.array(np.concatenate(out[2])),
                             pa.array(out[3], pa.float64())], schema=schema)
        return pa.table([pa.array([], f.type) for f in schema], schema=schema)

    on = ["dim", "s", "b"]
    # a query starts in the block its own vector is dealt to by the hash of its group, so that starts are spread over all blocks
    started = queries.withColumn("b", F.pmod(F.xxhash64("dim", "s"), F.col("nb")))
    one = save(started.groupBy(*on).cogroup(points.groupBy(*on)).applyInArrow(look, found_type), "hash-start")
    reach = one.groupBy(F.col("qid").alias("id")).agg(F.max("reach").alias("reach"))
    others = (started.withColumnRenamed("b", "own").join(reach, "id")
              .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).where("b <> own").drop("own"))
    rest = others.groupBy(*on).cogroup(points.groupBy(*on)).applyInArrow(look, found_type)
    every = one.unionByName(rest).select("qid", "ids", "score")
    by = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("ids")[0])
    best = every.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    # at most k + 1 classes a query, of at most k + 1 ids each: the best k + 1 rows
    rows_of = best.groupBy("qid").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.transform(
        "ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("vec_id")))))), 1, k + 1).alias("found"))
    mine = asked.join(classes.select(*same, F.col("ids")[0].alias("qid")), same).select("qid", F.col("id").alias("query_id"))
    answers = mine.join(rows_of, "qid").select("query_id", F.slice(F.filter(
        "found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("at", "f")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", (-F.col("f.less")).alias("score"))
