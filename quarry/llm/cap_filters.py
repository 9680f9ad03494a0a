"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A vector, rotated at random (in ``turns`` independent ways) and cut into ``blocks`` parts, passes every filter direction whose inner product with it
is at least ``alpha``. A direction is one code vector per part (``codes`` random unit vectors each), so there are
turns * codes ** blocks of them, and the passing ones are list-decoded from the parts: sums over half of the parts that
cannot reach the threshold with the best of the other half are cut before the halves are joined. Vectors of one label that pass
a common filter are compared; each pair counts at the first filter both pass.

Exact copies are one class with a count. A filter that more than ``block`` vectors pass is dealt out as pairs of
blocks; nothing in it is dropped. Tasks return one row a vector (its links there, and an edge of a spanning forest),
never one a pair. ``recall`` measures the search against brute force. For ten times the vectors of a label, raise
``codes`` by a quarter or ``alpha`` by 0.02: the vectors that pass a filter by chance then stay as few.

``alpha`` holds for 64 dimensions or fewer. Inner products with a random direction shrink with the square root of the
dimension, so in more dimensions the threshold is the one at which as many filters are expected to pass as at 64
(``threshold``); how alike two vectors' filters are depends on their cosine, not on the dimension. A vector that passes no
filter takes its nearest one of every turn.

Cosines are in double precision. Vectors that are null, zero, or hold null or non-finite components, and rows with a
null label, link with nothing. Vectors of different lengths do not link. Of rows with equal ids one counts (the smallest
label, then hash); a null id is left out. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, group_starts, grouped, save, shuffle_partitions

_codes: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def directions(dim: int, blocks: int, codes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation (dim x padded dim) and the code vectors (blocks x codes x part)."""
    got = _codes.get((dim, blocks, codes, seed))
    if got is None:
        part = -(-dim // blocks)
        r = np.random.default_rng(100 + seed)
        turn = np.linalg.qr(r.standard_normal((part * blocks, part * blocks)))[0][:dim]
        c = r.standard_normal((blocks, codes, part))
        got = _codes[dim, blocks, codes, seed] = turn, c / np.linalg.norm(c, axis=2, keepdims=True)
    return got


@functools.cache
def threshold(dim: int, blocks: int, codes: int, alpha: float) -> float:
    """The inner product that as large a share of filters reaches in ``dim`` dimensions as ``alpha`` in 64."""
    if dim <= 64:
        return alpha
    r = np.random.default_rng(99)

    def reached(d: int) -> np.ndarray:
        """Sorted inner products of random vectors with sums of half of the code vectors, for either half."""
        turn, c = directions(d, blocks, codes, 0)
        x = unit(r.standard_normal((400, d))) @ turn
        dots = np.einsum("nbp,bkp->nbk", x.reshape(400, blocks, -1), c)
        return dots / np.sqrt(blocks)

    def share(dots: np.ndarray, at: float) -> float:
        """Share of the filters that reach ``at``; the parts are drawn at random where there are more than two."""
        total = 0.0
        for d in dots:
            a = sum((r.choice(x, codes) for x in d[1:blocks // 2]), d[0])
            b = np.sort(sum((r.choice(x, codes) for x in d[blocks // 2 + 1:]), d[blocks // 2])) if blocks > 1 else np.zeros(1)
            total += np.sum(len(b) - np.searchsorted(b, at - a)) / (len(a) * len(b))
        return total / len(dots)

    want, here = share(reached(64), alpha), reached(dim)
    low, high = 0.0, alpha
    for _ in range(20):
        middle = (low + high) / 2
        low, high = (middle, high) if share(here, middle) > want else (low, middle)
    return high


def decode(x: np.ndarray, blocks: int, codes: int, turns: int, alpha: float) -> list[np.ndarray]:
    """For each row of unit vectors the sorted numbers of all filters it passes."""
    alpha = threshold(x.shape[1], blocks, codes, alpha)
    each = [_decode(x, blocks, codes, t, alpha) for t in range(turns)]
    out = [np.concatenate(f) for f in zip(*each)]
    none = [i for i, f in enumerate(out) if not len(f)]
    if none:
        for i, f in zip(none, np.stack([_nearest(x[none], blocks, codes, t) for t in range(turns)], axis=1)):
            out[i] = f
    return out


def _nearest(x: np.ndarray, blocks: int, codes: int, turn_no: int) -> np.ndarray:
    """For each row the number of the filter with the largest inner product."""
    turn, c = directions(x.shape[1], blocks, codes, turn_no)
    best = np.einsum("nbp,bkp->nbk", (x @ turn).reshape(len(x), blocks, -1), c).argmax(axis=2)
    number = np.zeros(len(x), np.int64)
    for b in range(blocks):
        number = number * codes + best[:, b]
    return turn_no * codes ** blocks + number


def _decode(x: np.ndarray, blocks: int, codes: int, turn_no: int, alpha: float) -> list[np.ndarray]:
    turn, c = directions(x.shape[1], blocks, codes, turn_no)
    y = (x @ turn).reshape(len(x), blocks, -1)
    dots = np.einsum("nbp,bkp->nbk", y, c)
    need = alpha * np.sqrt(blocks)
    out = []
    for d in dots:
        halves = []
        for part in (d[:blocks // 2], d[blocks // 2:]):
            total, number = part[0], np.arange(codes)
            for more in part[1:]:
                total = (total[:, None] + more[None, :]).ravel()
                number = (number[:, None] * codes + np.arange(codes)[None, :]).ravel()
            halves.append((total, number))
        (a, an), (b, bn) = halves
        top_a, top_b = a.max(), b.max()
        keep = a >= need - top_b
        a, an = a[keep], an[keep]
        keep = b >= need - top_a
        b, bn = b[keep], bn[keep]
        order = np.argsort(-b)
        b, bn = b[order], bn[order]
        many = np.searchsorted(-b, a - need, side="right")  # for each first half, the second halves that reach the need
        first = np.repeat(an, many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append(np.sort(turn_no * codes ** blocks + first * codes ** (blocks - blocks // 2) + bn[place]))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of double vectors scaled to length 1; safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(body: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.float64) for b in body.to_pylist()]


def link(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98,
         blocks: int = 2, codes: int = 256, turns: int = 8, alpha: float = 0.44, block: int = 256) -> DataFrame:
    """key, n_links, component_id, kept: one row per key."""
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                rows = batch.slice(part, 2000)
                ok, h1, h2, body = [], [], [], []
                for v, lab in zip(rows.column(1).to_pylist(), rows.column(2)):
                    good = False
                    if v and lab.is_valid and None not in v:
                        x = np.array(v, np.float64) + 0.0
                        good = bool(np.isfinite(x).all() and x.any())
                    ok.append(good)
                    raw = x.tobytes() if good else b""
                    h = xxhash.xxh3_128_intdigest(raw)
                    h1.append((h >> 64) - (1 << 63))
                    h2.append((h & ((1 << 64) - 1)) - (1 << 63))
                    body.append(raw)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(ok), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                     pa.array(body, pa.binary())], [key, "lab", "ok", "h1", "h2", "vec"])

    P = shuffle_partitions(table.sparkSession)
    types = table.select(key, F.xxhash64(label).alias("lab")).schema
    source = table.where(F.col(key).isNotNull()).select(
        key, vector, F.when(F.col(label).isNotNull(), F.xxhash64(label)).alias("lab"))
    rows = save(source.mapInArrow(prepare, f"`{key}` {types[0].dataType.simpleString()}, lab long, ok boolean, h1 long, "
                                           "h2 long, vec binary"), "cap-rows")
    same = ["lab", "h1", "h2"]
    per_key = rows.groupBy(key).agg(F.min(F.struct((~F.col("ok")).alias("bad"), *same)).alias("s")).select(
        key, (~F.col("s.bad")).alias("ok"), *[f"s.{c}" for c in same])
    classes = (per_key.where("ok").groupBy(*same).agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("copies")))
    reps = rows.where("ok").select(F.col(key).alias("id"), *same, "vec").dropDuplicates(["id", *same]).join(
        classes, ["id", *same])

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                t = batch.slice(part, 512)
                vecs = _vectors(t.column(3))
                found: list = [None] * len(vecs)
                dims = np.array([len(v) for v in vecs])
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x = unit(np.stack([vecs[i] for i in at]))
                    for i, f in zip(at, decode(x, blocks, codes, turns, alpha)):
                        found[i] = f
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(found, pa.list_(pa.int64()))],
                                                 ["id", "lab", "copies", "vec", "filters"])

    kind = types[0].dataType.simpleString()
    reps = save(reps.select("id", "lab", "copies", "vec").mapInArrow(
        filters, f"id {kind}, lab long, copies long, vec binary, filters array<long>"), "cap-filters")
    passed = reps.select("id", "lab", F.explode("filters").alias("f"))
    shared = passed.groupBy("lab", "f").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks_of = F.ceil(F.col("m") / block)
    dealt = (passed.join(shared, ["lab", "f"]).withColumn("nb", blocks_of)
             .withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")))
             .select("id", "f", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o"))
             .select("id", "f", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
             .join(reps, "id"))
    keys = ["lab", "f", "p", "q"]
    blocked = dealt.repartition(P, *keys).sortWithinPartitions(*keys, "b", "id").select(
        *keys, "b", "id", "copies", "vec", "filters")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, keys):
            edge = np.append(group_starts(t, keys), t.num_rows)
            cols = {c: t.column(c).to_numpy() for c in ("f", "p", "q", "b", "id", "copies")}
            out: list[list] = [[], [], []]
            for i, j in zip(edge[:-1], edge[1:]):
                if j - i < 2:
                    continue
                vecs = _vectors(t.column("vec").slice(i, j - i))
                dims = np.array([len(v) for v in vecs])
                near = np.zeros((j - i, j - i), bool)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x = unit(np.stack([vecs[k] for k in at]))
                    near[np.ix_(at, at)] = x @ x.T >= cosine
                if cols["p"][i] != cols["q"][i]:
                    side = cols["b"][i:j]
                    near &= side[:, None] != side[None, :]
                np.fill_diagonal(near, False)
                if near.any():
                    near &= ~_earlier(t.column("filters").slice(i, j - i), cols["f"][i])
                mine = np.flatnonzero(near.any(axis=1))
                if len(mine):
                    ids = cols["id"][i:j]
                    first = forest(j - i, *np.nonzero(near))
                    out[0].append(ids[mine])
                    out[1].append(near[mine] @ cols["copies"][i:j])
                    out[2].append(ids[first[mine]])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["id", "links", "root"])

    found = save(blocked.mapInArrow(compare, f"id {kind}, links long, root {kind}"), "cap-links")
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    totals = (classes.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(comp, "id", "left")
              .select(*same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id")))
    totals = totals.withColumn("ok", F.lit(True))
    return per_key.join(totals, ["ok", *same], "left").select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", key).alias("component_id"),
        (F.col(key) == F.coalesce("component_id", key)).alias("kept"))


def _earlier(lists: pa.ChunkedArray, f: int) -> np.ndarray:
    """Pairs of rows that pass a common filter with a number below f."""
    flat = [np.asarray(x, np.int64) for x in lists.to_pylist()]
    n = len(flat)
    row = np.repeat(np.arange(n), [len(x) for x in flat])
    value = np.concatenate(flat)
    row, value = row[value < f], value[value < f]
    known, col, times = np.unique(value, return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    number = np.cumsum(times > 1) - 1
    keep = times[col] > 1
    row, col = row[keep], number[col[keep]]
    for lo in range(0, int((times > 1).sum()), 4096):
        at = (col >= lo) & (col < lo + 4096)
        m = np.zeros((n, 4096), np.float32)
        m[row[at], col[at] - lo] = 1
        out += m @ m.T
    return out > 0


def recall(x: np.ndarray, cosine: float = 0.98, blocks: int = 2, codes: int = 256, turns: int = 8, alpha: float = 0.44) -> float:
    """Share of the pairs at or above the cosine, by brute force, that pass a common filter."""
    x = unit(np.asarray(x, np.float64))
    sets = [set(f.tolist()) for f in decode(x, blocks, codes, turns, alpha)]
    i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    return float(np.mean([not sets[a].isdisjoint(sets[b]) for a, b in zip(i, j)])) if len(i) else 1.0
