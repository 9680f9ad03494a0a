"""Helpers shared by the training-data operators: written tables, connected components, Arrow batches, hashes."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def save(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a table that ``save`` wrote, once nothing reads it any more (its successors are written)."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def made_in_task(sample: DataFrame, make: Callable[[list[tuple]], Any]) -> Any:
    """What ``make`` returns for the rows of a bounded sample, made in a task: only the result reaches the driver, not the
    sample and what training on it takes. None without rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(rows))], pa.binary())], ["made"])

    got = sample.repartition(1).mapInArrow(run, "made binary").collect()
    return pickle.loads(got[0][0]) if got else None


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: one row (id, component_id = smallest id) per vertex that has an edge.

    Alternates large-star and small-star steps; every round is a few aggregates and joins over at most
    the number of edges, written to the shared folder. Stops when a round changes nothing.
    """
    e = save(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct(), "cc")

    def state(d: DataFrame):
        r = d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = state(e)
    for _ in range(max_rounds):
        if now[0] == 0:
            break
        sym = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = sym.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        big = sym.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = big.groupBy("v").agg(F.min("u").alias("m"))
        small = (big.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .unionByName(low.select("v", F.col("m").alias("u"))).where("v > u").distinct())
        e, old = save(small, "cc"), e
        drop(old)
        nxt = state(e)
        if nxt == now:
            break
        now = nxt
    else:
        raise RuntimeError("components: no fixed point")
    return e.select(F.col("v").alias("id"), F.col("u").alias("component_id")).unionByName(
        e.select(F.col("u").alias("id"), F.col("u").alias("component_id")).distinct())


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (uint64 in, uint64 out, wraps)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_P = 0xD6E8FEB86659FD93  # odd base of the polynomial hash
_PINV = pow(_P, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_pow_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown and kept per worker."""
    have = _pow_cache.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        k = 1
        while k < len(out):
            step = np.uint64(pow(base, k, 1 << 64))
            m = min(k, len(out) - k)
            out[k:k + m] = out[:m] * step
            k += m
        _pow_cache[base] = have = out
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of table[data[j]] * P**j over j < i, modulo 2**64 (len(data) + 1 values)."""
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_BYTE[data] * powers(_P, len(data)), out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] from prefix sums, independent of the position; length is mixed in."""
    h = (s[end] - s[start]) * powers(_PINV, len(s))[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


#: the white space of the word rule [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    edge = np.diff(np.concatenate(([0], (~SPACE[data]).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def binary_parts(col: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    for v in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()):
        b = v.as_buffer()
        yield b"" if b is None else b.to_pybytes()


def portions(lengths: np.ndarray, rows: int = 1000, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``size`` bytes; a longer row comes alone."""
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and (i - at >= rows or total + n > size):
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def byte_lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column, null as 0."""
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups: rows must arrive with equal keys side by side.

    Holds one batch and the unfinished last group, so callers keep groups bounded.
    """
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if t.num_rows == 0:
            continue
        change = group_starts(t, keys)
        cut = int(change[-1])
        rest = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Index of the first row of each run of equal keys."""
    n = t.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n vertices over the edges (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label
