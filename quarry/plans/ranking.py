"""Exact order statistics without a single-task sort.

Spark's exact ``percentile`` aggregate keeps every distinct value of a group in one hash map
and, for a global aggregate, merges them all in one task. That does not survive a column with
billions of distinct values. The plan here is fully distributed and exact:

1. ``counts``: ``groupBy(key, value).count()`` - map-side combined, so a hot value costs one
   row, not a third of the table.
2. ``ranked``: range-partition the counts on (key, value), pin the layout with a checkpoint,
   take a running sum inside each (partition, key) slice, and add the totals of the slices
   before it. Only groups that cross a partition boundary need an offset, and there are at
   most two per partition, so the offset table is bounded by 2 x partitions and is broadcast.
3. ``quantiles``: every row of the ranked table knows the rank interval it covers; one more
   aggregate picks the rows under the target ranks and interpolates (pandas / DuckDB
   ``quantile_cont`` / Spark ``percentile`` semantics).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import local_table, pin


def long_values(df: DataFrame, cols: Sequence[str], key: str = "column", value: str = "v",
                cast: str = "double", keep_nulls: bool = False) -> DataFrame:
    """Unpivot ``cols`` into (key, value) rows, values cast to one type."""
    if not cols:
        raise ValueError("no columns")
    wide = df.select(*[F.col(c).cast(cast).alias(c) for c in cols])
    out = wide.unpivot([], list(cols), key, value)
    return out if keep_nulls else out.where(F.col(value).isNotNull())


def counts(long: DataFrame, keys: Sequence[str], value: str = "v", weight: str = "k") -> DataFrame:
    return long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(weight))


def _null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(right[c])
        cond = e if cond is None else cond & e
    return cond


def ranked(cnt: DataFrame, keys: Sequence[str], value: str = "v", weight: str = "k",
           partitions: int | None = None) -> DataFrame:
    """Add ``cum_before`` (rows of the same key with a smaller value) and ``n`` (rows of the key).

    ``cnt`` holds one row per (key, value) with its multiplicity ``weight``.
    """
    spark = cnt.sparkSession
    keys = list(keys)
    P = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = pin(cnt.repartitionByRange(P, *keys, value).withColumn("_pid", F.spark_partition_id()))
    slice_w = Window.partitionBy("_pid", *keys)
    run_w = slice_w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = laid.select(
        "_pid", *keys, value, weight,
        F.coalesce(F.sum(weight).over(run_w), F.lit(0)).alias("_local_before"),
        F.sum(weight).over(slice_w).alias("_local_n"),
    )
    # slice totals straight from the pinned layout (an aggregate, no second window pass)
    slices = laid.groupBy("_pid", *keys).agg(F.sum(weight).alias("_local_n"))
    key_struct = F.struct(*[F.col(c) for c in keys])
    slice_struct = F.struct(*[F.col(c) for c in keys], F.col("_local_n"))
    ends = slices.groupBy("_pid").agg(
        F.min_by(slice_struct, key_struct).alias("first"),
        F.max_by(slice_struct, key_struct).alias("last"),
    )
    # Only the first and last key of a partition can continue across a boundary. The offsets
    # of those at most 2 x partitions slices are a running sum over partition order, done on
    # the collected summary (one row per partition, never data rows).
    seen: dict[tuple, list] = {}
    for row in sorted(ends.collect(), key=lambda r: r["_pid"]):
        for end in {tuple(row["first"]), tuple(row["last"])}:
            seen.setdefault(end[:-1], []).append((row["_pid"], end[-1]))
    edge_rows = []
    for k, parts in seen.items():
        total, base = sum(n for _, n in parts), 0
        for pid, n in sorted(parts):
            edge_rows.append((pid, *k, base, total))
            base += n
    key_fields = [cnt.schema[c] for c in keys]
    edge_schema = T.StructType([T.StructField("_pid", T.IntegerType())] + key_fields +
                               [T.StructField("_base", T.LongType()), T.StructField("_n_all", T.LongType())])
    edge = local_table(spark, edge_rows, edge_schema)
    # at most 2 rows per range partition: bounded by the partition count, safe to broadcast
    e = F.broadcast(edge).alias("e")
    joined = local.alias("l").join(e, _null_safe_on(local.alias("l"), e, ["_pid", *keys]), "left")
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in keys], F.col(f"l.{value}").alias(value),
        F.col(f"l.{weight}").alias(weight),
        (F.coalesce(F.col("e._base"), F.lit(0)) + F.col("l._local_before")).alias("cum_before"),
        F.coalesce(F.col("e._n_all"), F.col("l._local_n")).alias("n"),
    )


def quantiles(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float],
              exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """One row per column: ``column`` plus one double per named probability.

    Linear interpolation between the order statistics at floor/ceil of p*(n-1).
    ``exact=False`` uses ``percentile_approx`` in a single aggregate pass instead.
    """
    names = list(probs)
    if not cols:
        raise ValueError("no numeric columns")
    if not exact:
        aggs = [F.struct(F.lit(c).alias("column"),
                         *[F.percentile_approx(F.col(c).cast("double"), float(probs[n]), accuracy).alias(n)
                           for n in names]) for c in cols]
        return _small(df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*"))
    rk = ranked(counts(long_values(df, cols), ["column"]), ["column"])
    aggs = []
    for n in names:
        p = float(probs[n])
        pos = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.floor(pos), F.ceil(pos)
        covers_lo = (F.col("cum_before") <= lo) & (lo < F.col("cum_before") + F.col("k"))
        covers_hi = (F.col("cum_before") <= hi) & (hi < F.col("cum_before") + F.col("k"))
        aggs += [F.max(F.when(covers_lo, F.col("v"))).alias(f"{n}__lo"),
                 F.max(F.when(covers_hi, F.col("v"))).alias(f"{n}__hi"),
                 F.max(pos).alias(f"{n}__pos")]
    picked = rk.groupBy("column").agg(*aggs)
    out = [F.col("column")]
    for n in names:
        pos, lo_v, hi_v = F.col(f"{n}__pos"), F.col(f"{n}__lo"), F.col(f"{n}__hi")
        interp = (F.ceil(pos) - pos) * lo_v + (pos - F.floor(pos)) * hi_v
        out.append(F.when(F.floor(pos) == F.ceil(pos), lo_v).otherwise(interp).alias(n))
    return _small(picked.select(*out))


def _small(df: DataFrame) -> DataFrame:
    """Materialise a per-column statistics table (one row per column: bounded by the schema).

    Downstream operators read it in several scalar subqueries and joins; as a local relation it
    is computed once instead of once per reference.
    """
    return local_table(df.sparkSession, [tuple(r) for r in df.collect()], df.schema)
