"""Row-order features (lag, rolling, cumulative) without a single-task window.

``Window.partitionBy(key).orderBy(t)`` sends each key to one task, and with no key at all the
whole table goes to one task. If one key holds a third of the rows, that task holds a third
of the table. The scan here is split instead, with one shuffle of the table:

1. range-partition on (keys, order) - a hot key is cut into many contiguous slices - and sort;
2. in the same stage, stream each partition once in order and add the running values of every
   (partition, key) slice, then pin the result with a checkpoint (partition ids must not move if
   a stage is recomputed);
3. summarise the last key of every partition (one row per partition), chain the running
   totals and the last two values across partitions on that collected summary, and join the
   carry (bounded by the partition count, broadcast) into the first rows of the next partition.

Results equal a plain window over (keys) ordered by ``order_by``, which must be a total order
inside each key (add a unique tie-breaker).
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import local_table, pin

_LONG = (-(1 << 63), (1 << 63) - 1)


def _types(dt: T.DataType) -> tuple[T.DataType, T.DataType]:
    """The type in which a column's values are scanned, and that of its running sums (as Spark's ``sum`` has it)."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return dt, T.LongType()
    if isinstance(dt, T.DecimalType):
        return dt, T.DecimalType(min(38, dt.precision + 10), dt.scale)
    return T.DoubleType(), T.DoubleType()


def _add(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _checked(total: int | decimal.Decimal) -> int | decimal.Decimal:
    if isinstance(total, int) and not _LONG[0] <= total <= _LONG[1]:
        raise OverflowError("a running sum does not fit 64 bits; cast the column to a decimal")
    return total


def _join(a, b, how):
    """``how`` of two values of which either may be missing."""
    return b if a is None else a if b is None else how(a, b)


_EXACT = decimal.Context(prec=76)
_HOW = {"s": lambda a, b: _EXACT.add(a, b) if isinstance(a, decimal.Decimal) else a + b, "mx": max, "mn": min}


def _floats(x: pd.Series, seg: np.ndarray, before: dict | None, same: np.ndarray) -> dict[str, np.ndarray]:
    """Running values of one column over a batch; ``same``: rows that go on with the slice of the batch before."""
    g = x.groupby(seg)
    out = {"l1": g.shift(1), "l2": g.shift(2), "s": g.cumsum(), "mx": g.cummax(), "mn": g.cummin()}
    for k in ("s", "mx", "mn"):
        out[k] = out[k].groupby(seg).ffill()
    out = {k: v.to_numpy(copy=True) for k, v in out.items()}
    if same[0]:
        was = {k: np.nan if v is None else v for k, v in before.items()}
        out["s"][same] = np.where(np.isnan(out["s"][same]), was["s"], np.where(np.isnan(was["s"]), 0, was["s"]) + out["s"][same])
        out["mx"][same] = np.fmax(out["mx"][same], was["mx"])
        out["mn"][same] = np.fmin(out["mn"][same], was["mn"])
        out["l1"][0], out["l2"][0] = was["x"], was["l1"]
        if len(same) > 1 and same[1]:
            out["l2"][1] = was["x"]
    return out


def _longs(x: pa.Array, seg: np.ndarray, before: dict | None, same: np.ndarray) -> dict[str, pd.Series]:
    """The same for whole numbers, in 64 bits throughout; a sum that does not fit is an error."""
    no = np.asarray(x.is_null())
    v = x.cast(pa.int64()).fill_null(0).to_numpy()
    s = pd.Series(pd.arrays.IntegerArray(v.copy(), no))
    g = s.groupby(seg)
    out = {"l1": g.shift(1), "l2": g.shift(2), "s": g.cumsum(), "mx": g.cummax(), "mn": g.cummin()}
    for k in ("s", "mx", "mn"):
        out[k] = out[k].groupby(seg).ffill()
    # a sum that wrapped around lies far from the sum in floating point
    near = pd.Series(np.where(no, 0, v).astype(np.float64)).groupby(seg).cumsum().to_numpy()
    if before is not None and before["s"] is not None:
        near = near + np.where(same, float(before["s"]), 0.0)
    if len(near) and np.abs(near).max() > 9.2e18:
        for total in _exact_sums(v, no, seg, same, before):
            _checked(total)
    if same[0]:
        m = int(same.sum())
        for k in ("s", "mx", "mn"):
            if before[k] is not None:
                head = out[k].iloc[:m]
                was = pd.Series([before[k]] * m, dtype="Int64")
                both = head + before[k] if k == "s" else np.maximum(head, was) if k == "mx" else np.minimum(head, was)
                out[k].iloc[:m] = both.where(head.notna(), before[k])
        out["l1"].iloc[0] = pd.NA if before["x"] is None else before["x"]
        out["l2"].iloc[0] = pd.NA if before["l1"] is None else before["l1"]
        if m > 1:
            out["l2"].iloc[1] = pd.NA if before["x"] is None else before["x"]
    return out


def _exact_sums(v, no, seg, same, before):
    total, at = 0, None
    for x, skip, g, s in zip(v.tolist(), no, seg, same):
        if g != at:
            total, at = (before["s"] or 0) if s else 0, g
        total += 0 if skip else x
        yield total


def _objects(x: pa.Array, seg: np.ndarray, before: dict | None, same: np.ndarray) -> dict[str, list]:
    """The same for decimals, value by value."""
    out: dict[str, list] = {k: [] for k in ("l1", "l2", "s", "mx", "mn")}
    at, now = None, {}
    for v, g, s in zip(x.to_pylist(), seg.tolist(), same.tolist()):
        if g != at:
            now, at = (before if s else dict.fromkeys(("x", "l1", "s", "mx", "mn"))), g
        new = {"l1": now["x"], "l2": now["l1"], **{k: _join(now[k], v, how) for k, how in _HOW.items()}}
        for k in out:
            out[k].append(new[k])
        now = {"x": v, **{k: new[k] for k in ("l1", "s", "mx", "mn")}}
    return out


def _slices(kinds: dict[str, T.DataType], names: list[str], arrow: dict[str, pa.DataType]):
    """Streams a partition that is sorted by key and order, adding the running values of every slice."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_before, rn_before, state, done = None, 0, {}, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key = b.column(b.schema.get_field_index("_key")).to_numpy()
            new = np.concatenate(([key_before is None or key[0] != key_before], key[1:] != key[:-1]))
            seg = np.cumsum(new)
            same = seg == 0
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rn = np.arange(n) - first + 1 + np.where(same, rn_before, 0)
            added = [pa.array(rn), pa.array(np.arange(done, done + n))]
            for c, kind in kinds.items():
                x = b.column(b.schema.get_field_index(f"{c}__x"))
                if isinstance(kind, T.DoubleType):
                    got = _floats(x.to_pandas().astype("float64"), seg, state.get(c), same)
                    got = {k: pa.array(v, mask=np.isnan(v)) for k, v in got.items()}
                elif isinstance(kind, T.DecimalType):
                    got = {k: pa.array(v, arrow[f"{c}__{k}"]) for k, v in _objects(x, seg, state.get(c), same).items()}
                else:
                    got = {k: pa.array(v, pa.int64()).cast(arrow[f"{c}__{k}"]) for k, v in _longs(x, seg, state.get(c), same).items()}
                added += [got[k] for k in ("l1", "l2", "s", "mx", "mn")]
                state[c] = {"x": x[-1].as_py(), **{k: got[k][-1].as_py() for k in ("l1", "s", "mx", "mn")}}
            key_before, rn_before, done = key[-1], int(rn[-1]), done + n
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names)
    return scan


def ordered_scan(df: DataFrame, cols: Sequence[str], order_by: Sequence[str],
                 partition_by: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Return ``df`` plus, for each c in ``cols``: c__lag1, c__lag2, c__cumsum, c__cummax, c__cummin.

    Cumulative statistics skip nulls (they are the statistic of the non-null values so far). Every value keeps its type:
    whole numbers stay whole (sums are longs; one that does not fit 64 bits is an error), decimals are exact (sums have ten
    digits more, as Spark's ``sum``), floats are doubles.
    """
    spark = df.sparkSession
    keys = list(partition_by or [])
    cols, order_by = list(cols), list(order_by)
    P = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {c: _types(df.schema[c].dataType)[0] for c in cols}
    sums = {c: _types(df.schema[c].dataType)[1] for c in cols}
    base = df if keys else df.withColumn("_g", F.lit(0))
    gkeys = keys or ["_g"]
    ready = base.repartitionByRange(P, *gkeys, *order_by).sortWithinPartitions(*gkeys, *order_by).select(
        "*", F.spark_partition_id().alias("_pid"), F.xxhash64(*gkeys).alias("_key"),
        *[F.col(c).cast(kinds[c]).alias(f"{c}__x") for c in cols])
    more = [T.StructField("_rn", T.LongType()), T.StructField("_idx", T.LongType())]
    more += [T.StructField(f"{c}__{k}", sums[c] if k == "s" else kinds[c]) for c in cols for k in ("l1", "l2", "s", "mx", "mn")]
    schema = T.StructType([*ready.schema.fields, *more])
    arrow = {f.name: to_arrow_type(f.dataType) for f in more}
    local = pin(ready.mapInArrow(_slices(kinds, schema.names, arrow), schema))

    # one row per partition: the slice of its last key
    last_fields = [F.col(k).alias(k) for k in gkeys] + [F.col("_rn").alias("_n")]
    for c in cols:
        last_fields += [F.col(f"{c}__x").alias(f"{c}__x"), F.col(f"{c}__l1").alias(f"{c}__x2"),
                        F.col(f"{c}__s").alias(f"{c}__s"), F.col(f"{c}__mx").alias(f"{c}__mx"),
                        F.col(f"{c}__mn").alias(f"{c}__mn")]
    summary = (local.groupBy("_pid").agg(F.max_by(F.struct(*last_fields), F.col("_idx")).alias("z"))
               .select("_pid", "z.*"))
    # Carry chain over the partitions, on the collected summary (one row per partition): the
    # running totals and last two values of a key through partition p go to the next non-empty
    # partition, where they complete the first rows of that key.
    rows = sorted(summary.collect(), key=lambda r: r["_pid"])
    carry_rows, prev = [], None
    for i, r in enumerate(rows):
        key = tuple(r[k] for k in gkeys)
        cont = prev is not None and prev["key"] == key  # the key ran through the previous partition
        through = {"key": key}
        vals = []
        for c in cols:
            x, x2 = r[f"{c}__x"], r[f"{c}__x2"]
            s_, mx, mn = r[f"{c}__s"], r[f"{c}__mx"], r[f"{c}__mn"]
            if cont:
                p = prev[c]
                s_, mx, mn = (_join(p[k], v, _HOW[k]) for k, v in (("s", s_), ("mx", mx), ("mn", mn)))
            second = x2 if r["_n"] >= 2 else (prev[c]["x"] if cont else None)
            through[c] = {"x": x, "s": s_, "mx": mx, "mn": mn}
            vals += [x, second, s_ if s_ is None else _checked(s_), mx, mn]
        if i + 1 < len(rows):
            carry_rows.append((rows[i + 1]["_pid"], *key, *vals))
        prev = through
    key_fields = [base.schema[k] for k in gkeys]
    carry_schema = T.StructType(
        [T.StructField("_pid", T.IntegerType())] + key_fields +
        [T.StructField(f"{c}__{n}", sums[c] if n == "cs" else kinds[c]) for c in cols for n in ("c1", "c2", "cs", "cmx", "cmn")])
    carry = local_table(spark, carry_rows, carry_schema)  # at most one row per range partition

    cond = local["_pid"] == carry["_pid"]
    for k in gkeys:
        cond = cond & local[k].eqNullSafe(carry[k])
    joined = local.join(F.broadcast(carry), cond, "left")
    out = [local[c] for c in base.columns if c != "_g"]
    rn = local["_rn"]
    for c in cols:
        c1, c2 = carry[f"{c}__c1"], carry[f"{c}__c2"]
        has = carry["_pid"].isNotNull()
        out += [
            F.when(has & (rn == 1), c1).otherwise(local[f"{c}__l1"]).alias(f"{c}__lag1"),
            F.when(has & (rn == 1), c2).when(has & (rn == 2), c1).otherwise(local[f"{c}__l2"]).alias(f"{c}__lag2"),
            _add(local[f"{c}__s"], carry[f"{c}__cs"]).cast(sums[c]).alias(f"{c}__cumsum"),
            F.greatest(local[f"{c}__mx"], carry[f"{c}__cmx"]).alias(f"{c}__cummax"),
            F.least(local[f"{c}__mn"], carry[f"{c}__cmn"]).alias(f"{c}__cummin"),
        ]
    return joined.select(*out)


def rolling3(x0: Column, x1: Column, x2: Column) -> tuple[Column, Column]:
    """Mean and sample std over the non-null values among the current and two previous rows."""
    vals = [x0, x1, x2]
    cnt = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in vals), F.lit(0))
    tot = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
    mean = F.when(cnt > 0, tot / cnt)
    ss = sum((F.when(v.isNotNull(), (v - mean) * (v - mean)).otherwise(0.0) for v in vals), F.lit(0.0))
    std = F.when(cnt > 1, F.sqrt(ss / (cnt - 1)))
    return mean, std
