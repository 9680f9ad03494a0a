"""Type families, NaN normalisation, portable hashing and small column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def family(dt: T.DataType) -> str:
    """numeric / text / datetime / other. Booleans are never numeric here."""
    if isinstance(dt, T.BooleanType):
        return "other"
    if isinstance(dt, _NUMERIC):
        return "numeric"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dt, _DATETIME):
        return "datetime"
    return "other"


def cols_of(df: DataFrame, fam: str | None = None, cols: Iterable[str] | None = None) -> list[str]:
    """Columns of ``df`` (optionally restricted to ``cols``, in table order) of one family."""
    wanted = None if cols is None else set(cols)
    out = []
    for f in df.schema.fields:
        if wanted is not None and f.name not in wanted:
            continue
        if fam is None or family(f.dataType) == fam:
            out.append(f.name)
    return out


def type_name(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN and NULL are one concept (missing): turn float NaN into NULL once, on input."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
            changed = True
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs) if changed else df


def stable_hash(c: Column) -> Column:
    """Portable 32-bit hash: first 8 hex digits of md5, as a number (same in DuckDB)."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def seeded_order(seed: int, key: Column) -> Column:
    """Deterministic pseudo-random order key: md5 of seed || key (portable to SQL)."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def dbl(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)
