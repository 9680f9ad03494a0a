"""Reading, writing, previewing and sampling tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import seeded_order

# fixed values: the tokens pandas' CSV reader treats as missing by default
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# order in which a text column is tried: whole numbers, then decimals, booleans (True / False), then timestamps
_INFER_ORDER = ["bigint", "double", "boolean", "timestamp_ntz"]

# what may be a whole number: a cast that fails costs far more than this look
WHOLE = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _parsed(name: str, kind: str) -> str:
    if kind == "boolean":
        return f"CASE {_q(name)} WHEN 'True' THEN true WHEN 'False' THEN false END"
    return f"try_cast(trim({_q(name)}) AS {kind})"


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None,
               infer: bool = True, multi_line: bool = False) -> DataFrame:
    """Read a headered CSV (pandas-style missing tokens and type inference) or a Parquet table.

    CSV is read as text, the missing tokens become NULL, then every column takes the narrowest
    of bigint / double / boolean / timestamp that all its values parse as (one aggregate pass), else
    stays text; text dates become timestamps (pandas would leave them as text). A given ``schema``
    skips inference and casts with ``try_cast``. Files are split over tasks; quoted values that hold
    line breaks need ``multi_line``, which reads each file in one task. A dot in a header becomes an
    underscore, as Spark reads a dot in a column's name as a field access.
    """
    if fmt == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r} (csv or parquet)")
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    names = []
    for c in raw.columns:
        c = c.replace(".", "_")
        while c in names:
            c += "_"
        names.append(c)
    raw = raw.toDF(*names)
    na = F.array(*[F.lit(x) for x in NA_TOKENS])
    clean = raw.select(*[F.when(F.array_contains(na, F.col(c)) | F.col(c).isNull(), None)
                         .otherwise(F.col(c)).alias(c) for c in raw.columns])
    if schema is not None:
        st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        return clean.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
                              for f in st.fields])
    if not infer:
        return clean
    checks = []
    for c in clean.columns:
        for ty in _INFER_ORDER:
            parsed = F.expr(_parsed(c, ty))
            if ty == "bigint":
                parsed = F.when(F.col(c).rlike(WHOLE), parsed)
            checks.append(F.count_if(F.col(c).isNotNull() & parsed.isNull()).alias(f"{c}\u0001{ty}"))
        checks.append(F.count(F.col(c)).alias(f"{c}\u0001n"))
    bad = clean.agg(*checks).first().asDict()  # one row: 4 counters per column
    out = []
    for c in clean.columns:
        chosen = "string"
        if bad[f"{c}\u0001n"] > 0:
            for ty in _INFER_ORDER:
                if bad[f"{c}\u0001{ty}"] == 0:
                    chosen = ty
                    break
        out.append(F.col(c) if chosen == "string" else F.expr(_parsed(c, chosen)).alias(c))
    return clean.select(*out)


def _flatten_for_csv(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a headered CSV without index; nested columns go through ``to_json``."""
    (_flatten_for_csv(df).write.mode(mode).option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    return path


def preview(df: DataFrame, order_by: Sequence[str | Column], k: int = 10) -> DataFrame:
    """First k rows in row order: TakeOrderedAndProject, a bounded top-k per task."""
    return df.orderBy(*order_by).limit(k)


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, repeatable: the n smallest md5(seed||key)."""
    k = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in key])
    return df.orderBy(seeded_order(seed, k), *key).limit(n)


def cap_rows(df: DataFrame, n: int | None, order_by: Sequence[str]) -> DataFrame:
    """Keep the first n rows in key order; ``None`` keeps everything (the default)."""
    return df if n is None else df.orderBy(*order_by).limit(n)
