"""Exploration and preparation: imputation, cleaning, outliers, missing values, transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import clean_nan, cols_of, family, type_name
from ..plans.ranking import _small, quantiles, ranked
from ..session import local_table, pin
from .profile import column_info, missing_info, skew_kurt_exprs, value_counts


def _by_column(small: DataFrame) -> dict:
    """Rows of a per-column statistics table (one row per column, already local) by column."""
    return {r["column"]: r for r in small.collect()}


def _lookup(rows: dict, small: DataFrame, column: str, field: str) -> Column:
    """One field of such a table as a typed literal: no scalar-subquery job per reference."""
    row = rows.get(column)
    return F.lit(None if row is None else row[field]).cast(small.schema[field].dataType)


def medians(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    return quantiles(clean_nan(df), list(cols), {"median": 0.5}, exact=exact)


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, mode: most frequent non-null value, smallest on ties.

    From the distributed value counts with a top-1 per column (partial WindowGroupLimit), not
    the ``mode`` aggregate, whose single-task merge holds every distinct value.
    """
    vc = value_counts(df, cols).where(F.col("value").isNotNull())
    w = Window.partitionBy("column").orderBy(F.col("k").desc(), F.col("value"))
    top = vc.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("column", F.col("value").alias("mode"))
    return _small(top)  # one row per column


def impute_median(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
                  med: DataFrame | None = None) -> DataFrame:
    """Numeric nulls -> exact median of the column.

    Columns without a null stay as they are. A filled integer column becomes decimal(38,6), which holds every
    value exactly (a double would merge ids above 2**53); floats become double, decimals keep their type.
    """
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    if not cols:
        return df
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    cols = [c for c in cols if holes[c]]
    if not cols:
        return df
    med = med if med is not None else medians(df, cols, exact)
    rows, fill = _by_column(med), {}
    for c in cols:
        kind = df.schema[c].dataType.typeName()
        to = "double" if kind in ("float", "double") else (
            df.schema[c].dataType.simpleString() if kind == "decimal" else "decimal(38,6)")
        fill[c] = F.coalesce(F.col(c).cast(to), _lookup(rows, med, c, "median").cast(to)).alias(c)
    return df.select(*[fill.get(c, F.col(c)) for c in df.columns])


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None, default: str = "Unknown",
                md: DataFrame | None = None) -> DataFrame:
    """Non-numeric nulls -> mode (smallest on ties); text columns with no value -> ``default``."""
    df = clean_nan(df)
    cols = [c for c in (cols or df.columns) if family(df.schema[c].dataType) != "numeric"]
    if not cols:
        return df
    md = md if md is not None else modes(df, cols)
    rows, fill = _by_column(md), {}
    for c in cols:
        m = _lookup(rows, md, c, "mode")
        if family(df.schema[c].dataType) == "text":
            fill[c] = F.coalesce(F.col(c), m, F.lit(default)).alias(c)
        else:
            fill[c] = F.coalesce(F.col(c), m.cast(df.schema[c].dataType)).alias(c)
    return df.select(*[fill.get(c, F.col(c)) for c in df.columns])


def impute_constant(df: DataFrame, cols: Sequence[str] | None = None, value: str = "Unknown") -> DataFrame:
    cols = cols_of(df, "text", cols)
    return df.fillna(value, subset=cols) if cols else df


def strip_lower(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", ""))


def standardize_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Trim (Unicode whitespace) and lowercase text columns; null stays null."""
    cols = set(cols_of(df, "text", cols))
    return df.select(*[strip_lower(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row dedupe over every column (map-side partial distinct, one shuffle)."""
    return clean_nan(df).distinct()


def clean_table(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True
                ) -> tuple[DataFrame, DataFrame]:
    """Impute (median / mode) -> standardise text -> drop duplicate rows; returns (table, log).

    The log has one row per change: action, column, count, value.
    """
    df = clean_nan(df)
    cols = list(cols or df.columns)
    num = cols_of(df, "numeric", cols)
    other = [c for c in cols if c not in num]
    text = cols_of(df, "text", cols)
    med = medians(df, num, exact) if num else None  # small tables, computed once
    md = modes(df, other) if other else None
    out = impute_median(df, num, exact, med) if num else df
    out = impute_mode(out, other, md=md) if other else out
    out = standardize_text(out, text) if text else out
    cleaned = out.distinct()
    spark = df.sparkSession
    info = column_info(df, cols).select("column", "missing")
    fills = []
    if num:
        fills.append(med.select("column", F.col("median").cast("string").alias("value"),
                                F.lit("fill_median").alias("action")))
    if other:
        fills.append(md.select("column", F.col("mode").alias("value"), F.lit("fill_mode").alias("action")))
        no_mode = local_table(spark, [(c,) for c in text], "column string")
        fills.append(no_mode.select("column", F.lit("Unknown").alias("value"), F.lit("fill_mode").alias("action"))
                     .join(md, "column", "left_anti"))
    log_parts = []
    if fills:
        f = fills[0]
        for x in fills[1:]:
            f = f.unionByName(x)
        log_parts.append(info.where(F.col("missing") > 0).join(f, "column").select(
            "action", "column", F.col("missing").alias("count"), "value"))
    if text:
        log_parts.append(local_table(spark, [("standardize_text", c) for c in text], "action string, column string")
                         .select("action", "column", F.lit(None).cast("bigint").alias("count"),
                                 F.lit(None).cast("string").alias("value")))
    removed = out.select(F.count(F.lit(1))).scalar() - cleaned.select(F.count(F.lit(1))).scalar()
    log_parts.append(spark.range(1).select(F.lit("drop_duplicates").alias("action"),
                                           F.lit(None).cast("string").alias("column"),
                                           removed.cast("bigint").alias("count"),
                                           F.lit(None).cast("string").alias("value")).where(F.col("count") > 0))
    log = log_parts[0]
    for x in log_parts[1:]:
        log = log.unionByName(x)
    return cleaned, log


def outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column, q1, q3, iqr, lower_bound, upper_bound, outlier_count, outlier_pct (of all rows)."""
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    q = quantiles(df, cols, {"q1": 0.25, "q3": 0.75}, exact=exact).select(
        "column", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_bound"))
    counts, rows = [], _by_column(q)
    for c in cols:
        x = F.col(c).cast("double")
        lo, hi = _lookup(rows, q, c, "lower_bound"), _lookup(rows, q, c, "upper_bound")
        counts.append(F.struct(F.lit(c).alias("column"), F.count_if((x < lo) | (x > hi)).alias("outlier_count")))
    n = F.count(F.lit(1))
    cnt = df.agg(F.array(*counts).alias("a"), n.alias("rows")).select(F.explode("a").alias("s"), "rows").select(
        "s.*", "rows")
    return q.join(cnt, "column").select("column", "q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count",
                                        F.try_divide(F.col("outlier_count") * 100.0, F.col("rows")).alias("outlier_pct"))


def outlier_rows(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Rows whose ``column`` lies outside the 1.5 IQR fences."""
    df = clean_nan(df)
    q = quantiles(df, [column], {"q1": 0.25, "q3": 0.75}, exact=exact)
    rows = _by_column(q)
    q1, q3 = _lookup(rows, q, column, "q1"), _lookup(rows, q, column, "q3")
    x = F.col(column)
    return df.where((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)))


def boxplot_stats(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column, q1, median, q3, whisker_low, whisker_high, fliers (matplotlib's 1.5 IQR whiskers)."""
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    q = quantiles(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}, exact=exact)
    items, rows = [], _by_column(q)
    for c in cols:
        x = F.col(c).cast("double")
        q1, q3 = _lookup(rows, q, c, "q1"), _lookup(rows, q, c, "q3")
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = (x >= lo) & (x <= hi)
        items.append(F.struct(F.lit(c).alias("column"), F.min(F.when(inside, x)).alias("whisker_low"),
                              F.max(F.when(inside, x)).alias("whisker_high"),
                              F.count_if((x < lo) | (x > hi)).alias("fliers")))
    w = df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return q.join(w, "column").select("column", "q1", "median", "q3", "whisker_low", "whisker_high", "fliers")


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, missing_count, missing_pct, data_type."""
    return missing_info(df, cols).select("column", F.col("missing").alias("missing_count"),
                                        F.col("missing_pct"), F.col("type").alias("data_type"))


def missing_pattern(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """pattern ('1' = missing, in column order), missing_columns, rows: which columns are null together."""
    df = clean_nan(df)
    cols = list(cols or df.columns)
    pat = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    names = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    # the names are a function of the pattern: grouping by both keeps a hash aggregate
    return df.groupBy(pat.alias("pattern"), names.alias("missing_columns")).agg(F.count(F.lit(1)).alias("rows"))


def variance_importance(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, importance_score (sample variance), normalized_score (variance / max, 0 if max is 0), rank."""
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    if len(cols) < 2:
        raise ValueError("need at least 2 numeric columns for feature importance analysis")
    items = [F.struct(F.lit(c).alias("feature"), F.var_samp(F.col(c)).alias("importance_score"),
                      F.max(F.col(c)).cast("double").alias("_max")) for c in cols]
    v = df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    norm = F.when(F.col("_max") != 0, F.try_divide(F.col("importance_score"), F.col("_max"))).otherwise(F.lit(0.0))
    w = Window.orderBy(F.col("importance_score").desc_nulls_last(), F.col("feature"))
    # a window over one row per column: bounded by the schema, not the data
    return v.select("feature", "importance_score", norm.alias("normalized_score"),
                    F.row_number().over(w).alias("rank"))


def shape_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """One small action: (G1 skewness, std) per column; the result decides the output schema."""
    items = []
    for c in cols:
        g1, _ = skew_kurt_exprs(F.col(c).cast("double"))
        items.append(F.struct(g1.alias("skew"), F.stddev_samp(F.col(c)).alias("std")))
    row = clean_nan(df).agg(*[it.alias(c) for it, c in zip(items, cols)]).first()
    return {c: (row[c]["skew"], row[c]["std"]) for c in cols}


def transform_log(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 1.0,
                  stats: dict | None = None) -> DataFrame:
    """Add ``{c}_log`` = log1p(c) for numeric columns whose skewness is above ``threshold``.

    log1p of x <= -1 is NULL in Spark (pandas gives -inf / NaN)."""
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    stats = stats or shape_stats(df, cols)
    new = [F.log1p(F.col(c).cast("double")).alias(f"{c}_log") for c in cols
           if stats[c][0] is not None and stats[c][0] > threshold]
    return df.select("*", *new)


def transform_standardize(df: DataFrame, cols: Sequence[str] | None = None, stats: dict | None = None) -> DataFrame:
    """Add ``{c}_standardized`` = (x - mean) / std for numeric columns with std > 0."""
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    stats = stats or shape_stats(df, cols)
    keep = [c for c in cols if stats[c][1] is not None and stats[c][1] > 0]
    if not keep:
        return df
    agg = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in keep])
    new = [((F.col(c) - agg.select(F.col(f"{c}.m")).scalar()) / agg.select(F.col(f"{c}.s")).scalar())
           .alias(f"{c}_standardized") for c in keep]
    return df.select("*", *new)


def label_codes(df: DataFrame, cols: Sequence[str], missing: str = "missing") -> DataFrame:
    """(column, value, code): 0-based position of each distinct value in sorted order.

    Nulls count as the string ``missing``. Codes come from the distributed ranking (each distinct
    value weighs 1, so the rows before it are its code), not from a one-task dense_rank.
    """
    vc = value_counts(df, cols).select("column", F.coalesce("value", F.lit(missing)).alias("v")).distinct()
    rk = ranked(vc.withColumn("k", F.lit(1)), ["column"], value="v", weight="k")
    # read once per encoded column: pinned (size = distinct values, so not collected)
    return pin(rk.select("column", F.col("v").alias("value"), F.col("cum_before").cast("int").alias("code")))


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_encoded", missing: str = "missing",
                 source: DataFrame | None = None) -> DataFrame:
    """Append ``{c}{suffix}`` integer codes (sorted order, null -> ``missing``) of the values of ``source`` (default ``df``).

    One join per column on the value; AQE picks broadcast when the code table is small and
    splits skewed values otherwise.
    """
    codes = label_codes(df if source is None else source, cols, missing)
    out = df
    for c in cols:
        key = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        cc = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}{suffix}"))
        out = out.join(cc, key == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    return out


def transform_label_encode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return label_encode(df, cols_of(df, "text", cols), "_encoded")


def transform_table(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """log (skew > 1), standardise (std > 0), label-encode text; returns (table, change log)."""
    df = clean_nan(df)
    cols = list(cols or df.columns)
    num = cols_of(df, "numeric", cols)
    text = cols_of(df, "text", cols)
    stats = shape_stats(df, num) if num else {}
    out = transform_log(df, num, stats=stats) if num else df
    out = transform_standardize(out, num, stats=stats) if num else out
    out = label_encode(out, text, "_encoded") if text else out
    changes = []
    for c in cols:
        if c in num:
            if stats[c][0] is not None and stats[c][0] > 1:
                changes.append(("log1p", c, f"{c}_log"))
            if stats[c][1] is not None and stats[c][1] > 0:
                changes.append(("standardize", c, f"{c}_standardized"))
        elif c in text:
            changes.append(("label_encode", c, f"{c}_encoded"))
    log = local_table(df.sparkSession, changes, "action string, column string, new_column string")
    return out, log


def prep_operation(name: str, df: DataFrame, cols: Sequence[str] | None = None, **kw):
    """Dispatch one of the eight preparation operations by name."""
    from . import profile
    ops = {
        "data_cleaning": lambda: clean_table(df, cols, **kw),
        "outlier_detection": lambda: outliers_iqr(df, cols, **kw),
        "missing_value_analysis": lambda: missing_report(df, cols),
        "correlation_analysis": lambda: profile.correlation_pairs(df, cols, **kw),
        "distribution_analysis": lambda: profile.distribution_stats(df, cols, **kw),
        "feature_importance": lambda: variance_importance(df, cols),
        "data_transformation": lambda: transform_table(df, cols),
        "custom_analysis": lambda: profile.custom_column_info(df, cols or df.columns),
    }
    if name not in ops:
        raise ValueError(f"unknown operation {name!r}; expected one of {sorted(ops)}")
    return ops[name]()


