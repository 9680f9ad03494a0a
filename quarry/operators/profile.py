"""Column metadata and table profiling (one aggregate pass per statistic family).

Every operator takes a DataFrame and returns a (small) DataFrame in long form: one row per
column (or per column and bin / value), never one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_table
from ..functions.types import clean_nan, cols_of, family, type_name
from ..plans.gram import correlations
from ..plans.ranking import long_values, quantiles


def _spark(df: DataFrame):
    return df.sparkSession


def exact_mean(c: Column) -> Column:
    """Mean from an exact decimal sum: the same value whatever the partitioning and merge order
    (a double sum's last digits depend on both)."""
    return F.avg(c.cast("decimal(38,10)")).cast("double")


def _meta(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Schema facts as a tiny DataFrame (bounded by the number of columns)."""
    rows = [(c, i, type_name(df, c), family(df.schema[c].dataType)) for i, c in enumerate(cols)]
    return local_table(_spark(df), rows, "column string, position int, type string, family string")


def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, k): multiplicity of every value of every column, nulls included.

    One scan, one shuffle (map-side combined). Values are compared as strings.
    """
    df = clean_nan(df)
    cols = list(cols or df.columns)
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    df = df.select(*[(F.col(c) + F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in floats else F.col(c)
                     for c in cols])  # -0.0 and 0.0 are one value
    return (long_values(df, cols, value="value", cast="string", keep_nulls=True)
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("k")))


def column_info(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, position, type, family, rows, missing, missing_pct, unique_count."""
    cols = list(cols or df.columns)
    vc = value_counts(df, cols)
    stats = vc.groupBy("column").agg(
        F.sum("k").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("k")).otherwise(0)).alias("missing"),
        F.count("value").alias("unique_count"),
    )
    # every column's value counts add up to the row count; an empty table has no counts at all
    n = F.coalesce(F.col("rows"), F.lit(0)).cast("bigint")
    return (F.broadcast(_meta(df, cols)).join(stats, "column", "left")
            .select("column", "position", "type", "family",
                    n.alias("rows"),
                    F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing"),
                    (F.try_divide(F.coalesce("missing", F.lit(0)) * 100.0, n)).alias("missing_pct"),
                    F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count")))


def missing_info(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, position, type, family, rows, missing, missing_pct: one aggregate, no value is shuffled."""
    df = clean_nan(df)
    cols = list(cols or df.columns)
    got = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*[
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing")) for c in cols]).alias("a"))
    counts = got.select("rows", F.explode("a").alias("s")).select("rows", "s.*")
    return F.broadcast(_meta(df, cols)).join(counts, "column").select(
        "column", "position", "type", "family", "rows", "missing",
        F.try_divide(F.col("missing") * 100.0, F.col("rows")).alias("missing_pct"))


def target_suitability(info: DataFrame) -> DataFrame:
    fam, u = F.col("family"), F.col("unique_count")
    tt = (F.when((fam == "numeric") & u.between(2, 20), "classification")
          .when((fam == "numeric") & (u > 20), "regression")
          .when((fam == "text") & u.between(2, 50), "classification"))
    return info.select("column", "type", "unique_count", tt.isNotNull().alias("is_target_suitable"),
                       tt.alias("target_type"))


def feature_potential(info: DataFrame) -> DataFrame:
    fam, u = F.col("family"), F.col("unique_count")
    pot = (F.when((fam == "numeric") & (u < 5), "Medium")
           .when((fam == "numeric") & (F.col("missing_pct") > 50), "Low")
           .when((fam == "text") & (u > F.col("rows") * 0.8), "Low")
           .otherwise("High"))
    return info.select("column", "type", "missing", "missing_pct", "unique_count", pot.alias("fe_potential"))


def column_quality_grade(info: DataFrame) -> DataFrame:
    m = F.col("missing_pct")
    grade = F.when(m > 50, "Poor").when(m > 20, "Fair").otherwise("Good")
    return info.select("column", "missing_pct", grade.alias("quality"))


def _first_non_null(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], k: int) -> DataFrame:
    """(column, rn, value): the first k non-null values of each column in ``order_by`` order.

    ``row_number() <= k`` becomes a map-side WindowGroupLimit: each task ships at most k rows
    per column to the final top-k.
    """
    order_by = list(order_by)
    base = clean_nan(df).select(*[F.col(c).cast("string").alias(c) for c in cols],
                                *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order_by)])
    okeys = [f"_o{i}" for i in range(len(order_by))]
    long = base.unpivot(okeys, list(cols), "column", "value").where(F.col("value").isNotNull())
    w = Window.partitionBy("column").orderBy(*okeys)
    return long.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("column", "rn", "value")


def sample_values(df: DataFrame, order_by: Sequence[str], k: int = 3,
                  cols: Sequence[str] | None = None) -> DataFrame:
    """column, sample_values: the first k non-null values as strings, in row order."""
    cols = list(cols or [c for c in df.columns if c not in order_by] or df.columns)
    first = _first_non_null(df, cols, order_by, k)
    return (first.groupBy("column")
            .agg(F.sort_array(F.collect_list(F.struct("rn", "value"))).alias("s"))
            .select("column", F.col("s.value").alias("sample_values")))


def text_suitability(df: DataFrame, order_by: Sequence[str], k: int = 5, min_len: float = 10.0,
                     cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns whose first k non-null values have a mean length above ``min_len``."""
    cols = [c for c in cols_of(df, "text", cols) if c not in order_by]
    first = _first_non_null(df, cols, order_by, k)
    return (first.groupBy("column").agg(F.avg(F.length("value")).alias("avg_length"))
            .select("column", "avg_length", (F.col("avg_length") > min_len).alias("is_text")))


ALGORITHMS = [
    # fixed values: problem type, complexity, algorithm, category, description
    ("classification", "quick", "Logistic Regression", "Linear Models", "Fast linear classifier for binary and multiclass problems"),
    ("classification", "quick", "Decision Tree", "Tree-based", "Interpretable tree-based classifier"),
    ("classification", "quick", "Naive Bayes", "Probabilistic", "Probabilistic classifier based on Bayes theorem"),
    ("classification", "standard", "Random Forest", "Ensemble", "Robust ensemble method with high accuracy"),
    ("classification", "standard", "Gradient Boosting", "Ensemble", "Sequential ensemble with excellent performance"),
    ("classification", "standard", "SVM", "Support Vector", "Powerful classifier for complex decision boundaries"),
    ("classification", "standard", "K-Nearest Neighbors", "Instance-based", "Simple yet effective distance-based classifier"),
    ("classification", "standard", "Neural Network", "Neural Networks", "Deep learning approach for complex patterns"),
    ("regression", "quick", "Linear Regression", "Linear Models", "Simple linear relationship modeling"),
    ("regression", "quick", "Ridge Regression", "Linear Models", "Regularized linear regression"),
    ("regression", "quick", "Decision Tree", "Tree-based", "Interpretable tree-based regressor"),
    ("regression", "standard", "Random Forest", "Ensemble", "Robust ensemble method for regression"),
    ("regression", "standard", "Gradient Boosting", "Ensemble", "Sequential ensemble with excellent performance"),
    ("regression", "standard", "SVR", "Support Vector", "Support Vector Regression for non-linear patterns"),
    ("regression", "standard", "K-Nearest Neighbors", "Instance-based", "Distance-based regression approach"),
]


def algorithm_catalog(spark) -> DataFrame:
    return local_table(spark, ALGORITHMS, "problem_type string, complexity string, algorithm string, "
                                             "category string, description string")


# ---------------------------------------------------------------- table level


def table_profile(df: DataFrame) -> DataFrame:
    """rows, columns, duplicated_rows. Distinct rows via count(distinct struct(*)): nulls equal."""
    df = clean_nan(df)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_distinct(F.struct(*[F.col(c) for c in df.columns])).alias("_d")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), (F.col("rows") - F.col("_d")).alias("duplicated_rows"))


def _explode_structs(agg_df: DataFrame) -> DataFrame:
    return agg_df.select(F.explode("a").alias("s")).select("s.*")


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column, min, max, mean, median, std (sample)."""
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    one = _explode_structs(df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(i).alias("position"),
        F.min(F.col(c)).cast("double").alias("min"), F.max(F.col(c)).cast("double").alias("max"),
        exact_mean(F.col(c)).alias("mean"), F.stddev_samp(F.col(c)).alias("std"))
        for i, c in enumerate(cols)]).alias("a")))
    med = quantiles(df, cols, {"median": 0.5}, exact=exact)
    return one.join(med, "column", "left").select("column", "position", "min", "max", "mean", "median", "std")


def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column, count, mean, std, min, q25, q50, q75, max."""
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    one = _explode_structs(df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.count(F.col(c)).alias("count"), exact_mean(F.col(c)).alias("mean"),
        F.stddev_samp(F.col(c)).alias("std"), F.min(F.col(c)).cast("double").alias("min"),
        F.max(F.col(c)).cast("double").alias("max")) for c in cols]).alias("a")))
    q = quantiles(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, exact=exact)
    return one.join(q, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50",
                                                  "q75", "max")


def null_counts(df: DataFrame) -> DataFrame:
    """column, nulls, columns_with_nulls (the same number on every row)."""
    df = clean_nan(df)
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    any_null = sum((F.when(n > 0, 1).otherwise(0) for n in nulls), F.lit(0))
    return (df.agg(F.array(*[F.struct(F.lit(c).alias("column"), n.alias("nulls"))
                             for c, n in zip(df.columns, nulls)]).alias("a"),
                   any_null.alias("columns_with_nulls"))
            .select(F.explode("a").alias("s"), "columns_with_nulls")
            .select("s.*", "columns_with_nulls"))


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """column, unique_count, rank, value, count: top-k values per text column.

    Ties are broken by value ascending. The ``rank <= k`` filter is planned as a partial
    WindowGroupLimit, so a column with billions of distinct values ships k rows per task.
    """
    cols = cols_of(df, "text", cols)
    vc = value_counts(df, cols).where(F.col("value").isNotNull())
    uniq = vc.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    w = Window.partitionBy("column").orderBy(F.col("k").desc(), F.col("value"))
    top = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(uniq, "column").select("column", "unique_count", "rank", "value", F.col("k").alias("count"))


def datetime_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, min, max, range_days (whole elapsed days)."""
    cols = cols_of(df, "datetime", cols)
    return _explode_structs(df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.min(F.col(c).cast("timestamp_ntz")).alias("min"),
        F.max(F.col(c).cast("timestamp_ntz")).alias("max")) for c in cols]).alias("a"))).select(
        "column", "min", "max",
        F.floor(F.expr("timestampdiff(SECOND, min, max)") / 86400).cast("bigint").alias("range_days"))


def _bin_table(df: DataFrame, cols: Sequence[str], params: DataFrame) -> DataFrame:
    """Count rows per (column, bin) given per-column (lo, hi, bins); all bins, empty ones too."""
    long = long_values(df, cols)
    p = F.broadcast(params)  # one row per column
    x = long.join(p, "column")
    span = F.col("hi") - F.col("lo")
    b = F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / span * F.col("bins"))).cast("int")
    cnt = x.groupBy("column", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = params.select("column", "lo", "hi", "bins",
                         F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return grid.join(cnt, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
        F.when(F.col("bin") == F.col("bins") - 1, F.col("hi"))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _range_params(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: min, max, n; numpy widens an empty range by 0.5 on each side."""
    rng = _explode_structs(df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.min(F.col(c)).cast("double").alias("mn"),
        F.max(F.col(c)).cast("double").alias("mx"), F.count(F.col(c)).alias("n"))
        for c in cols]).alias("a")))
    same = F.col("mn") == F.col("mx")
    return rng.where(F.col("n") > 0).select(
        "column", "n", F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """column, bin, lower, upper, count with ``bins`` equal-width bins over [min, max]."""
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    params = _range_params(df, cols).withColumn("bins", F.lit(bins))
    return _bin_table(df, cols, params)


def histogram_auto(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Histogram with numpy's 'auto' bin width: min(Sturges, Freedman-Diaconis), Sturges if FD=0."""
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    rng = _range_params(df, cols)
    q = quantiles(df, cols, {"q25": 0.25, "q75": 0.75}, exact=exact)
    ptp = F.col("hi") - F.col("lo")
    sturges = ptp / (F.log2(F.col("n")) + 1.0)
    fd = 2.0 * (F.col("q75") - F.col("q25")) * F.pow(F.col("n"), -1.0 / 3.0)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    params = rng.join(q, "column").select("column", "lo", "hi",
                                          F.greatest(F.lit(1), F.ceil(ptp / width)).cast("int").alias("bins"))
    return _bin_table(df, cols, params)


def density_curve(df: DataFrame, cols: Sequence[str] | None = None, points: int = 200) -> DataFrame:
    """Gaussian KDE (Scott bandwidth std * n^-1/5) on ``points`` grid points over [min, max].

    Exact: the data is first reduced to (value, multiplicity); every task sums the weighted kernels of its values
    into one array of ``points`` slots a column and hands on only that.
    """
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    st = _explode_structs(df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.min(F.col(c)).cast("double").alias("mn"),
        F.max(F.col(c)).cast("double").alias("mx"), F.count(F.col(c)).alias("n"),
        F.stddev_samp(F.col(c)).alias("sd")) for c in cols]).alias("a")))
    st = st.where((F.col("n") > 1) & (F.col("sd") > 0)).select(
        "column", "mn", "mx", "n", (F.col("sd") * F.pow(F.col("n"), -0.2)).alias("h"))
    vc = long_values(df, cols).groupBy("column", "v").agg(F.count(F.lit(1)).alias("k"))

    def kernels(batches):
        sums: dict = {}
        for batch in batches:
            name, v, k = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            mn, mx, h = (batch.column(i).to_numpy() for i in (3, 4, 5))
            name = np.array(name, dtype=object)
            for c in set(name.tolist()):
                at = np.flatnonzero(name == c)
                first = at[0]
                x = mn[first] + np.arange(points) * ((mx[first] - mn[first]) / (points - 1))
                total = sums.setdefault(c, np.zeros(points))
                for i in range(0, len(at), 1000):
                    part = at[i:i + 1000]
                    z = (x[:, None] - v[part][None, :]) / h[first]
                    total += np.exp(-0.5 * z * z) @ k[part].astype(np.float64)
        for c, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * points, pa.string()), pa.array(np.arange(points, dtype=np.int32)),
                                              pa.array(total)], ["column", "point", "s"])

    sums = (vc.join(F.broadcast(st), "column").select("column", "v", "k", "mn", "mx", "h")
            .mapInArrow(kernels, "column string, point int, s double").groupBy("column", "point").agg(F.sum("s").alias("s")))
    step = (F.col("mx") - F.col("mn")) / (points - 1)
    return sums.join(F.broadcast(st), "column").select(
        "column", "point", (F.col("mn") + F.col("point") * step).alias("x"),
        (F.col("s") / (F.col("n") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5))).alias("density"))


WIDE = 12  # columns


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """col_a, col_b, r: pairwise-complete Pearson for every ordered pair.

    A few columns are one aggregate of JVM expressions; from ``WIDE`` on, whose square would swamp the plan, they are blocked
    matrix products (``plans/gram.py``) with the same results.
    """
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    if len(cols) >= WIDE:
        return correlations(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}")
                   for i, (a, b) in enumerate(pairs)])
    items = []
    for i, (a, b) in enumerate(pairs):
        items.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"p{i}").alias("r")))
        if a != b:
            items.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"p{i}").alias("r")))
    return agg.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """column1, column2, correlation for i<j (table order) with |r| > threshold."""
    cols = cols_of(df, "numeric", cols)
    if len(cols) < 2:
        raise ValueError("need at least 2 numeric columns for correlation analysis")
    pos = local_table(_spark(df), [(c, i) for i, c in enumerate(cols)], "c string, i int")
    cm = correlation_matrix(df, cols)
    return (cm.join(F.broadcast(pos.withColumnRenamed("c", "col_a").withColumnRenamed("i", "ia")), "col_a")
            .join(F.broadcast(pos.withColumnRenamed("c", "col_b").withColumnRenamed("i", "ib")), "col_b")
            .where((F.col("ia") < F.col("ib")) & (F.abs("r") > threshold))
            .select(F.col("col_a").alias("column1"), F.col("col_b").alias("column2"), F.col("r").alias("correlation")))


def skew_kurt_exprs(c: Column) -> tuple[Column, Column]:
    """Bias-corrected sample skewness G1 and excess kurtosis G2 (pandas semantics) as aggregates."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    g2 = F.kurtosis(c)
    var0 = F.var_pop(c) == 0
    G1 = F.when(n < 3, None).when(var0, 0.0).otherwise(F.sqrt(n * (n - 1)) / (n - 2) * g1)
    G2 = (F.when(n < 4, None).when(var0, 0.0)
          .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))
    return G1, G2


def distribution_stats(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column, mean, median, std, skewness, kurtosis."""
    df = clean_nan(df)
    cols = cols_of(df, "numeric", cols)
    items = []
    for c in cols:
        x = F.col(c).cast("double")
        g1, g2 = skew_kurt_exprs(x)
        items.append(F.struct(F.lit(c).alias("column"), exact_mean(x).alias("mean"),
                              F.stddev_samp(x).alias("std"), g1.alias("skewness"), g2.alias("kurtosis")))
    one = _explode_structs(df.agg(F.array(*items).alias("a")))
    med = quantiles(df, cols, {"median": 0.5}, exact=exact)
    return one.join(med, "column", "left").select("column", "mean", "median", "std", "skewness", "kurtosis")


def dataset_overview(df: DataFrame) -> DataFrame:
    """rows, columns, column_names."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        F.lit(",".join(df.columns)).alias("column_names"))


def dataset_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Long rows (section, column, stat, num_value, text_value): shape, types, missing, numeric summary."""
    info = column_info(df)
    shape = dataset_overview(df).select(
        F.lit("shape").alias("section"), F.lit(None).cast("string").alias("column"),
        F.explode(F.array(F.struct(F.lit("rows").alias("stat"), F.col("rows").cast("double").alias("num_value")),
                          F.struct(F.lit("columns").alias("stat"), F.col("columns").cast("double").alias("num_value"))
                          )).alias("s")).select("section", "column", "s.stat", "s.num_value",
                                                F.lit(None).cast("string").alias("text_value"))
    types = info.select(F.lit("types").alias("section"), "column", F.lit("type").alias("stat"),
                        F.lit(None).cast("double").alias("num_value"), F.col("type").alias("text_value"))
    missing = info.select(F.lit("missing").alias("section"), "column", F.lit("missing").alias("stat"),
                          F.col("missing").cast("double").alias("num_value"),
                          F.lit(None).cast("string").alias("text_value"))
    parts = [shape, types, missing]
    if cols_of(df, "numeric"):
        d = describe(df, exact=exact)
        stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
        parts.append(d.select(F.lit("numeric").alias("section"), "column",
                              F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("num_value"))
                                                  for s in stats])).alias("s"))
                     .select("section", "column", "s.stat", "s.num_value", F.lit(None).cast("string").alias("text_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def custom_column_info(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """type, missing, distinct for user-chosen columns."""
    return column_info(df, cols).select("column", "type", "missing", "missing_pct", "unique_count")
