"""Quality score and anomaly report, built on the shared column statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import clean_nan, cols_of
from .prep import outliers_iqr
from ..session import local_table
from .profile import column_info, table_profile, missing_info

# fixed values: finding texts and confidences
HIGH_MISSING = ("High Missing Values in {c}", "Column {c} has {p}% missing values", 95)
DUPLICATES = ("Duplicate Rows Detected", "Found {n} duplicate rows ({p}% of dataset)", 100)
OUTLIERS = ("Statistical Outliers in {c}", "Column {c} contains {n} potential outliers", 80)
CONSTANT = ("Constant Column: {c}", "Column {c} has only one unique value", 100)
RECOMMEND = {
    "numeric_good": "Good quality numeric data. Consider for statistical analysis.",
    "numeric_some": "Some missing values. Consider for imputation strategies.",
    "numeric_high": "High missing values. Investigate data collection process.",
    "text_high": "High cardinality. Consider grouping or encoding strategies.",
    "text_low": "Low cardinality. Good for categorical analysis.",
    "text_medium": "Medium cardinality. Suitable for most analyses.",
    "other": "Review data type and consider appropriate preprocessing.",
}


def _fmt1(x):
    return F.round(x.cast("double"), 1).cast("string")


def _tmpl(template: str, **parts):
    """Build a string column from a template whose {name} slots are columns."""
    out, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        out += [F.lit(head), parts[name]]
    out.append(F.lit(rest))
    return F.concat(*out)


def _missing_cells(df: DataFrame):
    return sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))


def quality_score(df: DataFrame) -> DataFrame:
    """score = clamp(100 - 50 * missing / (rows * cols) - 30 * duplicates / rows, 0, 100); empty -> NULL.

    One aggregate: the distinct-row count is the single distinct aggregate, so Spark keys the
    partial aggregation by the row and needs no Expand for the other counters.
    """
    df = clean_nan(df)
    cols = len(df.columns)
    a = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*[F.col(c) for c in df.columns])).alias("d"),
               _missing_cells(df).alias("m"))
    n = F.col("n")
    raw = 100 - 50 * F.try_divide(F.col("m"), n * cols) - 30 * F.try_divide(n - F.col("d"), n)
    return a.select(F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).alias("quality_score"))


def quality_profile(df: DataFrame) -> DataFrame:
    """total_rows, total_columns, missing_values, numeric_columns, categorical_columns, quality_score."""
    df = clean_nan(df)
    score = quality_score(df)
    return df.agg(F.count(F.lit(1)).alias("total_rows"), _missing_cells(df).alias("missing_values")).select(
        "total_rows", F.lit(len(df.columns)).alias("total_columns"), "missing_values",
        F.lit(len(cols_of(df, "numeric"))).alias("numeric_columns"),
        F.lit(len(cols_of(df, "text"))).alias("categorical_columns"),
        score.select("quality_score").scalar().alias("quality_score"))


def _finding(df: DataFrame, kind, column, description, confidence, metric) -> DataFrame:
    return df.select(kind.alias("anomaly_type"), column.cast("string").alias("column"),
                     description.alias("description"), F.lit(confidence).alias("confidence"),
                     metric.cast("double").alias("metric"))


def anomaly_high_missing(df: DataFrame, info: DataFrame | None = None) -> DataFrame:
    info = info if info is not None else missing_info(df)
    hit = info.where(F.col("missing_pct") > 50)
    t, d, conf = HIGH_MISSING
    return _finding(hit, _tmpl(t, c=F.col("column")), F.col("column"),
                    _tmpl(d, c=F.col("column"), p=_fmt1(F.col("missing_pct"))), conf, F.col("missing_pct"))


def anomaly_duplicates(df: DataFrame, tp: DataFrame | None = None) -> DataFrame:
    tp = tp if tp is not None else table_profile(df)
    pct = F.col("duplicated_rows") * 100.0 / F.col("rows")
    t, d, conf = DUPLICATES
    return _finding(tp.where(F.col("duplicated_rows") > 0), F.lit(t), F.lit(None),
                    _tmpl(d, n=F.col("duplicated_rows").cast("string"), p=_fmt1(pct)), conf, F.col("duplicated_rows"))


def anomaly_outliers(df: DataFrame, share: float = 0.05, exact: bool = True) -> DataFrame:
    num = cols_of(df, "numeric")
    t, d, conf = OUTLIERS
    if not num:
        return _finding(df.sparkSession.range(0), F.lit(t), F.lit(None), F.lit(d), conf, F.lit(0))
    o = outliers_iqr(df, num, exact=exact).where(F.col("outlier_pct") > share * 100)
    return _finding(o, _tmpl(t, c=F.col("column")), F.col("column"),
                    _tmpl(d, c=F.col("column"), n=F.col("outlier_count").cast("string")), conf, F.col("outlier_count"))


def anomaly_constant(df: DataFrame, info: DataFrame | None = None) -> DataFrame:
    info = info if info is not None else column_info(df)
    t, d, conf = CONSTANT
    return _finding(info.where(F.col("unique_count") == 1), _tmpl(t, c=F.col("column")), F.col("column"),
                    _tmpl(d, c=F.col("column")), conf, F.col("unique_count"))


def anomaly_report(df: DataFrame, exact: bool = True) -> DataFrame:
    """Union of the four detectors; the column statistics are computed once and reused."""
    df = clean_nan(df)
    info = column_info(df)
    info = local_table(df.sparkSession, [tuple(r) for r in info.collect()], info.schema)  # one row per column
    return (anomaly_high_missing(df, info).unionByName(anomaly_duplicates(df))
            .unionByName(anomaly_outliers(df, exact=exact)).unionByName(anomaly_constant(df, info)))


def column_recommendation(df: DataFrame) -> DataFrame:
    """column, type, family, unique_count, min, max, recommendation."""
    df = clean_nan(df)
    info = column_info(df)
    num = cols_of(df, "numeric")
    if num:
        rng = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("min"),
                                        F.max(c).cast("double").alias("max")) for c in num]).alias("a")
                     ).select(F.explode("a").alias("s")).select("s.*")
        info = info.join(rng, "column", "left")
    else:
        info = info.withColumn("min", F.lit(None).cast("double")).withColumn("max", F.lit(None).cast("double"))
    fam, m, u = F.col("family"), F.col("missing_pct"), F.col("unique_count")
    rec = (F.when((fam == "numeric") & (m < 5), RECOMMEND["numeric_good"])
           .when((fam == "numeric") & (m < 20), RECOMMEND["numeric_some"])
           .when(fam == "numeric", RECOMMEND["numeric_high"])
           .when((fam == "text") & (F.try_divide(u, F.col("rows")) > 0.8), RECOMMEND["text_high"])
           .when((fam == "text") & (u < 10), RECOMMEND["text_low"])
           .when(fam == "text", RECOMMEND["text_medium"])
           .otherwise(RECOMMEND["other"]))
    return info.select("column", "type", "family", "unique_count", "min", "max", rec.alias("recommendation"))
