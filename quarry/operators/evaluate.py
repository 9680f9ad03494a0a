"""Model evaluation from a predictions table (label, prediction): SQL-expressible metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: grading thresholds and texts
CLS_GRADES = [(0.9, "Excellent performance", "Model is ready for deployment"),
              (0.8, "Good performance", "Consider minor tuning for improvement"),
              (0.7, "Moderate performance", "Try feature engineering or different algorithms"),
              (None, "Poor performance", "Needs significant improvement - check data quality")]
REG_GRADES = [(0.9, "Excellent fit", "Model explains data very well"),
              (0.7, "Good fit", "Model performs well with room for improvement"),
              (0.5, "Moderate fit", "Consider feature engineering or more complex models"),
              (None, "Poor fit", "Model needs significant improvement")]


def _pairs(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """(y, p, n): counts per true x predicted class (map-side combined; k x k rows)."""
    return pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def eval_classification(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy and support-weighted precision / recall / F1 (0 where a ratio divides by zero)."""
    pr = _pairs(pred, label, prediction)
    tp = pr.where(F.col("y") == F.col("p")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    sup = pr.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    prd = pr.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per = sup.join(prd, "c", "full").join(tp, "c", "left").fillna(0, ["support", "predicted", "tp"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    per = per.select("c", "support", "tp", prec.alias("prec"), rec.alias("rec"), f1.alias("f1"))
    n = F.sum("support")
    return per.agg((F.sum("tp") / n).alias("accuracy"),
                   (F.sum(F.col("prec") * F.col("support")) / n).alias("precision"),
                   (F.sum(F.col("rec") * F.col("support")) / n).alias("recall"),
                   (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_score"))


def eval_confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, prediction, count over the full grid of classes seen in either column."""
    pr = _pairs(pred, label, prediction)
    classes = pr.select(F.col("y").alias("c")).union(pr.select(F.col("p").alias("c"))).distinct()
    arr = classes.agg(F.array_sort(F.collect_list("c")).alias("cs"))  # one row: the k classes
    grid = (arr.select(F.explode("cs").alias("y"), "cs").select("y", F.explode("cs").alias("p")))
    return grid.join(pr, ["y", "p"], "left").select(
        F.col("y").alias(label), F.col("p").alias(prediction), F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def eval_regression(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """mse, rmse, r2_score (1 - SSE / SST)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    a = pred.agg(F.avg((y - p) * (y - p)).alias("mse"), F.sum((y - p) * (y - p)).alias("sse"),
                 F.var_pop(y).alias("vy"), F.count(F.lit(1)).alias("n"))
    return a.select("mse", F.sqrt("mse").alias("rmse"),
                    (1 - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2_score"))


def eval_actual_vs_predicted(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """actual, predicted and the identity line range (min and max over both)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    rng = pred.agg(F.least(F.min(y), F.min(p)).alias("lo"), F.greatest(F.max(y), F.max(p)).alias("hi"))
    return pred.select(y.alias("actual"), p.alias("predicted"), rng.select("lo").scalar().alias("line_min"),
                       rng.select("hi").scalar().alias("line_max"))


def ml_findings(metrics: DataFrame, problem_type: str, algorithm: str, top_feature: str | None = None) -> DataFrame:
    """performance, recommendation, feature_insight from the metrics row."""
    col, grades = ("accuracy", CLS_GRADES) if problem_type == "classification" else ("r2_score", REG_GRADES)
    x = F.col(col)
    perf, rec = F.lit(grades[-1][1]), F.lit(grades[-1][2])
    for thr, p, r in reversed(grades[:-1]):
        perf, rec = F.when(x > thr, p).otherwise(perf), F.when(x > thr, r).otherwise(rec)
    insight = (f"'{top_feature}' is the most important feature for prediction" if top_feature
               else "No feature importance available")
    return metrics.select(F.concat(perf, F.lit(f" achieved with {algorithm}")).alias("performance_assessment"),
                          rec.alias("recommendation"), F.lit(insight).alias("feature_insights"))
