"""Fitted preparation and saved model records.

``ml.ml_prepare`` fills and codes a table with statistics of that same table. Here the statistics are fitted once (on
the train rows, say), kept, saved and applied to rows that were not there: medians of numbers, sorted codes of texts, and the
classes of the target. Medians and classes are a few values and live in the object; the codes of text columns grow
with their distinct values, so they stay a table that is joined, written and read by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import clean_nan, cols_of
from ..plans.ranking import quantiles
from ..session import pin
from .prep import impute_constant, label_codes

UNKNOWN = "Unknown"


@dataclass
class Preparation:
    """Filled and coded features, as fitted on one table.

    Numbers: null or NaN takes the fitted median (0 if no row had a value). Booleans: 0 or 1, null 0. Texts: null counts as
    'Unknown'; the code is the value's place among the fitted values in sorted order, and values that were not there share
    the next code after the last. Classes: their place in sorted order; a class that was not there gives a null label.
    """
    target: str
    problem_type: str
    features: list[str]
    numbers: list[str]
    flags: list[str]
    texts: list[str]
    medians: dict[str, float]
    known: dict[str, int]
    classes: list | None
    codes: DataFrame | None = field(repr=False)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """keep..., feature columns (double), label (double) if the target is among the columns."""
        df = clean_nan(df)
        out = impute_constant(df, self.texts, UNKNOWN) if self.texts else df
        cols = []
        for c in self.features:
            if c in self.flags:
                cols.append(F.coalesce(F.col(c).cast("int"), F.lit(0)).cast("double").alias(c))
            elif c in self.numbers:
                cols.append(F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c, 0.0))).alias(c))
            else:
                codes = self.codes.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
                out = out.join(codes, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
                cols.append(F.coalesce(f"_c_{c}", F.lit(self.known.get(c, 0))).cast("double").alias(c))
        if self.target in df.columns:
            y = F.col(self.target)
            if self.classes is not None:
                y = F.array_position(F.array(*[F.lit(v) for v in self.classes]), y) - 1
                y = F.when(y >= 0, y)
            cols.append(y.cast("double").alias("label"))
        return out.select(*keep, *cols)

    def class_of(self, prediction: str = "prediction"):
        """The class a predicted number stands for."""
        if self.classes is None:
            return F.col(prediction)
        return F.get(F.array(*[F.lit(v) for v in self.classes]), F.col(prediction).cast("int"))

    def save(self, spark: SparkSession, path: str) -> None:
        values = {k: v for k, v in self.__dict__.items() if k != "codes"}
        spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/preparation")
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preparation:
        values = json.loads(spark.read.text(f"{path}/preparation").first()[0])
        codes = spark.read.parquet(f"{path}/codes") if values["texts"] else None
        return cls(codes=codes, **values)


def fit_preparation(df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None = None,
                    problem_type: str = "classification", exact: bool = True, labels: DataFrame | None = None,
                    most: int = 1000) -> Preparation:
    """Statistics of the rows of ``df`` that have a target. ``labels``: a table whose targets give the classes (default ``df``).

    Classes are values of the result, so at most ``most``; more is an error.
    """
    df = clean_nan(df).where(F.col(target).isNotNull())
    feats = [c for c in (features or df.columns) if c != target and c not in key]
    flags = [f.name for f in df.schema.fields if f.name in feats and f.dataType.typeName() == "boolean"]
    numbers, texts = cols_of(df, "numeric", feats), cols_of(df, "text", feats)
    medians = {r["column"]: r["median"] for r in quantiles(df, numbers, {"median": 0.5}, exact).collect()} if numbers else {}
    codes = label_codes(impute_constant(df, texts, UNKNOWN), texts, UNKNOWN) if texts else None
    known = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()} if texts else {}
    classes = None
    if problem_type == "classification":
        source = clean_nan(df if labels is None else labels).where(F.col(target).isNotNull())
        classes = [r[0] for r in source.select(target).distinct().orderBy(target).limit(most + 1).collect()]
        if len(classes) > most:
            raise ValueError(f"{target!r} has more than {most} classes")
    order = [c for c in df.columns if c in numbers] + texts + flags
    return Preparation(target, problem_type, order, numbers, flags, texts, medians, known, classes, codes)


def prepare_on_train(df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None = None,
                     problem_type: str = "classification", test_fraction: float = 0.2, exact: bool = True
                     ) -> tuple[DataFrame, Preparation]:
    """(key..., features, label, is_test) and what was fitted: the split comes first, and test rows tell the features nothing.

    Classes are those of all rows, so that every test row has its label.
    """
    from .ml import ml_split
    df = clean_nan(df).where(F.col(target).isNotNull())
    split = pin(ml_split(df, key, target if problem_type == "classification" else None, test_fraction))
    fitted = fit_preparation(split.where(~F.col("is_test")).drop("is_test"), target, key, features, problem_type, exact, labels=df)
    return fitted.transform(split, [*key, "is_test"]), fitted


@dataclass
class ModelRecord:
    """A trained model with all it needs to score rows as they come: preparation, columns, algorithm, metrics."""
    preparation: Preparation
    model: object
    algorithm: str
    metrics: dict
    training_time: float

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep..., prediction, predicted (the class or number it stands for) for raw rows, with or without a target."""
        out = self.model.transform(self.preparation.transform(df, keep))
        return out.select(*keep, F.col("prediction").cast("double").alias("prediction"), self.preparation.class_of().alias("predicted"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Into a folder that all executors see."""
        self.preparation.save(spark, path)
        about = {"algorithm": self.algorithm, "metrics": self.metrics, "training_time": self.training_time,
                 "kind": "pipeline" if isinstance(self.model, PipelineModel) else type(self.model).__name__.lower()}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        if isinstance(self.model, PipelineModel):
            self.model.write().overwrite().save(f"{path}/model")
        else:
            self.model.save(spark, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelRecord:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        kind = about.pop("kind")
        if kind == "pipeline":
            model = PipelineModel.load(f"{path}/model")
        elif kind == "margin":
            from .margin import Margin
            model = Margin.load(spark, f"{path}/model")
        elif kind == "network":
            from .network import Network
            model = Network.load(spark, f"{path}/model")
        elif kind == "calibrated":
            from .calibrate import Calibrated
            model = Calibrated.load(spark, f"{path}/model")
        else:
            from .trees import Trees
            model = Trees.load(spark, f"{path}/model")
        return cls(Preparation.load(spark, path), model, **about)


def train_record(df: DataFrame, target: str, key: Sequence[str], algorithm: str, problem_type: str,
                 features: Sequence[str] | None = None, test_fraction: float = 0.2) -> tuple[ModelRecord, DataFrame]:
    """Fit preparation and model on the train rows; the record, and (key..., label, prediction) of the test rows."""
    from . import evaluate as E
    from .ml import fit_predict
    prepared, fitted = prepare_on_train(df, target, key, features, problem_type, test_fraction)
    prepared = pin(prepared)
    train, test = prepared.where(~F.col("is_test")), prepared.where(F.col("is_test"))
    pred, model, secs = fit_predict(algorithm, problem_type, train, test, fitted.features, list(key))
    scores = (E.eval_classification(pred) if problem_type == "classification" else E.eval_regression(pred)).first().asDict()
    return ModelRecord(fitted, model, algorithm, scores, secs), pred
