"""Fixed answers of earlier faults, and the cost of building plans."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import infer, ml, prep, profile, text
from quarry.operators.features import detect_datetime
from quarry.plans.scan import ordered_scan
from quarry.session import local_table
from quarry.sources.io import read_table


def test_cleaning_keeps_ids_above_2_to_the_53(spark):
    df = spark.createDataFrame([(9007199254740992, "a"), (9007199254740993, "a"), (9007199254740993, "a"), (None, "b")], "id long, s string")
    out, _ = prep.clean_table(df.where("id is not null"))
    assert sorted(r[0] for r in out.collect()) == [9007199254740992, 9007199254740993]
    filled = {int(r[0]) for r in prep.impute_median(df).collect()}
    assert {9007199254740992, 9007199254740993} <= filled


def test_split_neither_multiplies_nor_parts_a_repeated_key(spark):
    df = spark.createDataFrame([(i // 3, 0.0, i) for i in range(300)] + [(None, 1.0, 300), (None, 1.0, 301)], "k long, label double, i int")
    got = ml.ml_split(df, ["k"]).collect()
    assert sorted(r["i"] for r in got) == list(range(302))
    assert all(len({r["is_test"] for r in got if r["k"] == k}) == 1 for k in range(100))


def test_zeros_of_both_signs_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "v double")
    assert profile.column_info(df).first()["unique_count"] == 2


def test_texts_that_share_a_key_keep_their_own_answers(spark):
    df = spark.createDataFrame([(1, "alpha alpha beta"), (1, "gamma delta gamma"), (None, "one word")], "id long, text string")
    got = [tuple(r["keywords"]) for r in text.keywords(df, "id", "text").collect()]
    assert sorted(got) == [("alpha", "beta"), ("gamma", "delta"), ("one", "word")]
    assert len(text.phrases(df, "id", "text").collect()) == len(text.embedding(df, "id", "text").collect()) == 3


def test_all_values_decide_whether_a_column_holds_dates(spark):
    df = spark.createDataFrame([(i, "2024-01-05" if i != 150 else "soon", "2024-01-05") for i in range(200)], "i int, a string, b string")
    got = {r["column"]: r for r in detect_datetime(df).collect()}
    assert not got["a"]["is_datetime"] and got["a"]["parsed"] == 199 and got["b"]["is_datetime"]
    assert {r["column"]: r["is_datetime"] for r in detect_datetime(df, ["i"], probe=100).collect()} == {"a": True, "b": True}


def test_entities_are_not_cut(spark):
    df = spark.createDataFrame([(1, ", ".join(f"Name {c}aa" for c in "ABCDEFGH"))], "id long, text string")
    assert len(text.entities(df, "id", "text").first()["entities"]) == 8
    assert len(text.entities(df, "id", "text", limit=5).first()["entities"]) == 5


@pytest.mark.parametrize("provider", [lambda b: "not json", lambda b: [{}] * (len(b) + 1), lambda b: 1 / 0, lambda b: [{"sentiment": 3}] * len(b)])
def test_bad_model_answers_fall_back_and_say_so(spark, provider):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, text string")
    got = {r["id"]: r for r in infer.batch_inference(df, "id", "text", "sentiment", provider=provider).collect()}
    assert got[1]["sentiment"] == "positive" and got[2]["sentiment"] == "negative"
    assert {r["answered_by"] for r in got.values()} == {"rule"}


def test_numeric_and_boolean_class_targets_and_features(spark):
    df = spark.createDataFrame([(i, float(-1 if i % 2 else 1), bool(i % 2), float(i)) for i in range(60)], "k long, y double, b boolean, x double")
    prep_, feats = ml.ml_prepare(df, "y", ["k"])
    assert {r[0] for r in prep_.select("label").distinct().collect()} == {0.0, 1.0} and set(feats) == {"b", "x"}
    metrics, _, _ = ml.ml_run(df, "y", ["k"], "Decision Tree", "classification")
    assert metrics.first()["accuracy"] == 1.0
    assert {r[0] for r in ml.ml_prepare(df, "b", ["k"])[0].select("label").distinct().collect()} == {0.0, 1.0}


def test_csv_with_dotted_headers_and_booleans(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("unit.price,unit_price,flag,day\n1.5,a,True,2024-01-05\nNA,b,False,2024-01-06\n")
    df = read_table(spark, str(path))
    assert df.dtypes == [("unit_price", "double"), ("unit_price_", "string"), ("flag", "boolean"), ("day", "timestamp_ntz")]
    assert profile.column_info(df).count() == 4


def test_plans_of_many_summaries_are_built_quickly(spark):
    rows = [(i, *[float(j) for j in range(25)]) for i in range(400)]
    t0 = time.perf_counter()
    assert local_table(spark, rows, "i int, " + ", ".join(f"c{j} double" for j in range(25))).count() == 400
    assert time.perf_counter() - t0 < 5


def test_scan_of_ten_columns_is_one_shuffle_and_equals_a_window(spark):
    cols = [f"c{j}" for j in range(10)]
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("g"), *[
        F.when(F.col("id") % 7 != j % 7, (F.col("id") * (j + 1) % 101).cast("double")).alias(c) for j, c in enumerate(cols)])
    out = ordered_scan(df, cols, ["id"], ["g"], partitions=40)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0
    from pyspark.sql import Window
    w = Window.partitionBy("g").orderBy("id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", *[e for c in cols for e in (F.lag(c, 2).over(w).alias(f"{c}_2"), F.sum(c).over(run).alias(f"{c}_s"))])
    a = {r["id"]: r for r in out.collect()}
    for r in want.collect():
        for c in cols:
            assert a[r["id"]][f"{c}__lag2"] == r[f"{c}_2"] and a[r["id"]][f"{c}__cumsum"] == r[f"{c}_s"]


def test_every_family_has_its_dispatcher(spark):
    df = spark.createDataFrame([(1, 2.0, "a b c."), (2, None, None), (3, 9.0, "good")], "id long, x double, s string")
    assert prep.prep_operation("missing_value_analysis", df).count() == 3
    assert text.text_task("keyword_extraction", df, "id", "s").columns == ["id", "keywords", "phrases"]
    for bad in (lambda: prep.prep_operation("none", df), lambda: text.text_task("none", df, "id", "s")):
        with pytest.raises(ValueError):
            bad()
