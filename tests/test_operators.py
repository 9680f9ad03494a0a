"""Operators on hand-written edge cases (FIXTURES.md) and invariants."""

from pyspark.sql import functions as F

from quarry.operators import evaluate as E
from quarry.operators import ml as M
from quarry.operators import prep as R
from quarry.operators import profile as P
from quarry.operators import quality as Q
from quarry.operators import text as X

XY = "id long, x double, y double, s string"


def test_column_info_empty_table(spark):
    df = spark.createDataFrame([], XY)
    info = {r["column"]: r for r in P.column_info(df).collect()}
    assert info["x"]["rows"] == 0 and info["x"]["missing_pct"] is None


def test_nan_is_missing_and_constant_column(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0, "a"), (2, 2.0, 1.0, "a"), (3, None, 1.0, None)], XY)
    info = {r["column"]: r for r in P.column_info(df).collect()}
    assert info["x"]["missing"] == 2 and info["y"]["unique_count"] == 1
    consts = {r["column"] for r in Q.anomaly_constant(df).collect()}
    assert consts == {"x", "y", "s"}  # nunique ignores missing values, as pandas does


def test_quality_score_empty_is_null(spark):
    assert Q.quality_score(spark.createDataFrame([], XY)).first()[0] is None


def test_log_transform_of_small_values_is_null(spark):
    df = spark.createDataFrame([(i, float(v), 0.0, "a") for i, v in enumerate([-2, -1, 0, 0, 0, 0, 0, 100])], XY)
    out = R.transform_log(df, ["x"]).orderBy("id").collect()
    assert out[0]["x_log"] is None and out[1]["x_log"] is None and out[2]["x_log"] == 0.0


def test_sentiment_rules(spark):
    df = spark.createDataFrame([(1, "I dislike it"), (2, "good and great"), (3, ""), (4, None)], "id long, text string")
    got = {r["id"]: r for r in X.sentiment(df, "id", "text").collect()}
    assert got[1]["sentiment"] == "neutral"  # 'dislike' also contains 'like'
    assert got[2]["sentiment"] == "positive" and abs(got[2]["confidence"] - 0.8) < 1e-12
    assert 4 not in got and got[3]["confidence"] == 0.5


def test_classify_ai_whole_word_and_other(spark):
    df = spark.createDataFrame([(1, "New AI chips"), (2, "a fair rain"), (3, "market profit")], "id long, text string")
    got = {r["id"]: r["category"] for r in X.classify(df, "id", "text").collect()}
    assert got == {1: "technology", 2: "other", 3: "business"}


def test_summary_and_entities(spark):
    df = spark.createDataFrame([(1, "no full stop"), (2, " A. B. C "), (3, "Anna Lee paid $1,234.50 on 2024-01-05.")],
                               "id long, text string")
    s = {r["id"]: r for r in X.summary(df, "id", "text").collect()}
    assert s[1]["summary"] == "no full stop" and s[1]["compression_ratio"] == 1.0
    assert s[2]["summary"] == "A.  C"
    e = X.entities(df, "id", "text").where("id = 3").first()["entities"]
    assert [(x["type"], x["entity"], x["start"]) for x in e] == [
        ("PERSON", "Anna Lee", 0), ("DATE", "2024-01-05", 27), ("MONEY", "$1,234.50", 14)]


def test_split_is_exact_disjoint_and_complete(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(1000)], "k long, label double")
    sp = M.ml_split(df, ["k"]).toPandas()
    assert len(sp) == 1000 and sp["k"].is_unique
    per = sp.groupby("label")["is_test"].agg(["sum", "count"])
    assert all(abs(r["sum"] - r["count"] * 0.2) <= 1 for _, r in per.iterrows())
    again = M.ml_split(df, ["k"]).toPandas().set_index("k")["is_test"]
    assert (sp.set_index("k")["is_test"] == again).all()


def test_knn_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    tr = [(i, float(rng.integers(0, 3)), rng.normal(size=4).tolist()) for i in range(120)]
    te = [(1000 + i, 0.0, rng.normal(size=4).tolist()) for i in range(30)]
    sch = "k long, label double, v array<double>"
    got = {r["k"]: r["prediction"] for r in M.knn(spark.createDataFrame(tr, sch), spark.createDataFrame(te, sch),
                                                     "k", "v", 3, block_rows=50).collect()}
    X_ = np.array([t[2] for t in tr])
    for k, _, v in te:
        d = ((X_ - np.array(v)) ** 2).sum(1)
        idx = np.lexsort((np.arange(len(tr)), d))[:3]
        labels = [tr[i][1] for i in idx]
        best = sorted(set(labels), key=lambda y: (-labels.count(y), y))[0]
        assert got[k] == best


def test_eval_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "label int, prediction int")
    m = E.eval_classification(df).first()
    assert abs(m["accuracy"] - 1 / 3) < 1e-12 and abs(m["precision"] - (1 / 3) * (1 / 3)) < 1e-12
    grid = E.eval_confusion(df).collect()
    assert len(grid) == 4


def test_model_beats_majority_on_planted_target(spark):
    from tests.conftest import SF
    from quarry.session import table
    o = table(spark, SF, "orders").select("o_orderkey", "o_totalprice", "o_custkey",
                                          F.when(F.col("o_totalprice") > 100000, "high").otherwise("low").alias("cls"))
    metrics, pred, _ = M.ml_run(o, "cls", ["o_orderkey"], "Decision Tree", "classification",
                                ["o_totalprice", "o_custkey"])
    acc = metrics.first()["accuracy"]
    majority = pred.groupBy("label").count().agg(F.max("count")).first()[0] / pred.count()
    assert acc > majority and acc > 0.95


def test_streaming_row_wise_and_per_batch(spark, tmp_path):
    from quarry.streaming import each_batch, text_stream
    from tests.conftest import SF
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    src = str(tmp_path / "docs")
    docs.write.parquet(src)  # a stream source is a folder
    stream = spark.readStream.schema(docs.schema).parquet(src)
    out = str(tmp_path / "out")
    q = each_batch(text_stream(stream, "doc_id", "text", "sentiment"), lambda b: b, out, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == docs.count()
    assert got.exceptAll(X.sentiment(docs, "doc_id", "text")).count() == 0
