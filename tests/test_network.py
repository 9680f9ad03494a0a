"""Neural network and calibrated support vectors: gradients by differences, accuracy, calibration, odd tables."""

import numpy as np
import pytest

from quarry.operators import calibrate, margin, network
from quarry.operators.prepare import ModelRecord, train_record


def table(spark, X, y):
    rows = [(i, *map(float, x), float(v)) for i, (x, v) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"f{j} double" for j in range(X.shape[1])) + ", label double")


def test_gradient_by_differences():
    r = np.random.default_rng(3)
    d, hidden, k = 3, 5, 4
    z, y = r.normal(size=(20, d)), r.integers(0, k, 20)
    w = r.normal(size=d * hidden + hidden + hidden * k + k)
    got = network.gradient(z, y, w, hidden, k)
    assert got[1] == 20
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = 1e-6
        slope = (network.gradient(z, y, w + e, hidden, k)[0] - network.gradient(z, y, w - e, hidden, k)[0]) / 2e-6
        assert slope == pytest.approx(got[2 + i], abs=1e-4)


def test_network_learns_what_no_line_can(spark, tmp_path):
    r = np.random.default_rng(4)
    X = r.uniform(-1, 1, size=(800, 2)) * [1.0, 100.0]
    y = (X[:, 0] * X[:, 1] > 0).astype(float)
    df = table(spark, X, y).repartition(3)
    model = network.fit_network(df.where("id < 600"), ["f0", "f1"], 2, rounds=40)
    assert model.losses[-1] < model.losses[0] / 2
    got = model.transform(df.where("id >= 600")).collect()
    assert np.mean([g["label"] == g["prediction"] for g in got]) > 0.93  # a constant answer has about 0.5
    assert all(abs(sum(g["probability"]) - 1) < 1e-9 and g["prediction"] == np.argmax(g["probability"]) for g in got)
    model.save(spark, str(tmp_path / "m"))
    assert network.Network.load(spark, str(tmp_path / "m")) == model


def test_network_of_odd_tables(spark):
    df = table(spark, np.array([[1.0, 7.0]] * 6 + [[2.0, 7.0]] * 6), [0.0] * 6 + [1.0] * 6)
    more = df.unionByName(spark.createDataFrame([(99, None, 7.0, 1.0), (98, 1.0, 7.0, None)], df.schema))
    model = network.fit_network(more, ["f0", "f1"], 2, rounds=20)
    got = {r["id"]: r for r in model.transform(more.withColumn("prediction", more.id)).collect()}
    assert len(got) == 14 and all(got[i]["prediction"] == got[i]["label"] for i in range(12))
    assert model.transform(df.where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        network.fit_network(df.where("id < 0"), ["f0"], 2)


def test_sums_of_few_and_many_partitions_agree(spark):
    df = spark.range(1000).repartition(20).selectExpr("cast(id as double) as a")
    told = lambda block: np.array([block.sum(), len(block)])
    assert margin.summed(df, ["a"], told, few=True).tolist() == margin.summed(df, ["a"], told, width=3).tolist() == [499500.0, 1000.0]


def test_network_in_a_model_record(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 10), "up" if i % 10 > 4 else "down") for i in range(200)], "id long, x double, y string")
    record, pred = train_record(df, "y", ["id"], "Neural Network", "classification", ["x"])
    record.save(spark, str(tmp_path / "m"))
    again = ModelRecord.load(spark, str(tmp_path / "m"))
    assert again.model == record.model and record.metrics["accuracy"] > 0.9
    assert {r["predicted"] for r in again.score(df, ["id"]).where("id % 10 = 9").collect()} == {"up"}


def test_svm_probabilities_are_calibrated(spark, tmp_path):
    r = np.random.default_rng(6)
    X = r.normal(size=(3000, 2)) * [1.0, 3.0]
    p = 1 / (1 + np.exp(-(1.5 * X[:, 0] - 0.4 * X[:, 1] + 0.5)))
    df = table(spark, X, (r.uniform(size=3000) < p).astype(float)).repartition(3)
    model = calibrate.fit_calibrated(df.where("id < 2000"), ["f0", "f1"], 2)
    got = model.transform(df.where("id >= 2000")).collect()
    told = np.array([g["probability"][1] for g in got])
    assert np.abs(told - [p[g["id"]] for g in got]).mean() < 0.04
    truth, error = np.array([g["label"] for g in got]), 0.0
    for low in np.arange(0, 1, 0.2):
        at = (told >= low) & (told < low + 0.2)
        error += abs(told[at].sum() - truth[at].sum()) / len(got)
    assert error < 0.06
    assert np.mean([g["label"] == g["prediction"] for g in got]) > max(truth.mean(), 1 - truth.mean()) + 0.1
    model.save(spark, str(tmp_path / "m"))
    again = calibrate.Calibrated.load(spark, str(tmp_path / "m"))
    assert [r["probability"] for r in again.transform(df.where("id < 9")).orderBy("id").collect()] == [
        r["probability"] for r in model.transform(df.where("id < 9")).orderBy("id").collect()]


def test_curve_is_the_least_cross_entropy(spark):
    r = np.random.default_rng(8)
    m = r.normal(size=500) * 2
    y = (r.uniform(size=500) < calibrate.chance(m, 0.8, -0.3)).astype(float)
    a, b = calibrate.fit_curve(spark.createDataFrame([(float(s), float(t)) for s, t in zip(m, y)], "margin double, y double"))
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (500 - y.sum() + 2))
    q = calibrate.chance(m, a, b) - t
    assert abs(q.sum()) < 1e-3 and abs((q * m).sum()) < 1e-3


def test_svm_of_odd_tables(spark):
    df = table(spark, np.array([[float(i % 3), 1.0] for i in range(60)]), [float(i % 3) for i in range(60)])
    got = calibrate.fit_calibrated(df, ["f0", "f1"], 3, folds=2, most=20).transform(df).collect()  # three classes, a constant feature, ties
    assert all(abs(sum(g["probability"]) - 1) < 1e-9 for g in got)
    ends = [g for g in got if g["label"] != 1]
    assert all(g["prediction"] == g["label"] for g in ends)
    one = calibrate.fit_calibrated(df.where("label = 0"), ["f0"], 2).transform(df.where("label = 0")).collect()
    assert {g["prediction"] for g in one} == {0.0} and all(g["probability"][0] > 0.9 for g in one)
    with pytest.raises(ValueError):
        calibrate.fit_calibrated(df.where("id < 0"), ["f0"], 2)
