"""Support vector regression against a fine solution in numpy, and its odd inputs."""

import numpy as np
import pytest

from quarry.operators import margin
from quarry.operators.ml import fit_predict


def objective(X, y, w, b, c=1.0, epsilon=0.1):
    return (w ** 2).sum() / 2 + c * np.maximum(np.abs(X @ w + b - y) - epsilon, 0).sum()


def fine(X, y, c=1.0, epsilon=0.1):
    """Subgradient steps from the best point so far, with three step sizes."""
    w, b = np.zeros(X.shape[1]), float(np.median(y))
    best = objective(X, y, w, b, c, epsilon), w, b
    for start in (1.0, 0.1, 0.01):
        w, b = best[1].copy(), best[2]
        for k in range(1, 30_001):
            r = X @ w + b - y
            s = np.sign(r) * (np.abs(r) > epsilon)
            g, gb = w + c * X.T @ s, c * s.sum()
            step = start / k ** 0.6 / max(1e-12, np.sqrt((g ** 2).sum() + gb ** 2))
            w, b = w - step * g, b - step * gb
            v = objective(X, y, w, b, c, epsilon)
            if v < best[0]:
                best = v, w.copy(), b
    return best


def table(spark, X, y):
    rows = [(i, *map(float, x), float(v)) for i, (x, v) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"f{j} double" for j in range(X.shape[1])) + ", label double")


def test_svr_is_no_worse_than_a_fine_solution(spark):
    r = np.random.default_rng(5)
    X = r.normal(size=(400, 3)) * [1.0, 5.0, 0.2]
    y = X @ [2.0, -1.0, 3.0] + 4 + r.normal(size=400) * 0.3
    y[:60] += 25  # what a square loss would follow
    got = margin.fit_svr(table(spark, X, y).repartition(5), ["f0", "f1", "f2"])
    w = np.array(got.weights)
    assert objective(X, y, w, got.bias) == pytest.approx(got.objective)
    assert got.objective <= fine(X, y)[0] * (1 + 1e-4)
    assert abs(w[0] - 2) < 0.1 and abs(w[1] + 1) < 0.05 and abs(got.bias - 4) < 0.3


def test_svr_of_odd_tables(spark):
    X, y = np.array([[1.0, 7.0]] * 20 + [[2.0, 7.0]] * 20), np.array([10.0] * 20 + [20.0] * 20)
    df = table(spark, X, y)
    got = margin.fit_svr(df, ["f0", "f1"])  # a constant feature, ties, repeated rows
    assert got.objective <= objective(X, y, np.array([9.8, 0.0]), 0.3) * (1 + 1e-3)
    one = margin.fit_svr(df.limit(1), ["f0", "f1"])
    assert abs(one.transform(df.limit(1)).first()["prediction"] - 10) <= 0.1 + 1e-6
    more = df.unionByName(spark.createDataFrame([(99, None, 1.0, 2.0), (98, 1.0, 1.0, None)], df.schema))
    assert margin.fit_svr(more, ["f0", "f1"]).objective == pytest.approx(got.objective, rel=1e-6)
    with pytest.raises(ValueError):
        margin.fit_svr(df.where("id < 0"), ["f0"])


def test_svr_by_name(spark, tmp_path):
    X = np.arange(60.0).reshape(-1, 1)
    df = table(spark, X, 3 * X[:, 0] + 1)
    pred, model, _ = fit_predict("SVR", "regression", df.where("id % 5 > 0"), df.where("id % 5 = 0"), ["f0"], ["id"])
    from quarry.operators.prepare import ModelRecord, train_record
    record, _ = train_record(df.withColumnRenamed("label", "y"), "y", ["id"], "SVR", "regression", ["f0"])
    record.save(spark, str(tmp_path / "m"))
    again = ModelRecord.load(spark, str(tmp_path / "m"))
    assert again.model == record.model and again.score(df, ["id"]).count() == 60
    assert all(abs(p["label"] - p["prediction"]) < 0.2 for p in pred.collect()) and isinstance(model, margin.Margin)
