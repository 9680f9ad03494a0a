"""Blocked co-moments, typed row-order scans, fitted preparation, indexed neighbours, histogram trees: against plain versions."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import ml, neighbours, prepare, profile, trees
from quarry.plans import gram
from quarry.plans.scan import ordered_scan


def _frame(rows=400, cols=14, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((rows, cols)) * 10.0 ** r.integers(-3, 6, cols) + 1e6 * r.integers(0, 2, cols)
    x[:, 1] = 2 * x[:, 0] + 1
    x[r.random((rows, cols)) < 0.2] = np.nan
    return pd.DataFrame(x, columns=[f"x{i}" for i in range(cols)])


@pytest.mark.parametrize("block", [256, 5])
def test_blocked_correlations_equal_pandas(spark, block):
    pdf = _frame()
    pdf["constant"], pdf["nothing"] = 3.25, np.nan
    pdf["once"] = [7.0] + [np.nan] * (len(pdf) - 1)
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in gram.correlations(df, pdf.columns, block).collect()}
    want = pdf.corr(min_periods=2)
    assert len(got) == len(pdf.columns) ** 2
    for a in pdf.columns:
        for b in pdf.columns:
            w = want.loc[a, b]
            assert (got[a, b] is None) if pd.isna(w) else abs(got[a, b] - w) < 1e-7, (a, b, got[a, b], w)


def test_blocked_correlations_equal_the_aggregate(spark):
    pdf = _frame(cols=11)
    df = spark.createDataFrame(pdf).repartition(3)
    a = {(r["col_a"], r["col_b"]): r["r"] for r in gram.correlations(df, pdf.columns).collect()}
    b = {(r["col_a"], r["col_b"]): r["r"] for r in profile.correlation_matrix(df).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-7 for k in a)


def test_two_hundred_columns_take_seconds(spark):
    df = spark.range(500).select(*[
        F.when(F.col("id") % (3 + i % 5) != 0, F.sin(F.col("id") * (i + 1))).alias(f"c{i}") for i in range(200)])
    t0 = time.perf_counter()
    got = profile.correlation_matrix(df)
    assert got.count() == 200 * 200
    assert time.perf_counter() - t0 < 60
    assert profile.correlation_matrix(df.where("c1 > 9")).where("r is not null").count() == 0  # no rows


def _window(df, cols, keys, order):
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select("id", *[e for c in cols for e in (
        F.lag(c, 1).over(w).alias(f"{c}__lag1"), F.lag(c, 2).over(w).alias(f"{c}__lag2"), F.sum(c).over(run).alias(f"{c}__cumsum"),
        F.max(c).over(run).alias(f"{c}__cummax"), F.min(c).over(run).alias(f"{c}__cummin"))])


@pytest.mark.parametrize("batch", [10_000, 7])
def test_scan_keeps_types_and_large_numbers(spark, batch):
    df = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("g"),
        F.when(F.col("id") % 11 != 0, F.lit(9007199254740993) - F.col("id") * 7919 % 1001).alias("big"),
        F.when(F.col("id") % 4 != 1, (F.col("id") * 31 % 17 - 8).cast("int")).alias("i"),
        (F.col("id") % 100 - 50).cast("byte").alias("b"), F.lit(None).cast("long").alias("none"),
        F.when(F.col("id") % 6 != 0, (F.lit("12345678901234567890.25").cast("decimal(30,2)") + F.col("id")).cast("decimal(30,2)")).alias("d"),
        F.sin("id").alias("f"))
    cols = ["big", "i", "b", "none", "d", "f"]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = ordered_scan(df, cols, ["id"], ["g"], partitions=13)
        want = _window(df, cols, ["g"], ["id"])
        assert [got.schema[c].dataType for c in want.columns] == [want.schema[c].dataType for c in want.columns]
        a, b = ({r["id"]: r for r in x.collect()} for x in (got, want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for k, r in b.items():
        for c in want.columns:
            same = a[k][c] == r[c] if not isinstance(r[c], float) else abs(a[k][c] - r[c]) < 1e-9
            assert same, (k, c, a[k][c], r[c])


def test_a_sum_beyond_64_bits_is_an_error_and_fits_a_decimal(spark):
    df = spark.range(2000).select("id", (F.lit(9007199254740993) + F.col("id")).alias("big"))
    with pytest.raises(Exception, match="64 bits"):
        ordered_scan(df, ["big"], ["id"], None, partitions=4).count()
    wide = ordered_scan(df.withColumn("big", F.col("big").cast("decimal(20,0)")), ["big"], ["id"], None, partitions=4)
    assert int(wide.agg(F.max("big__cumsum")).first()[0]) == sum(9007199254740993 + i for i in range(2000))


def _people(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 37), ["a", "b", None, "c"][i % 4], None if i % 9 == 0 else i % 2 == 0,
             None if i % 50 == 49 else ("yes" if i % 37 > 18 else "no")) for i in range(400)]
    return spark.createDataFrame(rows, "k long, x double, s string, f boolean, y string")


def test_preparation_is_fitted_on_train_rows_only(spark):
    df = _people(spark)
    got, fitted = prepare.prepare_on_train(df, "y", ["k"])
    rows = {r["k"]: r for r in got.collect()}
    raw = [r for r in df.collect() if r["y"] is not None]
    assert set(rows) == {r["k"] for r in raw}
    train = [r for r in raw if not rows[r["k"]]["is_test"]]
    assert fitted.medians["x"] == np.median([r["x"] for r in train if r["x"] is not None])
    # values of test rows change nothing
    moved = df.join(got.select("k", "is_test"), "k", "left").withColumn("x", F.when(F.col("is_test"), F.col("x") + 1e6).otherwise(F.col("x")))
    assert prepare.prepare_on_train(moved.drop("is_test"), "y", ["k"])[1].medians == fitted.medians
    assert rows[0]["x"] == fitted.medians["x"] and rows[0]["f"] == 0.0
    assert fitted.classes == ["no", "yes"] and fitted.known == {"s": 4}
    assert {r["s"]: rows[r["k"]]["s"] for r in raw} == {"a": 1.0, "b": 2.0, "c": 3.0, None: 0.0}
    with pytest.raises(ValueError):
        ml.ml_prepare(df, "y", ["k"], fit_on="test")


@pytest.mark.parametrize("name", ["Naive Bayes", "Decision Tree"])
def test_a_saved_record_scores_unseen_rows(spark, tmp_path, name):
    df = _people(spark)
    record, pred = prepare.train_record(df, "y", ["k"], name, "classification")
    record.save(spark, str(tmp_path))
    back = prepare.ModelRecord.load(spark, str(tmp_path))
    assert back.metrics == record.metrics and back.algorithm == name and back.preparation.medians == record.preparation.medians
    new = spark.createDataFrame([(1000, 30.0, "never seen", None), (1001, None, None, True), (1002, 2.0, "a", False)],
                                "k long, x double, s string, f boolean")
    a, b = ({r["k"]: (r["prediction"], r["predicted"]) for r in m.score(new, ["k"]).collect()} for m in (record, back))
    assert a == b and len(a) == 3 and {p for _, p in a.values()} <= {"no", "yes"}
    assert back.preparation.transform(new, ["k"]).where("k = 1000").first()["s"] == 4.0
    again = {r["k"]: r["prediction"] for r in back.score(df, ["k"]).collect()}
    assert all(again[r["k"]] == r["prediction"] for r in pred.collect())


def _grow(x, y, classes, depth, least):
    """A plain recursive tree on all distinct values: {node: (feature, threshold, rows)} and the leaf of each row."""
    out, leaf = {}, np.ones(len(y), int)

    def score(v):
        if not len(v):
            return 0.0
        s = np.array([np.sum(v == k) for k in range(classes)], float) if classes else np.array([v.sum()])
        return float((s ** 2).sum() / len(v))

    def split(node, at, level):
        leaf[at] = node
        if level == depth or len(at) < least:
            return
        best = None
        for f in range(x.shape[1]):
            for c in np.unique(x[at, f])[:-1]:
                left = x[at, f] <= c
                gain = score(y[at][left]) + score(y[at][~left]) - score(y[at])
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, c
        if best and best[0] > 1e-6:
            out[node] = (best[1], best[2], len(at))
            left = x[at, best[1]] <= best[2]
            split(2 * node, at[left], level + 1)
            split(2 * node + 1, at[~left], level + 1)

    split(1, np.arange(len(y)), 0)
    return out, leaf


def _planted(n=500, seed=3):
    r = np.random.default_rng(seed)
    x = np.round(r.uniform(0, 10, (n, 3)), 0)
    y = ((x[:, 0] > 4) + 2 * (x[:, 1] > 6)).astype(float)
    flip = r.random(n) < 0.1
    y[flip] = r.integers(0, 4, flip.sum())
    return x, y


@pytest.mark.parametrize("classes,least", [(4, 2), (4, 60), (0, 2)])
def test_tree_equals_a_plain_grower(spark, classes, least):
    x, y = _planted()
    if not classes:
        y = 3 * y - x[:, 2]
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y})).repartition(5)
    model = trees.fit(df, ["a", "b", "c"], kind="tree", classes=classes, depth=3, least=least)
    want, leaf = _grow(x, y, classes, 3, least)
    got = {node: ("abc".index(f), c, rows) for _, _, node, f, c, rows, _ in model.splits()}
    assert got == want
    pred = {tuple(r)[:3]: r["prediction"] for r in model.transform(df).collect()}
    for node in np.unique(leaf):
        values = y[leaf == node]
        p = pred[tuple(x[leaf == node][0])]
        assert p == np.argmax(np.bincount(values.astype(int), minlength=4)) if classes else abs(p - values.mean()) < 1e-4


def _boost(x, y, classes, rounds, rate):
    """Plain second-order boosting with the same loss on all distinct values; margins of the rows."""
    n, k = len(y), 1 if classes in (0, 2) else classes
    if classes == 0:
        f = np.full((n, 1), y.mean())
    else:
        p = np.bincount(y.astype(int), minlength=classes) / n
        f = np.tile([np.log(p[1] / p[0])] if classes == 2 else np.log(p), (n, 1))
    for _ in range(rounds):
        if classes == 0:
            g, h = y[:, None] - f, np.ones((n, 1))
        elif classes == 2:
            p = 1 / (1 + np.exp(-f))
            g, h = y[:, None] - p, p * (1 - p)
        else:
            p = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
            g, h = (y[:, None] == np.arange(k)) - p, p * (1 - p)
        step = np.zeros((n, k))
        for j in range(k):
            def grow(at, level):
                s = lambda m: g[m, j].sum() ** 2 / h[m, j].sum()
                best = None
                if level < 3 and len(at) >= 2:
                    for c in range(x.shape[1]):
                        for v in np.unique(x[at, c])[:-1]:
                            m = x[at, c] <= v
                            gain = s(at[m]) + s(at[~m]) - s(at)
                            if best is None or gain > best[0] * (1 + 1e-9):
                                best = gain, c, v
                if best and best[0] > 1e-6:
                    m = x[at, best[1]] <= best[2]
                    grow(at[m], level + 1)
                    grow(at[~m], level + 1)
                else:
                    step[at, j] = g[at, j].sum() / h[at, j].sum()
            grow(np.arange(n), 0)
        f = f + rate * step
    return f


@pytest.mark.parametrize("classes", [0, 2, 4])
def test_boosting_equals_a_plain_version(spark, classes):
    x, y = _planted(300, 5)
    y = y + 0.5 * x[:, 2] if classes == 0 else np.minimum(y, classes - 1)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y})).repartition(4)
    model = trees.fit(df, ["a", "b", "c"], classes=classes, rounds=3, rate=0.3)
    want = _boost(x, y, classes, 3, 0.3)
    got = model.margins(np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(model.cuts)], axis=1).astype(np.uint8))
    assert np.allclose(got, want, atol=1e-3)
    if classes:
        rows = model.transform(df).collect()
        assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in rows)
        most = np.bincount(y.astype(int)).max() / len(y)
        assert np.mean([r["prediction"] == r["label"] for r in rows]) > most + 0.15


def test_cuts_are_exact_quantiles_and_results_do_not_depend_on_partitions(spark):
    r = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": r.standard_normal(3000), "b": r.integers(0, 5, 3000).astype(float)})
    pdf["label"] = (pdf["a"] + pdf["b"] > 2).astype(float)
    pdf.loc[::17, "a"] = np.nan
    one, many = (trees.fit(spark.createDataFrame(pdf).repartition(n), ["a", "b"], classes=2, rounds=2, bins=16) for n in (1, 9))
    assert one.splits() == many.splits() and one.splits()
    a = np.sort(pdf["a"].dropna())
    steps = np.floor(np.arange(len(a) + 1) * 16 / len(a))
    assert one.cuts[0].tolist() == a[np.flatnonzero(steps[1:] > steps[:-1])][:-1].tolist()
    assert one.cuts[1].tolist() == [0.0, 1.0, 2.0, 3.0]
    assert abs(one.importances().sum() - 1) < 1e-9


def test_trees_of_empty_constant_and_one_class_tables(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 0.0), (1.0, None)], "a double, label double")
    for source in (df, df.where("1 = 0")):
        for kind in ("tree", "boost"):
            model = trees.fit(source, ["a"], kind=kind, classes=2, rounds=2)
            assert model.splits() == [] and {r["prediction"] for r in model.transform(df).collect()} == {0.0}


def test_saved_trees_predict_the_same(spark, tmp_path):
    x, y = _planted(200)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y}))
    model = trees.fit(df, ["a", "b"], classes=4, rounds=2)
    model.save(spark, str(tmp_path))
    back = trees.Trees.load(spark, str(tmp_path))
    assert back.splits() == model.splits()
    assert [r["probability"] for r in back.transform(df).collect()] == [r["probability"] for r in model.transform(df).collect()]


def _vectors(spark, n=1200, groups=12, seed=8):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((groups, 16)) * 3
    rows = [(i, [float(v) for v in centre[i % groups] + r.standard_normal(16)], float(i % groups)) for i in range(n)]
    rows += [(n + i, rows[0][1], 0.0) for i in range(60)]  # copies: one cell holds many rows
    return spark.createDataFrame(rows, "k long, v array<double>, label double").repartition(4)


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["qk"], set()).add(r["tk"])
    return out


def test_index_finds_the_wanted_share_and_with_all_cells_everything(spark):
    df = _vectors(spark)
    train, test = df.where("k % 5 <> 0"), df.where("k % 5 = 0").select(F.col("k").alias("qk"), "v")
    index = neighbours.VectorIndex.fit(train, "k", "v")
    assert index.rows.count() == train.count() and len(index.centres) == int(train.count() ** 0.5)
    probes = index.probes_for(test, 3, 0.95)
    exact = _found(neighbours.best(index.candidates(test, 3, len(index.centres), block_rows=40), 3))
    found = _found(neighbours.best(index.candidates(test, 3, probes, block_rows=40), 3))
    share = np.mean([len(exact[q] & found[q]) / 3 for q in exact])
    assert share >= 0.9 and probes < len(index.centres) / 3
    whole = ml.knn(train, df.where("k % 5 = 0"), "k", "v")
    all_cells = neighbours.knn_indexed(train, df.where("k % 5 = 0"), "k", "v", probes=10 ** 6)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in all_cells.collect()}


def test_index_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    train, test = e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qk"), F.col("embedding").cast("array<double>").alias("v"))
    index = neighbours.VectorIndex.fit(train, "vec_id", "embedding")
    probes = index.probes_for(test, 3, 0.95)
    exact = _found(neighbours.best(index.candidates(test, 3, len(index.centres)), 3))
    found = _found(neighbours.best(index.candidates(test, 3, probes), 3))
    assert np.mean([len(exact[q] & found[q]) / 3 for q in exact]) >= 0.9


def test_index_of_few_rows(spark):
    df = _vectors(spark).where("k < 4")
    got = neighbours.knn_indexed(df, df, "k", "v", k=9, mode="regress")
    assert {r["prediction"] for r in got.collect()} == {1.5}
    assert neighbours.knn_indexed(df, df.where("1 = 0"), "k", "v").collect() == []
    assert neighbours.knn_indexed(df.where("1 = 0"), df, "k", "v").collect() == []
    assert neighbours.auto_knn(df, df, "k", "v", pairs=0, recall=1.0).count() == neighbours.auto_knn(df, df, "k", "v").count() == 4


def test_predictions_beat_the_commonest_label(spark):
    from quarry import catalog
    rows = catalog.queries()["clf_predictions"](spark, "/root/testdata/sf0.001").collect()
    for name in ("Random Forest", "Gradient Boosting"):
        mine = [r for r in rows if r["algorithm"] == name]
        most = np.bincount([int(r["label"]) for r in mine]).max() / len(mine)
        assert np.mean([r["prediction"] == r["label"] for r in mine]) > most + 0.02, name
