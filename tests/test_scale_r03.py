"""Steps that did more work than their input asks for: results as before, work in proportion."""

import re
import threading

import numpy as np

from pyspark.ml.classification import LinearSVC

from quarry.operators import calibrate, margin, ml, trees
from quarry.operators import text as X
from quarry.sources import io


def _unpacked(block):
    cells, held, y, times = (v[0].as_py() for v in block.columns)
    held, y, times = np.frombuffer(held, np.int64), np.frombuffer(y), np.frombuffer(times, np.int64)
    x = np.frombuffer(cells, np.uint8).reshape(len(held), -1)
    return x, held, np.repeat(np.repeat(x, held, axis=0), times, axis=0), np.repeat(y, times)


def test_tree_blocks_hold_cells_once():
    rng = np.random.default_rng(1)
    for width in (2, 40):  # a cell fits one number, and does not
        x = rng.integers(0, 3, (5000, width)).astype(np.uint8)
        x[:, 2:] = x[:, :1]
        y = rng.integers(0, 2, 5000).astype(float)
        cells, held, rows, labels = _unpacked(trees._block([(x[:2000], y[:2000]), (x[2000:], y[2000:])], 64))
        assert len(cells) == 9 and held.tolist() == [2] * 9
        want = sorted((*a, b) for a, b in zip(x.tolist(), y))
        assert sorted((*a, b) for a, b in zip(rows.tolist(), labels)) == want


def test_boosting_on_cells_is_boosting_on_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(a * 2 + b + c)) for a, b, c in zip(rng.integers(0, 9, 600), rng.integers(0, 4, 600), rng.random(600))]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    once = trees.fit(df, ["a", "b"], rounds=4)
    size, trees.BLOCK = trees.BLOCK, 7  # blocks of a few rows: nearly every row is a cell of its own
    try:
        many = trees.fit(df.repartition(3), ["a", "b"], rounds=4)
    finally:
        trees.BLOCK = size
    assert once.splits() == many.splits()
    assert all((s.value == t.value).all() for r, q in zip(once.rounds, many.rounds) for s, t in zip(r, q))


def test_sums_over_packed_blocks(spark):
    df = spark.range(1000).selectExpr("cast(id as double) a", "id * 2 b").repartition(3)
    told = lambda x: np.array([x[:, 0].sum(), x[:, 1].sum(), len(x)])
    size, margin.BLOCK = margin.BLOCK, 50
    try:
        blocks = margin.packed(df, ["a", "b"])
    finally:
        margin.BLOCK = size
    assert blocks.count() < 10  # an Arrow batch or more each, not rows
    assert margin.summed(blocks, None, told).tolist() == margin.summed(df, ["a", "b"], told).tolist() == [499500.0, 999000.0, 1000.0]


def test_support_vector_folds_are_fitted_side_by_side(spark, monkeypatch):
    rows = [(float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    barrier, fit = threading.Barrier(4, timeout=60), LinearSVC.fit

    def meet(self, table):
        barrier.wait()  # breaks if the four fits do not run at the same time
        return fit(self, table)

    monkeypatch.setattr(LinearSVC, "fit", meet)
    got = calibrate.fit_calibrated(df, ["a", "b"], 2, most=5)
    assert len(got.weights) == 1 and got.curves[0][0] > 0


def test_svr_takes_the_shorter_steps_when_needed(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=200)
    df = spark.createDataFrame([(float(a), float(3 * a + 1 + e)) for a, e in zip(x, r.normal(size=200))], "a double, label double")
    few = margin.fit_svr(df, ["a"])
    monkeypatch.setattr(margin, "FIRST", len(margin.STEPS))  # all at once, as before
    every = margin.fit_svr(df, ["a"])
    assert few.weights == every.weights and few.bias == every.bias


def test_fits_of_several_algorithms_run_side_by_side(monkeypatch):
    barrier = threading.Barrier(3, timeout=10)

    class One:
        sparkSession = None

        def __init__(self, name):
            self.name = name

        def select(self, *cols):
            return self.name

    monkeypatch.setattr(ml, "inheritable_thread_target", lambda spark: lambda f: f)
    monkeypatch.setattr(ml, "fit_predict", lambda name, *a: (barrier.wait(), (One(name), None, 0.0))[1])
    monkeypatch.setattr(ml.F, "lit", lambda x: type("L", (), {"alias": lambda self, n: n})())
    assert ml.fit_predict_each(["a", "b", "c"], "regression", One(""), One(""), [], []) == ["a", "b", "c"]


def test_whole_numbers_are_looked_at_before_a_cast(spark, tmp_path):
    assert [bool(re.search(io.WHOLE, x)) for x in ("12", " +3\t", "-4", "1.5", "A", "2024-01-02", "1e3", "")] == [True] * 3 + [False] * 5
    (tmp_path / "a.csv").write_text("a,b,c,d\n 12,1.5,99999999999999999999,2024-01-02\n+3,2,1,NA\n-4,x,1e3,2024-01-03 04:05:06\n")
    got = io.read_table(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint", "string", "double", "timestamp_ntz"]
    assert [r["a"] for r in got.collect()] == [12, 3, -4]


def test_top_terms_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "bbb aaa bbb ccc aaa the"), (2, ""), (3, None), (4, "the the")], "id int, text string")
    got = {r["id"]: (r["keywords"], r["phrases"]) for r in X.keywords_and_phrases(df, "id", pairs=2).collect()}
    assert got == {1: (["bbb", "aaa", "ccc"], ["bbb aaa", "aaa bbb"]), 2: ([], []), 4: ([], [])}


def test_text_metrics_read_their_rows_once(spark):
    df = spark.createDataFrame([(1, "Anna met Bob on 2024-01-05"), (2, "good der der und"), (3, ""), (4, None)], "id int, text string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    ents = X.metrics_entities(X.entities(df, "id"))
    assert ents.first().asDict() == {"total_texts": 3, "total_entities": 3, "avg_entities_per_text": 1.0, "most_common_entity_type": "PERSON"}
    lang = X.metrics_language(X.language(df, "id"))
    assert lang.first().asDict() == {"total_texts": 3, "unique_languages": 2, "most_common_language": "English", "avg_confidence": 2 / 3}
    for d in (ents, lang):
        assert "scalar-subquery" not in plan(d) and plan(d).count("LogicalRDD") + plan(d).count("LocalRelation") == 1
    none = df.where("id > 9")
    assert X.metrics_entities(X.entities(none, "id")).first().asDict() == {
        "total_texts": 0, "total_entities": None, "avg_entities_per_text": None, "most_common_entity_type": "none"}
    one = X.findings_text(X.sentiment(df, "id"), X.classify(df, "id"), X.entities(df, "id"), X.topics(df, "id")).first()
    assert (one["top_category"], one["top_category_count"], one["top_entity_type"], one["top_entity_count"]) == ("other", 3, "PERSON", 2)
