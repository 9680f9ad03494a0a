"""Steps that wrote whole tables, or more, to disk: results as before, disk in proportion."""

import hashlib
import os

import numpy as np
import pandas as pd
import pytest

from quarry import catalog
from quarry.operators import margin, ml
from quarry.session import ensure_checkpoint_dir, stored


def _bytes(spark):
    """Bytes in the checkpoint folder."""
    at = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(at) for f in files)


def _is_test(rows, fraction):
    """By ranks: rows (a, b, label) -> whether each is among the first of its label."""
    order = lambda r: (hashlib.md5(("42" + "\x01".join(str(x) for x in r[:2] if x is not None)).encode()).hexdigest(),
                       *((x is not None, x or 0) for x in r[:2]))
    out = {}
    for label in {r[2] for r in rows}:
        mine, first = sorted(((order(r), r) for r in rows if r[2] == label), key=lambda x: x[0]), {}
        for i, (o, r) in enumerate(mine):
            out[r] = first.setdefault(o, i) < int(len(mine) * fraction + 0.5)
    return out


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.999, 1.0])
def test_split_by_the_last_test_row_is_the_split_by_ranks(spark, fraction):
    rng = np.random.default_rng(3)
    some = lambda n: [None if v == 0 else int(v) for v in rng.integers(0, n, 400)]
    rows = list(zip(some(40), some(4), [None if v == 0 else float(v) for v in rng.integers(0, 4, 400)]))
    rows += [(1000 + i, None, 9.0) for i in range(2)]  # too few for a test row at 0.2
    want = _is_test(rows, fraction)
    df = spark.createDataFrame(rows, "a long, b int, label double").repartition(3)
    got = ml.ml_split(df, ["a", "b"], test_fraction=fraction, in_place=True).collect()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)[:3]) for r in got)
    assert all(r["is_test"] == want[tuple(r)[:3]] for r in got)
    whole = _is_test([(a, b, 0) for a, b, _ in rows], fraction)
    assert all(r["is_test"] == whole[(r["a"], r["b"], 0)] for r in ml.ml_split(df, ["a", "b"], None, fraction, in_place=True).collect())


def test_split_of_many_strata(spark):
    df = spark.range(6000).selectExpr("id", "id % 2000 as label")
    got = ml.ml_split(df, ["id"], test_fraction=0.34, in_place=True).collect()
    assert len(got) == 6000 and len({r["label"] for r in got if r["is_test"]}) == sum(r["is_test"] for r in got) == 2000


def test_split_writes_no_rows(spark):
    df = spark.range(51000).selectExpr("id", "id % 7 as other", "cast(id % 3 as double) as label")
    for label in (None, "label"):
        was = _bytes(spark)
        assert ml.ml_split(df, ["id", "other"], label, in_place=True).where("is_test").count() == 10200
        assert _bytes(spark) - was < 2 * 51000  # 42 bytes a row when rows were ranked
        plan = ml.ml_split(df, ["id", "other"], label, in_place=True)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_stored_tables_are_small_and_whole(spark):
    df = spark.range(50000).selectExpr("id", "cast(id % 50 as double) as a", "if(id % 9 = 0, null, id % 11 / 100) as b", "id % 5 = 0 as t")
    was = _bytes(spark)
    got = stored(df)
    assert _bytes(spark) - was < 10 * 50000
    assert got.dtypes == df.dtypes and got.exceptAll(df).isEmpty() and got.count() == 50000
    assert stored(df.where("id < 0")).collect() == []


def test_packed_blocks_are_compressed(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(1, 51, 40000), rng.integers(0, 11, 40000)
    df = spark.createDataFrame(pd.DataFrame({"a": a.astype(float), "b": b / 100})).coalesce(1)
    was = _bytes(spark)
    blocks = margin.packed(df, ["a", "b"])
    assert _bytes(spark) - was < 3 * 40000  # 4.7 bytes a row when a block was held row by row
    told = lambda x: np.array([x[:, 0].sum(), np.rint(x[:, 1] * 100).sum(), len(x)])
    assert margin.summed(blocks, None, told).tolist() == [a.sum(), b.sum(), 40000]


@pytest.mark.parametrize("query", ["reg_forest", "reg_svr"])
def test_regressions_write_little_more_than_their_rows(spark, tmp_path, query):
    rng, n = np.random.default_rng(5), 30000
    li = pd.DataFrame({"l_orderkey": np.arange(n) // 3, "l_linenumber": np.arange(n) % 3, "l_partkey": rng.integers(1, 9000, n),
                       "l_suppkey": rng.integers(1, 500, n), "l_quantity": rng.integers(1, 51, n).astype(float),
                       "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100})
    spark.createDataFrame(li).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    keys = [f"{a}\x01{b}\x01{c}\x01{d}" for a, b, c, d in zip(*(li[k] for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))]
    test = np.argsort([hashlib.md5(f"42{k}".encode()).hexdigest() for k in keys])[:n // 5]
    label = (2 * li["l_quantity"] + 3 * li["l_discount"])[test]
    was = _bytes(spark)
    got = catalog.queries()[query](spark, str(tmp_path)).collect()
    assert _bytes(spark) - was < 25 * n  # 81 bytes a row and more when rows were ranked and pinned
    if query == "reg_forest":
        assert got[0]["rows"] == n // 5 and abs(got[0]["mean_label"] - label.mean()) < 1e-4
    else:
        found = {(r["l_orderkey"], r["l_linenumber"]): (r["label"], r["in_tube"]) for r in got}
        assert found == {(i // 3, i % 3): (round(label[i], 2), True) for i in test.tolist()}
