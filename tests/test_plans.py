"""Distributed building blocks against brute force on small hand-written data."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.plans.ranking import quantiles
from quarry.plans.scan import ordered_scan


def test_quantiles_match_numpy_with_ties_nulls_and_constants(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.choice([1, 2, 2, 3, 5, 8, 8, 8])) if i % 7 else None, 4.0, float(i)) for i in range(301)]
    df = spark.createDataFrame(rows, "id long, x double, c double, y double")
    q = {r["column"]: r for r in quantiles(df, ["x", "c", "y"], {"q1": .25, "med": .5, "q3": .75}).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "x", "c", "y"])
    for c in ["x", "c", "y"]:
        for name, p in [("q1", .25), ("med", .5), ("q3", .75)]:
            assert abs(q[c][name] - pdf[c].quantile(p)) < 1e-9


def test_quantiles_single_row_and_all_null(spark):
    df = spark.createDataFrame([(1, 3.5, None)], "id long, x double, z double")
    q = {r["column"]: r for r in quantiles(df, ["x", "z"], {"med": .5}).collect()}
    assert q["x"]["med"] == 3.5
    assert "z" not in q  # no values, no row; callers left-join from the column list


def test_ordered_scan_equals_plain_window_with_hot_key(spark):
    rng = random.Random(7)
    rows = []
    for i in range(2000):
        user = 0 if i % 3 == 0 else rng.randint(1, 40)  # one key holds a third of the rows
        rows.append((i, user, rng.randint(0, 10**6), None if i % 11 == 0 else float(rng.randint(-50, 50))))
    df = spark.createDataFrame(rows, "id long, user long, t long, v double")
    got = ordered_scan(df, ["v"], ["t", "id"], ["user"], partitions=16)
    w = Window.partitionBy("user").orderBy("t", "id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("id", F.lag("v", 1).over(w).alias("l1"), F.lag("v", 2).over(w).alias("l2"),
                    F.sum("v").over(run).alias("s"), F.max("v").over(run).alias("mx"), F.min("v").over(run).alias("mn"))
    a = got.select("id", F.col("v__lag1").alias("l1"), F.col("v__lag2").alias("l2"), F.col("v__cumsum").alias("s"),
                   F.col("v__cummax").alias("mx"), F.col("v__cummin").alias("mn")).toPandas().sort_values("id")
    b = ref.toPandas().sort_values("id")
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True), check_dtype=False)


def test_ordered_scan_global_order_no_key(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(500)], "id long, v double")
    got = ordered_scan(df, ["v"], ["id"], None, partitions=7).orderBy("id").toPandas()
    assert np.allclose(got["v__cumsum"].to_numpy(), np.cumsum(got["v"].to_numpy()))
    assert got["v__lag2"].isna().sum() == 2
