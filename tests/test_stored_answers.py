"""Stored answers: one call a distinct text, also when a task dies and is tried again, and in later runs."""

import os
import subprocess
import sys
from collections import Counter

import pytest

from quarry.operators import infer

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def counting(folder, dies_after=None):
    """Notes every text in a file of its own; the process dies once, before the call after ``dies_after`` texts."""
    def provider(texts):
        import os
        import uuid
        if dies_after is not None and len(os.listdir(f"{folder}/asked")) >= dies_after and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(3)
        for x in texts:
            with open(f"{folder}/asked/{uuid.uuid4().hex}", "w") as f:
                f.write(x)
        return [{"sentiment": x[-1], "confidence": 0.5} for x in texts]
    os.makedirs(f"{folder}/asked", exist_ok=True)
    return provider


def asked(folder):
    return Counter(open(f"{folder}/asked/{f}").read() for f in os.listdir(f"{folder}/asked"))


RETRY = """
import sys
from pyspark.sql import SparkSession
from quarry.operators import infer
from tests.test_stored_answers import counting
folder = sys.argv[1]
spark = (SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.driver.host", "127.0.0.1").getOrCreate())
df = spark.createDataFrame([(i, "text %d" % (i % 40)) for i in range(120)], "id long, text string")
out = infer.batch_inference(df, "id", "text", "sentiment", counting(folder, 15), batch_size=3, store="file:" + folder + "/store")
rows = out.collect()
assert len(rows) == 120 and all(r["answered_by"] == "model" and r["sentiment"] == str(r["id"] % 40)[-1] for r in rows)
spark.stop()
"""


def test_a_retried_task_asks_for_nothing_twice(tmp_path):
    subprocess.run([sys.executable, "-c", RETRY, str(tmp_path)], cwd=ROOT, check=True, timeout=240,
                   env=os.environ | {"PYTHONPATH": ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")})
    assert os.path.exists(tmp_path / "died")  # a worker did die in the middle
    assert asked(tmp_path) == {f"text {i}": 1 for i in range(40)}
    assert sorted(os.listdir(tmp_path / "store")) == ["answers"]


def test_later_runs_ask_for_new_texts_only(spark, tmp_path):
    make = lambda n: spark.createDataFrame([(i, None if i == 3 else f"t{i % 7}") for i in range(n)], "id long, text string")
    store, provider = str(tmp_path / "store"), counting(str(tmp_path))
    out = infer.batch_inference(make(5), "id", "text", "sentiment", provider, store=store)
    assert out.count() == 4 and out.count() == 4
    again = infer.batch_inference(make(30), "id", "text", "sentiment", provider, store=store).collect()
    assert len(again) == 29 and all(r["sentiment"] == str(r["id"] % 7) for r in again)
    assert asked(tmp_path) == {f"t{i}": 1 for i in range(7)}
    assert infer.batch_inference(make(0), "id", "text", "sentiment", provider, store=store).count() == 0


@pytest.mark.parametrize("bad", [lambda b: "not json", lambda b: 1 / 0])
def test_failed_calls_are_not_stored(spark, tmp_path, bad):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, text string")
    store = str(tmp_path / "store")
    got = infer.batch_inference(df, "id", "text", "sentiment", bad, store=store).collect()
    assert {r["answered_by"] for r in got} == {"rule"} and {r["sentiment"] for r in got} == {"positive", "negative"}
    got = infer.batch_inference(df, "id", "text", "sentiment", counting(str(tmp_path)), store=store).collect()
    assert {r["id"]: r["sentiment"] for r in got} == {1: "d", 2: "d"} and {r["answered_by"] for r in got} == {"model"}
