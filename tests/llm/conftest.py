import random

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    r = random.Random(1)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))
    base = [say(60) for _ in range(12)]
    near = [b.replace(b.split()[30], "changed", 1) for b in base[:6]]
    texts = base + near + base[:4] + [None, "", " \n\t ", "one", "Two words", say(30_000), "é日🙂 " * 40, "x" * 5000,
                                      base[7].upper(), "a\nb\na\n\nc  a"]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", None if t is None else len(t), i, "n", 1.5, "k") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[1], None, None, None, None, None, None, None)]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, id long, n string, score double, k string")
    return spark.createDataFrame(rows, T._parse_datatype_string(schema)).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="session")
def labels(spark, docs):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(25)] + [(26, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
