"""Searches over vectors against brute force: nulls, zeros, ties, copies, lengths, very large numbers, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import collision, hard_negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, id long, n int, score double, rank string, b int, s string, dim int"


def table(spark, rows):
    """Rows of (vec_id, embedding, label); the other columns clash with names used inside."""
    return spark.createDataFrame([(*r, 7, 1, 0.5, "x", 3, "y", 9) for r in rows], SCHEMA).repartition(3)


def odd_rows():
    r = np.random.default_rng(5)
    base = r.standard_normal((60, 6))
    rows = [(i, list(map(float, v)), int(i % 3)) for i, v in enumerate(base)]
    rows += [(100 + i, rows[4][1], 1) for i in range(30)]  # copies, more than are asked for
    rows += [(200 + i, [2.0 * x for x in rows[i][1]], i % 2) for i in range(10)]  # other lengths
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 6, 1), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (304, [float("nan")] * 6, 1),
             (305, [float("inf")] + [0.0] * 5, 1), (306, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0], None), (None, rows[1][1], 1),
             (320, [1.0, 2.0], 1), (340, [0.5, -1.0], 1), (7, rows[7][1], 1)]
    return rows


def valid(rows, zero=False):
    out = {}
    for i, v, lab in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and (zero or np.any(v)):
            out.setdefault(i, (np.array(v), lab))
    return out


def nearest(rows, step, k):
    data, out = valid(rows), {}
    for q, (v, _) in data.items():
        if q % step == 0:
            found = sorted((-float((v * w).sum()), i) for i, (w, _) in data.items() if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in found]
    return {q: x for q, x in out.items() if x}


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("block", [16384, 12])
def test_collision_search_equals_brute_force_on_odd_rows(spark, block):
    rows = odd_rows()
    got = answers(collision.search(table(spark, rows), lambda key: key % 20 == 0, k=5, miss=0.0, block=block, side=3))
    want = nearest(rows, 20, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-14)


@pytest.mark.parametrize("scale", [1e-200, 1e150])
def test_collision_search_takes_any_length(spark, scale):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v * scale * r.lognormal(0, 1)], 0) for i, v in enumerate(r.standard_normal((300, 20)))]
    got = answers(collision.search(table(spark, rows), lambda key: key % 20 == 0, k=5, block=100))
    want = nearest(rows, 20, 5)
    share = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(share) >= 0.95


def test_collision_recall_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    for block in (16384, 300):
        got = answers(collision.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), lambda key: key % 20 == 0, block=block))
        x, ids = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows])
        share = []
        for q, found in got.items():
            s = x @ x[np.flatnonzero(ids == q)[0]]
            best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
            share.append(len(set(best) & {i for i, _ in found}) / 20)
            assert len(found) == 20
        assert np.mean(share) >= 0.98


def test_collisions_of_a_vector_at_the_radius():
    need = collision.threshold(65, 128, 1.7, 0.01)
    r = np.random.default_rng(2)
    x = r.standard_normal((4000, 65))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (np.abs(x @ collision.directions(65, 128)) <= 1.7).sum(axis=1) >= need
    far = (np.abs(1.5 * x @ collision.directions(65, 128)) <= 1.7).sum(axis=1) >= need
    assert near.mean() >= 0.98 and far.mean() < 0.02


def test_windows_widen_as_if_counted_anew():
    r = np.random.default_rng(3)
    x = r.standard_normal((200, 5))
    b = collision.Block(x, collision.lift(x, np.full(200, 0.5)), np.ones(200, np.int64), 16)
    h = r.standard_normal((1, 16))
    points = b.lifted @ collision.directions(6, 16)
    counts, span = np.zeros(200, np.int64), b.windows(h, np.zeros(1))
    span = span[0][0], span[0][0]
    for half in (0.1, 0.4, 1.5, 9.0):
        lo, hi = (w[0] for w in b.windows(h, np.array([half])))
        counts, span = b.widen(counts, *span, lo, hi), (lo, hi)
        assert (counts == (np.abs(points - h[0]) <= half).sum(axis=1)).all()


def test_vector_searches_of_empty_tables(spark):
    none = table(spark, odd_rows()).where("1 = 0")
    assert collision.search(none, lambda key: key % 20 == 0).collect() == []
    assert hard_negatives.mine(none, lambda key: key % 100 == 0).collect() == []
    lone = table(spark, [(20, [1.0, 2.0], 1)])
    assert collision.search(lone, lambda key: key % 20 == 0).collect() == []


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (33, 65, 47), (64, 64, 64), (100, 37, 91)])
def test_strassen_equals_the_plain_product(shape):
    r = np.random.default_rng(4)
    n, k, m = shape
    a, b = r.integers(-2**30, 2**30, (n, k)), r.integers(-2**30, 2**30, (k, m))
    for leaf in (1, 4, 32):
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()
    big = a.astype(object) * 10**12
    assert (hard_negatives.strassen(big, b.astype(object), 4) == big @ b.astype(object)).all()


def test_scores_never_wrap():
    a = np.array([[2**40, -2**40]])
    assert hard_negatives.scores(a, np.array([[2**21, 2**21]]))[0, 0] == 0
    with pytest.raises(OverflowError):
        hard_negatives.scores(a, np.array([[2**40, 2**20]]))


def negatives(rows, step, scale=256, p_max=5, n_max=10, low=30, high=90):
    from fractions import Fraction
    from math import floor
    data = {i: ([floor(Fraction(float(x)) * scale) for x in v], lab) for i, (v, lab) in valid([r for r in rows if r[2] is not None], True).items()}
    out = set()
    for a, (v, lab) in data.items():
        if a % step:
            continue
        s = {i: sum(x * y for x, y in zip(v, w)) for i, (w, _) in data.items() if i != a and len(w) == len(v)}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if data[i][1] == lab][:p_max]:
            hits = [i for i in order if data[i][1] != lab and low * s[p] <= 100 * s[i] <= high * s[p]][:n_max]
            out |= {(a, p, k + 1, i, s[p], s[i]) for k, i in enumerate(hits)}
    return out


@pytest.mark.parametrize("tile,side", [(4096, 512), (7, 2)])
def test_hard_negatives_equal_brute_force(spark, tile, side):
    rows = odd_rows()[:-1]
    got = [tuple(r) for r in hard_negatives.mine(table(spark, rows), lambda key: key % 10 == 0, tile=tile, side=side).collect()]
    assert len(got) == len(set(got)) and set(got) == negatives(rows, 10)


def test_hard_negatives_of_large_numbers(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(r.standard_normal((40, 3)) * 2.5e6)]
    got = {tuple(r) for r in hard_negatives.mine(table(spark, rows), lambda key: key % 10 == 0).collect()}
    assert got == negatives(rows, 10) and got


def test_vector_queries_on_the_smallest_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = answers(queries.op11_collision_counting(spark, SF))
    want = nearest(rows, 20, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.98
    moved = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    df = queries.op13_strassen_negatives(spark, SF)
    assert {tuple(r) for r in df.collect()} == negatives(moved, 100)
    assert dict(df.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                               "positive_score": "bigint", "negative_score": "bigint"}
    assert queries.op11_collision_counting(spark, SF).select(F.max("rank")).first()[0] == 20
