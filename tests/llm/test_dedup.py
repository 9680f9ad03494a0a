"""Near-duplicate documents, vectors and passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import cap_filters, minhash, suffix_dedup
from quarry.llm.common import components


def smallest_reachable(ids, links):
    label = {i: i for i in ids}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


def shingle_set(text, words):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def linked(texts, words, percent):
    sets = {i: shingle_set(t, words) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = smallest_reachable(sets, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


@pytest.mark.parametrize("region", [256, 4])
def test_forest_links_as_brute_force(spark, docs, region):
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect() if r[0] is not None}
    got = {r[0]: tuple(r[1:]) for r in minhash.link(docs, region=region).collect()}
    assert got == linked(texts, 3, 85)
    assert any(v[1] != k for k, v in got.items())


def test_forest_splits_dense_regions(spark):
    r = random.Random(3)
    first = [r.choice("abcdefghij") + str(r.randint(0, 999)) for _ in range(120)]
    rows = []
    for i in range(150):  # one large group of near copies at all similarities around the threshold
        w = list(first)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = "z" + str(r.randint(0, 9999))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x[0]: tuple(x[1:]) for x in minhash.link(df, region=16).collect()}
    want = linked(dict(rows), 3, 85)
    assert sum(got[i] != want[i] for i in want) <= 1


@pytest.mark.parametrize("words, percent, base, tail, change, trees",
                         [(3, 85, 5, 20, 13, 20), (5, 80, 4, 30, 17, 20), (5, 80, 1, 30, 17, 6)])
def test_forest_is_exact_in_dense_regions(spark, words, percent, base, tail, change, trees):
    """Pairs at the threshold among texts that all share most of their shingles: deeper prefixes miss some."""
    core, rows = [f"w{i}" for i in range(200)], []
    for i in range(200):
        text = core[:200 - tail] + [f"t{i}x{j}" for j in range(tail)]
        rows.append((2 * i, " ".join(text)))
        text[60:60 + change] = [f"m{i}x{j}" for j in range(change)]
        rows.append((2 * i + 1, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x[0]: tuple(x[1:]) for x in minhash.link(df, words=words, percent=percent, base=base, trees=trees, region=32).collect()}
    want = linked(dict(rows), words, percent)
    assert all(want[2 * i + 1][1] == 2 * i for i in range(200))
    assert got == want


def test_forest_keeps_columns_and_handles_an_empty_table(docs, nothing):
    assert minhash.link(nothing).count() == 0
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert None in ids and 12 not in ids and ids.count(0) == 3


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges for x in e if e[0] != e[1]}
    assert got == smallest_reachable(ids, edges)


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((40, 16))
    rows = [(i, b.tolist(), i % 3) for i, b in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + 0.02 * r.standard_normal(16)).tolist(), i % 5 % 3) for i in range(60)]
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, rows[0][1], 1), (203, rows[0][1], None),
             (204, None, 0), (205, [0.0] * 16, 0), (206, [float("nan")] + [1.0] * 15, 0), (207, [None] + [1.0] * 15, 0),
             (208, [], 0), (209, [1e200] * 16, 0), (210, [2e200] * 16, 0), (211, [1.0] * 8, 0), rows[3], (None, rows[0][1], 0)]
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_caps_link_as_brute_force(spark, vectors, block):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    got = {r[0]: tuple(r[1:]) for r in cap_filters.link(df, block=block, codes=32, alpha=0.3).collect()}
    rows = {i: (v, lab) for i, v, lab in vectors if i is not None}
    good = {i: cap_filters.unit(np.array([v]))[0] for i, (v, lab) in rows.items()
            if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a != b and rows[a][1] == rows[b][1] and len(good[a]) == len(good[b])
             and good[a] @ good[b] >= 0.98]
    comp = smallest_reachable(rows, links)
    want = {i: (sum(a == i for a, _ in links), comp[i], comp[i] == i) for i in rows}
    assert got == want


def test_caps_recall_at_the_threshold():
    r = np.random.default_rng(1)
    x = cap_filters.unit(r.standard_normal((300, 64)))
    z = r.standard_normal(x.shape)
    z = cap_filters.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.9801 * x + np.sqrt(1 - 0.9801 ** 2) * z
    assert cap_filters.recall(np.concatenate((x, y))) >= 0.99


@pytest.mark.parametrize("dim", [128, 384, 768])
def test_caps_recall_in_more_dimensions(dim):
    r = np.random.default_rng(2)
    x = cap_filters.unit(r.standard_normal((200, dim)))
    z = r.standard_normal(x.shape)
    z = cap_filters.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.9801 * x + np.sqrt(1 - 0.9801 ** 2) * z
    assert cap_filters.recall(np.concatenate((x, y))) >= 0.99
    passed = [len(f) for f in cap_filters.decode(x, 2, 256, 8, 0.44)]
    assert min(passed) > 0 and 30 < np.mean(passed) < 130  # 66 at 64 dimensions


def test_caps_without_a_filter_take_the_nearest():
    x = cap_filters.unit(np.random.default_rng(3).standard_normal((20, 64)))
    passed = cap_filters.decode(x, 2, 256, 8, 0.95)
    assert all(len(f) == 8 for f in passed)


def test_caps_of_an_empty_table(spark):
    assert cap_filters.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def repeats(rows, length):
    """Per key the counts and digest by looking at every string."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[key] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [4096, 2])
def test_passages_as_brute_force(spark, docs, crowd):
    r = random.Random(5)
    passages = ["".join(r.choice("abé ") for _ in range(r.randint(20, 90))) for _ in range(6)]
    rows = [(i, "".join(r.choice(passages + [f"x{r.randint(0, 99)} y"] * 4) for _ in range(r.randint(0, 14)))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, "a" * 300), (903, "ab" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x[0]: tuple(x[1:]) for x in suffix_dedup.dedup(df, length=20, gram=8, crowd=crowd).collect()}
    assert got == repeats(rows, 20)


def test_passages_of_odd_rows(docs, nothing):
    assert suffix_dedup.dedup(nothing).count() == 0
    got = suffix_dedup.dedup(docs).collect()
    assert len(got) == docs.count()
    rows = {r[0]: tuple(r[1:]) for r in got}
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    want = repeats([(1 << 63, texts[None])] + [(k, t) for k, t in texts.items() if k is not None], 100)
    want[None] = want.pop(1 << 63)
    assert rows == want


def test_blind_tries_order_equal_and_different_strings():
    r = random.Random(2)
    data = "".join(r.choice("ab") for _ in range(3000)).encode()
    place = np.arange(len(data) - 12)
    got = {frozenset(x.tolist()) for x in suffix_dedup.deep_shallow(data, place, place % 2, 12, 8)}
    want: dict = {}
    for p in place.tolist():
        want.setdefault((data[p:p + 12], p % 2), set()).add(p)
    assert got == {frozenset(v) for v in want.values() if len(v) > 1}
