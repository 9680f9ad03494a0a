"""Alignment of two tokenizers against a plain version that reads whole texts and looks at all pairs."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from quarry.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b", "\n\n x", "a\n b", "  lead", "trail ", "trail  ", "x\ny z", "a \n b", "tab\tx y", "é🙂 日本 語", "▁x y", "no\xa0break x",
       "a'll it's 123 4.5 x", "<s> </s> <|endoftext|> q", "\x00 z", "a b c", "\n", " ", "x" * 300 + " y", "a\x1c b c", "a​ b",
       "１２ ﬁ x", "a\nb\n", "\r\n c", "aaaa bbbb" * 40, "ab" * 2000, "  x", "a\u0085 b", "<0x0A> z", "Ġa Ċ"]


@pytest.fixture(scope="module")
def aligner():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        x = align.Aligner(f.read(), g.read(), public_tokenizers.PATTERN)
    x.a = tokenizers.Tokenizer.from_file(A)
    x.a.encode_special_tokens = True
    return x


def plain(x, text):
    """Token ids, groups, overlap links (id pairs) and the number of shared-group links."""
    if not text:
        return None
    a, b = x.a.encode(" " + text, add_special_tokens=False).ids, x.b.encode(text)
    bytes_a, bytes_b = [x.bytes_a[i] for i in a], [x.bytes_b[i] for i in b]
    if not b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
        return None
    end_a, end_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
    cut = sorted(set(end_a) & set(end_b))
    groups, links, shared, i, j = [], [], 0, 0, 0
    for c in cut:
        k, m = end_a.index(c, i) + 1, end_b.index(c, j) + 1
        groups.append((a[i:k], b[j:m]))
        shared += (k - i) * (m - j)
        for p in range(i, k):
            for q in range(j, m):
                if max(end_a[p] - len(bytes_a[p]), end_b[q] - len(bytes_b[q])) < min(end_a[p], end_b[q]):
                    links.append((a[p], b[q]))
        i, j = k, m
    return len(a), len(b), groups, links, shared


def whole(x, texts):
    each = [plain(x, t) for t in texts]
    count = collections.Counter(pair for e in each if e for pair in e[3])
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for e in each:
        if e is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        digest = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in e[2])
        out.append((e[0], e[1], len(e[2]), len(e[3]), sum(count[p] == top[p[1]] for p in e[3]), sum(count[p] for p in e[3]),
                    hashlib.sha256(digest.encode()).hexdigest(), e[4]))
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 500])
def test_links_equal_the_plain_version(spark, docs, aligner, chunk):
    texts = [r[0] for r in docs.select("text").collect()]
    got = [tuple(r) for r in align.link(docs, A, B, public_tokenizers.PATTERN, chunk=chunk).collect()]
    keys = [r[0] for r in docs.select("doc_id").collect()]
    assert collections.Counter(got) == collections.Counter((k, *w) for k, w in zip(keys, whole(aligner, texts)))


def test_odd_texts_and_the_library_path(spark, aligner):
    rows = [(i, t, t, 1) for i, t in enumerate([*ODD, None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, chunk int").repartition(3)
    want = collections.Counter((r[0], *w) for r, w in zip(rows, whole(aligner, [r[1] for r in rows])))
    for pattern in (public_tokenizers.PATTERN, None):
        assert collections.Counter(tuple(r) for r in align.link(df, A, B, pattern).collect()) == want
    assert want[(len(ODD), 0, 0, 0, 0, 0, 0, "", 0)] == 1


def test_empty_table_and_columns(spark, nothing):
    df = align.link(nothing, A, B, public_tokenizers.PATTERN)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]
    assert df.collect() == []


def test_parts_are_read_alone_as_in_the_text(spark, aligner):
    assert aligner.cuts and aligner.ranks is not None
    texts = ODD + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r[0]]
    for t in texts:
        parts = aligner.parts(t)
        assert "".join(parts) == " " + t
        a, _, b, _ = aligner.encode(parts)
        assert a.tolist() == aligner.a.encode(" " + t, add_special_tokens=False).ids
        assert b.tolist() == aligner.b.encode(t)


def test_products_equal_dense_ones():
    r = np.random.default_rng(1)
    for _ in range(20):
        n, k, m = r.integers(1, 9, 3)
        x, y = r.integers(0, 3, (n, k)), r.integers(0, 3, (m, k))

        def csr(d):
            row, col = np.nonzero(d)
            return align.Csr(np.searchsorted(row, np.arange(len(d) + 1)), col, d[row, col], d.shape[1])

        def dense(c):
            d = np.zeros((len(c.indptr) - 1, c.columns), int)
            d[np.repeat(np.arange(len(d)), np.diff(c.indptr)), c.indices] = c.data
            return d

        assert (dense(align.transpose(csr(y))) == y.T).all()
        assert (dense(align.gustavson(csr(x), align.transpose(csr(y)))) == x @ y.T).all()
        v = r.integers(0, 9, k)
        assert (align.row_sums(csr(x), v) == x @ v).all()


def test_shared_bytes_and_group_links():
    # A: 2 + 1 + 3 bytes, B: 1 + 2 + 3 bytes; both end after 3 and 6
    got = align.align(np.array([2, 1, 3]), np.array([1, 2, 3]))
    links = [(i, j, v) for i in range(3) for j, v in zip(got.links.indices[got.links.indptr[i]:got.links.indptr[i + 1]],
                                                        got.links.data[got.links.indptr[i]:got.links.indptr[i + 1]])]
    assert links == [(0, 0, 1), (0, 1, 1), (1, 1, 1), (2, 2, 3)]
    shared = align.shared_group_links(got)
    assert np.diff(shared.indptr).tolist() == [2, 2, 1] and shared.indices.tolist() == [0, 1, 0, 1, 2]


def test_query_on_the_smallest_table(spark, aligner):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.op12_incidence_links(spark, sf).collect()}
    assert got == {(r[0], *w) for r, w in zip(rows, whole(aligner, [r[1] for r in rows]))}
