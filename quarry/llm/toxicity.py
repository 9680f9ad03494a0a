"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is lower-cased and cut at white space. A word's input is its vector from the training vocabulary (zero if
unknown) beside a vector from its characters (the scaled sum over its hashed 4- and 5-grams of bytes, with word ends
marked). Windows of ``window`` words that overlap by a quarter cover the whole text; two GRUs read each window forwards
and backwards, attention pools their states, a linear layer gives a logit. A text's logit is the largest of its
windows, mapped to a probability by a line fitted on the training texts.

Training uses at most ``sample`` labelled texts of each class (a documented bound: the first by a hash of their key),
joined to their texts, in one task; the model that comes of it has a fixed size and is broadcast. As labels are for texts, each
round takes the windows that now score highest in every text, and some at random. Only the text is an input; labels
are read only from rows that ``train`` admits.

Null and empty texts, and texts without words, score the share of positive labels. With no labelled rows, or only one
class, every text scores that share (0 without any). Rows with a null key or label are not learned from; a null key is held out. Rows are independent, so repeated rows repeat their score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_lengths, made_in_task, portions, prefix_hash, span_hash, word_bounds

H, WORD, CHAR, GRAMS = 8, 8, 8, 1 << 17
BLOCK = 1 << 14  # words whose hashes or character vectors are held at once


class Words:
    """The words of some texts: distinct words as bytes, and each text's run of word numbers."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        start, end = word_bounds(data)
        h = np.empty(len(start), np.uint64)
        for i in range(0, len(start), BLOCK):  # hashes of a block at a time: they take several words a byte
            a, b = start[i:i + BLOCK], end[i:i + BLOCK]
            h[i:i + len(a)] = span_hash(prefix_hash(data[a[0]:b[-1]]), a - a[0], b - a[0])
        self.hash, first, self.number = np.unique(h, return_index=True, return_inverse=True)
        place = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.first = np.searchsorted(start, place)  # of each text, and the total
        blocks = [self._grams(data, start[first[i:i + BLOCK]], end[first[i:i + BLOCK]]) for i in range(0, len(first), BLOCK)]
        none = [np.empty(0, np.int64)]
        self.gram = np.concatenate(none + [g for g, _ in blocks])
        self.owner = np.concatenate(none + [o + i * BLOCK for i, (_, o) in enumerate(blocks)])

    @staticmethod
    def _grams(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashed 4- and 5-grams of the words data[a:b], each between two marks, and the word of each."""
        n = b - a + 2
        off = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()), np.uint8)
        at = np.arange(len(flat)) - np.repeat(off, n)
        inside = (at > 0) & (at < np.repeat(n, n) - 1)
        flat[inside] = data[(np.repeat(a, n) + at - 1)[inside]]
        flat[~inside] = 0x20
        p = prefix_hash(flat)
        grams, owner = [], []
        left = np.repeat(n, n) - at  # bytes from here to the word's end
        for k in (4, 5):
            g = np.flatnonzero((left >= k) | (at == 0) & (left == np.repeat(n, n)) & (k == 4))
            e = np.minimum(g + k, g + left[g])
            grams.append((span_hash(p, g, e) & np.uint64(GRAMS - 1)).astype(np.int64))
            owner.append(np.repeat(np.arange(len(n)), n)[g])
        gram, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return gram[order], owner[order]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text of each window, word numbers padded by -1); each overlaps the next by a quarter."""
        step, rows, text = size - size // 4, [], []
        padded = np.concatenate((self.number, np.full(size, -1, self.number.dtype)))
        for i in range(len(self.first) - 1):
            a, n = self.first[i], self.first[i + 1] - self.first[i]
            if n:
                k = max(1, -(-(n - size // 4) // step))
                at = a + np.arange(k)[:, None] * step + np.arange(size)[None, :]
                w = padded[at]
                w[at >= a + n] = -1
                rows.append(w)
                text += [i] * k
        return np.array(text, np.int64), np.concatenate(rows) if rows else np.empty((0, size), np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _tanh(x: np.ndarray) -> None:
    """tanh in place: 2 / (1 + exp(-2x)) - 1."""
    x *= np.float32(-2)
    np.exp(x, out=x)
    x += np.float32(1)
    np.divide(np.float32(2), x, out=x)
    x -= np.float32(1)


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        d = WORD + CHAR
        f = np.float32

        def w(*shape):
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(f)

        self.vocabulary = vocabulary  # sorted hashes
        self.word = (0.1 * r.standard_normal((len(vocabulary) + 1, WORD))).astype(f)
        self.word[-1] = 0  # unknown
        self.char = (0.1 * r.standard_normal((GRAMS, CHAR))).astype(f)
        self.p = {"xf": w(d, 3 * H), "hf": w(H, 3 * H), "bf": np.zeros(3 * H, f), "xb": w(d, 3 * H), "hb": w(H, 3 * H),
                  "bb": np.zeros(3 * H, f), "wa": w(2 * H, H), "ba": np.zeros(H, f), "va": w(H), "wo": w(2 * H),
                  "bo": np.zeros(1, f)}
        self.line = (1.0, 0.0)  # probability = sigmoid(line[0] * logit + line[1])
        self.prior = 0.0

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of the distinct words and a zero row for padding; vocabulary rows; scale of the characters."""
        at = np.searchsorted(self.vocabulary, words.hash)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == words.hash if len(self.vocabulary) else np.zeros(len(at), bool)
        row = np.where(known, at, len(self.vocabulary))
        n = np.bincount(words.owner, minlength=len(row))
        scale = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
        out = np.zeros((len(row) + 1, WORD + CHAR), np.float32)
        out[:-1, :WORD] = self.word[row]
        for i in range(0, len(row), BLOCK):
            a, b = np.searchsorted(words.owner, (i, i + BLOCK))
            if a < b:
                owner = words.owner[a:b]
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                out[owner[first], WORD:] = np.add.reduceat(self.char[words.gram[a:b]], first) * scale[owner[first], None]
        return out, row, scale

    def _gru(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None):
        """States (time x windows x H) of one direction; x: projected inputs of all words, by index."""
        proj, idx = x
        u, n, steps = self.p["h" + side], idx.shape[0], idx.shape[1]
        h = np.zeros((n, H), np.float32)
        out = np.empty((steps, n, H), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a, b = proj[idx[:, t]], h @ u
            zr = _sigmoid(a[:, :2 * H] + b[:, :2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(a[:, 2 * H:] + r * b[:, 2 * H:])
            m = mask[:, t, None]
            new = h + m * (1 - z) * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, c, b[:, 2 * H:], m))
            h = out[t] = new
        return out

    def forward(self, vectors: np.ndarray, idx: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows of word numbers (-1: padding)."""
        p = self.p
        mask = (idx >= 0).astype(np.float32)
        kf, kb = (None, None) if keep is None else (keep.setdefault("f", []), keep.setdefault("b", []))
        hf = self._gru((vectors @ p["xf"] + p["bf"], idx), mask, "f", kf)
        hb = self._gru((vectors @ p["xb"] + p["bb"], idx), mask, "b", kb)
        h = np.concatenate((hf, hb), axis=2)
        q = np.tanh(h @ p["wa"] + p["ba"])
        e = q @ p["va"] + (mask.T - 1) * np.float32(1e9)
        e -= e.max(axis=0)
        a = np.exp(e)
        a /= a.sum(axis=0)
        c = np.einsum("tn,tnk->nk", a, h)
        if keep is not None:
            keep.update(h=h, q=q, a=a, c=c, mask=mask)
        return c @ p["wo"] + p["bo"][0]

    def quick(self, vectors: np.ndarray, idx: np.ndarray) -> np.ndarray:
        """As ``forward``, without what training needs: windows run along the last axis, steps work in place."""
        p, one, n = self.p, np.float32(1), len(idx)
        at, mask = np.ascontiguousarray(idx.T), np.ascontiguousarray((idx >= 0).T.astype(np.float32))
        steps = len(at)
        h = np.empty((steps, 2 * H, n), np.float32)
        with np.errstate(over="ignore"):
            for side, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
                proj, u = vectors @ p["x" + side] + p["b" + side], np.ascontiguousarray(p["h" + side].T)
                state = np.zeros((H, n), np.float32)
                for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                    a, b = np.ascontiguousarray(proj[at[t]].T), u @ state
                    zr, c = a[:2 * H], a[2 * H:]
                    zr += b[:2 * H]
                    np.negative(zr, out=zr)
                    np.exp(zr, out=zr)
                    zr += one
                    np.reciprocal(zr, out=zr)
                    c += b[2 * H:] * zr[H:]
                    _tanh(c)
                    z = np.subtract(one, zr[:H], out=zr[:H])
                    z *= mask[t]
                    c -= state
                    c *= z
                    state = h[t, part] = state + c
            q = np.matmul(np.ascontiguousarray(p["wa"].T), h)
            q += p["ba"][:, None]
            _tanh(q)
            e = np.tensordot(p["va"], q, (0, 1)) + (mask - 1) * np.float32(1e9)
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        return (e * np.tensordot(p["wo"], h, (0, 1))).sum(axis=0) + p["bo"][0]

    def backward(self, vectors: np.ndarray, idx: np.ndarray, keep: dict, dy: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of the word vectors."""
        p, h, q, a, c = self.p, keep["h"], keep["q"], keep["a"], keep["c"]
        g = {"wo": c.T @ dy, "bo": np.array([dy.sum()], np.float32)}
        dc = dy[:, None] * p["wo"]
        da = np.einsum("nk,tnk->tn", dc, h)
        de = a * (da - (a * da).sum(axis=0))
        dq = de[:, :, None] * p["va"] * (1 - q * q)
        g["va"] = np.einsum("tn,tnk->k", de, q)
        g["wa"] = np.einsum("tni,tnj->ij", h, dq)
        g["ba"] = dq.sum(axis=(0, 1))
        dh = a[:, :, None] * dc + dq @ p["wa"].T
        dvec = np.zeros_like(vectors)
        for side, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            u = p["h" + side]
            gu, dproj, back = np.zeros_like(u), np.zeros((len(vectors), 3 * H), np.float32), np.zeros((len(dy), H), np.float32)
            for t, prev, z, r, cand, bn, m in reversed(keep[side]):
                d = dh[t][:, part] + back
                dz = d * m * (prev - cand) * z * (1 - z)
                dcand = d * m * (1 - z) * (1 - cand * cand)
                dr = dcand * bn * r * (1 - r)
                db = np.concatenate((dz, dr, dcand * r), axis=1)
                gu += prev.T @ db
                back = d * (1 - m * (1 - z)) + db @ u.T
                np.add.at(dproj, idx[:, t], np.concatenate((dz, dr, dcand), axis=1))
            dproj[-1] = 0  # padding
            g["h" + side], g["x" + side], g["b" + side] = gu, vectors.T @ dproj, dproj.sum(axis=0)
            dvec += dproj @ p["x" + side].T
        return g, dvec

    def logits(self, words: Words, idx: np.ndarray, chunk: int = 4096) -> np.ndarray:
        vectors = self.inputs(words)[0]
        return np.concatenate([self.quick(vectors, idx[i:i + chunk]) for i in range(0, len(idx), chunk)] or
                              [np.empty(0, np.float32)])

    def scores(self, texts: list[str], window: int) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.line is None:
            return out
        words = Words(texts)
        text, idx = words.windows(window)
        if len(idx):
            first = np.flatnonzero(np.diff(text, prepend=-1))
            top = np.maximum.reduceat(self.logits(words, idx), first).astype(np.float64)
            out[text[first]] = 1 / (1 + np.exp(-np.clip(self.line[0] * top + self.line[1], -50, 50)))
        return out


def train(texts: list[str], y: np.ndarray, prior: float, window: int = 32, rounds: int = 8, seed: int = 5) -> Network:
    """A network from labelled texts; prior: the share of positive labels among all labelled texts."""
    words = Words(texts)
    text, idx = words.windows(window)
    seen, times = np.unique(words.number, return_counts=True)
    net = Network(np.sort(words.hash[seen[times >= 3]]), seed)
    net.prior = prior
    if not len(idx) or len(np.unique(y[np.unique(text)])) < 2:
        net.line = None
        return net
    rng = np.random.default_rng(seed)
    label = y[text].astype(np.float32)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    square = [np.full(len(net.word), 1e-8, np.float32), np.full(GRAMS, 1e-8, np.float32)]
    step = 0
    first = np.flatnonzero(np.diff(text, prepend=-1))
    pick_all = lambda score: np.lexsort((-score, text))[first]  # noqa: E731  the best window of each text
    for turn in range(rounds):
        score = net.logits(words, idx) if turn else rng.random(len(idx))
        best = pick_all(score)
        other = rng.choice(len(idx), min(len(idx), len(best)), replace=False)
        other = other[label[other] == 0]
        pick = np.concatenate((best, other)) if turn else np.concatenate((best, pick_all(rng.random(len(idx))), other))
        rng.shuffle(pick)
        share = label[pick].mean()
        for at in range(0, len(pick), 64):
            mine = pick[at:at + 64]
            used, local = np.unique(idx[mine], return_inverse=True)
            pad = int(used[0] < 0)
            local = local.reshape(len(mine), window) - pad
            used = used[pad:]
            sub = _subset(words, used)
            vectors, row, scale = net.inputs(sub)
            keep: dict = {}
            prob = _sigmoid(net.forward(vectors, local, keep))
            t = label[mine]
            dy = (prob - t) * np.where(t > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / np.float32(len(mine))
            g, dvec = net.backward(vectors, local, keep, dy.astype(np.float32))
            step += 1
            for k, v in net.p.items():
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * g[k]
                m[1] = 0.999 * m[1] + 0.001 * g[k] ** 2
                v -= (0.01 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            _rows(net.word, square[0], row, dvec[:-1, :WORD])
            net.word[-1] = 0
            _rows(net.char, square[1], sub.gram, (dvec[:-1, WORD:] * scale[:, None])[sub.owner])
    top = np.maximum.reduceat(net.logits(words, idx), first).astype(np.float64)
    net.line = _line(top, y[text[first]], prior)
    return net


def _subset(words: Words, used: np.ndarray) -> Words:
    """The given distinct words only, numbered in that order."""
    out = Words.__new__(Words)
    out.hash = words.hash[used]
    a = np.searchsorted(words.owner, used)
    n = np.searchsorted(words.owner, used, side="right") - a
    at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out.gram, out.owner = words.gram[at], np.repeat(np.arange(len(used)), n)
    return out


def _rows(table: np.ndarray, square: np.ndarray, row: np.ndarray, grad: np.ndarray, rate: float = 0.05) -> None:
    """Adagrad on some rows of a table of vectors."""
    used, inv = np.unique(row, return_inverse=True)
    g = np.zeros((len(used), table.shape[1]), np.float32)
    np.add.at(g, inv, grad)
    square[used] += (g * g).mean(axis=1)
    table[used] -= rate * g / np.sqrt(square[used])[:, None]


def _line(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic regression of labels on logits, weighted to the prior, with softened labels."""
    pos, neg = max(1, (y > 0).sum()), max(1, (y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.where(y > 0, prior / pos, (1 - prior) / neg)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        e, v = w * (p - t), w * p * (1 - p) + 1e-12
        g = np.array([(e * x).sum(), e.sum()])
        m = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 1e-9 * np.eye(2)
        s = np.linalg.solve(m, g)
        s *= min(1.0, 2 / np.abs(s).max()) if np.abs(s).max() > 0 else 1
        a, b = a - s[0], b - s[1]
        if np.abs(s).max() < 1e-8:
            break
    return (float(max(a, 1e-3)), float(b))


def admitted(key: str = "doc_id") -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(F.col(key).cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "toxic",
        train_rows: Column | None = None, sample: int = 800, window: int = 32) -> Network:
    """A network trained on at most ``sample`` texts of each class (where ``train_rows`` holds)."""
    known = labels.where((admitted(key) if train_rows is None else train_rows) & F.col(key).isNotNull() & F.col(target).isNotNull())
    known = known.select(F.col(key).alias("_k"), (F.col(target) > 0).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * sample keys: safe to broadcast
    got = docs.join(F.broadcast(chosen), docs[key] == F.col("_k")).select("_k", "_y", F.coalesce(docs[text], F.lit("")).alias("_t"))

    def make(rows: list[tuple]) -> Network:
        rows = sorted(rows)
        return train([r[2] for r in rows], np.array([r[1] for r in rows], np.float32), prior, window)

    return made_in_task(got, make) or make([])


def score(docs: DataFrame, net: Network, text: str = "text", column: str = "score", window: int = 32) -> DataFrame:
    """``docs`` with the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few MB: tables of fixed size, vocabulary of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i, j in portions(byte_lengths(batch.column(at))):
                rows = batch.slice(i, j - i)
                s = net.scores([v or "" for v in rows.column(at).to_pylist()], window)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s, pa.float64())], [*rows.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every row."""
    net = fit(docs, labels, key, text)
    return score(docs.select(key, text), net, text).select(
        key, F.coalesce(~admitted(key), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
