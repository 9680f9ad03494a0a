"""Mixing documents to target weights by soft membership.

A softmax classifier over hashed byte 4-grams and a few shares of character classes, trained in numpy on labelled
documents, predicts each document's posterior over domains. Nonnegative rates (expected copies) are then fitted so
that the expected tokens of every domain, ``sum(rate * tokens * posterior)``, match the target weights times the
token budget. This is nonnegative least squares over all documents, solved by projected gradient steps from rate 1:
each step aggregates the domain totals and the domains' Gram matrix over all documents on Spark, and moves every
rate by its posterior times the preconditioned residual, cut at 0. Only a vector and a matrix over the domains
reach the driver. A document's copies are the rate rounded up or down at random by a hash of its key.

Training takes at most ``sample`` labelled rows of each domain (a documented bound, the first by a hash of the key), in
one task.
Domains without labelled rows are left out and their weight is shared by the others; with fewer than two, posteriors
are uniform. Null and empty texts have no tokens, uniform posteriors from an empty input, and a rate as any other.
Repeated rows get equal rates. Targets out of reach are approached in the least-squares sense. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, byte_lengths, made_in_task, portions, prefix_hash, save, span_hash
from .perplexity import SYMBOL, _bytes

GRAMS = 1 << 14
#: shares of byte classes: upper case, digits, symbols, other marks, white space, line feeds
CLASSES = np.zeros((6, 256), bool)
CLASSES[0, 65:91] = CLASSES[1, 48:58] = CLASSES[5, 10] = True
CLASSES[2] = SYMBOL
CLASSES[3, list(b"!?.,;:'\"()-")] = True
CLASSES[4] = SPACE


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 4-grams (flat) with the row of each; the class shares; words per row."""
    data, start = _bytes(col, 1)
    data[start[:-1]] = 0x20
    n = np.diff(start)
    at = np.arange(max(0, len(data) - 3))
    row = np.repeat(np.arange(len(n)), n)[:len(at)]
    at = at[at + 4 <= start[1:][row]]
    gram, prefix = np.empty(len(at), np.int32), prefix_hash(data)
    for i in range(0, len(at), 1 << 18):  # hashes of a block at a time: they take several words a byte
        part = at[i:i + (1 << 18)]
        gram[i:i + len(part)] = span_hash(prefix, part, part + 4) & np.uint64(GRAMS - 1)
    shares = np.empty((len(n), 6), np.float32)
    for i, c in enumerate(CLASSES):
        total = np.concatenate(([0], np.cumsum(c[data])))
        shares[:, i] = np.diff(total[start]) / n
    word = ~SPACE[data]
    begins = np.concatenate(([0], np.cumsum(word & np.concatenate(([True], ~word[:-1])))))
    return gram, row[at], shares * 10, np.diff(begins[start])


def sample_features(texts: list[str]) -> tuple[list[tuple], np.ndarray]:
    """``features`` of some texts, made of about 1 MB of them at a time: (from, to, 4-grams, their rows); the shares of all."""
    col = pa.array(texts, pa.string())
    parts, shares = [], []
    for i, j in portions(byte_lengths(col), size=1 << 20):
        gram, row, share, _ = features(col.slice(i, j - i))
        parts.append((i, j, gram, row.astype(np.int32)))
        shares.append(share)
    return parts, np.concatenate(shares)


class Classifier:
    def __init__(self, domains: list[str]):
        k = len(domains)
        self.domains = domains
        self.gram, self.share, self.bias = np.zeros((GRAMS, k), np.float32), np.zeros((6, k), np.float32), np.zeros(k, np.float32)

    def posteriors(self, gram, row, shares) -> np.ndarray:
        return self._posteriors([(0, len(shares), gram, row)], shares)

    def _posteriors(self, parts: list[tuple], shares: np.ndarray) -> np.ndarray:
        out = shares @ self.share + self.bias
        for i, j, gram, row in parts:
            root = np.sqrt(np.maximum(np.bincount(row, minlength=j - i), 1))
            for k in range(out.shape[1]):
                out[i:j, k] += np.bincount(row, self.gram[gram, k], j - i) / root
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)

    def train(self, texts: list[str], y: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Adagrad on the whole sample; classes weigh the same."""
        parts, shares = sample_features(texts)
        k, n = len(self.domains), len(texts)
        weight = (1 / np.maximum(np.bincount(y, minlength=k), 1))[y] / k
        scales = [1 / np.sqrt(np.maximum(np.bincount(row, minlength=j - i), 1)) for i, j, _, row in parts]
        every = np.arange(GRAMS)
        sums = [np.full(x.shape, 1e-8, np.float32) for x in (self.gram, self.share, self.bias)]
        for _ in range(rounds):
            e = self._posteriors(parts, shares)
            e[np.arange(n), y] -= 1
            e *= weight[:, None]
            g = np.zeros((GRAMS, k))
            for (i, j, gram, row), scale in zip(parts, scales):  # the sums so far come first: added in the order of the rows
                ids = np.concatenate((every, gram))
                for c in range(k):
                    g[:, c] = np.bincount(ids, np.concatenate((g[:, c], (e[i:j, c] * scale)[row])), GRAMS)
            for x, s, d in zip((self.gram, self.share, self.bias), sums, (g + decay * self.gram, shares.T @ e, e.sum(axis=0))):
                s += d * d
                x -= (rate * 0.2 * d / np.sqrt(s)).astype(np.float32)


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text",
        sample: int = 600) -> Classifier:
    """``labelled``: (key, domain); null domains and keys are left out."""
    known = labelled.where(F.col("domain").isin(domains) & F.col(key).isNotNull()).select(F.col(key).alias("_k"), "domain")
    counts = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    chosen = None
    for d in domains:
        part = known.where(F.col("domain") == d).orderBy(F.xxhash64("_k"), "_k").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most sample * domains keys: safe to broadcast
    got = docs.join(F.broadcast(chosen), docs[key] == F.col("_k")).select("_k", "domain", docs[text])

    def make(rows: list[tuple]) -> Classifier:
        rows = sorted((k, d, t or "") for k, d, t in rows)
        present = [d for d in domains if any(r[1] == d for r in rows)]
        model = Classifier(present if len(present) > 1 else list(domains))
        if len(present) > 1:
            model.train([r[2] for r in rows], np.array([present.index(r[1]) for r in rows]))
            model.bias += np.log([counts[d] for d in present]).astype(np.float32)  # from even classes to their shares
        return model

    return made_in_task(got, make) or make([])


def rates(members: DataFrame, domains: list[str], targets: dict[str, float], budget: float = 1.0, rounds: int = 25,
          tolerance: float = 1e-4) -> Column:
    """The rate of a row of ``members`` (n_tokens, p_<domain>) as an expression."""
    n = F.col("n_tokens").cast("double")
    p = [F.col(f"p_{d}") for d in domains]
    k = len(domains)
    total = members.agg(F.sum(n)).first()[0] or 0.0
    weight = np.array([targets.get(d, 0.0) for d in domains])
    want = weight / weight.sum() * total * budget if weight.sum() else np.zeros(k)
    rate = F.lit(1.0)
    if not total:
        return rate
    for _ in range(rounds):
        here = members.select(n.alias("n"), *p, rate.alias("r"))
        got = here.agg(*[F.sum(F.col("n") * F.col("r") * x) for x in p],
                       *[F.sum(F.when(F.col("r") > 0, F.col("n") * p[i] * p[j])) for i in range(k) for j in range(k)]).first()
        left = want - np.array([x or 0.0 for x in got[:k]])
        if np.abs(left).max() <= tolerance * total:
            break
        gram = np.array([x or 0.0 for x in got[k:]]).reshape(k, k)
        move = np.linalg.solve(gram + 1e-6 * np.trace(gram) / k * np.eye(k) + 1e-12 * np.eye(k), left)
        rate = F.greatest(F.lit(0.0), rate + sum((F.lit(float(m)) * x for m, x in zip(move, p)), F.lit(0.0)))
    return rate


def _with_posteriors(docs: DataFrame, model, text: str) -> DataFrame:
    """(row: the columns of ``docs``, n_tokens, p_<domain>) of every row, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: GRAMS x domains
    names = ["n_tokens", *[f"p_{d}" for d in model.domains]]
    rows_of = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows_of.schema["row"], T.StructField("n_tokens", T.LongType()),
                           *[T.StructField(x, T.DoubleType()) for x in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in portions(byte_lengths(batch.column(1)), size=1 << 20):
                rows = batch.slice(i, j - i)
                gram, row, shares, words = features(rows.column(1))
                p = shared.value.posteriors(gram, row, shares).astype(np.float64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words.astype(np.int64)),
                                                  *[pa.array(p[:, x]) for x in range(p.shape[1])]], ["row", *names])

    return rows_of.mapInArrow(run, schema)


def _copies(key: str) -> Column:
    """Whole copies for a rate; the rest is drawn by the hash of the key."""
    draw = F.pmod(F.xxhash64(F.lit("mixing"), key), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(F.col("rate") + draw).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text",
        budget: float = 1.0, **options) -> DataFrame:
    """key, n_tokens, p_<domain> for every domain with labels, rate, copies; one row per row."""
    model = fit(docs, labelled, list(targets), key, text, **options)
    scored = _with_posteriors(docs.select(key, text), model, text).select(F.col(f"row.`{key}`").alias(key), "n_tokens",
                                                                         *[f"p_{d}" for d in model.domains])
    members = save(scored, "mixing")
    return members.withColumn("rate", rates(members, model.domains, targets, budget)).withColumn("copies", _copies(key))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text",
             budget: float = 1.0, **options) -> DataFrame:
    """``docs`` with every row as often as its own copies say; rows with a null key stay once.

    Rates are fitted on narrow rows. A rate is an expression of a row's posteriors, so copies are made in one more pass over the
    texts, which are not shuffled.
    """
    model = fit(docs, labelled, list(targets), key, text, **options)
    known = docs.where(F.col(key).isNotNull())
    members = save(_with_posteriors(known.select(key, text), model, text).drop("row"), "mixing")
    scored = _with_posteriors(docs, model, text).withColumn("rate", rates(members, model.domains, targets, budget))
    times = F.when(F.col(f"row.`{key}`").isNull(), 1).otherwise(_copies(f"row.`{key}`"))
    return (scored.select("row", times.alias("times")).where(F.col("times") > 0)
            .select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*"))


def quality_domains(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, domain) from the columns quality and toxic: good, poor or toxic."""
    return labels.select(key, F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
                         .when(F.col("quality") == 0, "poor").alias("domain"))
