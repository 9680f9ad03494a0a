"""Alignment of two tokenizers over the same bytes by sparse incidence products.

Tokenizer A (byte-level BPE) reads space + text, tokenizer B (sentence pieces) reads the text and adds the space itself, so
both cover the same bytes. A token-byte incidence matrix has a row a token and a column a byte, in CSR built by hand. The
row products of A and the transpose of B (Gustavson: each row of A gathers the rows of B' its columns name and adds them
up) give the overlap links and how many bytes each shares. Offsets where tokens of both end cut the bytes into groups; the
token-group incidence matrices give the shared-group links the same way. Of those, a document's row only counts the
links (the product with the group sums of B, so that a long group costs its tokens, not their pairs); ``shared_group_links``
gives the links themselves.

The bytes are cut where both tokenizers must cut: before a single space and around a single line feed between characters
that are no white space. (A's split pattern starts a piece there; no piece of B's vocabulary crosses such a place, which is
checked on the vocabulary, or else texts stay whole.) The matrices of a part are worked out once a task, whatever the
number of its occurrences.

Counts of id pairs are over all rows of the table. Tasks hand on chunks of about ``chunk`` bytes of text: a
row a document with its distinct parts, and one row with the chunk's distinct pairs, which are added up and joined on
Spark. A common pair costs a row a chunk, not one a link or document. A chunk then meets its own answers only.

Null and empty texts, and texts whose joined token bytes of A or B differ from space + text (U+2581 in a text), have
no tokens: zeros and an empty digest. Very long texts are a chunk of their own. Rows are independent: repeated rows, repeated
and null keys come out as often as they came in, and each counts. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_lengths, portions, save

LONG = 200  # characters of a part that is not remembered
KNOWN = 250_000  # parts whose alignment a worker remembers
CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
SPACES = re.compile(r"  |\n\n| \n|\n |[ \n]$|[^\S \n]|\x00")
OTHER = re.compile(r"\s|\x00")


class Csr(NamedTuple):
    """Rows of (column, value), row i at indptr[i]:indptr[i + 1]."""
    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), start[1], ..."""
    at = _starts(length)
    return np.arange(at[-1]) - np.repeat(at[:-1] - start, length)


def incidence(start: np.ndarray, end: np.ndarray, columns: int) -> Csr:
    """Row i holds ones in the columns start[i] to end[i] - 1."""
    length = end - start
    index = _ranges(start, length)
    return Csr(_starts(length), index, np.ones(len(index), np.int64), columns)


def transpose(m: Csr) -> Csr:
    """By counting the entries of each column."""
    row = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    order = np.argsort(m.indices, kind="stable")
    return Csr(_starts(np.bincount(m.indices, minlength=m.columns)), row[order], m.data[order], len(m.indptr) - 1)


def gustavson(a: Csr, b: Csr) -> Csr:
    """a x b: for each entry (i, k) of a the row k of b, added up within row i."""
    length = np.diff(b.indptr)[a.indices]
    take = _ranges(b.indptr[a.indices], length)
    row = np.repeat(np.repeat(np.arange(len(a.indptr) - 1), np.diff(a.indptr)), length)
    key, value = row * b.columns + b.indices[take], np.repeat(a.data, length) * b.data[take]
    if np.any(key[1:] < key[:-1]):
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    key = key[first]
    data = np.add.reduceat(value, first) if len(first) else value
    return Csr(_starts(np.bincount(key // b.columns, minlength=len(a.indptr) - 1)), key % b.columns, data, b.columns)


def row_sums(m: Csr, vector: np.ndarray) -> np.ndarray:
    """m x vector."""
    total = _starts(m.data * vector[m.indices])
    return total[m.indptr[1:]] - total[m.indptr[:-1]]


class Alignment(NamedTuple):
    """Of the tokens of A and B that cover the same bytes; the entries of ``links`` are the bytes shared."""
    links: Csr
    group_a: Csr
    group_b: Csr


def align(len_a: np.ndarray, len_b: np.ndarray) -> Alignment:
    """From the byte lengths of the tokens of A and of B, which have equal sums."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    n = int(end_a[-1]) if len(end_a) else 0
    at = np.searchsorted(end_b, end_a)  # tokens have bytes, so the ends rise
    cuts = end_a[end_b[np.minimum(at, len(end_b) - 1)] == end_a] if n else end_a
    a, b = incidence(end_a - len_a, end_a, n), incidence(end_b - len_b, end_b, n)
    ga, gb = np.searchsorted(cuts, end_a - len_a, side="right"), np.searchsorted(cuts, end_b - len_b, side="right")
    return Alignment(gustavson(a, transpose(b)), incidence(ga, ga + 1, len(cuts)), incidence(gb, gb + 1, len(cuts)))


def shared_group_links(x: Alignment) -> Csr:
    """Links of all tokens of A and B of a group; as many as the products of the group's sizes."""
    return gustavson(x.group_a, transpose(x.group_b))


def byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Part(NamedTuple):
    """What a part of the bytes adds to a document; groups is '' if a tokenizer's bytes differ."""
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    n_group_links: int
    groups: str
    pairs: bytes  # int64: id of A times 2**32 plus id of B, for every link


class Aligner:
    """``pattern``: A's split pattern. With it, and if A's ids follow the order of its merges, A is run from its byte ranks."""

    def __init__(self, file: str, model: bytes, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        symbol = byte_of_symbol()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = np.array([*map(len, self.bytes_a)]), np.array([*map(len, self.bytes_b)])
        # B cuts before a space and around a line feed if no piece goes across
        inside = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i)]
        self.cuts = not any("\n" in p or re.search("[^▁]▁", p) for p in inside)
        self.feed = self.b.encode("\n")
        self.cuts = self.cuts and [self.bytes_b[i] for i in self.feed] == [b" ", b"\n"]
        self.ranks = self._ranks(json.loads(file), vocab, pattern) if pattern else None
        if self.ranks is not None:
            self.a = None  # not needed any more; it is the largest object here
        self.known: dict[str, Part] = {}

    def _ranks(self, file: dict, vocab: dict[str, int], pattern: str):
        """A as byte ranks, if merging by rank is merging by its list."""
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in file["model"].get("merges", [])]
        first = len(file["model"]["vocab"]) - len(merges) - sum(x["content"] in file["model"]["vocab"] for x in file["added_tokens"])
        if [vocab.get(m) for m in merges] != list(range(first, first + len(merges))) or first != 256:
            return None
        import tiktoken
        special = {x["id"] for x in file["added_tokens"]}
        return tiktoken.Encoding("ranks", pat_str=pattern, special_tokens={},
                                 mergeable_ranks={b: i for i, b in enumerate(self.bytes_a) if i not in special})

    def parts(self, text: str) -> list[str]:
        """Parts of space + text that both tokenizers read alone as they read them in the text."""
        whole = " " + text
        if not self.cuts:
            return [whole]
        if SPACES.search(whole):
            return CUT.split(whole)
        out = whole.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        return [x for x in out if x] if "\n" in whole else out[1:]

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A of all parts, where each part starts in them, and the same of B."""
        # B puts a space before what it reads; a part without one is read behind a line feed, which stays apart
        b = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in parts], num_threads=1)
        b = [x if p[0] == " " else x[len(self.feed):] for p, x in zip(parts, b)]
        a, at_a = self._encode_a(parts)
        at_b = _starts([len(x) for x in b])
        return a, at_a, np.fromiter(chain.from_iterable(b), np.int64, at_b[-1]), at_b

    def _encode_a(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.ranks is None:
            ids = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
            at = _starts([len(x) for x in ids])
            return np.fromiter(chain.from_iterable(ids), np.int64, at[-1]), at
        # a part of a space and a word can be read behind any other such part, so all of them make one text
        words = [len(p) > 1 and p[0] == " " and not OTHER.search(p, 1) for p in parts]
        joined = np.array(self.ranks.encode_ordinary("".join(p for p, w in zip(parts, words) if w)), np.int64)
        edge = np.searchsorted(_starts(self.size_a[joined]), _starts([len(p.encode()) for p, w in zip(parts, words) if w]))
        counts, w = np.zeros(len(parts), np.int64), np.array(words, bool)
        counts[w] = np.diff(edge)
        rest = {i: self.ranks.encode_ordinary(parts[i]) for i in np.flatnonzero(~w).tolist()}
        for i, x in rest.items():
            counts[i] = len(x)
        at = _starts(counts)
        out = np.empty(at[-1], np.int64)
        out[np.repeat(w, counts)] = joined
        for i, x in rest.items():
            out[at[i]:at[i + 1]] = x
        return out, at

    def lookup(self, parts: list[str]) -> list[Part]:
        """For distinct parts."""
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        new = [p for p in parts if p not in known]
        fresh: dict[str, Part] = {}
        for lo, hi in portions(np.array([len(p) for p in new]), rows=20_000, size=1 << 20):
            fresh.update(zip(new[lo:hi], self._work_out(new[lo:hi])))
        known.update((p, x) for p, x in fresh.items() if len(p) <= LONG)
        return [fresh[p] if p in fresh else known[p] for p in parts]

    def _work_out(self, parts: list[str]) -> list[Part]:
        """All parts side by side as one block-diagonal product."""
        a, at_a, b, at_b = self.encode(parts)
        raw = "".join(parts).encode()
        if not b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, b.tolist())):
            return self._apart(parts, a, at_a, b, at_b)
        got = align(self.size_a[a], self.size_b[b])
        ga, gb = got.group_a.indices, got.group_b.indices
        shared = row_sums(got.group_a, np.bincount(gb, minlength=got.group_b.columns))
        row = np.repeat(np.arange(len(a)), np.diff(got.links.indptr))
        pairs = ((a[row] << 32) + b[got.links.indices]).tobytes()
        link = got.links.indptr[at_a]
        words = self._groups(a, b, ga, gb)
        groups = np.diff(np.append(ga, got.group_a.columns)[at_a])
        place, link8 = (at_a + at_b).tolist(), (8 * link).tolist()
        return [Part(*x, "".join(words[i:j])[:-1], pairs[k:m]) for *x, i, j, k, m in zip(
            np.diff(at_a).tolist(), np.diff(at_b).tolist(), groups.tolist(), np.diff(link).tolist(),
            np.diff(_starts(shared)[at_a]).tolist(), place, place[1:], link8, link8[1:])]

    def _apart(self, parts: list[str], a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> list[Part]:
        """Some part's bytes differ from its tokens': that part has no tokens, the others go on without it."""
        good = [b"".join(map(self.bytes_a.__getitem__, a[i:j].tolist())) == p.encode() == b"".join(map(self.bytes_b.__getitem__, b[k:m].tolist()))
                for p, i, j, k, m in zip(parts, at_a, at_a[1:], at_b, at_b[1:])]
        rest = iter(self._work_out([p for p, g in zip(parts, good) if g]) if any(good) else [])
        return [next(rest) if g else Part(0, 0, 0, 0, 0, "", b"") for g in good]

    @staticmethod
    def _groups(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> list[str]:
        """Ids of all tokens with the mark behind each: ',' within A or B of a group, '|' between, ';' behind."""
        place_a = np.arange(len(a)) + np.searchsorted(gb, ga)
        place_b = np.arange(len(b)) + np.searchsorted(ga, gb, side="right")
        last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
        out = np.empty(len(a) + len(b), object)
        if len(a):
            out[place_a] = [f"{i}{x}" for i, x in zip(a.tolist(), np.where(last_a, "|", ",").tolist())]
            out[place_b] = [f"{i}{x}" for i, x in zip(b.tolist(), np.where(last_b, ";", ",").tolist())]
        return out.tolist()


_aligners: dict[str, Aligner] = {}

_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]


def _chunk(aligner: Aligner, texts: list[str | None]) -> tuple[dict, dict]:
    """A chunk's documents (sums, digest, distinct parts and how often) and its pairs (of each part, in all)."""
    each = [aligner.parts(t) if t else [] for t in texts]
    code = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(each)))}
    found = aligner.lookup(list(code))
    groups = {p: x.groups for p, x in zip(code, found)}
    # a document of which one part cannot be read has no tokens
    bad = {p for p, x in zip(code, found) if not x.groups}
    each = [[] if bad and not bad.isdisjoint(p) else p for p in each]
    digest = [hashlib.sha256(";".join(map(groups.__getitem__, p)).encode()).hexdigest() if p else "" for p in each]
    at = _starts([len(p) for p in each])
    codes = np.fromiter(map(code.__getitem__, chain.from_iterable(each)), np.int64, at[-1])
    docs: dict = {"groups_sha256": digest}
    for i, c in enumerate(_COLUMNS):
        total = _starts(np.array([x[i] for x in found], np.int64)[codes])
        docs[c] = total[at[1:]] - total[at[:-1]]
    row = np.repeat(np.arange(len(each)), np.diff(at))
    key, times = np.unique(row * max(1, len(code)) + codes, return_counts=True)
    cut = np.searchsorted(key, np.arange(len(each) + 1) * max(1, len(code)))
    own, times = (key % max(1, len(code))).astype(np.int32), times.astype(np.int32)
    docs["parts"] = [own[i:j].tobytes() for i, j in zip(cut, cut[1:])]
    docs["times"] = [times[i:j].tobytes() for i, j in zip(cut, cut[1:])]
    links = np.array([len(x.pairs) // 8 for x in found], np.int32)
    pairs, which = np.unique(np.frombuffer(b"".join(x.pairs for x in found), np.int64), return_inverse=True)
    seen = np.repeat(np.bincount(codes, minlength=len(code)), links)
    totals = np.zeros(len(pairs), np.int64)
    np.add.at(totals, which, seen)
    return docs, {"links": links.tobytes(), "which": which.astype(np.int32).tobytes(), "pairs": pairs, "totals": totals}


def link(table: DataFrame, json_path: str, model_path: str, pattern: str | None = None, key: str = "doc_id", text: str = "text",
         chunk: int = 4 << 20) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links: one row per row.

    The two vocabulary files are read on the driver and broadcast; their size is fixed and unrelated to the corpus.
    """
    with open(json_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        shared = table.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    tag = f"{json_path}|{model_path}|{pattern}"
    kind = table.schema[key].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("key", kind), T.StructField("is_doc", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in _COLUMNS], T.StructField("groups_sha256", T.StringType()),
        *[T.StructField(c, T.BinaryType()) for c in ("parts", "times", "links", "which")],
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "totals")]])
    names = schema.names

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _aligners:
            _aligners[tag] = Aligner(*shared.value, pattern)
        aligner, no = _aligners[tag], TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in portions(byte_lengths(batch.column(1)), rows=10_000, size=chunk):
                rows = batch.slice(lo, hi - lo)
                docs, pairs = _chunk(aligner, rows.column(1).to_pylist())
                n = rows.num_rows
                have = {"chunk": np.full(n, no), "key": rows.column(0), "is_doc": np.ones(n, bool), **docs}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(have[f.name], f.type) if f.name in have and f.name != "key" else
                     rows.column(0) if f.name == "key" else pa.nulls(n, f.type) for f in arrow], names=names)
                have = {"chunk": [no], "is_doc": [False], **{k: [v] for k, v in pairs.items()}}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(have[f.name], f.type) if f.name in have else pa.nulls(1, f.type) for f in arrow], names=names)
                no += 1
        pa.default_memory_pool().release_unused()

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    saved = save(table.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(chunks, schema), "align-chunks")
    asked = saved.where(~F.col("is_doc")).select(
        "chunk", F.posexplode(F.arrays_zip("pairs", "totals")).alias("pos", "p")).select(
        "chunk", "pos", F.col("p.pairs").alias("pair"), F.col("p.totals").alias("n"))
    counts = save(asked.groupBy("pair").agg(F.sum("n").alias("count")), "align-counts")
    id_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # one row an id of B: bounded by its vocabulary
    top = F.broadcast(counts.groupBy(id_b.alias("b")).agg(F.max("count").alias("top")))
    answers = (asked.join(counts, "pair").withColumn("b", id_b).join(top, "b")
               .select("chunk", "pos", "count", (F.col("count") == F.col("top")).alias("best")))

    results = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in _COLUMNS[:4]],
                            T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                            T.StructField("groups_sha256", T.StringType()), T.StructField("n_group_links", T.LongType())])
    out_schema = to_arrow_schema(results)

    def finish(mine: pa.Table, got: pa.Table) -> pa.Table:
        is_doc = mine.column("is_doc").to_numpy()
        docs = mine.filter(pa.array(is_doc))
        pairs = mine.filter(pa.array(~is_doc))
        numbers = lambda t, c: [np.frombuffer(x, np.int32) for x in t.column(c).to_pylist()]
        links, which = numbers(pairs, "links")[0], numbers(pairs, "which")[0]
        count, best = np.zeros(got.num_rows, np.int64), np.zeros(got.num_rows, np.int64)
        pos = got.column("pos").to_numpy()
        count[pos], best[pos] = got.column("count").to_numpy(), got.column("best").to_numpy()
        at = _starts(links)
        each = [_starts(x[which])[at] for x in (best, count)]
        each = [x[1:] - x[:-1] for x in each]  # of every part
        sums: list[list[int]] = [[], []]
        for p, n in zip(numbers(docs, "parts"), numbers(docs, "times")):
            for out, x in zip(sums, each):
                out.append(int(x[p] @ n.astype(np.int64)))
        have = {key: docs.column("key"), "n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64())}
        return pa.table([have[f.name] if f.name in have else docs.column(f.name) for f in out_schema], schema=out_schema)

    answers = answers.toDF(*answers.columns)  # columns of their own beside those of the chunks
    return (saved.drop("pairs", "totals").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, results))
