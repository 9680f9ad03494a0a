"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a piece of bytes, ``last[i]`` is the one token that ends the correct encoding of the first ``i`` bytes.
It is unique: a token ``t`` ending at ``i`` is right exactly if the encoding of the prefix before it ends in a
token ``u`` such that no merge across the border of ``u`` and ``t`` would have come before the merges that
made them. The table makes appends exact (only new positions are filled in) and lets an edit keep everything
before it, so ``Prefixes`` supports ``append`` and ``edit`` without starting again. The new pieces of some
texts are encoded in sorted order by one table, which is edited from each piece to the next.

Inputs: null and empty texts have no tokens. Pieces are the matches of the split pattern; each is encoded
separately, without special tokens. Bytes that cannot be decoded are never produced, as all 256 single bytes
are tokens. Rows are independent: repeated rows give repeated results; extra columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import byte_lengths, portions

CACHE = 900_000  # distinct chunks, and pieces and id runs of them, before a worker starts that cache again
LONG = 200  # characters of a chunk that is not remembered
SHORT = (2, 1)  # lengths of tokens where none of three bytes or more can end
PORTION = 4 << 20  # bytes of the texts whose new chunks are encoded together
PAIRS = 3_000_000  # token pairs whose test a worker remembers


class Vocabulary:
    """Tokens by rank, and for each token the two tokens whose merge makes it (bytes: themselves)."""

    def __init__(self, tokens: list[bytes], left: np.ndarray | None = None, right: np.ndarray | None = None):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        if left is None:
            left, right = self._splits()
        self.left, self.right = left.tolist(), right.tolist()
        self.size = len(tokens)
        self.fits: dict[int, bool] = {}

    @cached_property
    def merged(self) -> dict[tuple[int, int], int]:
        return {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if len(self.tokens[i]) > 1}

    @cached_property
    def ends(self) -> tuple[dict[bytes, tuple[int, ...]], dict[bytes, tuple[int, ...]]]:
        """By the last three bytes, and by the last five where longer ones end so, the lengths of the tokens that end so
        (levels of a trie of reversed tokens). Made where texts are encoded, not on the driver."""
        found: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) > 2:
                found.setdefault(t[-3:], {1, 2}).add(len(t))
        long: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) > 4:
                long.setdefault(t[-5:], {n for n in found[t[-3:]] if n < 3 or n < 5 and t[-n:] in self.rank}).add(len(t))
        return ({k: tuple(n for n in (4, 3, 2, 1) if n in v) for k, v in found.items()},
                {k: tuple(sorted(v, reverse=True)) for k, v in long.items()})

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of lines 'base64 rank'."""
        pairs = [line.split() for line in open(path, "rb") if line.strip()]
        tokens = [b""] * (1 + max(int(r) for _, r in pairs))
        for t, r in pairs:
            tokens[int(r)] = base64.b64decode(t)
        return cls(tokens)

    def _splits(self) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.arange(len(self.tokens)), np.arange(len(self.tokens))
        for i, t in enumerate(self.tokens):
            if len(t) > 1:
                parts = [t[k:k + 1] for k in range(len(t))]
                while len(parts) > 2:
                    best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], i))
                    parts[best:best + 2] = [parts[best] + parts[best + 1]]
                left[i], right[i] = self.rank[parts[0]], self.rank[parts[1]]
        return left.astype(np.int32), right.astype(np.int32)

    def adjacent(self, u: int, t: int) -> bool:
        """Whether tokens u and t stay side by side when their bytes are encoded together.

        Walks back in time from both tokens. While the neighbours at the border are a and b, a merge of the
        two would have won if its rank is below that of the next merge inside u (ties: the left one is first).
        """
        known = self.fits.get(u * self.size + t)
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            known = self.fits[u * self.size + t] = self._adjacent(u, t)
        return known

    def _adjacent(self, a: int, b: int) -> bool:
        before = len(self.tokens)  # merges of a rank below this could still cross the border
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < before:
                return False
            part_a, part_b = self.right[a], self.left[b]
            if a > b and part_a != a or part_b == b and part_a != a:
                before, a = a, part_a
            elif part_b != b:
                before, b = b + 1, part_b
            else:
                return True


class Prefixes:
    """The prefix table of one piece; the encoding of every prefix can be read from it."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        v, last, size = self.vocab, self.last, self.vocab.size
        rank, fits, lengths, long = v.rank.get, v.fits.get, v.ends[0].get, v.ends[1].get
        start, self.data = len(self.data), self.data + more
        data = self.data
        put, adjacent = last.append, v.adjacent
        for end in range(start + 1, len(data) + 1):
            for n in (end > 4 and long(data[end - 5:end])) or (lengths(data[end - 3:end], SHORT) if end > 2 else SHORT):
                if n <= end:
                    t = rank(data[end - n:end])
                    if t is not None:
                        if n == end:
                            put(t)
                            break
                        u = last[end - n]
                        ok = fits(u * size + t)
                        if adjacent(u, t) if ok is None else ok:
                            put(t)
                            break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return self

    def edit(self, start: int, end: int, new: bytes) -> Prefixes:
        """Replace data[start:end]; the table up to start stays as it is."""
        tail = self.data[end:]
        self.data = self.data[:start]
        del self.last[start + 1:]
        return self.append(new + tail)

    def ids(self, end: int | None = None) -> list[int]:
        out, at = [], len(self.data) if end is None else end
        while at:
            t = self.last[at]
            out.append(t)
            at -= len(self.vocab.tokens[t])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece; remembers pieces, and whole chunks between single white-space characters.

    A space followed by no white space starts a piece, and a lone line feed is a piece of its own, so a text
    without runs of white space can be cut there before the split pattern is applied to each distinct chunk.
    """

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.split = vocab, regex.compile(pattern)
        self.other = re.compile("[\x00\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.pieces: dict[str, str] = {}
        self.chunks: dict[str, str] = {}
        self.bytes_of = {str(i): t for i, t in enumerate(vocab.tokens)}
        self.decoded: dict[str, bytes] = {}

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.vocab.rank.get(data)
        if whole is not None:
            return [whole]
        return Prefixes(self.vocab, data).ids()

    def _cut(self, text: str) -> list[str]:
        """The chunks of a text, encoded one by one."""
        if not text:
            return []
        if any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or self.other.search(text):
            return [text]
        return list(filter(None, text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")))

    def _learn(self, pieces: set[str]) -> dict[str, str]:
        """The ids of some pieces. In sorted order, each piece keeps the table of what it shares with the one before."""
        rank, table, out = self.vocab.rank.get, Prefixes(self.vocab), {}
        for piece in sorted(pieces):
            data = piece.encode()
            whole = rank(data)
            if whole is not None:
                out[piece] = str(whole)
                continue
            have, same = table.data, 0
            for x, y in zip(have, data):
                if x != y:
                    break
                same += 1
            out[piece] = " ".join(map(str, table.edit(same, len(have), data[same:]).ids()))
        return out

    def _chunks(self, chunks: set[str]) -> dict[str, str]:
        """The ids of some chunks, by way of their pieces."""
        lone, many = set(), {}
        for c in chunks:
            f = self.split.findall(c)
            if len(f) == 1:  # remembered as a chunk
                lone.add(c)
            else:
                many[c] = f
        known = self.pieces
        if len(known) > CACHE:
            known.clear()
        parts = set().union(*many.values())
        new = self._learn(lone.union(parts).difference(known))
        out = {c: new[c] if c in new else known[c] for c in lone}
        out.update((c, " ".join([new[p] if p in new else known[p] for p in f])) for c, f in many.items())
        known.update((p, new[p]) for p in parts if p in new and len(p) <= LONG)
        return out

    def encode_many(self, texts: list[str]) -> list[list[str]]:
        """``encode_parts`` of each text; chunks not seen before are encoded together."""
        cuts = [self._cut(t) for t in texts]
        known = self.chunks
        if len(known) > CACHE:
            known.clear()
        new = self._chunks(set().union(*cuts).difference(known))
        long = {c: new.pop(c) for c in [c for c in new if len(c) > LONG]}
        known.update(new)
        return [[long[p] if p in long else known[p] for p in parts] if long else list(map(known.__getitem__, parts))
                for parts in cuts]

    def encode_parts(self, text: str) -> list[str]:
        """Ids in decimal, joined by one space, of successive parts of the text."""
        return self.encode_many([text])[0]

    def encode_joined(self, text: str) -> str:
        return " ".join(self.encode_parts(text))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined(text).split()]

    def decode_joined(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))

    def decode_parts(self, parts: list[str]) -> bytes:
        """The bytes of the ids of all parts; runs of ids seen before are remembered."""
        known = self.decoded
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if max(map(len, parts)) > 8 * LONG:
                return b"".join(map(self.decode_joined, parts))
            if len(known) > CACHE:
                known.clear()
            for p in parts:
                if p not in known:
                    known[p] = self.decode_joined(p)
            return b"".join(map(known.__getitem__, parts))


_encoders: dict[str, Encoder] = {}


def encode_column(docs: DataFrame, vocab_path: str, pattern: str, text: str = "text", key: str = "doc_id",
                  digest: bool = True) -> DataFrame:
    """Per row: key, n_tokens, and either digests (ids_sha256, decoded_sha256) or the ids themselves.

    The vocabulary file is read on the driver and broadcast: its size is fixed and unrelated to the corpus.
    """
    vocab = Vocabulary.load(vocab_path)
    shared = docs.sparkSession.sparkContext.broadcast(
        (vocab.tokens, np.array(vocab.left, np.int32), np.array(vocab.right, np.int32)))
    tag = f"{vocab_path}|{pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(tag)
        if enc is None:
            enc = _encoders[tag] = Encoder(Vocabulary(*shared.value), pattern)
        for batch in batches:
            for i, j in portions(byte_lengths(batch.column(1)), size=PORTION):
                rows = batch.slice(i, j - i)
                counts, first, second = [], [], []
                for found in enc.encode_many([v or "" for v in rows.column(1).to_pylist()]):
                    ids = " ".join(found)
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    if digest:
                        first.append(hashlib.sha256(ids.encode()).hexdigest())
                        second.append(hashlib.sha256(enc.decode_parts(found)).hexdigest())
                    else:
                        first.append([int(x) for x in ids.split()])
                cols = [rows.column(0), pa.array(counts, pa.int64())]
                if digest:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(first), pa.array(second)],
                                                     ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(first, pa.list_(pa.int32()))],
                                                     ["key", "n_tokens", "ids"])

    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType())]
    fields += ([T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
               if digest else [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def named(batches):
        for b in run(batches):
            yield b.rename_columns([key, *b.schema.names[1:]])

    return docs.select(key, text).mapInArrow(named, T.StructType(fields))
