"""Removal of repeated passages by suffix sorting.

A byte goes if it lies in a ``length``-byte string that also starts earlier (in a smaller document, or before in the
same one). Strings never cross documents and are judged on the input.

Sorting all suffixes of a corpus would move every byte a hundred times, so only suffixes that can be repeated are:

1. Every string picks an anchor, the smallest hash among its ``gram``-byte substrings (winnowing), so equal strings
   pick equal anchors at equal offsets. Successive starts with one anchor form a run; a run's context is the bytes
   that its strings cover. One narrow row a run is shuffled by the anchor's hash.
2. Runs with an equal anchor and an equal context repeat each other wholly: all but the first are removed. An anchor
   met in one context only needs no more. The first runs of the other contexts go on.
3. Their contexts are brought together by anchor, and the suffixes at all starts are sorted: suffixes whose string
   hash occurs once are ordered apart at once, the rest by multikey quicksort over 8-byte characters to a shallow
   depth, and groups that still share their prefix by blind tries to the full length. In a group of equal strings
   all but the first are marked.

Tasks first collapse what is repeated in their own portion (only the first of equal runs, and one row of an anchor
with several contexts, go to the anchor's partition), so a passage in a third of all documents sends one row a
portion. An anchor with more than ``crowd`` contexts is dealt out by the 128-bit hashes of its single strings
instead, again after a collapse in each portion.

Null and empty texts and texts shorter than ``length`` lose nothing. Rows with equal key and text are one document;
rows with one key and several texts are ordered by a hash of the text. A null key comes after all others. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_lengths, group_starts, grouped, mix64, portions, prefix_hash, save, shuffle_partitions, span_hash
from .perplexity import _bytes

REMOVED, FIRST, OPEN = 1, 2, 0


# Positions are packed in one long: 15 bits of the text's hash, 40 of the start, 1 spare, 7 of the number of starts.
def _pack(tag: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return tag << 48 | start << 8 | n


def runs_of(data: np.ndarray, start: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: (document, first start, starts, anchor hash, context hash, anchor place)."""
    w = length - gram + 1  # grams of a string
    s = prefix_hash(data)
    m = len(data) - gram + 1
    size = np.diff(start)
    strings = np.maximum(size - length + 1, 0)
    if m < w or not strings.any():
        return tuple(np.empty(0, np.int64) for _ in range(6))
    h = span_hash(s, np.arange(m), np.arange(gram, m + gram))
    low = np.uint64(0xFFFFFFFF)
    pick = h & ~low | (low - np.arange(m, dtype=np.uint64))
    span = 1
    while span * 2 <= w:
        pick = np.minimum(pick[:-span], pick[span:])
        span *= 2
    if span < w:
        pick = np.minimum(pick[:len(pick) - (w - span)], pick[w - span:])
    doc = np.repeat(np.arange(len(size)), strings)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(strings) - strings, strings) + start[:-1][doc]
    anchor = (low - (pick[at] & low)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    n = np.diff(np.append(new, len(doc)))
    first = at[new]
    return (doc[new], first - start[:-1][doc[new]], n, h[anchor[new]].view(np.int64),
            span_hash(s, first, first + n - 1 + length).view(np.int64), anchor[new] - start[:-1][doc[new]])


def multikey_quicksort(words: list[np.ndarray], order: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by one 8-byte character after the other within buckets; buckets of one are finished at once.

    Returns what still shares all characters with another: the order and its buckets (equal numbers side by side).
    """
    for w in words:
        if not len(order):
            break
        char = w[order]
        at = np.lexsort((char, bucket))
        order, bucket, char = order[at], bucket[at], char[at]
        new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (char[1:] != char[:-1])))
        bucket = np.cumsum(new)
        alone = new & np.concatenate((new[1:], [True]))
        order, bucket = order[~alone], bucket[~alone]
    return order, bucket


class BlindTrie:
    """Strings data[p:p + length] as a trie that stores only the depth at which branches part."""

    def __init__(self, data: bytes, length: int, depth: int):
        self.data, self.length, self.depth = data, length, depth
        self.root: list | None = None  # leaf: [length, [places]]; branch: [depth, {byte: node}]

    def add(self, p: int) -> None:
        data, full = self.data, self.length
        if self.root is None:
            self.root = [full, [p]]
            return
        node = self.root
        while node[0] < full:  # blindly by the branching bytes, to any leaf
            kids = node[1]
            node = kids.get(data[p + node[0]]) or next(iter(kids.values()))
        q = node[1][0]
        if data[p + self.depth:p + full] == data[q + self.depth:q + full]:
            node[1].append(p)
            return
        lcp = self.depth
        while data[p + lcp] == data[q + lcp]:
            lcp += 1
        parent, node = None, self.root
        while node[0] < lcp:
            parent, node = node, node[1][data[p + node[0]]]
        leaf = [full, [p]]
        if node[0] == lcp:
            node[1][data[p + lcp]] = leaf
            return
        branch = [lcp, {data[q + lcp]: node, data[p + lcp]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][data[p + parent[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Places of equal strings, in lexical order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            depth, body = stack.pop()
            if depth == self.length:
                yield body
            else:
                stack += [body[b] for b in sorted(body, reverse=True)]


def deep_shallow(data: bytes, place: np.ndarray, group: np.ndarray, length: int, shallow: int = 32) -> Iterator[np.ndarray]:
    """Sets of two or more indices into ``place`` with equal strings of ``length`` bytes and equal groups."""
    raw = np.frombuffer(data, np.uint8)
    words, shallow = [], min(shallow, length // 8 * 8)
    for d in range(0, shallow, 8):
        w = np.zeros(len(place), np.uint64)
        for j in range(8):
            w = w << np.uint64(8) | raw[place + d + j].astype(np.uint64)
        words.append(w)
    order, bucket = multikey_quicksort(words, np.arange(len(place)), group)
    if not len(order):
        return
    edge = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(order))
    where = place[order].tolist()
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
        trie, back = BlindTrie(data, length, shallow), {}
        for x in range(i, j):
            back.setdefault(where[x], []).append(x)
            trie.add(where[x])
        for leaf in trie.leaves():
            if len(leaf) > 1:
                yield order[[y for p in dict.fromkeys(leaf) for y in back[p]]]


def repeated(data: bytes, place: np.ndarray, group: np.ndarray, oid: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings are equal to one of their group that comes before by (oid, pos)."""
    out = np.zeros(len(place), bool)
    raw = np.frombuffer(data, np.uint8)
    h = mix64(span_hash(prefix_hash(raw), place, place + length) ^ mix64(group.astype(np.uint64)))
    _, inv, times = np.unique(h, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(times[inv] > 1)
    for same in deep_shallow(data, place[maybe], group[maybe], length):
        mine = maybe[same]
        at = np.lexsort((pos[mine], oid[mine]))
        first = mine[at[0]]
        later = mine[(oid[mine] != oid[first]) | (pos[mine] != pos[first])]
        out[later] = True
    return out


def _identity(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """The order of a document (oid, tag) and its text."""
    return docs.select(*more, F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("oid"),
                       F.shiftrightunsigned(F.xxhash64(text), 49).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def _column(t, name: str) -> np.ndarray:
    i = t.schema.get_field_index(name)
    return t.column(i).to_numpy() if isinstance(t, pa.Table) else t.column(i).to_numpy(zero_copy_only=False)


def removals(docs: DataFrame, key: str, text: str, length: int, gram: int, crowd: int) -> DataFrame:
    """(oid, tag, pos, n): the starts pos .. pos + n - 1 of strings that start earlier too."""
    P = shuffle_partitions(docs.sparkSession)
    ident = _identity(docs, key, text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = byte_lengths(batch.column(2))
            for i, j in portions(lengths, rows=20_000, size=4 << 20):
                part = batch.slice(i, j - i)
                data, start = _bytes(part.column(2), 0)
                doc, first, n, k, c, _ = runs_of(data, start, length, gram)
                if not len(doc):
                    continue
                oid = _column(part, "oid")[doc]
                pos = _pack(_column(part, "tag")[doc], first, n)
                at = np.lexsort((pos, oid, c, k))
                oid, pos, k, c = oid[at], pos[at], k[at], c[at]
                new_k = np.concatenate(([True], k[1:] != k[:-1]))
                new_c = new_k | np.concatenate(([True], c[1:] != c[:-1]))
                again = ~new_c & ~np.concatenate(([False], (oid[1:] == oid[:-1]) & (pos[1:] == pos[:-1])))
                state = np.where(again, REMOVED, OPEN)
                group = np.cumsum(new_k) - 1
                several = np.bincount(group, new_c)[group] > 1
                state[several & new_c] = FIRST
                spread = mix64(oid.astype(np.uint64) ^ mix64(pos.astype(np.uint64))).view(np.int64)
                route = np.where((state == OPEN) | new_k, k, spread)
                keep = new_c | again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[keep]) for x in (route, k, c, oid, pos)] + [pa.array(state[keep].astype(np.int8))],
                    ["route", "k", "c", "oid", "pos", "state"])

    found = ident.mapInArrow(find, "route long, k long, c long, oid long, pos long, state byte")
    by_route = found.repartition(P, "route").sortWithinPartitions("route", "k", "c", "oid", "pos")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["route", "k"]):
            route, k, c, oid, pos, state = (_column(t, x) for x in ("route", "k", "c", "oid", "pos", "state"))
            new_k = np.concatenate(([True], (k[1:] != k[:-1]) | (route[1:] != route[:-1])))
            new_c = new_k | np.concatenate(([True], c[1:] != c[:-1]))
            group = np.cumsum(new_k) - 1
            several = np.bincount(group, new_c)[group] > 1
            known = np.bincount(group, (state == FIRST) & (route == k))[group] > 0
            here = route == k
            twin = ~new_c & np.concatenate(([False], (oid[1:] == oid[:-1]) & (pos[1:] == pos[:-1])))
            out = np.where(state == REMOVED, REMOVED, np.where(
                here & ~new_c & ~twin, REMOVED, np.where((state == FIRST) | here & (several | known) & new_c, FIRST, OPEN)))
            keep = out != OPEN
            yield pa.RecordBatch.from_arrays(
                [pa.array(oid[keep]), pa.array(pos[keep] >> 48), pa.array(pos[keep] >> 8 & ((1 << 40) - 1)),
                 pa.array((pos[keep] & 127).astype(np.int32)), pa.array(np.where(out == FIRST, k, 0)[keep]),
                 pa.array(out[keep].astype(np.int8))], ["oid", "tag", "pos", "n", "k", "state"])

    runs = save(by_route.mapInArrow(settle, "oid long, tag long, pos long, n int, k long, state byte"), "suffix-runs")
    firsts = runs.where(F.col("state") == FIRST)
    crowded = firsts.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowd).select("k", F.lit(True).alias("hot"))
    listed = (firsts.join(crowded, "k", "left").groupBy("oid", "tag").agg(
        F.collect_list(F.struct("k", "pos", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("r")))
    withal = ident.join(listed, ["oid", "tag"]).select("oid", "tag", "t", "r")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["route", "oid", "tag", "pos", "n", "body"]
        kind = pa.binary()
        for batch in batches:
            for i, j in portions(byte_lengths(batch.column(2)), rows=2000, size=2 << 20):
                part = batch.slice(i, j - i)
                data, start = _bytes(part.column(2), 0)
                lists = part.column(3)
                flat = lists.flatten()
                row = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
                k, pos, n, hot = (flat.field(x).to_numpy(zero_copy_only=False) for x in range(4))
                oid, tag = _column(part, "oid")[row], _column(part, "tag")[row]
                at = start[row] + pos
                cool = np.flatnonzero(~hot)
                if len(cool):
                    raw = data.tobytes()
                    body = [raw[a:a + m + length - 1] for a, m in zip(at[cool].tolist(), n[cool].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[cool]), pa.array(oid[cool]), pa.array(tag[cool]), pa.array(pos[cool]),
                         pa.array(n[cool].astype(np.int32)), pa.array(body, kind)], names)
                warm = np.flatnonzero(hot)
                if len(warm):  # one row a string, by its hashes; the first in this portion goes on
                    m = n[warm]
                    of = np.repeat(warm, m)
                    step = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
                    a = at[of] + step
                    s = prefix_hash(data)
                    h1 = span_hash(s, a, a + length)
                    h2 = mix64(span_hash(s, a, a + length // 2) * np.uint64(0x9E3779B97F4A7C15)
                               + span_hash(s, a + length // 2, a + length))
                    o, g, p = oid[of], tag[of], pos[of] + step
                    x = np.lexsort((p, g, o, h2, h1))
                    o, g, p, h1, h2 = o[x], g[x], p[x], h1[x], h2[x]
                    again = np.concatenate(([False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])))
                    route = np.where(again, mix64(o.astype(np.uint64) ^ mix64(p.astype(np.uint64))), h1).view(np.int64)
                    body = [b"" if y else z.tobytes() for y, z in zip(again, h2)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(route), pa.array(o), pa.array(g), pa.array(p), pa.array(np.ones(len(o), np.int32)),
                         pa.array(body, kind)], names)

    spread = withal.mapInArrow(contexts, "route long, oid long, tag long, pos long, n int, body binary")
    met = spread.repartition(P, "route").sortWithinPartitions("route", "oid", "tag", "pos")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["route"]):
            route, oid, tag, pos, n = (_column(t, x) for x in ("route", "oid", "tag", "pos", "n"))
            sizes = byte_lengths(t.column("body").combine_chunks())
            single = (n == 1) & (sizes == 8)
            done = sizes == 0
            out_o, out_g, out_p = [oid[done]], [tag[done]], [pos[done]]
            x = np.flatnonzero(single)
            if len(x):
                h2 = np.frombuffer(b"".join(t.column("body").take(pa.array(x)).to_pylist()), np.uint64)
                at = np.lexsort((pos[x], tag[x], oid[x], h2, route[x]))
                x, h2 = x[at], h2[at]
                same = np.concatenate(([False], (route[x][1:] == route[x][:-1]) & (h2[1:] == h2[:-1])))
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(x))))
                f = x[head]
                later = same & ((oid[x] != oid[f]) | (tag[x] != tag[f]) | (pos[x] != pos[f]))
                out_o.append(oid[x][later])
                out_g.append(tag[x][later])
                out_p.append(pos[x][later])
            x = np.flatnonzero(~single & ~done)
            if len(x):
                edge = np.flatnonzero(np.concatenate(([True], route[x][1:] != route[x][:-1])))
                many = np.diff(np.append(edge, len(x)))
                group = np.repeat(np.arange(len(edge)), many)
                y = many[group] > 1
                x, group = x[y], group[y]
            if len(x):
                data, start = _bytes(t.column("body").take(pa.array(x)).combine_chunks(), 0)
                m = n[x].astype(np.int64)
                of = np.repeat(np.arange(len(x)), m)
                step = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
                o, g, p = oid[x][of], tag[x][of], pos[x][of] + step
                gone = repeated(data.tobytes(), start[of] + step, group[of], o, g << 48 | p, length)
                out_o.append(o[gone])
                out_g.append(g[gone])
                out_p.append(p[gone])
            o, g, p = np.concatenate(out_o), np.concatenate(out_g), np.concatenate(out_p)
            at = np.lexsort((p, g, o))
            o, g, p = o[at], g[at], p[at]
            new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (g[1:] != g[:-1]) | (p[1:] > p[:-1] + 1)))) if len(o) else np.empty(0, np.int64)
            last = np.append(new[1:], len(o)) - 1 if len(o) else new
            yield pa.RecordBatch.from_arrays(
                [pa.array(o[new]), pa.array(g[new]), pa.array(p[new]), pa.array((p[last] - p[new] + 1).astype(np.int32))],
                ["oid", "tag", "pos", "n"])

    marked = met.mapInArrow(sort, "oid long, tag long, pos long, n int")
    return runs.where(F.col("state") == REMOVED).select("oid", "tag", "pos", "n").unionByName(marked)


def _cut(text: bytes, spans) -> tuple[int, int, list[tuple[int, int]]]:
    """Removed bytes, maximal removed runs, and what is kept as ranges."""
    gone = runs = at = 0
    keep = []
    for a, b in sorted(spans):
        if a > at or not runs:
            if a > at:
                keep.append((at, a))
            runs += 1
            gone += b - a
            at = b
        elif b > at:
            gone += b - at
            at = b
    if at < len(text):
        keep.append((at, len(text)))
    return gone, runs, keep


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, gram: int = 32, crowd: int = 4096,
          keep_bytes: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes), one row per row."""
    gone = removals(docs, key, text, length, gram, crowd).groupBy("oid", "tag").agg(
        F.collect_list(F.struct("pos", "n")).alias("r"))
    full = _identity(docs, key, text, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                cols: list[list] = [[], [], [], [], []]
                for t, r in zip(part.column(1), part.column(2)):
                    raw = t.as_py().encode()
                    spans = [(x["pos"], x["pos"] + x["n"] - 1 + length) for x in r.as_py() or ()]
                    removed, runs, keep = _cut(raw, spans)
                    rest = b"".join(raw[a:b] for a, b in keep)
                    for c, v in zip(cols, (len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), rest)):
                        c.append(v)
                arrays = [part.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
                names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_bytes:
                    arrays.append(pa.array(cols[4], pa.binary()))
                    names.append("kept_bytes")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                           *([T.StructField("kept_bytes", T.BinaryType())] if keep_bytes else [])])
    return full.join(gone, ["oid", "tag"], "left").select(key, "t", "r").mapInArrow(cut, schema)
