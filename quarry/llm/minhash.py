"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every document has a set of word shingles (64-bit hashes) and, for each of ``trees`` sorted orders, a signature of
``depth`` minima. Documents that share the first ``base`` minima of an order are neighbours by longest common
prefix. The depth adapts to the region: where more than ``region`` documents share a prefix, it is extended two
minima at a time, up to ``depth``. Longer prefixes only find links early: what they leave in different components is
compared over the whole base region, so dense regions have the recall of sparse ones.

1. Equal sets are one class; only its smallest key goes on, so any number of exact copies costs one row.
2. Every document is compared with the smallest key of each of its base regions (at most one pair a tree).
3. The links found give components. Regions that still hold several components are compared all against all in
   blocks of at most ``region`` documents, except pairs already connected: such a pair can change no component.
   A region that is still larger at full depth is dealt out as pairs of blocks, none of it is dropped.
4. Base regions that were cut and still hold several components are dealt out as pairs of blocks. A large component has
   blocks of its own, which are not paired with each other; small components share blocks.

Links are confirmed on the full sets: ``100 * intersection >= percent * union``. Chance of missing a pair at
similarity 0.85 is (1 - 0.85**5)**20, below 0.001 %, in any region.

Null and empty texts and texts without words have the empty set and no link. With fewer words than a shingle, the
whole sequence is the one shingle. Of rows with equal keys the largest set counts (ties: the larger hashes). An empty
table gives an empty result. Rows with a null key have no result; ``keep_first`` keeps them. Extra columns are ignored
here and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (binary_parts, components, drop, forest, group_starts, grouped, mix64, prefix_hash, save,
                     shuffle_partitions, span_hash, word_bounds)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240607)
    return (r.integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            r.integers(0, 1 << 32, n, dtype=np.uint32))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the lower-cased (A-Z) text; empty without words."""
    data = np.frombuffer(text.lower(), np.uint8)
    start, end = word_bounds(data)
    if not len(start):
        return np.empty(0, np.uint64)
    w = span_hash(prefix_hash(data), start, end)
    k = min(words, len(w))
    h = w[:len(w) - k + 1].copy()
    for j in range(1, k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[j:len(w) - k + 1 + j])
    return np.unique(mix64(h + np.uint64(k)))


def signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minima of the permuted set, one per seed (uint32)."""
    low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        x = low[None, at:at + 256] * mul[:, None]
        x += add[:, None]
        x ^= x >> np.uint32(15)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def sets(docs: DataFrame, key: str, text: str, words: int, columns: str, make) -> DataFrame:
    """(key, *make(shingle set)) for every row; whole texts, one at a time."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {columns}"
    target = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [(pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary()) for f in target.fields[1:]]
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = batch.slice(part, 1000)
                got = [make(shingles(b, words)) for b in binary_parts(rows.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *[pa.array([g[i] for g in got], t) for i, t in enumerate(types)]],
                    target.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _unpack(col) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a binary column of sets, and the row offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    _, off, body = col.buffers()
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1]
    values = np.frombuffer(body, np.uint8)[off[0]:off[-1]].view(np.uint64) if len(col) and off[-1] > off[0] else np.empty(0, np.uint64)
    return values, ((off - off[0]) // 8).astype(np.int64)


def overlaps(a, b) -> np.ndarray:
    """Intersection sizes of two aligned columns of sorted sets."""
    (x, xo), (y, yo) = _unpack(a), _unpack(b)
    n = len(xo) - 1
    row = np.concatenate((np.repeat(np.arange(n), np.diff(xo)), np.repeat(np.arange(n), np.diff(yo))))
    both = np.concatenate((x, y))
    order = np.lexsort((both, row))
    row, both = row[order], both[order]
    same = (row[1:] == row[:-1]) & (both[1:] == both[:-1])
    return np.bincount(row[1:][same], minlength=n)


def cross_counts(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Intersection sizes between all rows of a block: sums of products of 0/1 columns, some thousand at a time."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    word, col, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    row, col = row[shared], col[shared]
    renumber = np.cumsum(times > 1) - 1
    col = renumber[col]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    width = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += m @ m.T
    return out


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85, trees: int = 20,
         base: int = 5, depth: int = 9, region: int = 256) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable), kept; one row per key."""
    mul, add = _seeds(trees * depth)
    docs = docs.where(F.col(key).isNotNull())

    def named(s: np.ndarray) -> tuple[int, int, int]:
        """Size and two 64-bit sums: the identity of a set."""
        two = mix64(s ^ np.uint64(0x5851F42D4C957F2D))
        return len(s), _signed(int(s.sum(dtype=np.uint64))), _signed(int(two.sum(dtype=np.uint64)))

    same = ["id", "n", "h1", "h2"]
    sigs = save(sets(docs, key, text, words, "n long, h1 long, h2 long, sig binary",
                     lambda s: (*named(s), signature(s, mul, add).tobytes() if len(s) else b"")), "forest-sig")
    per_key = save(sigs.groupBy(key).agg(F.max(F.struct("n", "h1", "h2")).alias("s")).select(key, "s.*"), "forest-keys")
    firsts = per_key.where("n > 0").groupBy("n", "h1", "h2").agg(F.min(key).alias("id"))
    classes = save(firsts.join(sigs.withColumnRenamed(key, "id"), same).dropDuplicates(same), "forest-classes")
    drop(sigs)

    def prefix(d: int):
        return F.xxhash64("tree", F.substring(F.col("sig"), F.col("tree") * (4 * depth) + 1, F.lit(4 * d)))

    rows = classes.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    base_rows = rows.select("id", "tree", prefix(base).alias("k"))
    regions = save(base_rows.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first")).where("m > 1"),
                   "forest-regions")
    members = save(base_rows.join(regions, "k"), "forest-members")  # documents with a neighbour
    near = members.select("id").distinct()
    # the ids grow with the corpus, so they are not broadcast where they happen to be few: the same plan at every size
    full = sets(docs.join(near.hint("merge"), docs[key] == near["id"], "left_semi"), key, text, words,
                "n long, h1 long, h2 long, body binary", lambda s: (*named(s), s.tobytes()))
    full = save(full.withColumnRenamed(key, "id").join(classes.select(same), same, "left_semi").dropDuplicates(same)
                .select("id", "body"), "forest-sets")


    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                t = batch.slice(part, 500)
                x, y = t.column(t.schema.get_field_index("x")), t.column(t.schema.get_field_index("y"))
                both = overlaps(x, y)
                sizes = np.diff(_unpack(x)[1]) + np.diff(_unpack(y)[1])
                ok = pa.array(100 * both >= percent * (sizes - both))
                yield pa.RecordBatch.from_arrays(
                    [t.column(t.schema.get_field_index("a")).filter(ok), t.column(t.schema.get_field_index("b")).filter(ok)], ["a", "b"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        sides = (pairs.distinct().join(full.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
                 .join(full.select(F.col("id").alias("a"), F.col("body").alias("x")), "a"))
        return sides.mapInArrow(confirm, "a long, b long")

    # each document with the first of its regions
    links = save(confirmed(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))), "forest-links")
    comp = save(components(links), "forest-comp")

    # regions that hold several components, cut finer while they are large
    def tagged(df: DataFrame) -> DataFrame:
        """Rows of the regions that hold several components, with the region's size."""
        mixed = (df.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"))
                 .where("lo < hi").select("k", "m"))
        return df.join(mixed, "k")

    todo = members.join(comp, "id", "left").select("id", "tree", "k", F.coalesce("component_id", "id").alias("c"))
    leaves, stars = None, None
    levels = list(range(base, depth + 1, 2))
    for d in levels:
        here = save(tagged(todo), "forest-level")
        leaf = here.where(F.col("m") <= region)
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        if d == levels[-1]:
            # what is dense at the deepest level is nearly equal: each with the first of it is enough to find most links early,
            # and the dense regions are compared whole below
            large = here.where(F.col("m") > region)
            stars = large.join(large.groupBy("k").agg(F.min_by(F.struct("id", "c"), "id").alias("first")), "k").where(
                F.col("c") != F.col("first.c")).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
            break
        todo = (here.where(F.col("m") > region).select("id", "tree", "c").join(classes.select("id", "sig"), "id")
                .select("id", "tree", prefix(d + 2).alias("k"), "c"))
    half = region // 2
    dealt = leaves.select("id", "c", "k", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q")).join(full, "id")
    P = shuffle_partitions(docs.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["k", "p", "q"]):
            edge = np.append(group_starts(t, ["k", "p", "q"]), t.num_rows)
            ids, comps = t.column("id").to_numpy(), t.column("c").to_numpy()
            body, a, b = t.column("body"), [], []
            for i, j in zip(edge[:-1], edge[1:]):
                c = comps[i:j]
                if j - i < 2 or (c == c[0]).all():
                    continue
                values, off = _unpack(body.slice(i, j - i))
                both, size = cross_counts(values, off), np.diff(off)
                ok = 100 * both >= percent * (size[:, None] + size[None, :] - both)
                x, y = np.nonzero(np.triu(ok & (c[:, None] != c[None, :]), 1))
                if len(x):
                    first = forest(j - i, x, y)  # one edge a document is enough
                    x = np.flatnonzero(first != np.arange(j - i))
                    a.append(ids[i:j][first[x]])
                    b.append(ids[i:j][x])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def compared(dealt: DataFrame) -> DataFrame:
        blocked = dealt.repartition(P, "k", "p", "q").sortWithinPartitions("k", "p", "q", "id")
        return blocked.select("k", "p", "q", "id", "c", "body").mapInArrow(compare, "a long, b long")

    early = save(links.unionByName(compared(dealt)).unionByName(confirmed(stars)), "forest-early")
    comp = save(components(early), "forest-comp")

    # the base regions that were cut: pairs of different components, all of them
    dense = save(tagged(members.where(F.col("m") > region).join(comp, "id", "left")
                        .select("id", "k", F.coalesce("component_id", "id").alias("c"))).drop("m"), "forest-dense")
    if not dense.isEmpty():
        sizes = dense.groupBy("k", "c").agg(F.count(F.lit(1)).alias("own"))
        small = sizes.where(F.col("own") < half).groupBy("k").agg(F.sum("own").alias("rest"))
        large = F.col("own") >= half
        placed = save(dense.join(sizes, ["k", "c"]).join(small, "k", "left").select(
            "id", "k", "c", F.when(large, F.col("c")).alias("pure"),
            F.when(large, F.pmod(F.xxhash64("id"), F.ceil(F.col("own") / half)))
            .otherwise(F.pmod(F.xxhash64("c"), F.ceil(F.col("rest") / half))).alias("b"))
            .withColumn("b", F.xxhash64(F.coalesce(F.col("pure").cast("string"), F.lit("")), "b")), "forest-placed")
        cells = save(placed.select("k", "pure", "b").distinct(), "forest-cells")
        other = cells.select("k", F.col("pure").alias("pure2"), F.col("b").alias("q"))
        met = (cells.join(other, "k").where((F.col("b") <= F.col("q")) & ~F.coalesce(F.col("pure") == F.col("pure2"), F.lit(False)))
               .select("k", F.col("b").alias("p"), "q"))
        late = (met.select("k", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("b"))
                .join(placed.select("k", "b", "id", "c"), ["k", "b"]).select("id", "c", "k", "p", "q").join(full, "id"))
        comp = components(early.unionByName(compared(late)))
    found = classes.join(comp, "id", "left").select("n", "h1", "h2", F.coalesce("component_id", "id").alias("component_id"))
    return per_key.join(found, ["n", "h1", "h2"], "left").select(
        key, F.col("n").alias("n_shingles"), F.coalesce("component_id", key).alias("component_id"),
        (F.col(key) == F.coalesce("component_id", key)).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component. Same columns; rows without a key stay."""
    gone = link(docs, key, text, **options).where(~F.col("kept")).select(key)
    return docs.join(gone, key, "left_anti").select(*docs.columns)
