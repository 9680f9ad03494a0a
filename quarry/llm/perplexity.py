"""Quality rules and n-gram perplexity.

The language model is modified Kneser-Ney of a fixed order over the UTF-8 bytes of each language. Tasks cut their rows
into chunks and count the chunk's n-grams of the highest order with sorted arrays. These are dealt into buckets by the two
bytes before the last, so that a bucket holds whole contexts of all orders from three up: Spark brings the chunks' parts of a bucket
together, a task sums them, derives the continuation counts of the lower orders and answers each chunk with the counts of
its own n-grams and their contexts. Orders one and two have at most 65,536 n-grams a language; Spark sums them over the
buckets, and each chunk gets them whole. N-grams are exact (none are hashed or folded); parts and answers travel as packed and
compressed arrays, about a row for each chunk and bucket, and the number of buckets grows with the n-grams. Nothing of the model
reaches the driver or is broadcast, and its size is not capped.

``log_perplexity`` is the mean log-perplexity per byte under the model of all documents. ``held_out`` is the same with
the document's own counts, and those of all rows with equal text in its language, taken out of every order: n-grams
that only it has are unseen and back off to lower orders, down to uniform bytes. (The discounts stay those of all
documents.) For each language, the median and the median deviation of ``held_out`` over all documents that pass the base
rules give the band; documents below ``low`` or above ``high`` deviations are rejected. The lower band is wide, as a near
copy is predicted by its twin, which says nothing against it. A null language is a language of its own.

Null and empty texts have no words and fail the base rules (fewer than 20 words). Repeated rows count as often as they
occur, and get equal results. Lines are compared whole, words byte for byte. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, binary_parts, byte_lengths, drop, mix64, portions, prefix_hash, save, span_hash

ORDER, SHORT = 5, 2  # orders up to SHORT are small tables of a language
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LINE_EDGE = " \t\n\v\f\r"


def _bytes(col: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each after ``pad`` bytes 0x02; and where each begins (its first pad byte), and the end."""
    n = byte_lengths(col)
    start = np.concatenate(([0], np.cumsum(n + pad))).astype(np.int64)
    out = np.full(start[-1], 2, np.uint8)
    if n.sum():
        flat = col.cast(pa.large_binary()).fill_null(b"")
        _, off, body = flat.buffers()
        off = np.frombuffer(off, np.int64)[flat.offset:flat.offset + len(flat) + 1]
        at = np.arange(off[-1] - off[0]) + np.repeat(start[:-1] + pad - (off[:-1] - off[0]), n)
        out[at] = np.frombuffer(body, np.uint8)[off[0]:off[-1]]
    return out, start


def _grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed n-grams that end at every byte of every text, the row of each, and the rows' lengths."""
    data, start = _bytes(col, ORDER - 1)
    wide = data.astype(np.int64)
    k = np.zeros(max(0, len(data) - ORDER + 1), np.int64)
    for j in range(ORDER):
        k = k << 8 | wide[j:len(wide) - ORDER + 1 + j]
    n = np.diff(start) - (ORDER - 1)
    row = np.repeat(np.arange(len(n)), n)
    return k[np.arange(len(row)) + row * (ORDER - 1)], row, n


def gather(docs: DataFrame, key: str, text: str, group: Column, size: int) -> DataFrame:
    """Chunks of about ``size`` bytes of text of one language, written: chunk, g, body (compressed rows), the distinct
    n-grams of the highest order with counts (grams, packed) and how many they are (n), and the hashes of the texts (h)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # rows, hashes, n-grams, counts, bytes

        def drain(g: int) -> pa.RecordBatch:
            rows, hashes, k, c, _ = held.pop(g)
            table = pa.Table.from_batches(rows).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, "bz2") as body, pa.ipc.new_stream(body, table.schema) as out:
                out.write_table(table)  # written and shuffled: most of the disk, so the denser code
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65]), pa.array([g]), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                 pa.array([pack(k, c)], pa.binary()), pa.array([len(k)]),
                 pa.array([np.concatenate(hashes)], pa.list_(pa.int64()))], ["chunk", "g", "body", "grams", "n", "h"])

        for batch in batches:
            lengths = byte_lengths(batch.column(1))
            for i, j in portions(lengths, rows=5000):
                rows = batch.slice(i, j - i)
                gs = rows.column(2).to_numpy()
                for g in np.unique(gs).tolist():
                    mine = rows.filter(pa.array(gs == g))
                    k, _, n = _grams(mine.column(1))
                    k, c = _runs(np.sort(k))
                    have = held.setdefault(g, [[], [], np.empty(0, np.int64), np.empty(0, np.int64), 0])
                    have[0].append(mine.select([key, "t"]))
                    have[1].append(text_hashes(mine.column(1)))
                    have[2], have[3] = _summed([have[2], k], [have[3], c])
                    have[4] += int(n.sum())
                if sum(x[4] for x in held.values()) > size:
                    yield from [drain(g) for g in list(held)]
        yield from [drain(g) for g in list(held)]

    return save(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"), group.alias("g")).mapInArrow(
        run, "chunk long, g long, body binary, grams binary, n long, h array<long>"), "kn-chunks")


def text_hashes(col: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b) for b in binary_parts(col)], np.uint64).view(np.int64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _summed(ks: list[np.ndarray], cs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, sorted, and the sums of their counts."""
    k, c = np.concatenate(ks), np.concatenate(cs)
    order = np.argsort(k, kind="stable")
    k, first = np.unique(k[order], return_index=True)
    return k, np.add.reduceat(c[order], first) if len(first) else c


def _contexts(k: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Where each context of sorted n-grams begins; its sum of counts, and its followers with counts of 1, 2 and more."""
    first = np.flatnonzero(np.concatenate(([True], k[1:] >> 8 != k[:-1] >> 8)))
    return [first, np.add.reduceat(c, first), *(np.add.reduceat(x.astype(np.int64), first) for x in (c == 1, c == 2, c > 2))]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 as compressed bytes; of each number as many bytes as the largest of its array needs."""
    head, body = [len(arrays)], []
    for x in arrays:
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        head += [len(x), width]
        body.append(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    at, out = 8 + 16 * n, []
    for size, width in raw[8:at].view(np.int64).reshape(n, 2).tolist():
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = raw[at:at + size * width].reshape(width, size).T
        out.append(wide.reshape(-1).view(np.int64))
        at += size * width
    return out


def _dealt(chunks: DataFrame, buckets: int) -> DataFrame:
    """The n-grams of each chunk by bucket: chunk, g, b, grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, g, grams in zip(*(batch.column(i) for i in range(3))):
                k, c = unpack(grams.as_py())
                b = (mix64((k >> 8 & 0xFFFF).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                found, n = _runs(b[order])
                parts = np.split(order, np.cumsum(n)[:-1]) if len(n) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.as_py()] * len(parts), pa.int64()) for x in (chunk, g)] + [pa.array(found, pa.int64()),
                     pa.array([pack(k[x], c[x]) for x in parts], pa.binary())], ["chunk", "g", "b", "grams"])

    return chunks.select("chunk", "g", "grams").mapInArrow(run, "chunk long, g long, b long, grams binary")


def _answered(parts: pa.Table) -> pa.Table:
    """One bucket. For each chunk (of) its n-grams and, for the orders above SHORT, their counts and contexts (grams); and
    one row without chunk: the n-grams of order SHORT (k), in how many of the bucket's longer ones they are (c), and how many
    n-grams of each order above count 1 to 4 (t)."""
    k = c = np.empty(0, np.int64)
    ks, cs, held = [k], [c], 0
    for x in parts.column("grams"):
        a, b = unpack(x.as_py())
        ks.append(a)
        cs.append(b)
        held += len(a)
        if held > max(1 << 20, len(ks[0])):
            k, c = _summed(ks, cs)
            ks, cs, held = [k], [c], 0
    k, c = _summed(ks, cs)
    levels, tally = [], []
    for n in range(ORDER, SHORT, -1):
        if n < ORDER:  # continuation counts
            k, c = _runs(np.sort(k & ((1 << 8 * n) - 1)))
        first, *sums = _contexts(k, c)
        levels.append((n, k, c, k[first] >> 8, sums))
        tally += [int((c == i).sum()) for i in (1, 2, 3, 4)]
    out = []
    for x in parts.column("grams"):
        mine = unpack(x.as_py())[0]
        answer = [mine]
        for n, keys, counts, contexts, sums in levels:
            if n < ORDER:
                mine = np.unique(mine & ((1 << 8 * n) - 1))
            at = np.searchsorted(contexts, np.unique(mine >> 8))
            answer += [counts[np.searchsorted(keys, mine)], *(s[at] for s in sums)]
        out.append(pack(*answer))
    k, c = _runs(np.sort(k & ((1 << 8 * SHORT) - 1)))
    g, none = parts.column("g")[0].as_py(), [None] * len(out)
    return pa.table({"of": pa.array([*parts.column("chunk").to_pylist(), None], pa.int64()), "g": pa.array([g] * (len(out) + 1), pa.int64()),
                     "grams": pa.array([*out, None], pa.binary()), **{name: pa.array([*none, x], pa.list_(pa.int64()))
                                                                      for name, x in (("k", k), ("c", c), ("t", tally))}})


def model(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each chunk needs of the model, in rows (of: the chunk) of three kinds: answers of the buckets (grams); rows with equal
    text (k, c); the language's n-grams of order SHORT with their counts (k, c) and the discounts by order (d). And the
    written answers, to remove them."""
    total = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << min(12, max(4, (total >> 20).bit_length()))  # up to a million n-grams, counted once a chunk, in a bucket of all languages
    answers = save(_dealt(chunks, buckets).groupBy("g", "b").applyInArrow(
        _answered, "of long, g long, grams binary, k array<long>, c array<long>, t array<long>"), "kn-answers")
    hashes = chunks.select("chunk", "g", F.explode("h").alias("k"))
    copies = hashes.groupBy("g", "k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = hashes.distinct().join(copies, ["g", "k"])
    sums = answers.where("of IS NULL")
    short = save(sums.select("g", F.explode(F.arrays_zip("k", "c")).alias("x")).groupBy("g", F.col("x.k").alias("k"))
                 .agg(F.sum("x.c").alias("c")), "kn-short")
    times = [f"n{i}" for i in (1, 2, 3, 4)]
    tallies = sums.select("g", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *[
        F.col("t")[4 * (ORDER - n) + i].alias(x) for i, x in enumerate(times)]) for n in range(ORDER, SHORT, -1)])).alias("x"))
    tallies = tallies.groupBy("g", "x.n").agg(*[F.sum(f"x.{x}").cast("double").alias(x) for x in times])
    table = short
    for n in range(SHORT, 0, -1):
        if n < SHORT:
            table = table.groupBy("g", F.col("k").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("k")).agg(F.count(F.lit(1)).alias("c"))
        tallies = tallies.unionByName(table.groupBy("g").agg(F.lit(n).alias("n"), *[
            F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def cut(i: int) -> Column:
        raw = F.lit(float(i)) - F.lit(i + 1.0) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        safe = (F.col("n1") > 0) & (F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0)  # else half of the smallest count
        return F.when(safe, F.greatest(F.lit(0.05), F.least(raw, F.lit(i - 0.05)))).otherwise(F.lit(0.5))

    cuts = tallies.select("g", "n", F.array(F.lit(0.0), cut(1), cut(2), cut(3)).alias("d")).groupBy("g").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "d"))), lambda x: x["d"]).alias("d"))
    whole = short.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("x")).join(cuts, "g")
    whole = chunks.select("chunk", "g").join(whole, "g").select("chunk", F.col("x.k").alias("k"), F.col("x.c").alias("c"), "d")
    needs = answers.where("of IS NOT NULL").select("of", "grams").unionByName(
        copies.select(F.col("chunk").alias("of"), F.array("k").alias("k"), F.array("c").alias("c")), True).unionByName(
        whole.withColumnRenamed("chunk", "of"), True)
    return needs, answers


class Level:
    """The n-grams of one order that a chunk needs: sorted keys, counts, sums and discounted mass of their contexts."""

    def __init__(self, cuts: np.ndarray, k: np.ndarray, c: np.ndarray, s: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray):
        order = np.argsort(k)
        self.cuts, self.k, self.c, self.s = cuts, k[order], c[order], s[order]
        self.mass = (cuts[1] * n1 + cuts[2] * n2 + cuts[3] * n3)[order]

    def cut(self, c: np.ndarray) -> np.ndarray:
        return self.cuts[np.minimum(c, 3)]


class Slice:
    """The part of the model that one chunk needs."""

    def __init__(self, needs: pa.Table):
        whole = needs.filter(pc.is_valid(needs.column("d")))
        cuts, k, c = np.array(whole.column("d")[0].as_py()), *(np.array(whole.column(x)[0].as_py(), np.int64) for x in ("k", "c"))
        found: dict[int, list] = {n: [] for n in range(1, ORDER + 1)}
        for n in range(SHORT, 0, -1):
            if n < SHORT:
                k, c = _runs(np.sort(k & ((1 << 8 * n) - 1)))
            first, *sums = _contexts(k, c)
            found[n].append([k, c, *(np.repeat(x, np.diff(np.append(first, len(k)))) for x in sums)])
        for x in needs.column("grams").drop_null():
            k, *rest = unpack(x.as_py())
            for i, n in enumerate(range(ORDER, SHORT, -1)):
                if n < ORDER:
                    k = np.unique(k & ((1 << 8 * n) - 1))
                times = _runs(k >> 8)[1]
                c, *sums = rest[5 * i:5 * i + 5]
                found[n].append([k, c, *(np.repeat(x, times) for x in sums)])
        self.levels = {n: Level(cuts[n - 1], *map(np.concatenate, zip(*parts))) for n, parts in found.items()}
        same = needs.filter(pc.and_(pc.is_null(needs.column("d")), pc.is_valid(needs.column("k"))))
        self.copies = dict(zip(*(same.column(x).combine_chunks().flatten().to_pylist() for x in ("k", "c"))))
        p = None
        for i, t in self.levels.items():  # probabilities by all documents
            low = 1 / 256 if p is None else p[np.searchsorted(self.levels[i - 1].k, t.k & ((1 << 8 * (i - 1)) - 1))]
            p = (t.c - t.cut(t.c) + t.mass * low) / t.s
        self.logs = np.log(p)

    def score(self, k: np.ndarray, row: np.ndarray, n: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-perplexity per byte of each row: by all documents, and with its own counts left out."""
        rows = len(n)
        key, times = _runs(np.sort(row << 8 * ORDER | k))
        at, key = key >> 8 * ORDER, key & ((1 << 8 * ORDER) - 1)
        place = np.searchsorted(self.levels[ORDER].k, key)
        full = -np.bincount(at, times * self.logs[place], rows) / np.maximum(n, 1)
        top, r, own, steps = at, at, times * copies[at], []
        for i in range(ORDER, 0, -1):
            t = self.levels[i]
            if i < ORDER:
                place = np.searchsorted(t.k, key)
            c = t.c[place]
            left = c - own
            context = key >> 8
            first = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (r[1:] != r[:-1]))))
            cut = t.cut(left)
            s = t.s[place[first]] - np.add.reduceat(own, first)
            mass = t.mass[place[first]] + np.add.reduceat(cut - t.cut(c), first)
            seen, size = s > 0, np.diff(np.append(first, len(key)))
            over = 1 / np.maximum(s, 1)
            steps.append([(left - cut) * np.repeat(np.where(seen, over, 0), size),
                          np.repeat(np.where(seen, mass * over, 1), size), None])
            if i > 1:
                # sorted by row and shorter n-gram, with the place in the low bits
                bits, low = len(key).bit_length(), 8 * (i - 1)
                packed = np.sort((r << low | key & ((1 << low) - 1)) << bits | np.arange(len(key)))
                order, value = packed & ((1 << bits) - 1), packed >> bits
                fresh = np.concatenate(([True], value[1:] != value[:-1]))
                first = np.flatnonzero(fresh)
                back = np.empty(len(key), np.int64)
                back[order] = np.cumsum(fresh) - 1
                steps[-1][2] = back
                own = np.add.reduceat((left == 0)[order].astype(np.int64), first)  # n-grams that only this text has
                r, key = value[first] >> low, value[first] & ((1 << low) - 1)
        p = None
        for own_share, rest, back in reversed(steps):
            p = own_share + rest * (1 / 256 if p is None else p[back])
        return full, -np.bincount(top, times * np.log(p), rows) / np.maximum(n, 1)


def base_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    data, start = _bytes(col, 1)  # the pad byte parts the texts: it is made white space
    data[start[:-1]] = 0x20
    data = np.append(data, np.uint8(0x20))
    rows = len(start) - 1
    word = ~SPACE[data]
    edge = np.diff(np.concatenate(([0], word.view(np.int8))))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(a, start)
    point = np.concatenate(([0], np.cumsum(word & ((data & 0xC0) != 0x80))))
    mark = np.concatenate(([0], np.cumsum(SYMBOL[data])))
    # words in windows of eight that occur twice or more in the same text
    h = span_hash(prefix_hash(data), a, b)
    repeat = np.zeros(len(a) + 1, np.int64)
    if len(h) >= 8:
        w = h[:len(h) - 7].copy()
        for j in range(1, 8):
            w = mix64(w * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - 7 + j])
        row = np.repeat(np.arange(rows), np.diff(first))
        at = np.flatnonzero(row[:len(w)] == row[7:])
        _, inv, times = np.unique(mix64(w[at] + row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)),
                                  return_inverse=True, return_counts=True)
        twice = at[times[inv] > 1]
        np.add.at(repeat, twice, 1)
        np.add.at(repeat, twice + 8, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(repeat[:-1]) > 0)))
    lines = []
    for v in col:
        t, n = v.as_py(), 0
        if t and "\n" in t:
            seen = set()
            for line in t.split("\n"):
                if line.strip(LINE_EDGE):
                    n += line in seen
                    seen.add(line)
        lines.append(n)
    return {"n_words": np.diff(first), "word_chars": np.diff(point[start]), "n_symbols": np.diff(mark[start]),
            "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": np.diff(covered[first])}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", low: float = 15.0,
          high: float = 6.0, size: int = 32 << 20) -> DataFrame:
    """key, the base counts, base_failed, log_perplexity, held_out, deviations, kept: one row per row."""
    group = F.coalesce(F.xxhash64(lang), F.lit(0).cast("long"))
    chunks = gather(docs, key, text, group, size)
    needs, answers = model(chunks)
    kind = docs.schema[key].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        with pa.CompressedInputStream(pa.BufferReader(left.column("body")[0].as_buffer()), "bz2") as body:
            table = pa.ipc.open_stream(body).read_all().combine_chunks()
        part, out = Slice(right) if pc.any(pc.is_valid(right.column("d"))).as_py() else None, []
        for batch in table.to_batches():
            for i, j in portions(byte_lengths(batch.column(1)), size=1 << 20):
                rows = batch.slice(i, j - i)
                c = base_counts(rows.column(1))
                k, row, n = _grams(rows.column(1))
                full = held = np.zeros(len(n))
                if len(k):
                    copies = np.array([part.copies.get(h, 1) for h in text_hashes(rows.column(1)).tolist()])
                    full, held = part.score(k, row, n, copies)
                out.append(pa.Table.from_arrays(
                    [rows.column(0), pa.array(np.full(len(n), left.column("g")[0].as_py())),
                     *[pa.array(c[x].astype(np.int64)) for x in COUNTS],
                     pa.array(full, mask=n == 0), pa.array(held, mask=n == 0)],
                    [key, "g", *COUNTS, "log_perplexity", "held_out"]))
        return pa.concat_tables(out)

    bodies = chunks.select("chunk", "g", "body")
    scored = save(bodies.groupBy("chunk").cogroup(needs.groupBy("of")).applyInArrow(
        run, f"`{key}` {kind}, g long, " + ", ".join(f"{c} long" for c in COUNTS)
        + ", log_perplexity double, held_out double"), "kn-scored")
    drop(chunks)
    drop(answers)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = scored.where(~failed)
    middle = good.groupBy("g").agg(F.percentile_approx("held_out", 0.5, 10000).alias("mid"))
    spread = (good.join(middle, "g").groupBy("g", "mid").agg(
        F.percentile_approx(F.abs(F.col("held_out") - F.col("mid")), 0.5, 10000).alias("mad"))
        .select("g", "mid", F.greatest(1.4826 * F.col("mad"), F.lit(0.01)).alias("unit")))
    z = (F.col("held_out") - F.col("mid")) / F.col("unit")
    return scored.join(spread, "g", "left").select(
        key, *COUNTS, failed.alias("base_failed"), "log_perplexity", "held_out", z.alias("deviations"),
        (~failed & F.coalesce(z.between(-low, high), F.lit(True))).alias("kept"))
