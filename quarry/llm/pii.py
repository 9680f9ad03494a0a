"""Personal data by bootstrapped contextual extraction.

1. Seeds: four kinds of entities found by rule (email, ip, card, phone), each a span in code points, and keys (32 or
   more hexadecimal digits, some of them letters), which are seeds but no entities by themselves.
2. Every seed induces lexical patterns from the words around it: the word before, the two words before, and the words
   before and after. Patterns of punctuation alone are none. A pattern is open if ``min_seeds`` different seeds stand
   behind its words, and at least ``least_share`` of the places behind its words hold a seed: common words are refused
   before their places are listed, so at most 1 / ``least_share`` places a seed are listed.
3. What fills an open pattern's place is a candidate, whatever its characters: the word there without its edges or, if
   it bears a digit, the run of such words that it begins (``123 45 6789``, ``GB29 NWBK 6016``). What overlaps an entity or a
   key is none.
4. The pattern-instance graph (distinct pairs, so copies of a document count once) is scored in rounds on
   Spark: a pattern's confidence is the mean score of its instances, shrunk towards 0; an unseen instance
   scores the noisy-or of its patterns. Seeds keep the score 1.
5. Patterns with enough distinct instances and a high confidence are accepted; an unseen instance with a high score is
   reported as a ``context`` span wherever an accepted pattern meets it, and so is a key.
6. Accepted instances are seeds of the next hop, wherever they stand: they induce patterns of their own. It ends after
   ``hops`` or when a hop finds no new instance.

Words are looked up in a filter of fixed size (``bits``) before an exact join, so its size does not change results.
Null and empty texts have no spans. A text is used whole, in time linear in its length. Equal rows get equal
results and count once in the graph. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, save

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match cannot begin inside a run of digits: what fails at the start of the run fails later in it too
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SPACE = re.compile(r"\s")
WORD = re.compile(r"\S+")
CAPITALS = re.compile(r"[A-Z]{1,5}")
KEY = re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
EDGE = ".,;:!?()[]{}<>\"'`|"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text)
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return out


def _before(text: str, at: int) -> list[str]:
    """Up to two words before a position, nearest first."""
    out: list[str] = []
    while at > 0 and len(out) < 2:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        end = at
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        if end > at:
            out.append(text[at:end].lower())
    return out


def _after(text: str, at: int) -> str:
    n = len(text)
    while at < n and text[at].isspace():
        at += 1
    stop = SPACE.search(text, at)
    return text[at:stop.start() if stop else n].lower()


def _hash(*parts: str) -> int:
    h = xxhash.xxh3_64_intdigest("\x00".join(parts))
    return h - (1 << 64) if h >> 63 else h


def contexts(text: str, start: int, end: int) -> tuple[int | None, ...]:
    """Hashes of the word before a span, and of its patterns: the word before, the two before, the words around.
    Edges that stand at the span itself (brackets, quotes) belong to none."""
    while start > 0 and text[start - 1] in EDGE:
        start -= 1
    while end < len(text) and text[end] in EDGE:
        end += 1
    left = _before(text, start)
    if not left:
        return None, None, None, None
    said = any(c.isalnum() for c in left[0])
    right = _after(text, end) if said else ""
    pair = len(left) > 1 and (said or any(c.isalnum() for c in left[1]))
    return (_hash("W", left[0]), _hash("L1", left[0]) if said else None, _hash("L2", left[1], left[0]) if pair else None,
            _hash("L1R1", left[0], right) if right else None)


def filler(text: str, start: int, end: int, limit: int, most: int = 10) -> tuple[int, int]:
    """The candidate that the word at (start, end) begins, without edges; start = end if nothing is left.

    A run of words with digits, or of up to five capitals between them, has at most ``most`` words, ends before
    ``limit`` and at a word with an edge behind it.
    """
    stop = end
    while end > start and text[end - 1] in EDGE:
        end -= 1
    while start < end and text[start] in EDGE:
        start += 1
    more, at = end == stop and DIGIT.search(text, start, end), end
    while more and most > 1 and (word := WORD.search(text, at)):
        a, at = word.span()
        cut = at
        while cut > a and text[cut - 1] in EDGE:
            cut -= 1
        digits = DIGIT.search(text, a, cut)
        if at > limit or text[a] in EDGE or not (digits or CAPITALS.fullmatch(text, a, at)):
            break
        if digits:
            end = cut
        more, most = cut == at, most - 1
    return start, end


def keys(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans of the keys that overlap no entity."""
    found = [m.span() for m in KEY.finditer(text)]
    return [(s, e) for s, e in found if not any(a < e and s < b for _, a, b in spans)] if found else found


_CTX = "inst long, w long, l1 long, l2 long, r1 long, t long"
FOUND = ("n_email long, n_ip long, n_card long, n_phone long, base_spans string, "
         "seeds array<struct<start:int,end:int,base:boolean,inst:long,w:long,l1:long,l2:long,r1:long>>")
_SEEDS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), *(
    (c, pa.int64()) for c in ("inst", "w", "l1", "l2", "r1"))]))


def seeds(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    out = []
    for s, e, base in [(s, e, True) for _, s, e in spans] + [(s, e, False) for s, e in keys(text, spans)]:
        w, l1, l2, r1 = contexts(text, s, e)
        out.append({"start": s, "end": e, "base": base, "inst": _hash(text[s:e]), "w": w, "l1": l1, "l2": l2, "r1": r1})
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names[:-1]
        for part in range(0, batch.num_rows, 2000):
            rows = batch.slice(part, 2000)
            counts, spans, inst = [[], [], [], []], [], []
            for v in rows.column(len(names)):
                text = v.as_py() or ""
                found = base_spans(text)
                for c, kind in zip(counts, KINDS):
                    c.append(sum(x[0] == kind for x in found))
                spans.append(written(found))
                inst.append(seeds(text, found))
            cols = [rows.column(i) for i in range(len(names))] + [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(spans, pa.string()), pa.array(inst, _SEEDS)],
                [*names, "n_email", "n_ip", "n_card", "n_phone", "base_spans", "seeds"])


# ---------------------------------------------------------------- places in the texts


class Memo(dict):
    """Answers of ``told`` by short text; forgets all of them rather than grow."""

    def __init__(self, told, most: int = 200_000):
        super().__init__()
        self.told, self.most = told, most

    def __missing__(self, key: str):
        value = self.told(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Filter:
    """A set of 64-bit hashes with false hits: two bits each in an array of 2**bits."""

    def __init__(self, data: bytes, bits: int):
        self.data, self.mask = data, (1 << bits) - 1

    def __contains__(self, h: int | None) -> bool:
        if h is None:
            return False
        a, b = h & self.mask, (h >> 32) & self.mask
        return bool(self.data[a >> 3] >> (a & 7) & 1 and self.data[b >> 3] >> (b & 7) & 1)


def bit_table(hashes: DataFrame, bits: int) -> bytes:
    """The filter of column ``h``: 2**bits bits whatever the number of rows; only they reach the driver."""
    mask = F.lit((1 << bits) - 1)
    at = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftright("h", 32).bitwiseAND(mask))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["i"].to_numpy()] = words["b"].to_numpy()
    return out.tobytes()


def _texts(batches) -> Iterator[tuple]:
    for batch in batches:
        for k, h, text in zip(batch.column(0), batch.column(1), batch.column(2)):
            value = text.as_py()
            if value:
                yield k, h, value


def count_places(texts: DataFrame, data: bytes, bits: int) -> DataFrame:
    """(pat, n): words that stand behind the words of the patterns in the filter, added up in each task first."""
    shared = texts.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        known, n = Filter(shared.value, bits), {}
        mark = lambda tag, word: h if (h := _hash(tag, word)) in known else 0
        # None: no pattern ends with the word; else its own pattern, 0 if only pairs do
        near = Memo(lambda w: mark("L1", w) if mark("W", w) else None)
        pair = Memo(lambda p: mark("L2", p))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["pat", "n"])

        for _, _, text in _texts(batches):
            words = text.lower().split()
            del text
            last = len(words) - 1
            for i, one in enumerate(map(near.__getitem__, words)):
                if one is not None and i < last:
                    if one:
                        n[one] = n.get(one, 0) + 1
                    two = pair[f"{words[i - 1]}\0{words[i]}"] if i else 0
                    if two:
                        n[two] = n.get(two, 0) + 1
            if len(n) > 500_000:
                yield out()
                n.clear()
        yield out()

    return texts.mapInArrow(run, "pat long, n long").groupBy("pat").agg(F.sum("n").alias("n"))


def places(texts: DataFrame, data: bytes, bits: int, behind: bool = True) -> DataFrame:
    """(k, h, start, end, inst, w, l1, l2, r1, t): candidates behind the words in the filter, or (``behind`` false)
    those that begin with a word in it; t stands for that word."""
    shared = texts.sparkSession.sparkContext.broadcast(data)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:2])
    kinds = [pa.int32(), pa.int32()] + [pa.int64()] * 6
    names = ["start", "end", "inst", "w", "l1", "l2", "r1", "t"]

    def candidates(text, known, near):
        taken, one = None, ""
        if behind and not any(map(near.__getitem__, text.lower().split())):
            return
        for m in WORD.finditer(text):
            word = m.group()
            if near[one if behind else word.strip(EDGE)]:
                if taken is None:
                    spans = base_spans(text)
                    taken = sorted([x[1:] for x in spans] + keys(text, spans))
                    begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
                start = m.start()
                while start < m.end() and text[start] in EDGE:
                    start += 1
                ahead = bisect_left(begins, start)
                s, e = filler(text, *m.span(), begins[ahead] if ahead < len(begins) else len(text))
                before = bisect_left(begins, e)
                if s < e and not (before and reach[before - 1] > s):
                    w, l1, l2, r1 = contexts(text, s, e)
                    if not behind or l1 in known or l2 in known:
                        yield s, e, _hash(text[s:e]), w, l1, l2, r1, _hash("T", word.strip(EDGE))
            one = word.lower()

    def run(batches):
        known = Filter(shared.value, bits)
        near = Memo(lambda w: w != "" and _hash("W" if behind else "T", w) in known)
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                lines = batch.slice(part, 2000)
                rows, cols = [], [[] for _ in kinds]
                for row, v in enumerate(lines.column(2)):
                    text = v.as_py()
                    for found in candidates(text, known, near) if text else ():
                        rows.append(row)
                        for c, x in zip(cols, found):
                            c.append(x)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([lines.column(0).take(at), lines.column(1).take(at),
                                                  *(pa.array(c, k) for c, k in zip(cols, kinds))], [*batch.schema.names[:2], *names])

    return texts.mapInArrow(run, f"{kept}, start int, end int, {_CTX}")


# ---------------------------------------------------------------- the graph


def _edges(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.explode(F.array_compact(F.array("l1", "l2", "r1"))).alias("pat"))


def score(graph: DataFrame, rounds: int, shrink: float) -> tuple[DataFrame, DataFrame]:
    """Patterns (pat, c, n, seeds) and instances (inst, s) of the distinct pairs (pat, inst, seed)."""
    marks = graph.select("inst", F.col("seed").cast("double").alias("s")).distinct()
    for _ in range(rounds):
        conf = graph.join(marks, "inst").groupBy("pat").agg(
            (F.sum("s") / (F.count(F.lit(1)) + F.lit(shrink))).alias("c"), F.count(F.lit(1)).alias("n"),
            F.count_if("seed").alias("seeds"))
        conf = save(conf, "pii-conf")
        marks = save(graph.join(conf.select("pat", "c"), "pat").groupBy("inst").agg(
            F.when(F.max("seed"), 1.0).otherwise(
                1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))).alias("s")), "pii-score")
    return conf, marks


def discover(texts: DataFrame, found: DataFrame, rounds: int = 3, min_instances: int = 5, min_seeds: int = 5,
             confidence: float = 0.7, accept: float = 0.9, shrink: float = 2.0, least_share: float = 0.02, hops: int = 2,
             bits: int = 24) -> DataFrame:
    """Rows (k, h, start, end) of the identifiers that accepted patterns point at in ``texts`` (k, h, text)."""
    own = found.select("k", "h", F.explode("seeds").alias("i")).select("k", "h", "i.*", F.lit(None).cast("long").alias("t"))
    known, hits = own, None
    for hop in range(hops):
        pats = known.select("inst", "w", F.explode(F.array_compact(F.array("l1", "l2"))).alias("pat"))
        wanted = save(pats.groupBy("pat").agg(F.count(F.lit(1)).alias("held"), F.count_distinct("inst").alias("seeds"),
                                              F.first("w").alias("w")).where(F.col("seeds") >= min_seeds), "pii-wanted")
        both = lambda d: d.select("pat").union(d.select("w")).toDF("h")
        n = count_places(texts, bit_table(both(wanted), bits), bits)
        opened = save(wanted.join(n, "pat").where(F.col("held") >= F.lit(least_share) * F.col("n")).select("pat", "w"), "pii-open")
        found_at = places(texts, bit_table(both(opened), bits), bits)
        # a pattern of the words around stands with its word before
        firsts = opened.select(F.col("pat").alias("l1"))
        seconds = opened.select(F.col("pat").alias("l2"))

        def only_open(rows):
            rows = rows.join(firsts.withColumn("o1", F.lit(True)), "l1", "left").join(seconds.withColumn("o2", F.lit(True)), "l2", "left")
            keep = lambda c, o: F.when(F.col(o), F.col(c)).alias(c)
            return (rows.where("o1 or o2")
                    .select("k", "h", "start", "end", "inst", keep("l1", "o1"), keep("l2", "o2"), keep("r1", "o1"), "t", "base", "seed"))

        at = only_open(found_at.withColumn("base", F.lit(False)).withColumn("seed", F.lit(False)))
        held = only_open(known.withColumn("seed", F.lit(True)))
        rows = save(at.unionByName(held), "pii-places")
        pairs = _edges(rows, "inst", "seed").groupBy("pat", "inst").agg(F.max("seed").alias("seed"))
        sure = pairs.groupBy("inst").agg(F.max("seed").alias("_s"))
        graph = save(pairs.join(sure, "inst").select("pat", "inst", F.col("_s").alias("seed")), "pii-graph")
        conf, marks = score(graph, rounds, shrink)
        good = conf.where((F.col("c") >= confidence) & (F.col("seeds") >= min_seeds) & (F.col("n") >= min_instances)).select("pat")
        met = (_edges(rows.where("not base"), "k", "h", "start", "end", "inst", "t", "seed").join(good, "pat")
               .join(marks.where(F.col("s") >= accept).select("inst"), "inst"))
        met = save(met.select("k", "h", "start", "end", "inst", "t", "seed").distinct(), "pii-met")
        hits = met if hits is None else hits.union(met)
        new = met.where("not seed").select("inst").distinct()
        new = save(new.join(known.select("inst"), "inst", "left_anti"), "pii-new")
        if hop + 1 == hops or new.isEmpty():
            break
        begun = met.join(new, "inst", "left_semi").select(F.col("t").alias("h")).distinct()
        again = places(texts, bit_table(begun, bits), bits, behind=False).join(new, "inst", "left_semi")
        known = save(known.unionByName(again.withColumn("base", F.lit(False))), "pii-known")
    return hits.select("k", "h", "start", "end").distinct()


def scan(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(k, h, text) of ``docs``, and one written row each: k, h (of the text), counts and spans of the entities, seeds."""
    src = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src, save(src.mapInArrow(_scan, f"{kept}, {FOUND}"), "pii-scan")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans (text 'kind:start:end', comma-joined)."""
    texts, found = scan(docs, key, text)
    extra = discover(texts, found, **options).groupBy("k", "h").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("x"))
    extra = extra.select(F.col("k").alias("k_"), F.col("h").alias("h_"), "x")
    more = F.array_join(F.transform("x", lambda s: F.concat_ws(":", F.lit("context"), s["start"], s["end"])), ",")
    return (found.join(extra, F.col("k").eqNullSafe(F.col("k_")) & (F.col("h") == F.col("h_")), "left").select(
        F.col("k").alias(key), "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans"), 256).alias("base_sha256"),
        F.when(F.col("x").isNull(), F.col("base_spans"))
        .when(F.col("base_spans") == "", more).otherwise(F.concat("base_spans", F.lit(","), more)).alias("spans")))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every found span replaced; null texts stay null. Same rows and columns."""
    k, h, x = fresh(docs, "_k"), fresh(docs, "_h"), fresh(docs, "_x")
    texts, found = scan(docs, key, text)
    # written, so that its size is known: few documents have such spans, and a small table is broadcast instead of moving all texts
    extra = save(discover(texts, found, **options).groupBy(F.col("k").alias(k), F.col("h").alias(h))
                 .agg(F.collect_set(F.struct("start", "end")).alias(x)), "pii-extra")
    joined = docs.join(extra, docs[key].eqNullSafe(F.col(k)) & (F.xxhash64(docs[text]) == F.col(h)), "left")
    joined = joined.select(*[docs[c] for c in docs.columns], x)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in range(0, batch.num_rows, 2000):
                rows = batch.slice(part, 2000)
                new = []
                for t, more in zip(rows.column(at), rows.columns[-1]):
                    value = t.as_py()
                    if value:
                        value = redacted(value, base_spans(value) + [("context", s["start"], s["end"]) for s in more.as_py() or ()])
                    new.append(value)
                cols = rows.columns[:-1]
                cols[at] = pa.array(new, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def sha256_of_spans(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
