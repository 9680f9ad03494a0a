"""Tokens, personal data, pages, shards, quality, toxicity, mixing and the pipeline."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, common, html_text, mixing, packing, perplexity, pii, toxicity
from quarry.llm.queries import tokenizer

PATH, PATTERN = tokenizer()


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library(vocab):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(vocab, library):
    enc, r = bpe.Encoder(vocab, PATTERN), random.Random(1)
    parts = ["a", "b", " ", "é", "the", "ing", "\n", "日", "🙂", "  ", "'s", "1", "aaaa", "\x1c", "\x85", "\t", "ab" * 20, "--", "²", "ª", "\x00"]
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert enc.encode(s) == library.encode_ordinary(s)
        assert enc.decode_parts(enc.encode_parts(s)) == s.encode()
    long = "a" * 3000 + " " * 3000 + "word " * 3000
    assert enc.encode(long) == library.encode_ordinary(long)


def test_appends_and_edits_are_exact(vocab, library):
    r, data = random.Random(2), b""
    p = bpe.Prefixes(vocab)
    for _ in range(60):
        piece = r.choice([b"the", b"re", b"tion", b"x", "é".encode()])
        if r.random() < 0.6:
            data += piece
            p.append(piece)
        else:
            a = r.randint(0, len(data))
            b = min(len(data), a + r.randint(0, 3))
            data = data[:a] + piece + data[b:]
            p.edit(a, b, piece)
        assert p.ids() == library._core_bpe.encode_single_piece(data)
        k = r.randint(1, len(data))
        assert p.ids(k) == library._core_bpe.encode_single_piece(data[:k])


def test_new_pieces_share_the_table_of_their_common_beginnings(vocab, library, monkeypatch):
    words = ["xqthzk" + a + b + c for a in "bcdfg" for b in "hjklm" for c in "npqrs"]
    random.Random(4).shuffle(words)
    filled, append = [], bpe.Prefixes.append
    monkeypatch.setattr(bpe.Prefixes, "append", lambda self, more: (filled.append(len(more)), append(self, more))[1])
    enc, texts = bpe.Encoder(vocab, PATTERN), [" ".join(words[:60]), "", " ".join(words[60:])]
    assert enc.encode(" ".join(texts[:1] + texts[2:])) == library.encode_ordinary(" ".join(texts[:1] + texts[2:]))
    assert sum(filled) < sum(map(len, words)) / 3
    many = bpe.Encoder(vocab, PATTERN).encode_many(texts)
    assert [[int(x) for x in " ".join(m).split()] for m in many] == [library.encode_ordinary(t) for t in texts]


def test_training_samples_are_taken_in_blocks():
    """The driver holds the words and 4-grams of a sample, but not what makes them, for all of it at once."""
    import tracemalloc

    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(600)) for _ in range(600)]
    size, found = sum(map(len, texts)), {}
    common.powers(common._P, 1 << 22), common.powers(common._PINV, 1 << 22)  # kept by a worker, not counted here
    for name, make in (("words", lambda: toxicity.Words(texts)), ("grams", lambda: mixing.Classifier(["a", "b"]).train(
            texts, np.arange(600) % 2, rounds=1))):
        tracemalloc.start()
        make()
        found[name] = tracemalloc.get_traced_memory()[1] / size
        tracemalloc.stop()
    assert found["words"] < 65 and found["grams"] < 55  # bytes a byte of the sample; held whole: 95 and 66


def test_training_runs_in_a_task(spark, docs, labels, monkeypatch):
    """The driver's memory stays free of the samples and of what training on them takes."""
    monkeypatch.setattr(toxicity, "train", lambda *_: os.getpid())
    assert toxicity.fit(docs, labels) != os.getpid()

    def here(*_):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(mixing.Classifier, "train", here)
    assert mixing.fit(docs, mixing.quality_domains(labels), ["good", "poor", "toxic"]).gram.any()


def test_blocks_of_the_samples_change_nothing(monkeypatch):
    texts = ["", " ", "a", "Some wörds and some more " * 9, *(f"text {i} of " + "letters " * i for i in range(40))]
    whole, y = toxicity.Words(texts), np.arange(len(texts)) % 3
    net = toxicity.Network(np.sort(whole.hash[::2]))
    one = mixing.Classifier(["a", "b", "c"])
    one.train(texts, y, rounds=5)
    want = net.inputs(whole)
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    monkeypatch.setattr(mixing, "portions", lambda n, size: ((i, min(i + 4, len(n))) for i in range(0, len(n), 4)))
    cut = toxicity.Words(texts)
    for name in ("hash", "number", "first", "gram", "owner"):
        assert np.array_equal(getattr(whole, name), getattr(cut, name))
    assert all(np.array_equal(a, b) for a, b in zip(want, net.inputs(cut)))
    two = mixing.Classifier(["a", "b", "c"])
    two.train(texts, y, rounds=5)
    assert np.array_equal(one.gram, two.gram) and np.array_equal(one.share, two.share) and np.array_equal(one.bias, two.bias)


def test_encoding_of_odd_rows(docs, nothing, library):
    rows = bpe.encode_column(docs, PATH, PATTERN).collect()
    texts = Counter(r[0] or "" for r in docs.select("text").collect())
    want = Counter()
    for t, n in texts.items():
        ids = library.encode_ordinary(t)
        want[len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert Counter(tuple(r[1:]) for r in rows) == want
    assert bpe.encode_column(nothing, PATH, PATTERN, digest=False).count() == 0


CASES = ["mail a.b+c@x-y.co.uk, or a@b", "a@b.c_d@e.f @x.y z@", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 999999999999.1.1.1", "+1 (947) 555-7668 +12 +1-2",
         "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8796", "é 🙂 a@b.de " * 3, "x" * 4000 + "@" + "y." * 2000, "1" * 6000, "+" * 2000 + "9" * 30]


def plain(text):
    """The four rules by regular expression alone."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]


def test_base_spans_as_by_rule():
    r = random.Random(3)
    for t in CASES + ["".join(r.choice("a1.@+- (é_9") for _ in range(r.randint(0, 60))) for _ in range(3000)]:
        assert pii.base_spans(t) == plain(t), t


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"note {i} please call number {'+1 (212) 555-%04d' % (1000 + i)} today thanks {i}") for i in range(40)]
    rows += [(100 + i, f"you can call number 77-{12345 + i}-X today or not") for i in range(3)]
    rows += [(200, "just 1234567 words"), (201, None), (202, ""), (203, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert len(got) == len(rows) and got[0]["n_phone"] == 1 and got[200]["spans"] == "" and got[201]["n_email"] == 0
    text = dict(rows)[100]
    a = text.index("77-")
    assert got[100]["spans"] == f"context:{a}:{a + len('77-12345-X')}"
    assert got[0]["spans"] == pii.written(plain(rows[0][1]))
    assert got[0]["base_sha256"] == hashlib.sha256(got[0]["spans"].encode()).hexdigest()
    clean = {r[0]: r[1] for r in pii.redact(df).collect()}
    assert clean[100] == "you can call number <CONTEXT> today or not" and "<PHONE>" in clean[0] and clean[201] is None


def plain_discovery(rows, min_seeds=5, least_share=0.02, hops=2):
    """The spans of pii.discover by loops over all words of all texts: {(doc_id, start, end)}."""
    texts = {i: t or "" for i, t in rows}
    own, taken = [], {}
    for i, t in texts.items():
        spans = pii.base_spans(t)
        own += [(i, x["start"], x["end"], x["base"], x["inst"], x["w"], x["l1"], x["l2"], x["r1"]) for x in pii.seeds(t, spans)]
        taken[i] = [x[1:] for x in spans] + pii.keys(t, spans)
    every, behind = [], {}
    for i, t in texts.items():
        for m in pii.WORD.finditer(t):
            left = pii._before(t, m.start())
            for pat in [pii._hash("L1", *left[:1])][:len(left)] + [pii._hash("L2", *left[::-1])][:len(left) // 2]:
                behind[pat] = behind.get(pat, 0) + 1
            start = m.start() + len(m.group()) - len(m.group().lstrip(pii.EDGE))
            s, e = pii.filler(t, *m.span(), min([a for a, _ in taken[i] if a >= start], default=len(t)))
            if s < e and not any(a < e and s < b for a, b in taken[i]):
                every.append((i, s, e, False, pii._hash(t[s:e]), *pii.contexts(t, s, e)))
    known, out = list(own), set()
    for _ in range(hops):
        opened = set()
        for pat in {p for r in known for p in r[6:8] if p}:
            held = [r for r in known if pat in r[6:8]]
            if len({r[4] for r in held}) >= min_seeds and len(held) >= least_share * behind[pat]:
                opened.add(pat)
        edges = {}
        rows_ = [(r, False) for r in every] + [(r, True) for r in known]
        seeded = {r[4] for r in known}
        pats = lambda r: [p for p in (r[6] if r[6] in opened else None, r[7] if r[7] in opened else None,
                                      r[8] if r[6] in opened else None) if p]
        for r, _ in rows_:
            for pat in pats(r):
                edges.setdefault(pat, set()).add(r[4])
        score = {x: float(x in seeded and any(r[4] == x and pats(r) for r in known)) for v in edges.values() for x in v}
        sure = {x for x, v in score.items() if v}
        for _ in range(3):
            conf = {pat: sum(score[x] for x in v) / (len(v) + 2) for pat, v in edges.items()}
            for x in score:
                miss = 1.0
                for pat, v in edges.items():
                    miss *= max(1 - conf[pat], 1e-9) if x in v else 1
                score[x] = 1.0 if x in sure else 1 - miss
        good = {pat for pat, v in edges.items() if conf[pat] >= 0.7 and len(v) >= 5 and len(v & sure) >= min_seeds}
        met = {(r, seed) for r, seed in rows_ if not r[3] and score.get(r[4], 0) >= 0.9 and any(p in good for p in pats(r))}
        out |= {r[:3] for r, _ in met}
        new = {r[4] for r, seed in met if not seed} - seeded
        known += [r for r in every if r[4] in new]
    return out


def test_bootstrapping_equals_loops_and_goes_on(spark):
    hexes = [hashlib.sha256(str(i).encode()).hexdigest()[:40] for i in range(30)]
    rows = [(i, f"a{i} note call number +1 (212) 555-{1000 + i} today b{i}") for i in range(40)]
    rows += [(100, "you can call number 212 555 0199 today or not"), (101, "please call number 123 45 6789, or 77"),
             (102, "my call number GB29 NWBK 6016 1331 9268 19 is"), (103, "the call number (AB-1234) again"), (104, "call number jdoe ok")]
    # found behind the first pattern, seeds of a second one, which finds what the first cannot
    rows += [(110 + i, f"he may call number X{i}-77 soon") for i in range(8)] + [(120 + i, f"see badge of X{i}-77 there") for i in range(8)]
    rows += [(130, "see badge of anna-b there")]
    rows += [(140 + i, f'x{i} token = "{h}" y{i}') for i, h in enumerate(hexes)]
    rows += [(190, 'z token = "short one" q'), (191, f"checksum {hexes[0]}"), (192, "the token is = 7")]
    # a word as common as "the" stands before seeds, too, and points at nothing
    rows += [(200 + i, f"the me{i}@mail.example.com of the house" + " the tree by the sea" * 200) for i in range(6)]
    rows += [(300, None), (301, ""), (302, " "), (303, "the"), (304, rows[40][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    assert len(got) == len(rows)
    text = dict(rows)
    found = {(i, int(x.split(":")[1]), int(x.split(":")[2])) for i, v in got.items() for x in v.split(",") if x.startswith("context")}
    assert found == plain_discovery(rows)
    caught = {i: {text[j][a:b] for j, a, b in found if j == i} for i in got}
    assert caught[100] == caught[304] == {"212 555 0199"} and caught[101] == {"123 45 6789"} and caught[103] == {"AB-1234"}
    assert caught[102] == {"GB29 NWBK 6016 1331 9268 19"}
    assert caught[104] == {"jdoe"} and all(caught[110 + i] == {f"X{i}-77"} for i in range(8))
    assert all(caught[120 + i] == {f"X{i}-77"} for i in range(8)) and caught[130] == {"anna-b"}
    assert all(caught[140 + i] == {h} for i, h in enumerate(hexes)) and caught[190] == {"short"} and caught[191] == set()
    assert not any(caught[i] for i in (*range(40), 192, *range(200, 206), 300, 301, 302, 303))
    clean = {r[0]: r[1] for r in pii.redact(df).collect()}
    assert clean[140] == 'x0 token = "<CONTEXT>" y0' and clean[205].startswith("the <EMAIL> of")


def test_personal_data_of_odd_rows(docs, nothing):
    assert pii.find(nothing).count() == 0 and pii.find(docs).count() == docs.count()
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><header>Head</header>"
     "<div class='sidebar'><p>Side, side, side</p></div><article><h1>Title</h1><p>First, second &amp; third,\n\t fourth. <b>bold<br><p>Next one<script>"
     "var a='</p>'</script> here, &eacute; &#8364;</article><div id=comments><p>A, reader, says</div><footer>&copy; me</footer>",
     "Title\nFirst, second & third, fourth. bold\nNext one here, é €"),
    ("<body><div class='content has-sidebar'><section><p>One, two, three, four words.</p></section><section><p>Five, six, seven, eight words.</p></section></div></body>",
     "One, two, three, four words.\nFive, six, seven, eight words."),
    ("<div class=cookie-notice>We use</div>plain &lt;text&gt; alone", "plain <text> alone"),
    ("", ""), (None, ""), ("<p", ""), ("<!-- only", ""), ("<script>x", ""), ("a < b", "a < b"), ("<nav>x</nav>", ""),
    ("<div>" * 3000 + "deep, text" + "</span>" * 3000, "deep, text"),
    ("<ul>" + "<li>a, b" * 3 + "</ul>", "a, b\na, b\na, b"),
]


def test_main_text_of_pages(spark):
    for html, want in PAGES:
        assert html_text.main_text(html) == want
    rows = [(i, f"u{i}", h, "text") for i, (h, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], "x"), (None, "u", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and {(r[0], r[2], r[3]) for r in got if r[0]} == {(i, w, len(w)) for i, (_, w) in enumerate(PAGES) if i}
    assert html_text.extract(df.where("1 = 0")).count() == 0


def test_best_fit_takes_the_tightest_bin():
    r = random.Random(3)
    for _ in range(200):
        sizes = sorted((r.randint(1, 40) for _ in range(r.randint(0, 60))), reverse=True)
        cap, room, want = r.randint(20, 80), [], []
        for s in sizes:
            fit = [(x, i) for i, x in enumerate(room) if x >= s]
            i = min(fit)[1] if fit else len(room)
            if not fit:
                room.append(max(cap, s))
            room[i] -= s
            want.append(i)
        assert packing.pack(sizes, cap) == want


def test_shards_hold_whole_groups_evenly(spark, docs, nothing):
    r = random.Random(4)
    more = spark.createDataFrame([(1000 + i, "w" * int(r.paretovariate(1.1) * 20)) for i in range(800)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    got = packing.assign(df, shards=8).collect()
    texts = defaultdict(set)
    for k, t in df.collect():
        texts[k].add(t or "")
    assert len(got) == df.count()
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for x in got:
        assert x["law"] == "bytes" and x["grown_shard"] is None
        t = next(t for t in texts[x["doc_id"]] if zlib.crc32(t.encode()) == x["text_crc32"])
        assert x["size"] == len(t.encode()) + 1
        load[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        where[t].add(x["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(sum(x["size"] for x in got if x["text_crc32"] == zlib.crc32(t.encode())) for t in where)
    assert max(load.values()) <= max(largest, 1.02 * sum(load.values()) / 8) and set(load) <= set(range(8))
    assert packing.assign(nothing).count() == 0


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def kneser_ney(texts):
    """Probability of every 5-gram by the formulas, in plain Python."""
    n, table = perplexity.ORDER, Counter()
    for t in texts:
        b = b"\x02" * (n - 1) + t.encode()
        table.update(b[i:i + n] for i in range(len(b) - n + 1))
    tables = {n: table}
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    probs = {b"": 1 / 256}
    low = {b"": 1 / 256}
    for k in range(1, n + 1):
        c = tables[k]
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        d = [0] + [max(0.05, min(i - (i + 1) * y * m[i + 1] / m[i], i - 0.05)) if m[1] and m[i] and m[i + 1] else 0.5 for i in (1, 2, 3)]
        total, cut = Counter(), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            cut[g[:-1]] += d[min(x, 3)]
        probs = {g: (x - d[min(x, 3)]) / total[g[:-1]] + cut[g[:-1]] / total[g[:-1]] * (low[b""] if k == 1 else low[g[1:]]) for g, x in c.items()}
        low = probs
    return probs


def test_perplexity_as_brute_force(spark):
    r = random.Random(6)
    texts = {i: " ".join(r.choice("the cat sat on a mat and then left".split()) for _ in range(30)) for i in range(40)}
    texts |= {100: "zq xv " * 15, 101: None, 102: "", 103: " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(30))}
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in perplexity.judge(df, low=1.5, high=1.5).collect()}
    p = kneser_ney([t for t in texts.values() if t])
    for i, t in texts.items():
        x = got[i]
        assert tuple(x[c] for c in perplexity.COUNTS) == brute_counts(t)
        if t:
            b = b"\x02" * 4 + t.encode()
            assert x["log_perplexity"] == pytest.approx(-np.mean([np.log(p[b[k:k + 5]]) for k in range(len(b) - 4)]), rel=1e-4)
    assert got[100]["base_failed"] and got[101]["base_failed"] and not got[103]["base_failed"]
    good = sorted(x["deviations"] for x in got.values() if not x["base_failed"])
    assert abs(good[(len(good) - 1) // 2]) < 1e-9 and 0.4 < sorted(map(abs, good))[len(good) // 2] < 0.9
    for x in got.values():
        assert x["kept"] == (not x["base_failed"] and abs(x["deviations"]) <= 1.5)
    assert {x["kept"] for x in got.values() if not x["base_failed"]} == {True, False}


def test_model_is_exact_in_any_chunks(spark):
    r = random.Random(14)
    texts = [" ".join(r.choice("the cat sat on a mat and then left".split()) for _ in range(30)) for _ in range(12)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    p = kneser_ney(texts)
    for x in perplexity.judge(df, size=500).collect():
        b = b"\x02" * 4 + texts[x["doc_id"]].encode()
        assert x["log_perplexity"] == pytest.approx(-np.mean([np.log(p[b[k:k + 5]]) for k in range(len(b) - 4)]), rel=1e-9)


def test_model_travels_in_packed_rows(spark):
    """About a row for each chunk and bucket, not one for each n-gram of each chunk and order."""
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(200)), "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    chunks = perplexity.gather(docs, "doc_id", "text", F.lit(1).cast("long"), 10_000)
    needs, _ = perplexity.model(chunks)
    n, total = chunks.count(), chunks.agg(F.sum("n")).first()[0]
    assert n >= 3 and needs.count() <= n * 17 < total / 10
    assert sum(len(x["grams"]) for x in needs.where("grams IS NOT NULL").collect()) < 30 * total  # of all orders; as rows over 100


def test_packed_arrays_come_back():
    arrays = [np.array([0, 255, 256, (1 << 40) - 1]), np.empty(0, np.int64), np.zeros(3, np.int64), np.arange(300)]
    assert all(np.array_equal(a, b) for a, b in zip(arrays, perplexity.unpack(perplexity.pack(*arrays)), strict=True))


def test_held_out_score_is_that_of_the_other_texts(spark):
    """A text's score with its own counts out equals brute force over the other texts (discounts of all texts)."""
    r = random.Random(12)
    texts = [" ".join(r.choice("the cat sat on a mat and then left".split()) for _ in range(30)) for _ in range(12)]
    texts += [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(25))] * 2  # a text and its copy
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["held_out"] for x in perplexity.judge(df, size=500).collect()}
    n = perplexity.ORDER

    def tables(some):
        out = {n: Counter(g for t in some for b in [b"\x02" * (n - 1) + t.encode()] for g in (b[i:i + n] for i in range(len(b) - n + 1)))}
        for k in range(n - 1, 0, -1):
            out[k] = Counter(g[1:] for g in out[k + 1])
        return out

    cuts = {}
    for k, c in tables(texts).items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        cuts[k] = [0] + [max(0.05, min(i - (i + 1) * y * m[i + 1] / m[i], i - 0.05)) if m[1] and m[i] and m[i + 1] else 0.5 for i in (1, 2, 3)]
    for i, t in enumerate(texts):
        left = tables([x for x in texts if x != t])
        total = {k: Counter() for k in left}
        mass = {k: Counter() for k in left}
        for k, c in left.items():
            for g, x in c.items():
                total[k][g[:-1]] += x
                mass[k][g[:-1]] += cuts[k][min(x, 3)]

        def p(g):
            if not g:
                return 1 / 256
            k, s = len(g), total[len(g)][g[:-1]]
            if not s:
                return p(g[1:])
            x = left[k][g]
            return (x - cuts[k][min(x, 3)] + mass[k][g[:-1]] * p(g[1:])) / s

        b = b"\x02" * (n - 1) + t.encode()
        assert got[i] == pytest.approx(-np.mean([np.log(p(b[j:j + n])) for j in range(len(b) - n + 1)]), rel=1e-6)


def test_production_bands_reject_planted_noise(spark):
    r = random.Random(13)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").collect()
    long = [[x["text"] for x in rows if x["lang"] == g and len(x["text"] or "") > 800 and len(set(x["text"].split())) > 100]
            for g in ("en", "fr")]
    noise = {}
    for i in range(4):
        noise[1000 + i] = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in long[0][i])
        code = base64.b64encode(r.randbytes(900)).decode()
        noise[1100 + i] = " ".join(code[j:j + 12] for j in range(0, len(code), 12))
        noise[1200 + i] = "".join(r.sample(long[0][10 + i], len(long[0][10 + i])))
        noise[1300 + i] = long[1][i]  # off language
    docs = [(i, x["text"], x["lang"]) for i, x in enumerate(rows) if x["text"] not in noise.values()]
    df = spark.createDataFrame(docs + [(1_000_000 + i, t, "en") for i, t in noise.items()], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in perplexity.judge(df).collect()}
    wrong = [(i, got[1_000_000 + i]["deviations"]) for i in noise if got[1_000_000 + i]["kept"]]
    assert not wrong
    good = [x for i, x in got.items() if i < 1_000_000 and not x["base_failed"]]
    assert np.mean([x["kept"] for x in good]) > 0.9


def test_quality_of_odd_rows(docs, nothing):
    got = perplexity.judge(docs).collect()
    assert len(got) == docs.count() and perplexity.judge(nothing).count() == 0
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    for x in got:
        assert tuple(x[c] for c in perplexity.COUNTS) == brute_counts(texts[x["doc_id"]])
        assert x["base_failed"] == (x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"])
        assert not (x["kept"] and x["base_failed"])


def test_gradients_by_differences():
    words = toxicity.Words(["one two three four five six seven", "eight nine ten one"])
    _, idx = words.windows(8)
    net = toxicity.Network(np.sort(words.hash))
    y = np.array([1.0, 0.0], np.float32)

    def loss():
        z = net.forward(net.inputs(words)[0], idx).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    keep: dict = {}
    vectors = net.inputs(words)[0]
    z = net.forward(vectors, idx, keep)
    assert np.allclose(z, net.quick(vectors, idx), atol=1e-5)
    g, _ = net.backward(vectors, idx, keep, ((1 / (1 + np.exp(-z)) - y) / 2).astype(np.float32))
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old = v[at]
        v[at] = old + 1e-2
        up = loss()
        v[at] = old - 1e-2
        down = loss()
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4), k


def test_toxicity_on_held_out_texts(spark):
    r = random.Random(7)
    common = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, known = [], []
    for i in range(500):
        w = [r.choice(common) for _ in range(r.randint(5, 200))]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(len(w))] = "vile" + r.choice(["x", "yz", "q", "on"])
        rows.append((i, " ".join(w)))
        known.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in toxicity.classify(docs, spark.createDataFrame(known, "doc_id long, toxic int")).collect()}
    test = [(i, t) for i, t in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in test) and len(got) == 502
    assert np.mean([got[i]["predicted"] == t for i, t in test]) >= 0.95
    assert 0 <= got[900]["score"] == got[901]["score"] < 0.5


def test_toxicity_of_odd_rows(docs, labels, nothing):
    assert toxicity.classify(docs, labels).count() == docs.count()
    assert toxicity.classify(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity.classify(docs, labels.where("1 = 0")).collect()} == {0.0}


def test_mixing_reaches_its_targets(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["lorem", "ipsum", "dolor"] if i % 3 else ["ALPHA!", "BETA!", "###"]) for _ in range(r.randint(5, 60)))) for i in range(600)]
    labelled = spark.createDataFrame([(i, "good" if i % 3 else "poor") for i in range(0, 600, 4)], "doc_id long, domain string")
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), labelled, {"good": 0.9, "poor": 0.1}).collect()
    n = np.array([x["n_tokens"] for x in out], float)
    p = np.array([[x["p_good"], x["p_poor"]] for x in out])
    rate, copies = np.array([x["rate"] for x in out]), np.array([x["copies"] for x in out])
    assert (rate >= 0).all() and np.allclose((n * rate) @ p / n.sum(), [0.9, 0.1], atol=1e-3)
    assert (np.abs(copies - rate) < 1).all() and abs(((n * copies) @ p / n.sum())[1] - 0.1) < 0.04
    assert np.mean([(x["p_poor"] > 0.5) == (x["doc_id"] % 3 == 0) for x in out]) > 0.95


def test_mixing_of_odd_rows(docs, labels, nothing):
    domains = mixing.quality_domains(labels)
    targets = {"good": 0.6, "poor": 0.3, "toxic": 0.1}
    assert mixing.mix(docs, domains, targets).count() == docs.count()
    assert mixing.mix(nothing, domains, targets).count() == 0
    out = mixing.resample(docs, domains.where("1 = 0"), targets)
    assert out.columns == docs.columns


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, names = [docs.count()], [n for n, _ in corpus_pipeline.STAGES]
    first = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        sizes.append(out.count())
        if i < len(names) - 1:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in first.schema]
        docs = out
    assert names == ["toxicity", "near_dedup", "pii", "mixing", "byte_bpe"]
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] and sizes[4] == sizes[5] > 0
