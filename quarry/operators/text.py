"""Rule-based text analysis over (key, text) rows: native expressions, whole texts.

Every task keys its output by the caller's key columns (never by the text, which repeats).
Null texts are dropped; an input with no text is the caller's concern (``require_texts``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (CATEGORIES, DATE_PATTERN, EMBEDDING_DIM, LANGUAGE_NAMES, LANGUAGE_STOP_WORDS,
                              MONEY_PATTERN, NEGATIVE_WORDS, PERSON_PATTERN, POSITIVE_WORDS, STOP_WORDS,
                              alpha3_tokens, category_scores, contains_any_count, in_words, md5_bucket, substring_count,
                              word_tokens)

Key = str | Sequence[str]


def _keys(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def texts(df: DataFrame, key: Key, text: str) -> DataFrame:
    """(key..., text) with null texts dropped and the text cast to string."""
    ks = _keys(key)
    return df.where(F.col(text).isNotNull()).select(*ks, F.col(text).cast("string").alias("text"))


def require_texts(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("no valid text data found in the selected column")


def _conf(base: float, score: Column) -> Column:
    return F.least(F.lit(0.9), F.lit(base) + score.cast("double") * F.lit(0.1))


# ---------------------------------------------------------------- per-text tasks


def sentiment(df: DataFrame, key: Key, text: str = "text") -> DataFrame:
    """key, sentiment, confidence, positive_hits, negative_hits."""
    t = texts(df, key, text).select(*_keys(key), F.lower(F.col("text")).alias("lt"))  # lowered once
    lt = F.col("lt")
    pos, neg = contains_any_count(lt, POSITIVE_WORDS), contains_any_count(lt, NEGATIVE_WORDS)
    s = t.select(*_keys(key), pos.alias("positive_hits"), neg.alias("negative_hits"))
    p, n = F.col("positive_hits"), F.col("negative_hits")
    return s.select(*_keys(key), F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral").alias("sentiment"),
                    F.when(p > n, _conf(0.6, p - n)).when(n > p, _conf(0.6, n - p)).otherwise(F.lit(0.5)).alias("confidence"),
                    "positive_hits", "negative_hits")


def classify(df: DataFrame, key: Key, text: str = "text",
             categories: Mapping[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    """key, category, confidence: keyword hits per category, first category wins ties, none -> other."""
    names = list(categories)
    t = texts(df, key, text).select(*_keys(key), F.lower(F.col("text")).alias("lt"))  # lowered once
    scores = category_scores(F.col("lt"), categories)
    s = t.select(*_keys(key), *[sc.alias(f"_s{i}") for i, sc in enumerate(scores)])
    best = F.greatest(*[F.col(f"_s{i}") for i in range(len(names))]) if len(names) > 1 else F.col("_s0")
    cat = F.lit("other")
    for i in reversed(range(len(names))):
        cat = F.when(F.col(f"_s{i}") == best, F.lit(names[i])).otherwise(cat)
    return s.select(*_keys(key), F.when(best > 0, cat).otherwise(F.lit("other")).alias("category"),
                    F.when(best > 0, _conf(0.5, best)).otherwise(F.lit(0.5)).alias("confidence"))


def parse_labels(labels: str, keywords: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """Caller's comma-separated labels (trimmed); each label is its own keyword unless given."""
    out = {}
    for lab in (x.strip() for x in labels.split(",")):
        if lab:
            out[lab] = list((keywords or {}).get(lab, [lab]))
    return out


def entities(df: DataFrame, key: Key, text: str = "text", limit: int | None = None) -> DataFrame:
    """key, entities: array<struct<entity,type,start,end>>: names, then dates, then money (the first ``limit`` if given).

    ``start`` is the first occurrence of the entity string (0-based), ``end`` = start + length.
    """
    t = texts(df, key, text)
    s = F.col("text")

    def tagged(pattern: str, kind: str) -> Column:
        found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
        at = F.transform(found, lambda e: F.struct(e.alias("e"), (F.instr(s, e) - 1).alias("at")))  # looked up once
        return F.transform(at, lambda x: F.struct(
            x["e"].alias("entity"), F.lit(kind).alias("type"), x["at"].alias("start"), (x["at"] + F.length(x["e"])).alias("end")))

    allx = F.concat(tagged(PERSON_PATTERN, "PERSON"), tagged(DATE_PATTERN, "DATE"), tagged(MONEY_PATTERN, "MONEY"))
    return t.select(*_keys(key), (allx if limit is None else F.slice(allx, 1, limit)).alias("entities"))


def embedding(df: DataFrame, key: Key, text: str = "text", dim: int = EMBEDDING_DIM) -> DataFrame:
    """key, embedding (array<float>, L2-normalised hashed bag of words), dimension.

    A row's result depends on its own text only: buckets are native expressions, counting them is one Arrow batch
    function, so nothing is shuffled.
    """
    @F.pandas_udf("array<float>")
    def weights(buckets: pd.Series) -> pd.Series:
        out = []
        for b in buckets:
            c = np.bincount(np.asarray(b, np.int64), minlength=dim).astype(np.float64)
            n = np.sqrt((c * c).sum())
            out.append((c / n if n > 0 else c).astype(np.float32))
        return pd.Series(out)

    buckets = F.transform(word_tokens(F.col("text")), lambda w: md5_bucket(w, dim))
    return texts(df, key, text).select(*_keys(key), weights(buckets).alias("embedding"), F.lit(dim).alias("dimension"))


def summary(df: DataFrame, key: Key, text: str = "text", short_passthrough: bool = False,
            short_len: int = 100) -> DataFrame:
    """key, summary, compression_ratio: first + '. ' + last full-stop part (texts with <= 2 parts kept).

    The ratio uses the summary before stripping; an empty text has ratio 1.0. With
    ``short_passthrough`` texts under ``short_len`` characters are their own summary (ratio 1.0).
    """
    t = texts(df, key, text)
    s = F.col("text")
    parts = F.split(s, r"\.", -1)
    raw = F.when(F.size(parts) <= 2, s).otherwise(F.concat(F.element_at(parts, 1), F.lit(". "), F.element_at(parts, -1)))
    stripped = F.regexp_replace(raw, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")
    ratio = F.when(F.length(s) > 0, F.length(raw) / F.length(s)).otherwise(F.lit(1.0))
    if short_passthrough:
        short = F.length(s) < short_len
        stripped, ratio = F.when(short, s).otherwise(stripped), F.when(short, F.lit(1.0)).otherwise(ratio)
    return t.select(*_keys(key), stripped.alias("summary"), ratio.alias("compression_ratio"))


def corpus_topics(df: DataFrame, key: Key, text: str = "text", k: int = 5) -> DataFrame:
    """rank, topic, count: the k most frequent words (3+ ASCII letters) of the corpus, ties by first use."""
    ks = _keys(key)
    t = texts(df, key, text)
    tok = t.select(*ks, F.posexplode(alpha3_tokens(F.col("text"))).alias("pos", "w"))
    first = F.struct(*[F.col(c) for c in ks], F.col("pos"))
    c = tok.groupBy("w").agg(F.count(F.lit(1)).alias("count"), F.min(first).alias("first"))
    top = c.orderBy(F.col("count").desc(), F.col("first")).limit(k)  # distributed top-k
    return top.select(F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("first"))).alias("rank"),
                      F.col("w").alias("topic"), "count")


def topics(df: DataFrame, key: Key, text: str = "text", k: int = 5) -> DataFrame:
    """key, topic, confidence: the corpus topic occurring most often in the text (first on ties)."""
    top = corpus_topics(df, key, text, k)
    arr = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"])
                  ).scalar()  # k words, computed once
    # the topic array is computed once (scalar subquery) and attached as a column, because a
    # subquery may not sit inside a lambda
    t = texts(df, key, text).select(*_keys(key), F.lower(F.col("text")).alias("lt"), arr.alias("_topics"))
    arr = F.col("_topics")
    lt = F.col("lt")  # a column, not an expression re-run inside the lambda for every topic
    scored = F.transform(arr, lambda w, i: F.struct(substring_count(lt, w).alias("score"), (-i).alias("neg_i"),
                                                    w.alias("topic")))
    best = F.array_max(scored)
    return t.select(*_keys(key), F.when(F.size(arr) > 0, best["topic"]).otherwise(F.lit("general")).alias("topic"),
                    F.when(F.size(arr) > 0, _conf(0.5, best["score"])).otherwise(F.lit(0.5)).alias("confidence"))


def language(df: DataFrame, key: Key, text: str = "text") -> DataFrame:
    """key, language, language_code, confidence: stop-word vote over en / fr / de / es.

    Confidence is the winner's share of all stop-word hits; no hit -> English with 0.5.
    """
    t = texts(df, key, text).select(*_keys(key), word_tokens(F.col("text")).alias("toks"))  # tokenised once
    toks = F.col("toks")
    codes = list(LANGUAGE_STOP_WORDS)
    def hit_count(words):
        return F.size(F.filter(toks, lambda w: in_words(w, words)))

    hits = [hit_count(ws) for ws in LANGUAGE_STOP_WORDS.values()]
    s = t.select(*_keys(key), *[h.alias(f"_h_{c}") for h, c in zip(hits, codes)])
    best = F.greatest(*[F.col(f"_h_{c}") for c in codes])
    total = sum((F.col(f"_h_{c}") for c in codes), F.lit(0))
    code = F.lit(codes[0])
    for c in reversed(codes):
        code = F.when(F.col(f"_h_{c}") == best, F.lit(c)).otherwise(code)
    code = F.when(best > 0, code).otherwise(F.lit("en"))
    name = F.create_map(*[x for c in codes for x in (F.lit(c), F.lit(LANGUAGE_NAMES[c]))])[code]
    return s.select(*_keys(key), name.alias("language"), code.alias("language_code"),
                    F.when(best > 0, best / total).otherwise(F.lit(0.5)).alias("confidence"))


def _top_terms(terms: Column, k: int) -> Column:
    """Top-k of an array of terms by count, ties by first position; nulls are no terms."""
    @F.arrow_udf("array<string>")
    def top(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows:  # the words of one text at a time: those of a batch are many, and become no Python strings
            seen = r.values.drop_null().value_counts() if r.is_valid else pa.array([], pa.struct({"values": pa.string(), "counts": pa.int64()}))
            first = np.argsort(-seen.field("counts").to_numpy(), kind="stable")[:k]  # kept in the order of first use
            out.append(seen.field("values").take(pa.array(first)).to_pylist())
        return pa.array(out, pa.list_(pa.string()))

    return top(terms)


def keywords(df: DataFrame, key: Key, text: str = "text", k: int = 5) -> DataFrame:
    """key, keywords: the k most frequent non-stop words (3+ ASCII letters), ties by first position."""
    words = F.filter(alpha3_tokens(F.col("text")), lambda w: ~in_words(w, STOP_WORDS))
    return texts(df, key, text).select(*_keys(key), _top_terms(words, k).alias("keywords"))


def _pairs(w: Column) -> Column:
    """Adjacent pairs of an array of words; null where one of the two is a stop word."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.when(
        ~in_words(a, STOP_WORDS) & ~in_words(b, STOP_WORDS), F.concat(a, F.lit(" "), b)))
    return F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))


def phrases(df: DataFrame, key: Key, text: str = "text", k: int = 3) -> DataFrame:
    """key, phrases: the k most frequent adjacent word pairs where neither word is a stop word."""
    t = texts(df, key, text).select(*_keys(key), alpha3_tokens(F.col("text")).alias("_w"))  # tokenised once
    return t.select(*_keys(key), _top_terms(_pairs(F.col("_w")), k).alias("phrases"))


def keywords_and_phrases(df: DataFrame, key: Key, text: str = "text", k: int = 5, pairs: int = 3) -> DataFrame:
    """key, keywords, phrases in one pass."""
    t = texts(df, key, text).select(*_keys(key), alpha3_tokens(F.col("text")).alias("_w"))
    words = F.filter(F.col("_w"), lambda w: ~in_words(w, STOP_WORDS))
    return t.select(*_keys(key), _top_terms(words, k).alias("keywords"), _top_terms(_pairs(F.col("_w")), pairs).alias("phrases"))


TASKS = {
    "sentiment": sentiment, "classification": classify, "entity_extraction": entities, "embedding": embedding,
    "summarization": summary, "topic_modeling": topics, "language_detection": language,
    "keyword_extraction": keywords_and_phrases,
}


def text_task(name: str, df: DataFrame, key: Key, text: str = "text") -> DataFrame:
    if name not in TASKS:
        raise ValueError(f"unknown text task {name!r}; expected one of {sorted(TASKS)}")
    return TASKS[name](df, key, text)


# ---------------------------------------------------------------- metrics and findings


def _top1(value: Column, n: Column) -> Column:
    """(value, n) of the most common value of grouped counts, smallest value on ties: an aggregate."""
    return F.min(F.when(value.isNotNull(), F.struct((-n).alias("less"), value.alias("value"), n.alias("n"))))


def metrics_sentiment(res: DataFrame) -> DataFrame:
    s = F.col("sentiment")
    return res.agg(F.count(F.lit(1)).alias("total_texts"), F.count_if(s == "positive").alias("positive_count"),
                   F.count_if(s == "negative").alias("negative_count"), F.count_if(s == "neutral").alias("neutral_count"),
                   F.avg("confidence").alias("avg_confidence"))


def _metrics_label(res: DataFrame, c: str, plural: str) -> DataFrame:
    """One pass over the rows: everything comes from sums by label."""
    by = res.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("s"), F.count("confidence").alias("m"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_texts"), F.count(c).alias(f"unique_{plural}"),
                  F.coalesce(_top1(F.col(c), F.col("n"))["value"], F.lit("none")).alias(f"most_common_{c}"),
                  F.try_divide(F.sum("s"), F.sum("m")).alias("avg_confidence"))


def metrics_classification(res: DataFrame) -> DataFrame:
    return _metrics_label(res, "category", "categories")


def metrics_topics(res: DataFrame) -> DataFrame:
    return _metrics_label(res, "topic", "topics")


def metrics_language(res: DataFrame) -> DataFrame:
    return _metrics_label(res, "language", "languages")


def _entity_types(res: DataFrame) -> DataFrame:
    """type, n, texts, arrays: entities by type; texts are counted with their first entity, or under null if they have none."""
    each = res.select(F.col("entities").isNotNull().alias("has"), F.posexplode_outer("entities.type").alias("pos", "type"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return each.groupBy("type").agg(F.count("pos").alias("n"), F.count_if(first).alias("texts"), F.count_if(first & F.col("has")).alias("arrays"))


def metrics_entities(res: DataFrame) -> DataFrame:
    """One pass over the rows: everything comes from sums by type."""
    n, texts = F.sum("n"), F.coalesce(F.sum("texts"), F.lit(0))
    return _entity_types(res).agg(
        texts.alias("total_texts"), F.when(F.sum("arrays") > 0, n).alias("total_entities"), _top1(F.col("type"), F.col("n"))["value"].alias("_top")
    ).select("total_texts", "total_entities",
             F.try_divide(F.col("total_entities"), F.col("total_texts")).cast("double").alias("avg_entities_per_text"),
             F.coalesce("_top", F.lit("none")).alias("most_common_entity_type"))


def metrics_embedding(res: DataFrame, source: DataFrame, key: Key, text: str = "text") -> DataFrame:
    t = texts(source, key, text)
    return res.agg(F.count(F.lit(1)).alias("total_texts"), F.max("dimension").alias("embedding_dimension")).select(
        "total_texts", "embedding_dimension", t.agg(F.avg(F.length("text"))).scalar().alias("avg_text_length"))


def metrics_summary(res: DataFrame) -> DataFrame:
    r = F.col("compression_ratio")
    return res.agg(F.count(F.lit(1)).alias("total_texts"), F.avg(r).alias("avg_compression_ratio"),
                   F.min(r).alias("min_compression_ratio"), F.max(r).alias("max_compression_ratio"))


def metrics_keywords(res: DataFrame) -> DataFrame:
    words = res.select(F.explode("keywords").alias("w"))
    return res.agg(F.count(F.lit(1)).alias("total_texts"), F.sum(F.size("keywords")).cast("bigint").alias("total_keywords")
                   ).select("total_texts", "total_keywords",
                            words.agg(F.count_distinct("w")).scalar().alias("unique_keywords"),
                            F.try_divide(F.col("total_keywords"), F.col("total_texts")).cast("double")
                            .alias("avg_keywords_per_text"))


FINDING_TITLES = {  # fixed values
    "positive": "Predominantly Positive Sentiment",
    "negative": "Predominantly Negative Sentiment",
    "mixed": "Mixed Sentiment Distribution",
}


def findings_text(sent: DataFrame, cls: DataFrame, ents: DataFrame, tops: DataFrame) -> DataFrame:
    """One row: sentiment finding, top category (count, %), top entity type (count), distinct topics."""
    ms = metrics_sentiment(sent)
    n = F.col("total_texts")
    finding = (F.when(F.col("positive_count") > n * 0.6, FINDING_TITLES["positive"])
               .when(F.col("negative_count") > n * 0.6, FINDING_TITLES["negative"]).otherwise(FINDING_TITLES["mixed"]))
    # one row each, from one pass over each input
    by = cls.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    topc = by.agg(_top1(F.col("category"), F.col("n")).alias("_c"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
    tope = _entity_types(ents).agg(_top1(F.col("type"), F.col("n")).alias("_e"))
    topics_ = tops.agg(F.count_distinct("topic").alias("distinct_topics"))
    for one in (topc, tope, topics_):
        ms = ms.crossJoin(F.broadcast(one))
    return ms.select(finding.alias("sentiment_finding"), F.col("_c.value").alias("top_category"), F.col("_c.n").alias("top_category_count"),
                     (F.col("_c.n") * 100.0 / F.col("_n")).alias("top_category_pct"),
                     F.col("_e.value").alias("top_entity_type"), F.col("_e.n").alias("top_entity_count"), "distinct_topics")
