"""Queries for the rule-based text analysis (§2.7) on whole documents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import text as W
from ..operators import infer as I
from ..operators import text as X
from ..session import ensure_checkpoint_dir
from .base import register, rnd, t
from .sqlgen import lit_list

DOCS_SQL = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
D = "CAST({} AS DOUBLE)"


def _docs(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "text")


def _hits(words, lt="lower(text)"):
    return " + ".join(f"(CASE WHEN contains({lt}, '{w.lower()}') THEN 1 ELSE 0 END)" for w in words)


def _conf_sql(base, score):
    return f"least(0.9::DOUBLE, {base}::DOUBLE + CAST({score} AS DOUBLE) * 0.1::DOUBLE)"


_SENT = f"""SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN p > n THEN {_conf_sql(0.6, 'p - n')} WHEN n > p THEN {_conf_sql(0.6, 'n - p')} ELSE 0.5::DOUBLE END AS confidence,
  p AS positive_hits, n AS negative_hits
FROM (SELECT doc_id, {_hits(W.POSITIVE_WORDS)} AS p, {_hits(W.NEGATIVE_WORDS)} AS n FROM {DOCS_SQL})"""


@register("text_sentiment", _SENT)
def q_text_sentiment(spark, sf):
    return X.sentiment(_docs(spark, sf), "doc_id", "text")


def _kw_sql(k, lt="lower(text)"):
    if isinstance(k, W.WholeWord):
        return f"regexp_matches({lt}, '(^|[^\\p{{L}}\\p{{N}}_]){k.lower()}([^\\p{{L}}\\p{{N}}_]|$)')"
    return f"contains({lt}, '{k.lower()}')"


def _classify_sql(categories, src, key):
    names = list(categories)
    scores = ", ".join(" + ".join(f"(CASE WHEN {_kw_sql(k)} THEN 1 ELSE 0 END)" for k in kws) + f" AS s{i}"
                       for i, kws in enumerate(categories.values()))
    best = f"greatest({', '.join(f's{i}' for i in range(len(names)))})" if len(names) > 1 else "s0"
    case = " ".join(f"WHEN s{i} = {best} THEN '{n}'" for i, n in enumerate(names))
    return f"""SELECT {key}, CASE WHEN {best} = 0 THEN 'other' {case} END AS category,
  CASE WHEN {best} > 0 THEN {_conf_sql(0.5, best)} ELSE 0.5::DOUBLE END AS confidence
FROM (SELECT {key}, {scores} FROM {src})"""


_CLS = _classify_sql(W.CATEGORIES, DOCS_SQL, "doc_id")


@register("text_classify", _CLS)
def q_text_classify(spark, sf):
    return X.classify(_docs(spark, sf), "doc_id", "text")


CUSTOM = X.parse_labels("the, les, der, und, market")
CONV_SQL = "(SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL)"


@register("text_labels_custom", _classify_sql(CUSTOM, CONV_SQL, "conv_id, turn"))
def q_text_labels_custom(spark, sf):
    return X.classify(t(spark, sf, "conversations"), ["conv_id", "turn"], "text", CUSTOM)


SUFFIX = " on 2024-01-05 for $1,234.50"
_ACCENTED = r"[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]"


def _docs_ent(spark, sf):
    return _docs(spark, sf).select("doc_id", F.concat("text", F.lit(SUFFIX)).alias("text"))


def _ent_list(pattern, kind):
    return (f"list_transform(regexp_extract_all(u, '{pattern}'), lambda e: '{kind}:' || e || ':' || "
            f"CAST(instr(t, e) - 1 AS VARCHAR) || ':' || CAST(instr(t, e) - 1 + length(e) AS VARCHAR))")


_ENT_BASE = f"""(SELECT doc_id, t, regexp_replace(t, '{_ACCENTED}', '_', 'g') AS u FROM (
  SELECT doc_id, text || '{SUFFIX}' AS t FROM {DOCS_SQL}))"""
_ENT_LIST = (f"list_concat({_ent_list(W.PERSON_PATTERN, 'PERSON')}, {_ent_list(W.DATE_PATTERN, 'DATE')}, "
             f"{_ent_list(W.MONEY_PATTERN, 'MONEY')})")


@register("text_entities", f"SELECT doc_id, array_to_string({_ENT_LIST}, '|') AS entities FROM {_ENT_BASE}")
def q_text_entities(spark, sf):
    e = X.entities(_docs_ent(spark, sf), "doc_id", "text")
    flat = F.transform("entities", lambda x: F.concat_ws(":", x["type"], x["entity"], x["start"].cast("string"),
                                                          x["end"].cast("string")))
    return e.select("doc_id", F.array_join(flat, "|").alias("entities"))


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
_ALPHA3 = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{3,}'))"


@register("text_embedding", f"""
WITH tok AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM {DOCS_SQL}),
c AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(w), 1, 8)) AS UBIGINT) % 384 AS INTEGER) AS bucket, count(*) AS c
      FROM tok GROUP BY ALL)
SELECT doc_id, bucket, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) AS weight FROM c""")
def q_text_embedding(spark, sf):
    e = X.embedding(_docs(spark, sf), "doc_id", "text")
    return (e.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
            .where(F.col("weight") != 0).select("doc_id", "bucket", F.col("weight").cast("double").alias("weight")))


def _summary_sql(src, key, short=None):
    raw = ("CASE WHEN len(string_split(text, '.')) <= 2 THEN text ELSE string_split(text, '.')[1] || '. ' || "
           "string_split(text, '.')[-1] END")
    summ = r"regexp_replace(raw, '^\s+|\s+$', '', 'g')"
    ratio = "CASE WHEN length(text) > 0 THEN length(raw) / length(text) ELSE 1.0 END"
    if short:
        summ = f"CASE WHEN length(text) < {short} THEN text ELSE {summ} END"
        ratio = f"CASE WHEN length(text) < {short} THEN 1.0 ELSE {ratio} END"
    return f"SELECT {key}, {summ} AS summary, CAST({ratio} AS DOUBLE) AS compression_ratio FROM (SELECT {key}, text, {raw} AS raw FROM {src})"


@register("text_summary", _summary_sql(DOCS_SQL, "doc_id"))
def q_text_summary(spark, sf):
    return X.summary(_docs(spark, sf), "doc_id", "text")


@register("text_short_passthrough", _summary_sql(CONV_SQL, "conv_id, turn", short=100))
def q_text_short_passthrough(spark, sf):
    return X.summary(t(spark, sf, "conversations"), ["conv_id", "turn"], "text", short_passthrough=True)


_TOPICS = f"""(SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, min(doc_id * 100000000 + pos)) AS INTEGER) AS rank,
    w AS topic, count(*) AS count
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {_ALPHA3} AS ws FROM {DOCS_SQL}))
  GROUP BY w ORDER BY count(*) DESC, min(doc_id * 100000000 + pos) LIMIT 5)"""


@register("corpus_topics", f"SELECT * FROM {_TOPICS}")
def q_corpus_topics(spark, sf):
    return X.corpus_topics(_docs(spark, sf), "doc_id", "text")


_TOPIC_ROWS = f"""SELECT doc_id, topic, {_conf_sql(0.5, 'score')} AS confidence FROM (
  SELECT doc_id, topic, rank, CAST((length(lt) - length(replace(lt, topic, ''))) / length(topic) AS INTEGER) AS score
  FROM (SELECT doc_id, lower(text) AS lt FROM {DOCS_SQL}), {_TOPICS})
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1"""


@register("text_topics", _TOPIC_ROWS)
def q_text_topics(spark, sf):
    return X.topics(_docs(spark, sf), "doc_id", "text")


def _lang_sql():
    codes = list(W.LANGUAGE_STOP_WORDS)
    hits = ", ".join(f"len(list_filter(toks, lambda w: list_contains([{lit_list(ws)}], w))) AS h_{c}"
                     for c, ws in W.LANGUAGE_STOP_WORDS.items())
    best = f"greatest({', '.join(f'h_{c}' for c in codes)})"
    total = " + ".join(f"h_{c}" for c in codes)
    code = "CASE WHEN " + best + " = 0 THEN 'en' " + " ".join(f"WHEN h_{c} = {best} THEN '{c}'" for c in codes) + " END"
    name = "CASE code " + " ".join(f"WHEN '{c}' THEN '{W.LANGUAGE_NAMES[c]}'" for c in codes) + " END"
    return f"""SELECT doc_id, {name} AS language, code AS language_code, confidence FROM (
  SELECT doc_id, {code} AS code, CASE WHEN {best} > 0 THEN CAST({best} AS DOUBLE) / ({total}) ELSE 0.5::DOUBLE END AS confidence
  FROM (SELECT doc_id, {hits} FROM (SELECT doc_id, {_TOKENS} AS toks FROM {DOCS_SQL})))"""


_LANG = _lang_sql()


@register("text_language", _LANG)
def q_text_language(spark, sf):
    return X.language(_docs(spark, sf), "doc_id", "text")


@register("language_accuracy", f"""
SELECT count(*) AS texts, sum(CASE WHEN l.language_code = d.lang THEN 1 ELSE 0 END) AS correct,
  CAST(sum(CASE WHEN l.language_code = d.lang THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy
FROM ({_LANG}) l JOIN documents d USING (doc_id)""")
def q_language_accuracy(spark, sf):
    docs = t(spark, sf, "documents")
    lang = X.language(docs, "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id")
    ok = F.when(F.col("language_code") == F.col("lang"), 1).otherwise(0)
    return lang.agg(F.count(F.lit(1)).alias("texts"), F.sum(ok).cast("bigint").alias("correct"),
                    (F.sum(ok) / F.count(F.lit(1))).alias("accuracy"))


_STOP = lit_list(W.STOP_WORDS)
_TOK_POS = f"(SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {_ALPHA3} AS ws FROM {DOCS_SQL}))"


def _top_terms_sql(terms_sql, k, out):
    return f"""SELECT d.doc_id, coalesce(array_to_string(list(term ORDER BY n DESC, p) FILTER (WHERE term IS NOT NULL), ','), '') AS {out}
FROM {DOCS_SQL} d LEFT JOIN (
  SELECT doc_id, term, count(*) AS n, min(pos) AS p FROM ({terms_sql}) WHERE term IS NOT NULL GROUP BY doc_id, term
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) <= {k}) x USING (doc_id)
GROUP BY d.doc_id"""


_KW = _top_terms_sql(f"SELECT doc_id, w AS term, pos FROM {_TOK_POS} WHERE w NOT IN ({_STOP})", 5, "keywords")
_PH = _top_terms_sql(f"""SELECT doc_id, CASE WHEN w NOT IN ({_STOP}) AND nxt NOT IN ({_STOP}) THEN w || ' ' || nxt END AS term, pos
  FROM (SELECT doc_id, w, pos, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM {_TOK_POS}) WHERE nxt IS NOT NULL""",
                     3, "phrases")


@register("text_keywords", _KW)
def q_text_keywords(spark, sf):
    k = X.keywords(_docs(spark, sf), "doc_id", "text")
    return k.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@register("text_phrases", _PH)
def q_text_phrases(spark, sf):
    k = X.phrases(_docs(spark, sf), "doc_id", "text")
    return k.select("doc_id", F.array_join("phrases", ",").alias("phrases"))


@register("batch_inference", f"SELECT doc_id, sentiment, confidence, 'rule' AS answered_by FROM ({_SENT})")
def q_batch_inference(spark, sf):
    return I.batch_inference(_docs(spark, sf), "doc_id", "text", "sentiment")


def _offline(task, fails=None):
    """A stand-in for a model: answers that SQL can repeat, as JSON text; raises where ``fails`` holds."""
    def answer(x):
        n = len(x)
        return {"sentiment": {"sentiment": "positive" if n % 2 else "negative", "confidence": 0.75},
                "classification": {"category": "long" if n > 500 else "short", "confidence": 0.5},
                "entity_extraction": {"entities": [{"entity": x[:5], "type": "HEAD", "start": 0, "end": min(5, n)}]},
                "summarization": {"summary": x[:20], "compression_ratio": 0.25},
                "language_detection": {"language": "Any", "language_code": "xx", "confidence": 1.0},
                "keyword_extraction": {"keywords": [str(n)], "phrases": []}}[task]

    def provider(batch):
        if fails and any(fails(x) for x in batch):
            raise RuntimeError("no answer")
        return json.dumps([answer(x) for x in batch])
    return provider


_MODEL = {
    "sentiment": "CASE WHEN length(text) % 2 = 1 THEN 'positive' ELSE 'negative' END AS sentiment, 0.75::DOUBLE AS confidence",
    "classification": "CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END AS category, 0.5::DOUBLE AS confidence",
    "entity_extraction": "'HEAD:' || left(text, 5) || ':0:' || least(5, length(text)) AS entities",
    "summarization": "left(text, 20) AS summary, 0.25::DOUBLE AS compression_ratio",
    "language_detection": "'Any' AS language, 'xx' AS language_code, 1.0::DOUBLE AS confidence",
    "keyword_extraction": "CAST(length(text) AS VARCHAR) AS keywords, '' AS phrases",
}


def _flat(df):
    """Arrays as text, as the oracles have them."""
    if "entities" in df.columns:
        df = df.withColumn("entities", F.array_join(F.transform("entities", lambda x: F.concat_ws(
            ":", x["type"], x["entity"], x["start"].cast("string"), x["end"].cast("string"))), "|"))
    for c in ("keywords", "phrases"):
        if c in df.columns:
            df = df.withColumn(c, F.array_join(c, ","))
    return df


for _task, _sql in _MODEL.items():
    register(f"batch_inference_{_task}", f"SELECT doc_id, {_sql}, 'model' AS answered_by FROM {DOCS_SQL}")(
        lambda spark, sf, _t=_task: _flat(I.batch_inference(_docs(spark, sf), "doc_id", "text", _t, provider=_offline(_t))))


@register("batch_inference_stored", f"""
SELECT doc_id, {_MODEL['sentiment']}, 'model' AS answered_by FROM {DOCS_SQL}""")
def q_batch_inference_stored(spark, sf):
    store = f"{ensure_checkpoint_dir(spark)}/answers-{uuid.uuid4().hex}"
    return I.batch_inference(_docs(spark, sf), "doc_id", "text", "sentiment", provider=_offline("sentiment"), store=store)


@register("batch_inference_partly", f"""
SELECT doc_id, CASE WHEN length(text) % 4 = 0 THEN s.sentiment ELSE m.sentiment END AS sentiment,
  CASE WHEN length(text) % 4 = 0 THEN s.confidence ELSE m.confidence END AS confidence,
  CASE WHEN length(text) % 4 = 0 THEN 'rule' ELSE 'model' END AS answered_by
FROM {DOCS_SQL} JOIN ({_SENT}) s USING (doc_id)
JOIN (SELECT doc_id, {_MODEL['sentiment']} FROM {DOCS_SQL}) m USING (doc_id)""")
def q_batch_inference_partly(spark, sf):
    return I.batch_inference(_docs(spark, sf), "doc_id", "text", "sentiment", batch_size=1,
                             provider=_offline("sentiment", lambda x: len(x) % 4 == 0))


# ---------------------------------------------------------------- metrics and findings

def _mode_sql(src, c):
    return f"(SELECT {c} FROM ({src}) WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register("metrics_sentiment", f"""
SELECT count(*) AS total_texts, count(*) FILTER (WHERE sentiment = 'positive') AS positive_count,
  count(*) FILTER (WHERE sentiment = 'negative') AS negative_count, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count,
  round(avg(confidence), 6) AS avg_confidence FROM ({_SENT})""")
def q_metrics_sentiment(spark, sf):
    return rnd(X.metrics_sentiment(X.sentiment(_docs(spark, sf), "doc_id", "text")))


def _metrics_label_sql(src, c, plural):
    return f"""SELECT count(*) AS total_texts, count(DISTINCT {c}) AS unique_{plural},
  coalesce({_mode_sql(src, c)}, 'none') AS most_common_{c}, round(avg(confidence), 6) AS avg_confidence FROM ({src})"""


@register("metrics_classification", _metrics_label_sql(_CLS, "category", "categories"))
def q_metrics_classification(spark, sf):
    return rnd(X.metrics_classification(X.classify(_docs(spark, sf), "doc_id", "text")))


_ENT_TYPES = f"SELECT unnest(list_transform({_ENT_LIST}, lambda s: split_part(s, ':', 1))) AS type FROM {_ENT_BASE}"


@register("metrics_entities", f"""
SELECT count(*) AS total_texts, CAST(sum(len({_ENT_LIST})) AS BIGINT) AS total_entities,
  CAST(sum(len({_ENT_LIST})) AS DOUBLE) / count(*) AS avg_entities_per_text,
  coalesce({_mode_sql(_ENT_TYPES, 'type')}, 'none') AS most_common_entity_type FROM {_ENT_BASE}""")
def q_metrics_entities(spark, sf):
    return X.metrics_entities(X.entities(_docs_ent(spark, sf), "doc_id", "text"))


@register("metrics_embedding", f"""
SELECT count(*) AS total_texts, 384 AS embedding_dimension, round(avg(length(text)), 6) AS avg_text_length FROM {DOCS_SQL}""")
def q_metrics_embedding(spark, sf):
    d = _docs(spark, sf)
    return rnd(X.metrics_embedding(X.embedding(d, "doc_id", "text"), d, "doc_id", "text"))


_SUMM = _summary_sql(DOCS_SQL, "doc_id")


@register("metrics_summary", f"""
SELECT count(*) AS total_texts, round(avg(compression_ratio), 6) AS avg_compression_ratio,
  round(min(compression_ratio), 6) AS min_compression_ratio, round(max(compression_ratio), 6) AS max_compression_ratio FROM ({_SUMM})""")
def q_metrics_summary(spark, sf):
    return rnd(X.metrics_summary(X.summary(_docs(spark, sf), "doc_id", "text")))


@register("metrics_topics", _metrics_label_sql(_TOPIC_ROWS, "topic", "topics"))
def q_metrics_topics(spark, sf):
    return rnd(X.metrics_topics(X.topics(_docs(spark, sf), "doc_id", "text")))


@register("metrics_language", _metrics_label_sql(_LANG, "language", "languages"))
def q_metrics_language(spark, sf):
    return rnd(X.metrics_language(X.language(_docs(spark, sf), "doc_id", "text")))


@register("metrics_keywords", f"""
SELECT count(*) AS total_texts, CAST(sum(len(ks)) AS BIGINT) AS total_keywords,
  (SELECT count(DISTINCT k) FROM (SELECT unnest(string_split(keywords, ',')) AS k FROM ({_KW}) WHERE keywords <> '')) AS unique_keywords,
  CAST(sum(len(ks)) AS DOUBLE) / count(*) AS avg_keywords_per_text
FROM (SELECT CASE WHEN keywords = '' THEN [] ELSE string_split(keywords, ',') END AS ks FROM ({_KW}))""")
def q_metrics_keywords(spark, sf):
    return X.metrics_keywords(X.keywords(_docs(spark, sf), "doc_id", "text"))


@register("findings_text", f"""
SELECT CASE WHEN pos > n * 0.6 THEN '{X.FINDING_TITLES['positive']}' WHEN neg > n * 0.6 THEN '{X.FINDING_TITLES['negative']}'
  ELSE '{X.FINDING_TITLES['mixed']}' END AS sentiment_finding,
  {_mode_sql(_CLS, 'category')} AS top_category,
  (SELECT count(*) FROM ({_CLS}) WHERE category = {_mode_sql(_CLS, 'category')}) AS top_category_count,
  (SELECT count(*) FROM ({_CLS}) WHERE category = {_mode_sql(_CLS, 'category')}) * 100.0 / (SELECT count(*) FROM ({_CLS})) AS top_category_pct,
  {_mode_sql(_ENT_TYPES, 'type')} AS top_entity_type,
  (SELECT count(*) FROM ({_ENT_TYPES}) WHERE type = {_mode_sql(_ENT_TYPES, 'type')}) AS top_entity_count,
  (SELECT count(DISTINCT topic) FROM ({_TOPIC_ROWS})) AS distinct_topics
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE sentiment = 'positive') AS pos,
  count(*) FILTER (WHERE sentiment = 'negative') AS neg FROM ({_SENT}))""")
def q_findings_text(spark, sf):
    d = _docs(spark, sf)
    return X.findings_text(X.sentiment(d, "doc_id", "text"), X.classify(d, "doc_id", "text"),
                           X.entities(_docs_ent(spark, sf), "doc_id", "text"), X.topics(d, "doc_id", "text"))
