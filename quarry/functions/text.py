"""Text expressions and the fixed word lists of the rule-based text analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class WholeWord(str):
    """A keyword that must stand alone; plain keywords match inside words too."""


# ---------------------------------------------------------------- fixed values (rule path)

# sentiment words, matched as substrings of the lower-cased text, each counted at most once
POSITIVE_WORDS = ["good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "like"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "hate", "dislike", "horrible", "worst"]

# text categories and their keywords, in tie-break order
CATEGORIES = {
    "business": ["business", "company", "market", "finance", "economy", "profit", "revenue"],
    "technology": ["technology", "software", "computer", WholeWord("AI"), "digital", "tech", "innovation"],
    "sports": ["sports", "game", "team", "player", "match", "score", "championship"],
    "entertainment": ["movie", "music", "celebrity", "entertainment", "show", "actor", "film"],
    "politics": ["politics", "government", "election", "policy", "political", "vote", "democracy"],
}

# keyword / phrase stop words
STOP_WORDS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was",
              "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
              "may", "might", "must", "can", "this", "that", "these", "those"]

# entity patterns: capitalised runs, two numeric date shapes, dollar amounts
PERSON_PATTERN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
DATE_PATTERN = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b"
MONEY_PATTERN = r"\$\d+(?:,\d{3})*(?:\.\d{2})?"

# ---------------------------------------------------------------- our own choices (re-aimed rules)

# language vote: common function words of each language, no word in two lists
LANGUAGE_STOP_WORDS = {
    "en": ["the", "and", "of", "to", "is", "that", "with", "for", "this", "was", "are", "have", "from", "it",
           "not", "be", "by", "at", "or", "which"],
    "fr": ["le", "les", "et", "des", "est", "une", "du", "dans", "pour", "qui", "pas", "au", "sur", "avec", "ce",
           "il", "elle", "sont", "nous", "aux"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "sich", "auf",
           "dem", "im", "auch", "wird", "ich"],
    "es": ["el", "los", "las", "y", "por", "con", "para", "del", "se", "lo", "como", "pero", "al", "una",
           "esta", "sus", "muy", "ser", "hay", "donde"],
}
LANGUAGE_NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
EMBEDDING_DIM = 384

_ALL_LANG_WORDS = [w for ws in LANGUAGE_STOP_WORDS.values() for w in ws]
assert len(_ALL_LANG_WORDS) == len(set(_ALL_LANG_WORDS)), "a stop word sits in two languages"

# a token is a maximal run of letters, digits and underscore (Unicode), like Python's \w
NON_WORD = r"[^\p{L}\p{N}_]+"


def words_ws(s: Column) -> Column:
    """Whitespace-separated words (str.split() semantics: no empty words)."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def word_tokens(s: Column) -> Column:
    """Lower-cased word tokens (maximal \\w runs), empty ones removed."""
    return F.filter(F.split(F.lower(s), NON_WORD), lambda w: w != "")


_LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"


def alpha3_tokens(s: Column) -> Column:
    """Tokens equal to \\b[a-zA-Z]{3,}\\b matches on the lower-cased text (no per-token regex)."""
    return F.filter(word_tokens(s), lambda w: (F.length(w) >= 3) & (F.translate(w, _LOWER_ASCII, "") == ""))


def in_words(w: Column, words: Sequence[str]) -> Column:
    """Membership in a fixed word list; the optimizer turns a long IN list into a hash set."""
    return w.isin(*words)


def count_matches(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def contains_any_count(lower_text: Column, words: Sequence[str]) -> Column:
    """Number of ``words`` occurring (as substrings) in ``lower_text``; each counts once."""
    return sum((F.when(F.instr(lower_text, w.lower()) > 0, 1).otherwise(0) for w in words), F.lit(0))


def keyword_hit(lower_text: Column, keyword: str) -> Column:
    """Substring hit, or a hit as a whole word for keywords marked ``WholeWord``."""
    if isinstance(keyword, WholeWord):
        kw = keyword.lower()
        return lower_text.rlike(f"(^|[^\\p{{L}}\\p{{N}}_]){kw}([^\\p{{L}}\\p{{N}}_]|$)")
    return F.instr(lower_text, keyword.lower()) > 0


def category_scores(lower_text: Column, categories: Mapping[str, Sequence[str]]) -> list[Column]:
    return [sum((F.when(keyword_hit(lower_text, k), 1).otherwise(0) for k in kws), F.lit(0))
            for kws in categories.values()]


def substring_count(lower_text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of ``word`` in ``lower_text`` (str.count semantics)."""
    return F.when(F.length(word) > 0,
                  ((F.length(lower_text) - F.length(F.replace(lower_text, word, F.lit("")))) / F.length(word))
                  .cast("int")).otherwise(0)


def md5_bucket(w: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Portable hash bucket of a token: first 8 hex digits of md5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
