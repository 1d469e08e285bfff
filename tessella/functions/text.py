"""Shared tokenisers and fixed word lists, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
# fixed values: stop-words of the grounding tokeniser
STOP_WORDS = (
    "the", "a", "an", "is", "it", "in", "on", "at", "to", "of",
    "and", "or", "but", "for", "not", "with", "this", "that", "are",
    "was", "be", "as", "by", "from", "has", "have", "had", "its",
)
# fixed values: stop-words of the template features
FEATURE_STOP_WORDS = (
    "the", "a", "an", "is", "it", "in", "on", "at", "to", "of",
    "and", "or", "for", "not", "with", "this", "that", "are", "be",
    "by", "from", "has", "have", "as", "you", "will", "all", "use",
)
# fixed values: abbreviations that do not end a sentence
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "sr", "jr", "vs", "etc", "approx", "fig", "eq", "no", "vol", "ch", "ncert")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def plain_tokens(text: Column) -> Column:
    return find_all(F.lower(text), "[a-z0-9]+")


def tokenize(text: Column) -> Column:
    """Lower-case alphanumeric tokens, without stop-words and single characters; repeats stay."""
    return F.filter(plain_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def word_tokens(text: Column) -> Column:
    return find_all(F.lower(text), WORD)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use reads it."""
    return F.transform(F.array(value), use)[0]


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams as text, tokens joined by one space; empty if there are too few."""

    def grams(t: Column) -> Column:
        count = F.greatest(F.size(t) - n + 1, F.lit(0))
        out = F.slice(t, 1, count)
        for i in range(1, n):
            out = F.zip_with(out, F.slice(t, i + 1, count), lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    return tokens if n == 1 else bound(tokens, grams)


def space_words(text: Column) -> Column:
    return find_all(text, r"\S+")


def sentences(text: Column) -> Column:
    """Sentences of at least three words; the whole trimmed text if none is left.

    Dots inside numbers and after known abbreviations are hidden behind control characters while splitting.
    """
    hidden = F.regexp_replace(text, r"([0-9])\.([0-9])", "$1\u0002$2")
    hidden = F.regexp_replace(hidden, r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(ABBREVIATIONS) + r")\.", "$1$2\u0003")
    parts = F.split(F.regexp_replace(hidden, r"([.!?])\s+([A-Z\"'])", "$1\u0001$2"), "\u0001")
    shown = F.transform(parts, lambda s: F.regexp_replace(F.translate(s, "\u0002\u0003", ".."), r"^\s+|\s+$", ""))
    kept = F.filter(shown, lambda s: F.size(space_words(s)) >= 3)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.regexp_replace(text, r"^\s+|\s+$", "")))
