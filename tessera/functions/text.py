"""Tokenizers and text measures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that full-text search leaves out.
STOPWORDS = [
    "a", "is", "the", "an", "and", "are", "as",
    "at", "be", "but", "by", "for", "if", "in",
    "into", "it", "no", "not", "of", "on", "or",
    "such", "that", "their", "then", "there", "these",
    "they", "this", "to", "was", "will", "with",
]


def stem(word: Column) -> Column:
    """One suffix off words longer than three: ies, ing or ed, else an s that isn't ss."""
    cut = F.regexp_replace(word, "(ies|ing|ed)$", "")
    plural = F.when(word.rlike("s$") & ~word.rlike("ss$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.when(F.length(word) <= 3, word).when(cut != word, cut).otherwise(plural)


def search_tokens(text: Column) -> Column:
    """ASCII word runs in lower case, without stopwords, stemmed."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9'_]+)"), F.lit(1))
    return F.transform(F.filter(words, lambda w: ~w.isin(STOPWORDS)), stem)


def retrieval_tokens(text: Column) -> Column:
    """Unicode word runs of two bytes or more in lower case, without stopwords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOPWORDS))


def plain_tokens(text: Column) -> Column:
    """Unicode word runs in lower case, all of them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of text are among these."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
