"""Text helpers as Column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

# The public English stop list used by common full-text dictionaries.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]


def words(text: Column) -> Column:
    """Lower-cased word tokens in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """Tokens split on runs of whitespace, without empty edge tokens."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def sentences(text: Column, before_capital: bool = False) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by whitespace; trimmed, without empties.

    ``before_capital`` splits only where an ASCII capital follows.
    """
    pattern = r"(?<=[.!?])\s+(?=[A-Z])" if before_capital else r"(?<=[.!?])\s+"
    parts = F.transform(F.split(text, pattern), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0.0 where the denominator is zero or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def approx_tokens(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(F.length(text) / F.lit(4)).cast("int")
