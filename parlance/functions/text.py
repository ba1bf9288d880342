"""Tokenisers and text expressions. The five normalisers differ on purpose; each is named for its use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_tokens(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes of the lower-cased text; digits and accents part words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def norm_duplicate(text: Column) -> Column:
    """Lower case, everything else than a-z and 0-9 to one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def norm_contract(text: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def cue_words(text: Column) -> Column:
    """Words with everything but a-z and 0-9 taken out; words left empty go."""
    return F.filter(F.transform(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")


def display_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def shingles(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space, in order with repeats; none if there are fewer words."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def tidy_joined(text: Column) -> Column:
    """A space after a joined sentence, none before punctuation, blanks collapsed."""
    text = F.regexp_replace(text, r"([.!?])([A-Z])", "$1 $2")
    text = F.regexp_replace(text, r"\s+([,.!?;:])", "$1")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def head_and_tail(text: Column, limit: int, head: int = 500) -> Column:
    """A long text as its head and its tail around an ellipsis, `limit` characters in all."""
    first = min(head, limit // 2)
    mark = "\n...\n"
    rest = max(0, limit - first - len(mark))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(first)), F.lit(mark), F.right(text, F.lit(rest))))


def trimmed_utterance(text: Column, limit: int = 120) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(limit))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """A share that is null, not zero, where there is nothing to share."""
    return F.round(part / F.when(whole != 0, whole), digits)
