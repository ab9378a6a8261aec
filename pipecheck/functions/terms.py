"""Term sets of texts and their overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for scoring.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "to", "of", "in", "for",
    "on", "with", "at", "by", "from", "as", "into", "but", "or", "and",
    "not", "no", "it", "its", "that", "this", "which", "what", "who",
    "how", "when", "where", "why", "all", "each", "both", "few", "more",
)

# Fixed value: what counts as a word; a single character does not.
TERM = "[a-z0-9_]{2,}"


def term_set(text: Column) -> Column:
    """Distinct words of a text without stop words and single characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def matched_terms(predicted: Column, expected: Column) -> Column:
    """Sorted terms of ``expected`` that ``predicted`` has (term sets in, array out)."""
    return F.array_sort(F.array_intersect(expected, predicted))


def missing_terms(predicted: Column, expected: Column) -> Column:
    """Sorted terms of ``expected`` that ``predicted`` lacks."""
    return F.array_sort(F.array_except(expected, predicted))


def _share(predicted: Column, expected: Column, of: Column) -> Column:
    """Shared terms per term of ``of``; 0 when it has none."""
    shared = F.size(F.array_intersect(expected, predicted))
    return F.coalesce(F.try_divide(shared, F.size(of)), F.lit(0.0))


def overlap_ratio(predicted: Column, expected: Column) -> Column:
    """Shared terms per expected term; 0 when nothing is expected."""
    return _share(predicted, expected, expected)


def precision(predicted: Column, expected: Column) -> Column:
    """Shared terms per predicted term; 0 when nothing was predicted."""
    return _share(predicted, expected, predicted)


def terms_match(predicted: Column, expected: Column, threshold: float = 0.5) -> Column:
    """Whether the term set ``predicted`` has enough of the terms of ``expected``."""
    return (F.size(expected) > 0) & (overlap_ratio(predicted, expected) >= F.lit(threshold))


def cause_matches(predicted: Column, expected: Column, threshold: float = 0.5) -> Column:
    """The same for two texts; an empty text matches nothing."""
    given = (F.length(predicted) > 0) & (F.length(expected) > 0)
    enough = terms_match(term_set(predicted), term_set(expected), threshold)
    return F.coalesce(given & enough, F.lit(False))
