"""Title cleaning, normalisation and canonical roles, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.config import ROLE_RULES, TITLE_NOISE, TITLE_NORM_PATTERNS
from postloom.functions.text import bind, collapse, unicode_pattern


def _half(c: Column, start: Column) -> Column:
    return F.substr(c, start, F.floor(F.length(c) / 2).cast("int"))


def fix_doubled(c: Column) -> Column:
    """Undo a title written twice, with or without a space between.

    In a collapsed text ``X X`` has odd length with a space in the middle and
    ``XX`` has even length, so comparing the two character halves decides both.
    """
    def repair(text: Column) -> Column:
        n = F.length(text)
        mid = F.floor(n / 2).cast("int")
        first = _half(text, F.lit(1))
        spaced = (n % 2 == 1) & (F.substr(text, mid + 1, F.lit(1)) == " ") & (first == _half(text, mid + 2))
        joined = (n % 2 == 0) & (n > 4) & (first == _half(text, mid + 1))
        return F.when(spaced | joined, first).otherwise(text)
    return bind(collapse(F.coalesce(c, F.lit(""))), repair)


def sanitize_title(c: Column, noise: Sequence[str] = TITLE_NOISE) -> Column:
    """Delete noise phrases, collapse blanks, undo doubling in any letter case."""
    text = reduce(
        lambda t, phrase: F.regexp_replace(t, f"(?iu)\\Q{phrase}\\E", ""),
        noise, F.coalesce(c, F.lit("")),
    )
    def repair(text: Column) -> Column:
        words, folded = F.split(text, " "), F.split(F.lower(text), " ")
        # slice() must not see a length of 0 for a one-word title
        length = F.greatest(F.floor(F.size(words) / 2).cast("int"), F.lit(1))
        by_words = (
            (F.size(words) % 2 == 0)
            & (F.slice(folded, F.lit(1), length) == F.slice(folded, length + 1, length))
        )
        n = F.length(text)
        first, second = _half(text, F.lit(1)), _half(text, F.floor(n / 2).cast("int") + 1)
        by_chars = (n > 6) & (n % 2 == 0) & (F.lower(first) == F.lower(second))
        return (
            F.when(by_words, F.array_join(F.slice(words, F.lit(1), length), " "))
            .when(by_chars, first)
            .otherwise(text)
        )
    return bind(collapse(text), repair)


def normalize_title(c: Column, patterns: Sequence[str] = TITLE_NORM_PATTERNS) -> Column:
    """Lower-case a title and drop brackets, codes, separators and level numerals."""
    text = reduce(
        lambda t, pattern: F.regexp_replace(t, unicode_pattern(pattern), " "),
        patterns, F.lower(F.coalesce(c, F.lit(""))),
    )
    return collapse(text)


def canonical_title(c: Column, rules: Sequence[tuple[str, str]] = ROLE_RULES) -> Column:
    """The label of the first rule found in a normalised title, else the title."""
    return F.coalesce(
        *[F.when(c.rlike(unicode_pattern(pattern)), label) for label, pattern in rules], c,
    )


def role_pattern(*phrases: str) -> str:
    """A rule pattern that finds any of ``phrases`` as whole words."""
    return "|".join(rf"\b{re.escape(p)}\b" for p in phrases)
