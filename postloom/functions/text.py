"""String helpers with the Unicode rules the results depend on.

Java's ``\\s``, ``\\w`` and ``\\b`` are ASCII and Spark's ``trim`` removes only
U+0020, so blank space and word characters are spelled out here, once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as blank space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
SPACE_CLASS = "[" + SPACES + "]"
WORD_CLASS = r"[\p{L}\p{N}_]"
_BOUNDARY = f"(?:(?<={WORD_CLASS})(?!{WORD_CLASS})|(?<!{WORD_CLASS})(?={WORD_CLASS}))"

#: What counts as "no value", in any letter case.
MISSING_WORDS = ("", "n/a", "na", "none", "null")


def unicode_pattern(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite ``\\b \\w \\s \\d`` and the dot to their Unicode meaning in Java.

    Beside a literal letter or digit one half of the boundary test is enough.
    """
    pattern = re.sub(r"(?<!\\)([A-Za-z0-9])\\b", lambda m: f"{m[1]}(?!{WORD_CLASS})", pattern)
    pattern = re.sub(r"\\b(?=[A-Za-z0-9])", lambda _: f"(?<!{WORD_CLASS})", pattern)
    for token, meaning in (
        (r"\b", _BOUNDARY), (r"\w", WORD_CLASS), (r"\s", SPACE_CLASS), (r"\d", r"\p{Nd}"),
    ):
        pattern = pattern.replace(token, meaning)
    return ("(?diu)" if ignore_case else "(?d)") + pattern


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used.

    Filters and generators evaluate an expression at each of its uses.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def strip(c: Column) -> Column:
    """Drop leading and trailing blank space."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Strip, and turn every run of blank space into one space.

    Few texts have two blanks in a row, so few need the pattern search.
    """
    spaced = F.translate(c, SPACES, " " * len(SPACES))
    return F.btrim(F.when(spaced.contains("  "), F.regexp_replace(spaced, "  +", " ")).otherwise(spaced))


def is_missing(c: Column) -> Column:
    """Null, blank, or one of the words that stand for "no value"."""
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*MISSING_WORDS)


def present(c: Column) -> Column:
    """The stripped text, or null where it is missing."""
    return F.when(~is_missing(c), strip(c))


def first_non_blank(*candidates: Column) -> Column:
    """The first candidate with text, stripped; empty when there is none."""
    texts = [F.nullif(strip(c), F.lit("")) for c in candidates]
    return F.coalesce(*texts, F.lit(""))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether any of ``words`` occurs in ``c`` as a substring."""
    def search(text: Column) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        return hit
    return bind(c, search)
