"""Pay, qualifications, URLs, capture stamps and duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.config import PAY_PATTERN
from postloom.functions.text import collapse, present, strip, unicode_pattern
from postloom.schema import MISSING_TEXT


def pay_statement(c: Column) -> Column:
    """The first pay statement in a text, else ``N/A``."""
    found = strip(F.regexp_extract(collapse(c), unicode_pattern(PAY_PATTERN, ignore_case=True), 0))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(MISSING_TEXT))


def extract_salary(box: Column, body: Column) -> Column:
    """Pay from the compensation box; from the body only if there is no box."""
    return F.when(box.isNotNull(), pay_statement(box)).otherwise(pay_statement(body))


def fill_salary(c: Column) -> Column:
    """``N/A`` for a null or blank salary."""
    return F.when(F.length(strip(c)) > 0, c).otherwise(MISSING_TEXT)


def join_quals(items: Column) -> Column:
    """One text from a list of qualifications: stripped, blanks dropped."""
    kept = F.filter(F.transform(items, strip), lambda q: F.length(q) > 0)
    joined = F.array_join(kept, "; ")
    return F.when(F.length(joined) > 0, joined).otherwise(MISSING_TEXT)


def canonical_url(href: Column, base: str, layout: str) -> Column:
    """Drop the query part. Layout A keeps an absolute address whole and
    completes a relative one with ``base``; layout B always cuts."""
    cut = F.substring_index(href, "?", 1)
    if layout == "B":
        return F.coalesce(cut, F.lit(""))
    return (
        F.when(F.coalesce(href, F.lit("")) == "", "")
        .when(href.startswith("http"), href)
        .otherwise(F.concat(F.lit(base), cut))
    )


def stamp() -> Column:
    """The capture time as text, in the session's time zone."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def ingest_sig(title: Column, company: Column) -> Column:
    """Key of a posting during collection: title and company, folded."""
    def fold(c: Column) -> Column:
        return F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.struct(fold(title).alias("title"), fold(company).alias("company"))


def batch_sig(title: Column, company: Column) -> Column:
    """Key of a posting in the batch clean: ASCII letters and digits only."""
    def letters(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    return F.concat(letters(company), F.lit("_"), letters(title))


def url_key(c: Column) -> Column:
    """The URL as a duplicate key: null where it is missing."""
    return present(c)
