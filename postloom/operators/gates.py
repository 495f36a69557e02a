"""Which captured postings are wanted: gates, tiers, caps, and the funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.config import Config
from postloom.functions.text import contains_any, is_missing
from postloom.schema import ARRIVAL, MISSING_TEXT

REJECT, KEEP, CHECK, SKIP = "REJECT", "KEEP_IMMEDIATE", "CHECK_DESCRIPTION", "SKIP"


def missing_field(cfg: Config, layout: Column) -> Column:
    """The first required field without a value, or null.

    Layout A needs title, URL and, if asked for, salary; layout B a title.
    Both need a company if asked for.
    """
    on_a = layout == "A"
    reason = F.when(is_missing(F.col("title")), "missing_title").when(
        on_a & is_missing(F.col("url")), "missing_url"
    )
    if cfg.require_company:
        reason = reason.when(is_missing(F.col("company")), "missing_company")
    if cfg.require_salary:
        reason = reason.when(on_a & is_missing(F.col("salary")), "missing_salary")
    return reason


def gate_required(df: DataFrame, cfg: Config, layout: Column | None = None) -> DataFrame:
    """Rows with every required field."""
    return df.where(missing_field(cfg, F.col("layout") if layout is None else layout).isNull())


def title_tier(title: Column, cfg: Config) -> Column:
    """Relevance of a title by the keywords it contains, as substrings."""
    folded = F.lower(title)
    return (
        F.when(contains_any(folded, cfg.bad), REJECT)
        .when(contains_any(folded, cfg.strong), KEEP)
        .when(contains_any(folded, cfg.ambiguous), CHECK)
        .otherwise(SKIP)
    )


def accept(tier: Column, description: Column, cfg: Config) -> Column:
    """Whether title tier and description let a posting in."""
    text = F.coalesce(description, F.lit(MISSING_TEXT))
    verified = (text != MISSING_TEXT) & contains_any(F.lower(text), cfg.tech)
    return (tier == KEEP) | ((tier == CHECK) & verified)


def page_limit(df: DataFrame, cfg: Config) -> DataFrame:
    """Result pages within the limit per keyword, if there is one."""
    return df if cfg.max_pages is None else df.where(F.col("page_num") <= cfg.max_pages)


def cap(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order`` (default: arrival)."""
    return df.orderBy(*(order or (ARRIVAL,))).limit(n)


def funnel(decided: DataFrame, *keys: str) -> DataFrame:
    """Candidates per reason (and per ``keys``)."""
    return decided.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def decision_log(decided: DataFrame) -> DataFrame:
    """One short line per decision, fields cut to a readable width."""
    widths = {"title": 80, "company": 60, "salary": 40, "url": 90}
    return decided.select(
        ARRIVAL, "reason",
        *[F.substring(F.coalesce(F.trim(F.col(c)), F.lit("")), 1, w).alias(c) for c, w in widths.items()],
    )
