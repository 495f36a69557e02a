"""Check postings against page snapshots, and report what was removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.config import Config
from postloom.functions.text import bind, contains_any
from postloom.functions.titles import fix_doubled
from postloom.schema import ARRIVAL


def classify_liveness(postings: DataFrame, snaps: DataFrame, cfg: Config) -> DataFrame:
    """Add ``reason`` and ``is_valid`` to postings, by the snapshot of its URL.

    ``snaps`` has ``url, final_url, body_text, ok``. A URL without a snapshot,
    or with a failed one, is kept: only a page that was read can remove a row.

    Rows that no page can save are decided without the join. Page bodies are
    wide, so they meet only the narrow title, and leave a verdict behind.
    """
    url, title = F.col("url"), fix_doubled(F.col("title"))
    checkable = F.coalesce(url.startswith("http"), F.lit(False)) & (F.length(title) > 0)
    mark, path = cfg.redirect_marks
    body_says = bind(F.lower("body_text"), lambda body: (
        F.when(contains_any(body, cfg.dead_phrases), "unavailable")
        .when(body.contains(F.col("_title")), "live")
        .otherwise("title_mismatch")
    ))

    narrow = postings.where(checkable).select(ARRIVAL, "url", F.lower(title).alias("_title"))
    pages = snaps.where(F.coalesce(F.col("ok"), F.lit(False))).select("url", "final_url", "body_text")
    verdicts = narrow.join(pages, "url").select(
        ARRIVAL,
        F.when(
            url.contains(mark) & url.contains(path)
            & F.lower(F.coalesce("final_url", F.lit(""))).contains(cfg.redirect_target), "redirected",
        )
        .otherwise(body_says).alias("_verdict"),
    )
    # should a URL have several snapshots, one that shows it live decides
    verdicts = verdicts.groupBy(ARRIVAL).agg(F.min("_verdict").alias("_verdict"))
    reason = F.when(~checkable, "not_checkable").otherwise(
        F.coalesce("_verdict", F.lit("not_captured"))
    )
    return (
        postings.join(verdicts, ARRIVAL, "left")
        .withColumn("reason", reason)
        .withColumn("is_valid", F.col("reason").isin("live", "not_captured"))
        .drop("_verdict")
    )


def clean_report(flagged: DataFrame) -> DataFrame:
    """Original, kept and removed counts of rows flagged by ``is_valid``."""
    return flagged.agg(
        F.count(F.lit(1)).alias("original"),
        F.count_if("is_valid").alias("kept"),
        F.count_if(~F.col("is_valid")).alias("removed"),
    )


def dedup_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Original, kept and removed counts of a batch clean."""
    counts = before.select(F.lit(0).alias("k")).unionAll(after.select(F.lit(1).alias("k"))).agg(
        F.count_if(F.col("k") == 0).alias("original"), F.count_if(F.col("k") == 1).alias("kept"),
    )
    return counts.withColumn("removed", F.col("original") - F.col("kept"))
