"""Title analysis: normalise, name roles, cluster, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.config import ROLE_RULES
from postloom.functions.titles import canonical_title, normalize_title
from postloom.operators.clusters import DISTANCE, assign, cluster_titles


def titled(df: DataFrame, rules: Sequence[tuple[str, str]] = ROLE_RULES) -> DataFrame:
    """Add ``title_norm`` and ``title_updated``."""
    return df.withColumn("title_norm", normalize_title(F.col("title"))).withColumn(
        "title_updated", canonical_title(F.col("title_norm"), rules)
    )


def role_counts(df: DataFrame, rules: Sequence[tuple[str, str]] = ROLE_RULES) -> DataFrame:
    """Postings per canonical role, most common first."""
    return (
        titled(df, rules).groupBy("title_updated").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "title_updated")
    )


def clustered(df: DataFrame, rules: Sequence[tuple[str, str]] = ROLE_RULES,
              distance: float = DISTANCE) -> DataFrame:
    """Postings with ``title_norm``, ``title_updated`` and ``cluster_id``."""
    rows = titled(df, rules)
    return assign(rows, cluster_titles(rows, distance))
