"""Clean and verify the stored postings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postloom.config import Config
from postloom.operators.dedup import dedup_batch
from postloom.operators.liveness import classify_liveness
from postloom.schema import ARRIVAL
from postloom.scratch import Scratch
from postloom.sources.store import PostingStore


def clean_store(store: PostingStore, blank_url: str = "collapse") -> dict[str, int]:
    """Sanitise and de-duplicate the stored postings; returns the row counts."""
    before = store.read()
    version = store.replace(dedup_batch(before, blank_url, ordered=False))
    counts = {"original": before.count(), "kept": store.spark.read.parquet(version).count()}
    return {**counts, "removed": counts["original"] - counts["kept"]}


def verify_store(store: PostingStore, snaps: DataFrame, cfg: Config) -> dict[str, int]:
    """Drop stored postings that their page snapshot disproves.

    The verdicts are written first, so the pages are read once.
    """
    postings = store.read()
    verdicts = Scratch(store.spark, "verify").save(
        classify_liveness(postings, snaps, cfg).select(ARRIVAL, "is_valid"), "verdicts"
    )
    return store.replace_with_backup(postings.join(verdicts, ARRIVAL))
