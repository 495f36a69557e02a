"""Incremental ingest as a stream of captured postings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from postloom.config import Config
from postloom.operators.chunks import Infer
from postloom.plans.collect import ingest_part
from postloom.sources.store import PostingStore


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query a checkpoint belongs to, which is the same after a restart."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def ingest_stream(candidates: DataFrame, store: PostingStore, cfg: Config, checkpoint: str,
                  infer: Infer | None = None, available_now: bool = True, model: str | None = None) -> StreamingQuery:
    """Append every micro-batch; together they accept what one batch run over all of them would.

    De-duplication needs two keys over all stored rows, so the state is the
    store itself. The stream is a writer of its own, named by the id that its
    checkpoint keeps. A micro-batch writes that writer's folder of its own number and
    takes all other rows but the stream's later batches for stored: after a failure it is simply
    written again, and a stream with a new checkpoint adds to what is there.
    The last description of each session and the number of admitted rows go from one
    micro-batch to the next as notes under the same numbers (``collect.ingest_part``): a session's rows
    are never brought into one task, as an operator with state per session would do.
    ``candidates`` must arrive in order: a later micro-batch holds later rows.
    """
    def write(batch: DataFrame, number: int) -> None:
        ingest_part(store, batch, cfg, number, infer, _query_id(batch.sparkSession, checkpoint), model)

    writer = candidates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
