"""From raw documents to token ids, one stage after the other.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that is
written and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from postloom.llm import bpe, bucket_refine, decision_list, minhash_bayes, winnowing
from postloom.llm.common import table
from postloom.llm.queries import TOKENIZER
from postloom.scratch import Scratch

#: Documents whose sets of five-word shingles are this similar, in percent, are near duplicates.
NEAR_PERCENT = 85


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return decision_list.good_documents(docs, table(spark, sf_dir, "labels"), Scratch(spark, "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash_bayes.one_per_group(docs, percent=NEAR_PERCENT)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; ``n_chars`` follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = bucket_refine.remove_repeats(docs, keep=others, as_text=True)
    new = {"doc_id": F.col("id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return left.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark items."""
    return winnowing.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, text)`` of every document that is left.

    Ids are little-endian unsigned 32-bit integers; the text is what they decode to by the offset table.
    """
    path = public_tokenizers.path(TOKENIZER)
    return bpe.decode(bpe.encode(docs, path), path).select(
        "doc_id", F.expr("octet_length(ids) DIV 4").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", token_ids),
]

#: A learned decision list and BPE cannot be written in SQL; the tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
