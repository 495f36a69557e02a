"""The operators of this folder over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import (
    block_labeller, bpe, bucket_refine, decision_list, fill_in_middle, hilbert, minhash_bayes, periodic_runs, simhash_trie,
    token_files, url_model, warc, winnowing,
)
from postloom.llm.common import table
from postloom.llm.oracle import SQL
from postloom.scratch import Scratch

TOKENIZER = "byte_bpe_50k.json"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
N_SHARDS, CURVE_BITS = 16, 6


def op1_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the rules, else by the models learned from the urls that the rules judge."""
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", url_model.host(url).alias("host"), url_model.path(url).alias("path"))
    ruled = pages.withColumn("by", url_model.rule_of(F.col("host"), F.col("path"), RULES))
    model = url_model.learn(ruled.where("by IS NOT NULL").select("url", (F.col("by.verdict") == "allow").alias("accepted")))
    return url_model.score(ruled, model).select(
        "page_id", "host", "path", F.col("by.rule").alias("rule"),
        F.coalesce("by.verdict", F.when(F.col("score") >= model.threshold, "allow").otherwise("block")).alias("verdict"), "score")


def op3_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    found = block_labeller.extract(pages, block_labeller.learn(pages), keep=("url",))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the base rule and the learned list."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "quality")
    stats = decision_list.text_stats(docs).drop("text")
    stats = scratch.save(stats, "stats")
    rules = decision_list.learn(scratch.save(
        decision_list.labelled_rows(stats, table(spark, sf_dir, "labels")), "labelled"))
    return decision_list.judge(stats, rules).select("doc_id", *decision_list.COUNTS, "base_failed", "kept", "rule")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back, segments put together and revisits resolved."""
    folder = f"{Scratch(spark, 'warc').root}/archive"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.captures(spark, folder).select(
        F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers_page").alias("refers_to"), "url", "problem")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return minhash_bayes.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op7_bucket_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings that repeat."""
    return bucket_refine.remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document from compressed files with a shared dictionary."""
    folder = f"{Scratch(spark, 'token-files').root}/ids"
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), end_id=0)
    return token_files.read(spark, folder).select(
        F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by backtracking and decoded by the offset table."""
    path = public_tokenizers.path(TOKENIZER)
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", F.expr("octet_length(ids) DIV 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to one of 16 shards along a curve over length, language and source, and read back; row counts balance."""
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)
    steps = [hilbert.log_step(size, CURVE_BITS), hilbert.name_step(F.col("lang"), CURVE_BITS),
             hilbert.name_step(F.col("source"), CURVE_BITS)]
    ties = [F.xxhash64("text"), F.col("doc_id")]
    scratch = Scratch(spark, "hilbert")
    folder = f"{scratch.root}/shards"
    sharded = hilbert.shards(docs, steps, CURVE_BITS, ties, N_SHARDS, scratch)
    hilbert.write(sharded, folder)
    scratch.drop("numbered")
    text = F.coalesce("text", F.lit(""))
    return spark.read.schema(sharded.schema).parquet(folder).select(
        "doc_id", size.cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and put together in another order, and the text rebuilt from that."""
    return fill_in_middle.transform(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of them with a periodic tail written in, and the texts without repeats."""
    found = periodic_runs.collapse(periodic_runs.planted(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash group of every document."""
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), simhash_trie.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and "_" in name}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
