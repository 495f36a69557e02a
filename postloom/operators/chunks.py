"""Chunk long descriptions and summarise them with a caller's batch function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.config import CHUNK_PROMPT, FINAL_PROMPT
from postloom.functions.fields import fill_salary
from postloom.functions.text import collapse
from postloom.schema import ARRIVAL, MISSING_TEXT
from postloom.scratch import Scratch

MIN_WORDS, CHUNK_WORDS = 80, 450
#: Prompts whose outputs are kept together: what a lost job may cost.
PROMPTS_PER_JOB = 100_000

#: Prompts in, one output per prompt; null marks a failure.
Infer = Callable[[pd.Series], pd.Series]


#: Up to 450 words with the space after each, in a collapsed text. Nothing is
#: given back on a failed match, so the search is linear.
_CHUNK = rf"(?:[^ ]++ ?+){{1,{CHUNK_WORDS}}}+"


def word_count(collapsed: Column) -> Column:
    """Words of a text whose blanks are single spaces."""
    spaces = F.length(collapsed) - F.length(F.replace(collapsed, F.lit(" "), F.lit("")))
    return F.when(F.length(collapsed) > 0, spaces + 1).otherwise(0)


def _with_text(df: DataFrame, column: str = "description") -> DataFrame:
    """Add ``_text`` (collapsed) and ``_long``: whether to summarise it."""
    c = F.col(column)
    return df.withColumn("_text", collapse(F.coalesce(c, F.lit("")))).withColumn(
        "_long", F.coalesce(c != MISSING_TEXT, F.lit(False)) & (word_count(F.col("_text")) >= MIN_WORDS)
    )


def chunk_descriptions(df: DataFrame, key: str = ARRIVAL, column: str = "description") -> DataFrame:
    """Rows ``(key, chunk_no, chunk)``: 450 words each; short texts whole."""
    chunks = F.transform(F.regexp_extract_all("_text", F.lit(_CHUNK), F.lit(0)), lambda c: F.rtrim(c))
    pieces = F.when(F.col("_long"), chunks).otherwise(F.array(F.col(column)))
    return _with_text(df, column).select(key, F.posexplode(pieces).alias("chunk_no", "chunk"))


def _apply(df: DataFrame, keys: list[str], infer: Infer) -> DataFrame:
    """Run ``infer`` over the ``prompt`` column, batch by batch."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def one(prompt: str) -> str | None:
        try:
            return infer(pd.Series([prompt])).iloc[0]
        except Exception:
            return None  # this text stays as it was

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                out = list(infer(batch["prompt"]))
            except Exception:
                out = [one(p) for p in batch["prompt"]]
            yield batch[keys].assign(output=out)

    return df.select(*keys, "prompt").mapInPandas(run, f"{types}, output string")


def answers(prompts: DataFrame, infer: Infer, folder: str) -> DataFrame:
    """``(digest, output)`` of prompts ``(digest, prompt)``, kept in a folder that all executors share.

    Equal prompts are sent once, and none that has an output in the folder. The others are
    dealt to jobs of about ``PROMPTS_PER_JOB``, each of which adds its outputs to the folder when it ends, so a job that
    is lost loses its own prompts only and the next run goes on from there. A job reads its own prompts only, from
    the folders of its parts. In a task, prompts of
    similar length follow each other, so that a model's batches are little padded. A prompt that failed
    has no output and is asked again by the next run.
    """
    spark = prompts.sparkSession
    schema = "digest string, output string"
    prompts = Scratch(spark, "prompts").save(prompts.groupBy("digest").agg(F.first("prompt").alias("prompt")), "distinct")
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    # as many parts as jobs at most, so that a job reads the folders of its own parts only
    parts = -(-prompts.count() // PROMPTS_PER_JOB) or 1
    root = f"{Scratch(spark, 'prompts').root}/left"
    left = prompts.join(spark.read.schema(schema).parquet(folder).select("digest"), "digest", "left_anti").withColumns(
        {"length": F.length("prompt"), "part": F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")})
    left.write.partitionBy("part").parquet(root)
    left = spark.read.schema(left.schema).parquet(root)
    jobs = -(-left.count() // PROMPTS_PER_JOB)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for job in range(jobs):
        own = left.where(F.col("part") % jobs == job).select("digest", "prompt", "length")
        packed = own.repartition(width, "digest").sortWithinPartitions("length", "digest")
        _apply(packed, ["digest"], infer).where("output IS NOT NULL").write.mode("append").parquet(folder)
    found = spark.read.schema(schema).parquet(folder)
    # a job that was run twice may have left an output twice
    return found.join(prompts.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("output").alias("output"))


def _answered(prompts: DataFrame, keys: list[str], infer: Infer, folder: str | None) -> DataFrame:
    """Outputs of the ``prompt`` column, by the keys; from a folder of outputs if one is named."""
    if folder is None:
        return _apply(prompts, keys, infer)
    asked = prompts.withColumn("digest", F.sha2("prompt", 256))
    return asked.join(answers(asked.select("digest", "prompt"), infer, folder), "digest", "left").select(*keys, "output")


def summarize(df: DataFrame, infer: Infer, key: str = ARRIVAL, outputs: str | None = None) -> DataFrame:
    """Replace long descriptions by a two-stage summary; fill blank salaries.

    One prompt per chunk, the outputs joined in chunk order into a final
    prompt. Any failure keeps the original text. Only long rows pass through
    Python; the groups collected are the chunks of a single description.

    With ``outputs``, a folder for the outputs of one model, prompts are sent when this is called, and
    only those the folder does not answer yet (``answers``).
    """
    long_rows = _with_text(df).where("_long")
    prompts = chunk_descriptions(long_rows.select(key, "description"), key).select(
        key, "chunk_no", F.concat(F.lit(CHUNK_PROMPT), "chunk").alias("prompt")
    )
    parts = _answered(prompts, [key, "chunk_no"], infer, outputs)
    finals = (
        parts.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("chunk_no", "output"))).alias("parts"))
        .where(~F.exists("parts", lambda p: p["output"].isNull()))
        .select(key, F.concat(
            F.lit(FINAL_PROMPT), F.array_join(F.col("parts.output"), " ")).alias("prompt"))
    )
    summaries = _answered(finals, [key], infer, outputs).withColumnRenamed("output", "_summary")
    return (
        df.join(summaries, key, "left")
        .withColumn("description", F.coalesce("_summary", "description"))
        .withColumn("salary", fill_salary(F.col("salary")))
        .select(*df.columns)
    )
