"""Jobs of prompts read their own prompts only."""

from pyspark.sql import functions as F

from postloom.operators import chunks
from postloom.scratch import Scratch


def test_a_job_reads_its_own_prompts_only(spark, monkeypatch):
    monkeypatch.setattr(chunks, "PROMPTS_PER_JOB", 50)
    plans, apply = [], chunks._apply
    monkeypatch.setattr(chunks, "_apply", lambda df, *a: plans.append(df) or apply(df, *a))
    prompts = spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.concat(F.lit("p"), "id").alias("prompt"))
    folder = f"{Scratch(spark, 'outputs').root}/m"
    got = chunks.answers(prompts, lambda p: p.str.upper(), folder)
    assert {r.output for r in got.collect()} == {f"P{k}" for k in range(200)}
    files = [set(p.inputFiles()) for p in plans]
    scans = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(files) == 4 and all("PartitionFilters: [isnotnull(part" in s for s in scans)
    again = chunks.answers(prompts, lambda p: p.str.lower(), folder)
    assert len(plans) == 4 and again.count() == 200
