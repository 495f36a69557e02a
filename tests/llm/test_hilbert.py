from pyspark.sql import functions as F

from postloom.llm import hilbert
from postloom.scratch import Scratch

from .data import documents, texts


def test_curve_visits_every_cell_by_single_steps(spark):
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        n = 1 << bits
        cell = [(F.floor(F.col("id") / n**k) % n).cast("int").alias(f"d{k}") for k in range(dims)]
        rows = spark.range(n**dims).select(*cell).select("*", hilbert.hilbert_index(
            [F.col(f"d{k}") for k in range(dims)], bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(n**dims))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[k] - b[k]) for k in range(dims)) == 1


def test_shards_balance_and_slots_have_no_gaps(spark):
    docs = documents(spark, texts() * 3).withColumn("shard", F.lit("clash"))
    steps = [hilbert.log_step(F.length("text"), 4), hilbert.name_step(F.col("lang"), 4)]
    for n in (1, 4, 16, 100):
        rows = hilbert.shards(docs, steps, 4, [F.col("doc_id")], n).collect()
        assert sorted(r.doc_id for r in rows) == list(range(60))
        sizes = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(n)}
        assert all(v == list(range(len(v))) for v in sizes.values())
        assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
        order = sorted(rows, key=lambda r: (r.shard, r.slot))
        assert [r.curve for r in order] == sorted(r.curve for r in rows)
    assert hilbert.shards(docs.limit(0), steps, 4, [F.col("doc_id")], 4).count() == 0


def test_written_shards_read_back(spark):
    docs = documents(spark, texts(), extra=False)
    rows = hilbert.shards(docs, [hilbert.log_step(F.length("text"), 4)], 4, [F.col("doc_id")], 4)
    path = Scratch(spark, "shards").root
    hilbert.write(rows, path)
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == list(range(len(texts())))


def test_query_and_pruning(spark, tmp_path):
    import zlib

    from postloom.llm import queries

    rows = [(k, None if k % 31 == 0 else "é" * (1 << k % 12) + "x" * (k % 7), ("en", "de", None, "fr")[k % 4], f"s{k % 9}") for k in range(600)]
    rows += rows[:20]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_hilbert(spark, str(tmp_path)).collect()
    raw = lambda t: (t or "").encode()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (k, len(raw(t)) + 1, zlib.crc32(raw(t))) for k, t, _, _ in rows)
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(16)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    steps = [hilbert.log_step(size, 6), hilbert.name_step(F.col("lang"), 6), hilbert.name_step(F.col("source"), 6)]
    folder = Scratch(spark, "pruned").root
    hilbert.write(hilbert.shards(docs.withColumns({"x": steps[0], "y": steps[1], "z": steps[2]}), steps, 6, [F.col("doc_id")], 16), folder)
    files = spark.read.parquet(folder).groupBy(F.input_file_name().alias("f")).agg(
        *[g(c).alias(f"{g.__name__}_{c}") for c in "xyz" for g in (F.min, F.max)]).collect()
    for c in "xyz":
        values = {r[c] for r in docs.select(steps["xyz".index(c)].alias(c)).collect()}
        read = sum(f[f"min_{c}"] <= v <= f[f"max_{c}"] for f in files for v in values)
        assert read < 0.8 * len(files) * len(values), c
