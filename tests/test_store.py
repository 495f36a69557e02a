"""CSV reading, the store, verification, chunking, summaries, streaming."""

import hashlib
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postloom.config import CHUNK_PROMPT, CSV_NULLS, FINAL_PROMPT, Config
from postloom.operators import chunks, liveness
from postloom.plans import clean, collect
from postloom.schema import OUTPUT_COLUMNS
from postloom.scratch import shared_dir
from postloom.sources import csv_records, key_index, postings
from postloom.sources.store import PostingStore
from postloom.streaming.ingest import ingest_stream

CFG = Config(max_rows=None)


def test_read_postings(spark, tmp_path):
    (tmp_path / "b.csv").write_text('title,url,extra\n"A ""q""\nline",N/A,1\nna,n/a,2\n')
    (tmp_path / "a b.csv").write_text('title,url,extra\nfirst, ,\nNone,null,NA\n')
    rows = postings.read_postings(spark, str(tmp_path)).orderBy("arrival").collect()
    assert [(r.title, r.url, r.extra) for r in rows] == [
        ("first", " ", None), (None, None, None), ('A "q"\nline', None, "1"), ("na", None, "2")]
    assert rows[0].company is None and len({r.arrival for r in rows}) == 4
    one = pd.read_csv(tmp_path / "a b.csv")
    assert one["title"].isna().tolist() == [False, True] and one["url"].tolist()[0] == " "


def test_files_of_two_header_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,url\nT1,u1\n"T\n2",u2\n')
    (tmp_path / "b.csv").write_text("url,title,more\nu3,T3,x\n")
    (tmp_path / "c.csv").write_text("")
    rows = postings.read_postings(spark, str(tmp_path)).orderBy("arrival").collect()
    assert [(r.title, r.url, r.more, r.company) for r in rows] == [
        ("T1", "u1", None, None), ("T\n2", "u2", None, None), ("T3", "u3", "x", None)]
    assert [r.arrival >> 33 for r in rows] == [0, 0, 1]


def test_conform(spark):
    df = spark.createDataFrame([(None, "t", 1)], "url string, title string, extra int")
    out = postings.conform(df)
    assert out.columns == OUTPUT_COLUMNS
    assert tuple(out.first()) == ("t", None, "N/A", "N/A", "N/A", "N/A", "N/A")
    assert postings.conform(out).collect() == out.collect()


def rows_df(spark, rows):
    return spark.createDataFrame(rows, "arrival long, title string, url string, company string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in OUTPUT_COLUMNS[3:]])


def test_store_versions(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "s"))
    assert store.read().count() == 0 and store.batches() == []
    store.append(rows_df(spark, [(1, "a", None, "c"), (2, "b", "u", "N/A")]))
    store.append(rows_df(spark, [(3, "c", "u3", "c")]), 5)
    store.append(rows_df(spark, [(3, "c", "u3", "c")]), 5)
    assert store.batches() == [0, 5]
    got = {r.arrival: (r.title, r.url, r.company) for r in store.read().collect()}
    assert got == {1: ("a", None, "c"), 2: ("b", "u", None), 3: ("c", "u3", "c")}
    assert store.read(before_batch=5).count() == 2
    raw = spark.read.parquet(store.current())
    assert raw.where("url = 'N/A'").count() == 1
    # nothing removed: nothing written
    before = store.current()
    assert store.replace_with_backup(store.read().withColumn("is_valid", F.lit(True)))["removed"] == 0
    assert store.current() == before
    counts = store.replace_with_backup(store.read().withColumn("is_valid", F.col("arrival") != 2))
    assert counts == {"original": 3, "kept": 2, "removed": 1}
    assert sorted(r.arrival for r in store.read().collect()) == [1, 3]
    assert spark.read.parquet(str(tmp_path / "s" / "backup-v000000")).where("NOT is_valid").count() == 1
    assert store.append(rows_df(spark, [(4, "d", "u4", "c")])) == 6
    assert store.read().count() == 3


def test_clean_store(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "s"))
    store.append(rows_df(spark, [(1, "a a", "u1", "c"), (2, "A", "u22", "C."), (3, "b", "u1", "c")]))
    assert clean.clean_store(store) == {"original": 3, "kept": 1, "removed": 2}
    assert [(r.arrival, r.title) for r in store.read().collect()] == [(1, "a")]


def test_liveness(spark, tmp_path):
    a = "https://www.simplyhired.ca/job/1"
    cases = [("ftp://x", "T", None, "not_checkable"), (None, "T", None, "not_checkable"),
             ("https://b", " ", ("https://b", "x", True), "not_checkable"),
             ("https://f", "T", ("https://f", "x", False), "not_captured"), ("https://none", "T", None, "not_captured"),
             ("https://d", "T", ("https://d", "t This job has Expired", True), "unavailable"),
             ("https://l", "My Title My Title", ("https://l", "has MY TITLE here", True), "live"),
             ("https://m", "T9", ("https://m", "other", True), "title_mismatch"),
             (a, "T", ("https://www.simplyhired.ca/SEARCH?q=x", "t", True), "redirected")]
    df = rows_df(spark, [(i, t, u, "c") for i, (u, t, _, _) in enumerate(cases)])
    snaps = spark.createDataFrame(
        [(u, *s) for u, _, s, _ in cases if s] + [("https://l", "https://l", "closed", True)],
        "url string, final_url string, body_text string, ok boolean")
    out = liveness.classify_liveness(df, snaps, CFG).orderBy("arrival").collect()
    assert [r.reason for r in out] == [c[3] for c in cases]
    report = liveness.clean_report(liveness.classify_liveness(df, snaps, CFG)).first()
    assert tuple(report) == (9, 3, 6)
    store = PostingStore(spark, str(tmp_path / "s"))
    store.append(df)
    assert clean.verify_store(store, snaps, CFG) == {"original": 9, "kept": 3, "removed": 6}
    assert [r.title for r in store.read().orderBy("arrival").collect()] == ["T", "T", "My Title My Title"]


@pytest.mark.parametrize("n, sizes", [(1, None), (79, None), (80, [80]), (450, [450]), (451, [450, 1]), (900, [450, 450])])
def test_chunks(spark, n, sizes):
    text = "  " + "\n".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "arrival long, description string")
    got = [r.chunk for r in chunks.chunk_descriptions(df).orderBy("chunk_no").collect()]
    if sizes is None:
        assert got == [text]
    else:
        assert [len(c.split(" ")) for c in got] == sizes and " ".join(got).split() == text.split()


def test_chunks_of_missing_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "N/A")], "arrival long, description string")
    assert {r.arrival: r.chunk for r in chunks.chunk_descriptions(df).collect()} == {1: None, 2: "", 3: "N/A"}


def test_summarize(spark):
    def infer(prompts):
        if any("boom" in p for p in prompts):
            raise ValueError("boom")
        return prompts.map(lambda p: p[:9] + "|" + p.split("\n\n", 1)[1][:12])

    long = lambda w: " ".join([w] * 460)
    rows = [(1, long("ab"), " "), (2, "short", "$5"), (3, long("boom"), None), (4, None, "")]
    df = spark.createDataFrame(rows, "arrival long, description string, salary string").coalesce(1)
    got = {r.arrival: (r.description, r.salary) for r in chunks.summarize(df, infer).collect()}
    assert got == {1: (FINAL_PROMPT[:9] + "|" + (CHUNK_PROMPT[:9] + "|ab")[:12], "N/A"), 2: ("short", "$5"),
                   3: (long("boom"), "N/A"), 4: (None, "N/A")}


CAND = "arrival long, layout string, title string, url string, company string, description string"


def candidates(n=60):
    return [(i, "B" if i % 3 else "A", f"Data Analyst {i * 7 % 17}", f"https://u/{i * 5 % 23}", f"C{i % 4}", "sql")
            for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    rows = candidates()
    cfg = CFG
    whole = PostingStore(spark, str(tmp_path / "whole"))
    extra = [F.lit("x").alias(c) for c in ("salary", "qualifications", "scraped_at")]
    df = spark.createDataFrame(rows, CAND).select("*", *extra)
    collect.ingest(whole, df, cfg)

    src = tmp_path / "in"
    streamed = PostingStore(spark, str(tmp_path / "streamed"))
    for k in range(3):
        df.where((F.col("arrival") >= k * 20) & (F.col("arrival") < (k + 1) * 20)).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(df.schema).parquet(str(src))
        ingest_stream(stream, streamed, cfg, str(tmp_path / "ck")).awaitTermination()
    (writer,) = streamed.writers()
    assert streamed.batches(writer) == [0, 1, 2]
    key = lambda s: sorted((r.arrival, r.title, r.url) for r in s.read().collect())
    assert key(streamed) == key(whole) and 0 < len(key(whole)) < len(rows)
    # repeating any batch changes nothing
    for k in (2, 1):
        part = df.where((F.col("arrival") >= k * 20) & (F.col("arrival") < (k + 1) * 20))
        collect.ingest(streamed, part, cfg, k, writer=writer)
    assert key(streamed) == key(whole)


def test_writers_keep_each_others_rows(spark, tmp_path):
    """A batch ingest, a stream, a stream with a new checkpoint, and a replay: nothing stored is lost or doubled."""
    df = spark.createDataFrame(candidates(80), CAND).select(
        "*", *[F.lit("x").alias(c) for c in ("salary", "qualifications", "scraped_at")])
    part = lambda k: df.where((F.col("arrival") >= k * 20) & (F.col("arrival") < (k + 1) * 20))
    whole, store = PostingStore(spark, str(tmp_path / "whole")), PostingStore(spark, str(tmp_path / "s"))
    collect.ingest(whole, df, CFG)
    collect.ingest(store, part(0), CFG)
    for k, checkpoint in ((1, "ck1"), (2, "ck2"), (3, "ck2")):
        src = str(tmp_path / f"in-{checkpoint}")
        part(k).coalesce(1).write.mode("append").parquet(src)
        ingest_stream(spark.readStream.schema(df.schema).parquet(src), store, CFG, str(tmp_path / checkpoint)).awaitTermination()
    key = lambda s: sorted((r.arrival, r.title, r.url) for r in s.read().collect())
    assert key(store) == key(whole)
    assert len(store.writers()) == 3
    assert sorted(b for w in store.writers() for b in store.batches(w)) == [0, 0, 0, 1]
    writer = next(w for w in store.writers() if store.batches(w) == [0, 1])
    collect.ingest(store, part(3), CFG, 1, writer=writer)
    assert key(store) == key(whole)
    clean_counts = store.replace_with_backup(store.read().withColumn("is_valid", F.col("arrival") > 0))
    assert clean_counts["removed"] == 1 and "batch" in store.writers()


HARD_CSV = ["plain,x", '"q",y', '"two\nlines",z', '"a ""quoted"" word",""', ',', '" ""\n\n"" ,\n,",w', "5\" pipe,it's", '"" ,v', "", '"\r\n","\r"',
            '"ends with """,k', ' "not quoted", s', '"""",one quote', '"x"', '"éß\n漢",u', "N/A,null"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_is_split_inside_quoted_fields(spark, tmp_path, end):
    """Any border of ranges, inside quotes, between them or in a line end, gives the rows of the reader that does not split."""
    rng = random.Random(6)
    lines = ["title,url"] + [rng.choice(HARD_CSV) for _ in range(400)]
    (tmp_path / "one.csv").write_bytes((end.join(lines) + end).encode())
    (tmp_path / "two.csv").write_bytes(end.join(['"u\nrl",title', "a,b", '"c\nd",e']).encode())
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "one.csv")).collect()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for width in ("300", "1777", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", width)
            steps = csv_records.steps(spark, str(tmp_path / "one.csv"))
            assert width == size or steps.count() > 2
            got = postings.read_postings(spark, str(tmp_path)).orderBy("arrival").collect()
            none = lambda x: None if x in CSV_NULLS else x
            assert [(r.title, r.url) for r in got[:-2]] == [(none(r[0]), none(r[1])) for r in plain]
            assert [(r["u\nrl"], r.title) for r in got[-2:]] == [("a", "b"), ("c\nd", "e")]
            assert [r.arrival for r in got] == [*range(len(plain)), 1 << 33, (1 << 33) + 1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_ingest_reads_met_buckets_only(spark, tmp_path, monkeypatch):
    """No stored posting is read, and of the key files those with a filter that may hold a new key."""
    extra = [F.lit("x").alias(c) for c in ("salary", "qualifications", "scraped_at")]
    rows = [(i, "A", f"Data Analyst {i}", f"https://u/{i}", "c", "sql" * 50) for i in range(3000)]
    df = spark.createDataFrame(rows, CAND).select("*", *extra)
    store = PostingStore(spark, str(tmp_path / "s"))
    for k in range(2):
        store.append(df.where(F.col("arrival") % 2 == k), k)
    new = [(5000, "A", "Data Analyst 7", "https://new/1", "c ", "sql"), (5001, "A", "Data Analyst 9000", "https://u/8", "c", "sql"),
           *[(5002 + i, "A", f"Data Analyst {8000 + i}", f"https://new/{8000 + i}", "c", "sql") for i in range(28)]]
    new = spark.createDataFrame(new, CAND).select("*", *extra)
    asked, paths = [], key_index.met_buckets
    monkeypatch.setattr(key_index, "met_buckets", lambda *a: asked.append(paths(*a)) or asked[-1])
    monkeypatch.setattr(store, "read", None)
    met = store.met(new)
    assert sorted((r.url or "", r.title or "") for r in met.collect()) == [("", "data analyst 7"), ("https://u/8", "")]
    assert 2 <= len(asked[0]) <= 4 and all("/index/" in p for p in asked[0])
    files = [f for f in met.inputFiles() if "/index/" in f]
    assert len(files) == len(asked[0]) < len(list((tmp_path / "s" / "index").rglob("keys/*/part-*"))) / 20
    collect.ingest(store, new, CFG)
    monkeypatch.undo()
    assert store.read().count() == 3028
    # a batch without an index, as after a clean, is indexed when it is asked for
    store.replace(store.read().where("arrival < 10"))
    collect.ingest(store, new, CFG)
    assert store.read().count() == 38


def test_key_filters():
    r = np.random.default_rng(1)
    h, g = r.integers(-(1 << 63), (1 << 63) - 1, (2, 5000))
    bits = key_index._filter(h[:500], g[:500])
    assert key_index.may_hold(bits, h[:500], g[:500]).all() and key_index.may_hold(bits, h[500:], g[500:]).sum() < 5


SESSIONS = CAND + ", session string"


def session_rows(n, seed):
    """Long runs of equal texts in few sessions, and rows that the title gate turns away between them."""
    rng = random.Random(seed)
    return [(i, rng.choice("ABB"), rng.choice(["Data Analyst", "Research Associate", "Research Associate", "Nurse"]) + f" {i}", f"https://u/{i}",
             "c", rng.choice(["uses sql", "uses sql", "uses sql", "python", None, "paper"]), rng.choice(["s", "s", "t", None])) for i in range(n)]


def in_parts(spark, df, borders, cfg, tmp_path, name):
    """A store that took the rows as micro-batches that end before the given arrivals."""
    store, src = PostingStore(spark, str(tmp_path / name)), str(tmp_path / f"{name}-in")
    for lo, hi in zip([0, *borders], [*borders, 1 << 40]):
        df.where((F.col("arrival") >= lo) & (F.col("arrival") < hi)).coalesce(1).write.mode("append").parquet(src)
        ingest_stream(spark.readStream.schema(df.schema).parquet(src), store, cfg, str(tmp_path / f"{name}-ck")).awaitTermination()
    return store


def content(store):
    return sorted((r.arrival, r.title, r.description) for r in store.read().collect())


@pytest.mark.parametrize("cap", [None, 17])
def test_sessions_and_cap_over_micro_batches(spark, tmp_path, monkeypatch, cap):
    monkeypatch.setattr("postloom.sources.store.WHOLE_MEMORY", 2)
    cfg = Config(max_rows=cap)
    df = spark.createDataFrame(session_rows(70, 2), SESSIONS).select(
        "*", *[F.lit("x").alias(c) for c in ("salary", "qualifications", "scraped_at")])
    whole = PostingStore(spark, str(tmp_path / "whole"))
    collect.ingest(whole, df, cfg)
    want = content(whole)
    assert len(want) == cap if cap else {"uses sql", None} < {d for _, _, d in want}
    borders = [9, 10, 31, 55]
    store = in_parts(spark, df, borders, cfg, tmp_path, "parts")
    assert content(store) == want
    (writer,) = store.writers()
    assert store.batches(writer) == [0, 1, 2, 3, 4]
    # a repeated part decides as before, and so do those after it
    ends = [0, *borders, 70]
    for k in (4, 2, 3):
        part = df.where((F.col("arrival") >= ends[k]) & (F.col("arrival") < ends[k + 1]))
        collect.ingest_part(store, part, cfg, k, writer=writer)
        assert content(store) == want
    if cap:
        assert store.admitted(99, writer) == cap


def test_memory_holds_digests_of_each_session(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "s"))
    columns = "arrival long, layout string, title string, url string, company string, description string, session string"
    text = "uses sql " * 10000
    for k, texts in enumerate(([text], [text], [None])):
        df = spark.createDataFrame([(k, "A", f"Data Analyst {k}", f"u{k}", "c", t, "s") for t in texts], columns)
        collect.ingest_part(store, df.select("*", *[F.lit("x").alias(c) for c in ("salary", "qualifications", "scraped_at")]), CFG, k)
    seen = [[(r.session, len(r.digest) if r.digest else None, r.stale) for r in store.memory(k).collect()] for k in range(4)]
    assert seen == [[], [("s", 16, False)], [("s", 16, True)], [("s", None, False)]]
    assert [r.description for r in store.read().orderBy("arrival").collect()] == [text.strip(), None, None]


def noting(path, die=None):
    """A model that notes each prompt it is sent, and ends its worker at prompts with a given word."""
    def infer(prompts):
        out = []
        for p in prompts:
            if die and die in p:
                os._exit(1)
            with open(path, "a") as f:
                f.write(hashlib.md5(p.encode()).hexdigest() + "\n")
            out.append(" ".join(p.split()[-3:]))
        return pd.Series(out)
    return infer


def test_outputs_are_kept_and_resumed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunks, "PROMPTS_PER_JOB", 4)
    sent, folder = str(tmp_path / "sent"), str(tmp_path / "outputs")
    texts = [" ".join(f"w{k % 9}x{i}" for i in range(n)) for k, n in enumerate([90, 500, 1000, 90, 100, 700, 30, 460, 95, 90, 2000, 90])]
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(k + 50, t, None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "arrival long, description string, salary string")
    read = lambda: open(sent).read().split() if os.path.exists(sent) else []
    with pytest.raises(Exception):
        chunks.summarize(df, noting(sent, die="w5x3 "), outputs=folder)
    before = len(spark.read.parquet(folder).collect())
    assert 0 < before <= len(read())
    calls = len(read())
    got = {r.arrival: r.description for r in chunks.summarize(df, noting(sent), outputs=folder).collect()}
    # equal prompts went once; what the lost job had not written went again, at most its own prompts
    assert calls < len(read()) and len(read()) - len(set(read())) <= chunks.PROMPTS_PER_JOB * 3
    assert got == {r.arrival: r.description for r in chunks.summarize(df, noting(str(tmp_path / "other"))).collect()}
    calls = len(read())
    again = {r.arrival: r.description for r in chunks.summarize(df, noting(sent), outputs=folder).collect()}
    assert again == got and len(read()) == calls


def test_a_failed_prompt_is_asked_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "word " * 100, "$5"), (2, "other " * 100, "$5")], "arrival long, description string, salary string")

    def broken(prompts):
        return pd.Series([None if "other" in p else "short" for p in prompts])

    folder = str(tmp_path / "outputs")
    first = {r.arrival: r.description for r in chunks.summarize(df, broken, outputs=folder).collect()}
    assert first == {1: "short", 2: "other " * 100}
    second = {r.arrival: r.description for r in chunks.summarize(df, lambda p: p.map(lambda _: "now"), outputs=folder).collect()}
    assert second == {1: "short", 2: "now"}


def test_ingest_with_summaries_and_cap(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame(candidates(), CAND).select(
        "*", F.lit("").alias("salary"), F.lit(None).cast("string").alias("qualifications"), F.lit("x").alias("scraped_at"))
    collect.ingest(store, df, Config(max_rows=5), infer=lambda p: p)
    assert store.read().count() == 5
    assert {r.salary for r in spark.read.parquet(store.current()).collect()} == {"N/A"}


def test_scratch_uses_the_named_folder():
    from types import SimpleNamespace as NS

    def session(named, master="spark://m", checkpoint=None):
        return NS(conf=NS(get=lambda key, default: {"spark.checkpoint.dir": named}.get(key) or default),
                  sparkContext=NS(master=master, getCheckpointDir=lambda: checkpoint))

    assert shared_dir(session("hdfs://n/ck")) == "hdfs://n/ck"
    assert shared_dir(session(None, checkpoint="hdfs://n/x")) == "hdfs://n/x"
    with pytest.raises(RuntimeError):
        shared_dir(session(None))
    assert shared_dir(session(None, "local[2]")) == shared_dir(session(None, "local[2]"))
