import re

import pytest

from postloom.llm import winnowing

from .data import documents, prose, texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    cut = lambda t: WORD.findall((t or "").translate(LOWER))
    out = []
    for doc in docs:
        w, hit, own = cut(doc), set(), set()
        for item, text in items:
            v = cut(text)
            n = min(13, len(v))
            windows = {tuple(v[k: k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k: k + n]) in windows:
                    hit.update(range(k, k + n))
                    own.add(str(item) if item is not None else "")
        out.append((len(w), len(hit), sorted(own), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_against_brute_force(spark):
    item = prose(40, 50)
    w = item.split()
    docs = [*texts(), prose(30, 51) + ". " + " ".join(w[5:18]).upper() + "! " + prose(400, 52), " ".join(w[5:17]), item + " " + item,
            "-".join(w[:13]), " ".join(w[:13]) + " " + " ".join(w[12:30]), "ÉA b c", "éa b c", "one two", "x one two three y", "ΑΣ.Α two"]
    items = [(1, item), (2, "one two"), (3, None), (4, "..."), (None, "éa B c"), (5, " ".join(w[8:40])), (5, prose(20, 60)),
             (6, "a b c d e f g h i j k l"), (7, "Of the"), (8, "ας"), (9, prose(3000, 8)[200:2000])]
    table = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, item int")
    got = sorted(winnowing.contamination(documents(spark, docs), table).collect(), key=lambda r: r.id)
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in got] == brute(docs, items)
    left = {r.doc_id for r in winnowing.clean(documents(spark, docs), table).collect()}
    assert left == {r.id for r in got if not r.contaminated}


def test_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, ["one two three", None])
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    twice = docs.unionByName(docs)
    assert sorted(r.n_hit for r in winnowing.contamination(twice, items).collect()) == [0, 0, 2, 2]
    assert [r.n_hit for r in winnowing.contamination(docs, items.limit(0)).collect()] == [0, 0]
    assert winnowing.contamination(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("span", [1, 3, 5, 6, 12, 13])
def test_every_span_shares_a_fingerprint(spark, span):
    from pyspark.sql import functions as F

    text = prose(60, 70).split()
    rows = [(k, text[k: k + span]) for k in range(60 - span + 1)] + [(99, text)]
    df = spark.createDataFrame(rows, "n int, w array<string>").select("n", winnowing.word_hashes(F.col("w")).alias("h"))
    marks = {}
    for r in winnowing.fingerprints(df, span, "n", positions=False).collect():
        marks.setdefault(r.n, set()).add(r.fp)
    assert all(marks[k] & marks[99] for k in range(60 - span + 1))


def test_documents_are_read_three_times_whatever_lengths_items_have(spark):
    w = prose(200, 90).split()
    items = [(k, " ".join(w[3 * k: 4 * k])) for k in range(1, 14)] + [(20, " ".join(w[100:130]))]
    docs = [" ".join(w[:90]), " ".join(w[60:]), prose(300, 91), "x"]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    table = documents(spark, docs).select("doc_id", "text")
    watched = table.mapInArrow(counted, table.schema)
    got = sorted(winnowing.contamination(watched, spark.createDataFrame(items, "item_id long, text string")).collect(), key=lambda r: r.id)
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in got] == brute(docs, items)
    assert reads.value == 3 * len(docs)


def test_a_gram_that_many_items_share(spark):
    common = " ".join(prose(5, 92).split()[:5])
    items = [(k, f"{prose(10, 100 + k)} {common} {prose(10, 300 + k)}") for k in range(60)]
    docs = [f"{prose(20, 500 + k)} {common} {prose(20, 600 + k)}" for k in range(60)] + [items[3][1] + " " + items[4][1]]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(winnowing.contamination(documents(spark, docs), table).collect(), key=lambda r: r.id)
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in got] == brute(docs, items)


@pytest.mark.parametrize("listed", [1, 0])
def test_clean_shuffles_no_text_for_a_list_that_fits(spark, monkeypatch, listed):
    monkeypatch.setattr(winnowing, "BROADCAST_KEYS", 1000 * listed)
    item = prose(40, 50)
    docs = documents(spark, [item, None, "", prose(60, 51), item + " " + prose(9000, 52), prose(30, 53) + " " + item]).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, item), (None, prose(50, 54))], docs.schema))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
    try:
        left = winnowing.clean(docs, items)
        assert sorted((r.doc_id or -1, len(r.text or "")) for r in left.collect()) == sorted(
            (r.doc_id or -1, len(r.text or "")) for r in docs.collect() if item not in (r.text or "") or len(r.text) > 9000)
        assert ("SortMergeJoin" in left._jdf.queryExecution().executedPlan().toString()) == (not listed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
