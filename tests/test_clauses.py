"""Queries over whole texts, and the stream of the registered query."""

import __spark_entry__ as entry
from postloom.plans import collect
from postloom.scratch import Scratch
from postloom.sources.store import PostingStore


def write(spark, texts):
    folder = Scratch(spark, "tables").root
    rows = [(k, t, "en", "src1", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    return folder


def test_every_clause_is_a_posting(spark):
    folder = write(spark, ["first one,the late clause|x\nlast", "alone", "."])
    got = [tuple(r) for r in entry.clause_postings(spark, folder).orderBy("arrival").collect()]
    second, third = 1 << 32, 2 << 32
    assert got == [(0, "first one"), (1, "the late clause"), (2, "x"), (3, "last"), (second, "alone"), (third, ""), (third + 1, "")]
    counts = {r.title_updated: r.n for r in entry.queries()["clause_role_counts"](spark, folder).collect()}
    assert counts["The"] == 1 and sum(counts.values()) == 7


def test_later_clauses_make_clusters_above_the_small_size(spark):
    folder = write(spark, [f"n{k}x. senior data platform engineer z{k}y" for k in range(300)])
    parts = entry.queries()["clause_title_components"](spark, folder).groupBy("component").count().collect()
    assert max(r["count"] for r in parts) > entry.linkage.SMALL


def test_stream_takes_three_batches_onto_a_filled_store(spark, monkeypatch):
    stores = []
    monkeypatch.setattr(entry, "PostingStore", lambda *a: stores.append(PostingStore(*a)) or stores[-1])
    folder = write(spark, [f"the clerk {k % 30}. text" for k in range(40)])
    got = sorted(r.arrival for r in entry.queries()["ingest_stream"](spark, folder).collect())
    assert sorted(len(stores[0].batches(w)) for w in stores[0].writers()) == [1, 3]
    whole = PostingStore(spark, f"{Scratch(spark, 'store').root}/postings")
    collect.ingest(whole, entry.postings(spark, folder), entry.CFG)
    assert got == sorted(r.arrival for r in whole.read().collect()) and 0 < len(got) < 40
