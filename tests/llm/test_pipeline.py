import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from postloom.scratch import Scratch

from .data import documents, prose, texts
from .test_bucket_refine import brute as without_repeats
from .test_decision_list import brute as statistics
from .test_minhash import brute as groups
from .test_minhash import family
from .test_winnowing import brute as contamination


def tables(spark, folder):
    item = prose(40, 900)
    good = [*texts(), *family(25, 5), *(prose(40, 300 + k) for k in range(50)), item + " " + prose(60, 901)]
    junk = [" ".join(f"{w}###" for w in prose(40, 400 + k).split()) for k in range(50)]
    all_texts = [*good, *junk]
    documents(spark, all_texts, extra=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < len(good))) for k in range(len(all_texts))], "doc_id long, quality int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return all_texts, len(good), item


def test_against_brute_force(spark):
    folder = Scratch(spark, "tables").root
    all_texts, good, item = tables(spark, folder)
    left = {k: t for k, t in enumerate(all_texts) if k < good and not statistics(t)[-1]}
    of = lambda d: list(d.values())
    left = {k: t for (k, t), g in zip(left.items(), groups(of(left))) if g[2]}
    left = {k: b[3].decode(errors="ignore") for k, b in zip(left, without_repeats(of(left)))}
    left = {k: t for (k, t), c in zip(left.items(), contamination(of(left), [(1, item)])) if not c[3]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in left.items()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == want
    assert all(r.n_tokens == len(want[r.doc_id]) for r in got) and len(got) == len(want) and 0 < len(want) < good


def test_stages_keep_columns_and_take_empty_tables(spark):
    folder = Scratch(spark, "tables").root
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "BPE encoding"]


def test_last_stage_decodes_its_ids(spark):
    docs = documents(spark, ["the clerk", "é漢字 \n x", "", None], extra=False)
    got = {r.doc_id: r.text for r in corpus_pipeline.token_ids(spark, docs, "").collect()}
    assert got == {0: "the clerk", 1: "é漢字 \n x", 2: "", 3: ""}
