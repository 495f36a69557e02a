"""What similar pairs, components and written tables leave on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import components as joined
from postloom.operators import features, similarity
from postloom.scratch import Scratch
from tests.test_clusters import dense_vectors, random_titles, vectors_of


def want(rows, ids, low):
    dense = dense_vectors(rows)
    sim = dense @ dense.T
    return {(a, b): sim[a, b] for i, a in enumerate(ids) for b in ids[i + 1:] if sim[a, b] >= low}


@pytest.mark.parametrize("copies", [10**9, 3000])
def test_cells_in_waves_find_the_same_pairs(spark, monkeypatch, copies):
    monkeypatch.setattr(similarity, "FEATURES", 500)
    monkeypatch.setattr(similarity, "COPIES", copies)
    written, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: written.append(name) or save(self, df, name))
    rows = random_titles(120, 9)
    vectors, _, scratch = vectors_of(spark, rows)
    got = [tuple(r) for r in similarity.similar_pairs(vectors, 0.55, scratch).collect()]
    sims = want(rows, sorted(r.id for r in vectors.collect()), 0.55)
    assert {(a, b) for a, b, _ in got} == set(sims) and len(got) == len(sims) > 50
    assert all(abs(s - sims[a, b]) < 1e-9 for a, b, s in got)
    assert (len([x for x in written if x.startswith("pairs-")]) > 1) == (copies < 10**9)


def test_packs_take_few_bytes_and_give_the_same_vectors(spark):
    rows = [f"senior {w} engineer for {w} platforms {k % 40} team{k % 90}x" for k in range(1500) for w in ("data", "cloud")]
    vectors, _, scratch = vectors_of(spark, rows)
    packs = scratch.save(vectors.select("id", "fids", *similarity._FACTORS).mapInArrow(similarity._packs(10**6), similarity._PACKED), "packs")
    block = similarity._Block(packs.toArrow())
    for r in vectors.where("id % 50 = 0").collect():
        k = int(np.flatnonzero(block.id == r.id)[0])
        own = slice(block.first[k], block.first[k + 1])
        assert block.fids[block.code[own]].tolist() == r.fids
        assert np.allclose(block.w[own], r.ws, rtol=1e-14, atol=0)
    sent = packs.select(sum(F.length(k) for k in similarity._KINDS if k != "w")).collect()
    assert sum(r[0] for r in sent) < 3 * len(block.w)


def test_vectors_without_factors_keep_their_weights(spark):
    vectors, _, scratch = vectors_of(spark, random_titles(60, 5))
    plain = scratch.save(vectors.select("id", "n", "fids", "ws"), "plain")
    pairs = [{tuple(r) for r in similarity.similar_pairs(v, 0.55, scratch).collect()} for v in (vectors, plain)]
    assert pairs[0] == pairs[1] and pairs[0]


@pytest.mark.parametrize("edges", [1_000_000, 50])
def test_components_write_no_pairs(spark, monkeypatch, edges):
    monkeypatch.setattr(joined, "EDGES", edges)
    pairs = spark.range(80).select(F.col("id").alias("a")).crossJoin(spark.range(80).select(F.col("id").alias("b")))
    pairs = pairs.where("a < b and a % 4 = b % 4").union(spark.createDataFrame([(500, 500)], "a long, b long")).coalesce(1)
    written, save = {}, Scratch.save

    def kept(self, df, name):
        written[name] = save(self, df, name)
        return written[name]
    monkeypatch.setattr(Scratch, "save", kept)
    got = {r.node: r.component for r in joined.components(pairs).collect()}
    assert got == {**{k: k % 4 for k in range(80)}, 500: 500}
    assert written["edges-0"].count() < pairs.count() // 2


def test_a_saved_table_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum("shuffle" in str(f) for f in manager.getAllFiles().mkString("\n").split("\n"))
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    at = count()
    table = Scratch(spark, "left").save(spark.range(1000).groupBy(F.col("id") % 7).count(), "sums")
    assert count() <= at and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before


def test_weights_of_factors(spark):
    titles = spark.createDataFrame([("ab cd", 1, 2), ("ab ab", 2, 1)], "title string, title_id long, n long")
    rows = features.unit_vectors(titles).select("fids", features.weights().alias("ws")).collect()
    assert all(abs(sum(w * w for w in r.ws) - 1) < 1e-12 and len(r.ws) == len(r.fids) for r in rows) and len(rows) == 2
