"""Features, similar pairs, components, clusters and reports, against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import clusters, features, reports, similarity
from postloom.operators.components import components
from postloom.plans import titles
from postloom.scratch import Scratch

WORDS = "data analyst engineer senior risk cloud ml ops nurse web lead research retail bi x".split()


def random_titles(n, seed, words=WORDS):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def dense_vectors(rows):
    """Unit vectors of all rows, straight from the definition."""
    import re
    blocks = {"w": [], "c": []}
    for t in rows:
        tok = re.findall(r"\w\w+", t)
        blocks["w"].append(Counter(" ".join(tok[i:i + n]) for n in (1, 2, 3) for i in range(len(tok) - n + 1)))
        blocks["c"].append(Counter(
            w[i:i + n] for w in (f" {x} " for x in t.split()) for n in (3, 4, 5) for i in range(len(w) - n + 1)))
    parts = []
    for docs in blocks.values():
        df = Counter(g for d in docs for g in d)
        vocab = {g: i for i, g in enumerate(sorted(g for g in df if df[g] >= 2))}
        m = np.zeros((len(rows), len(vocab)))
        for i, d in enumerate(docs):
            for g, tf in d.items():
                if g in vocab:
                    m[i, vocab[g]] = tf * (math.log((1 + len(rows)) / (1 + df[g])) + 1)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        parts.append(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))
    m = np.hstack(parts)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def naive_linkage(sim, theta=0.45):
    """Merge the closest two clusters while their average distance is below theta."""
    groups = [[i] for i in range(len(sim))]
    while len(groups) > 1:
        best = max(((sim[np.ix_(g, h)].mean(), -i, -j) for i, g in enumerate(groups)
                    for j, h in enumerate(groups) if i < j))
        if not 1 - best[0] < theta:
            break
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def rows_df(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "arrival long, title_updated string")


def vectors_of(spark, rows):
    scratch = Scratch(spark, "test")
    t = scratch.save(features.distinct_titles(rows_df(spark, rows)), "titles")
    vectors, members = similarity.title_vectors(t, scratch)
    return vectors, members, scratch


def test_tfidf_rows(spark):
    rows = ["ai ops", "ai ops", "data ai", "b", "zz"]
    t = features.distinct_titles(rows_df(spark, rows))
    got = defaultdict(dict)
    for r in features.tfidf_word(t).collect():
        got[r.title_id][r.feature] = r.weight
    idf = lambda df: math.log(6 / (1 + df)) + 1
    n = math.sqrt(idf(3) ** 2 + 2 * idf(2) ** 2)
    assert set(got) == {0, 2}
    assert got[0] == pytest.approx({"ai": idf(3) / n, "ops": idf(2) / n, "ai ops": idf(2) / n})
    assert got[2] == pytest.approx({"ai": 1.0})
    chars = {r.feature for r in features.tfidf_char(t).where("title_id = 2").collect()}
    assert chars == {" ai", "ai ", " ai "}
    union = features.union_features(features.tfidf_word(t), features.tfidf_char(t))
    lengths = union.groupBy("title_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(math.isclose(r.s, 1.0) for r in lengths)


@pytest.mark.parametrize("seed, block, per_group", [(1, 1024, 20_000), (2, 3, 50)])
def test_similar_pairs_brute_force(spark, seed, block, per_group, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "PAIRS_PER_GROUP", per_group)
    rows = random_titles(150, seed)
    vectors, members, scratch = vectors_of(spark, rows)
    sim = dense_vectors(rows) @ dense_vectors(rows).T
    for low in (0.55, 0.2)[:seed]:
        got = {(r.a, r.b): r.sim for r in similarity.similar_pairs(vectors, low, Scratch(spark, "t")).collect()}
        ids = sorted(r.id for r in vectors.collect())
        want = {(a, b): sim[a, b] for i, a in enumerate(ids) for b in ids[i + 1:] if sim[a, b] >= low}
        assert set(got) == set(want)
        assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_vectors_and_pairs_are_shuffled_but_no_products(spark, monkeypatch):
    """Vectors meet in cells of blocks; a pair is made once, whatever number of features it shares."""
    monkeypatch.setattr(similarity, "FEATURES", 300)
    rows = [*random_titles(60, 4), *(f"senior cloud data platform engineer number{k % 7} team{k}" for k in range(40))]
    vectors, _, scratch = vectors_of(spark, rows)
    pairs = similarity.similar_pairs(vectors, 0.55, scratch)
    for df in (pairs, similarity.candidate_pairs(vectors, 0.55, scratch)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Aggregate" not in plan
    sim = dense_vectors(rows) @ dense_vectors(rows).T
    ids = sorted(r.id for r in vectors.collect())
    want = sorted((a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sim[a, b] >= 0.55)
    assert sorted((r.a, r.b) for r in pairs.collect()) == want and want


def test_candidates_by_partial_products(spark, monkeypatch):
    """No pair is missed wherever the sum ends, and the longer it is the fewer are left."""
    vectors, _, scratch = vectors_of(spark, random_titles(200, 7))
    held = {r.id: dict(zip(r.fids, r.ws)) for r in vectors.collect()}
    product = lambda a, b: sum(w * held[b].get(f, 0.0) for f, w in held[a].items())
    want = {(a, b) for a in held for b in held if a < b and product(a, b) >= 0.55}
    left = []
    for carried in (0.0, 0.7, 1.0):
        monkeypatch.setattr(similarity, "CARRIED", carried)
        got = {tuple(r) for r in similarity.candidate_pairs(vectors, 0.55, Scratch(spark, "t")).collect()}
        assert want <= got
        left.append(len(got))
    assert left == sorted(left) and left[1] < left[2]


def test_linkage_never_puts_a_vocabulary_into_one_row(spark):
    """A cluster sum is as many rows as it has features, in the plan of the averages too."""
    links = spark.createDataFrame([(1, 2, 1, 1)], "a long, b long, na long, nb long")
    sums = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.5), (2, 7, 1.0)], "cluster long, fid long, s double")
    out = clusters._averages(links, sums)
    assert [tuple(r) for r in out.collect()] == [(1, 2, 1, 1, 0.5)]
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInPandas" not in plan and "CartesianProduct" not in plan


def test_identical_vectors_fold(spark):
    # a third of the rows differ by a unique token only, which is no feature
    rows = [f"analyst {1000 + 7919 * i}q" for i in range(40)] + random_titles(80, 3)
    vectors, members, scratch = vectors_of(spark, rows)
    dense = dense_vectors(rows)
    for r in members.collect():
        assert np.allclose(dense[r.title_id], dense[r.id])
    sizes = {r.id: r.n for r in vectors.collect()}
    assert sum(sizes.values()) == sum(1 for d in dense if d.any())


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)]
    pairs += [tuple(sorted(rng.sample(range(200, 260), 2))) for _ in range(35)]
    relabel = list(range(300))
    rng.shuffle(relabel)
    pairs = [tuple(sorted((relabel[a], relabel[b]))) for a, b in pairs]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def run_linkage(spark, sims, weights):
    """Linkage over given similarities, by vectors that have them as products."""
    names = sorted(weights)
    # a large diagonal makes any products possible; it is not used
    gram = np.array([[2.0 if a == b else sims.get((min(a, b), max(a, b)), 0.0) for b in names] for a in names])
    root = np.linalg.cholesky(gram)
    scratch = Scratch(spark, "link")
    vec = [(a, weights[a], list(range(len(names))), [float(x) for x in root[i]]) for i, a in enumerate(names)]
    vectors = scratch.save(spark.createDataFrame(vec, "id long, n long, fids array<long>, ws array<double>"), "v")
    near = [(a, b, s) for (a, b), s in sims.items() if s > 0.55]
    pairs = scratch.save(spark.createDataFrame(near, "a long, b long, sim double"), "p")
    joined = {r.node: r.parent for r in clusters.average_linkage(vectors, pairs, scratch).collect()}
    return {a: joined.get(a, a) for a in names}


def test_linkage_fixture(spark):
    sims = {(1, 2): 0.90, (2, 3): 0.70, (1, 3): 0.30}
    assert run_linkage(spark, sims, {1: 1, 2: 1, 3: 1}) == {1: 1, 2: 1, 3: 3}
    assert run_linkage(spark, sims, {1: 1, 2: 3, 3: 1}) == {1: 1, 2: 1, 3: 1}


def test_linkage_random(spark, seed=1):
    """Random dense vectors: no ties, many partly linked clusters."""
    rng = np.random.default_rng(seed)
    n = 40
    m = np.abs(rng.normal(size=(n, 6))) * (rng.random((n, 6)) < 0.6) + rng.random((n, 6)) * 0.05
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    gram = m @ m.T
    scratch = Scratch(spark, "link")
    vec = [(i, 1, list(range(6)), [float(x) for x in m[i]]) for i in range(n)]
    vectors = scratch.save(spark.createDataFrame(vec, "id long, n long, fids array<long>, ws array<double>"), "v")
    near = [(i, j, float(gram[i, j])) for i in range(n) for j in range(i + 1, n) if gram[i, j] > 0.55]
    pairs = scratch.save(spark.createDataFrame(near, "a long, b long, sim double"), "p")
    joined = {r.node: r.parent for r in clusters.average_linkage(vectors, pairs, scratch).collect()}
    got = defaultdict(set)
    for i in range(n):
        got[joined.get(i, i)].add(i)
    assert {frozenset(g) for g in got.values()} == naive_linkage(gram)
    assert all(k == min(g) for k, g in got.items())


@pytest.mark.parametrize("small, rows, width", [(4, 10**6, 4096), (256, 10**6, 3), (256, 60, 4096)])
def test_cluster_titles_brute_force(spark, small, rows, width, monkeypatch):
    monkeypatch.setattr(clusters, "SMALL", small)  # both ways, local only, both ways by the number of features
    monkeypatch.setattr(clusters, "LOCAL_ROWS", rows)
    monkeypatch.setattr(clusters, "WIDTH", width)
    monkeypatch.setattr(clusters, "BATCH", 5)
    words = "data analytics analyst engineer engineering scientist platform cloud risk security systems network".split()
    rng = random.Random(11)
    rows = [" ".join(rng.sample(words, rng.randint(2, 4))) for _ in range(45)]
    rows += ["", "", "unique-zzzz", "data analyst"] * 2
    rows.remove("unique-zzzz")
    df = rows_df(spark, rows)
    out = clusters.assign(df, clusters.cluster_titles(df))
    got = defaultdict(set)
    for r in out.collect():
        got[r.cluster_id].add(r.arrival)
    assert all(k == min(g) for k, g in got.items())
    dense = dense_vectors(rows)
    sim = dense @ dense.T
    assert {frozenset(g) for g in got.values()} == naive_linkage(sim)
    blanks = [i for i, t in enumerate(rows) if not t]
    assert all({i} in got.values() for i in blanks)


def test_titles_plan_and_reports(spark):
    rows = [(1, "Data Analyst (Toronto)"), (2, "data analyst II"), (3, None), (4, "Welder"), (5, "Welder"),
            (6, "Data Analyst (Toronto)"), (7, None)]
    df = titles.clustered(spark.createDataFrame(rows, "arrival long, title string"))
    ids = {r.arrival: r.cluster_id for r in df.collect()}
    assert ids == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 1, 7: 7}
    assert [tuple(r) for r in reports.cluster_sizes(df, 3).collect()] == [(1, 3), (4, 2), (3, 1)]
    top = {(r.cluster_id, r.rank): (r.title, r.n, r["size"]) for r in reports.top_titles(df, 1).collect()}
    assert top == {(1, 1): ("Data Analyst (Toronto)", 2, 3), (4, 1): ("Welder", 2, 2)}
    assert sorted(r.arrival for r in reports.outside_top(df, 2).collect()) == [3, 7]
    assert tuple(reports.outside_summary(df, 2).first()) == (2, 2)
    assert tuple(reports.outside_summary(df, 9).first()) == (0, 0)
    assert [r.title for r in reports.cluster_members(df, 1).collect()] == ["Data Analyst (Toronto)", "data analyst II"]
    assert [r.title_updated for r in reports.preview(df, ["title", "title_updated"], 2).collect()] == ["Data Analyst"] * 2
    roles = [tuple(r) for r in titles.role_counts(df).collect()]
    assert roles == [("Data Analyst", 3), ("", 2), ("welder", 2)]


def test_empty_and_single_vocabulary(spark):
    df = rows_df(spark, ["alpha", "beta"])
    out = clusters.assign(df, clusters.cluster_titles(df)).collect()
    assert {r.arrival: r.cluster_id for r in out} == {0: 0, 1: 1}


def test_a_component_of_hundreds_of_clusters_is_linked_inside_a_task(spark, monkeypatch):
    size, rng = 300, np.random.default_rng(5)
    dense = np.zeros((size, size + 2))
    dense[:, -1] = 0.6
    for i, share in enumerate(rng.uniform(0.5, 0.7, size)):  # neighbours share a feature, all share the last
        dense[i, i], dense[i, i + 1] = share, 1.2 - share
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    n = rng.integers(1, 4, size).astype(float)
    rows = [(i, int(n[i]), [*map(int, np.flatnonzero(v))], [*map(float, v[v > 0])]) for i, v in enumerate(dense)]
    sim = dense @ dense.T
    near = [(i, j, float(sim[i, j])) for i in range(size) for j in range(i + 1, size) if sim[i, j] >= 0.55]
    scratch, written, save = Scratch(spark, "test"), [], Scratch.save
    vectors = scratch.save(spark.createDataFrame(rows, "id long, n long, fids array<long>, ws array<double>"), "vectors")
    pairs = scratch.save(spark.createDataFrame(near, "a long, b long, sim double"), "pairs")
    assert len({r.component for r in components(pairs).collect()}) == 1
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: written.append(name) or save(self, df, name))
    joined = {r.node: r.parent for r in clusters.link_components(vectors, pairs, scratch).collect()}
    assert not [x for x in written if x.startswith("relinked-")]

    total, home, weight = np.outer(n, n) * sim, np.arange(size), n.copy()
    while True:
        mean = np.triu(np.round(total / np.outer(weight, weight), 12), 1)
        a, b = divmod(int(mean.argmax()), size)
        if not 1 - mean[a, b] < 0.45:
            break
        home[home == b] = a
        total[a] += total[b]
        total[:, a] += total[:, b]
        total[b] = total[:, b] = 0.0
        weight[a] += weight[b]
    assert 1 < len(set(home.tolist())) < size
    assert [joined.get(i, i) for i in range(size)] == home.tolist()
