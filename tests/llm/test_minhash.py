import random

import numpy as np
import pyarrow as pa

from postloom.llm import minhash_bayes as m

from .data import documents, prose, texts


def brute(all_texts):
    sets = []
    for t in all_texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def family(n, seed=1):
    """Near copies of near copies: chains of links in which far members are not links."""
    r = random.Random(seed)
    made = [prose(150, seed)]
    for _ in range(n):
        words = r.choice(made).split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = prose(1)
        made.append(" ".join(words))
    return made


def check(spark, all_texts):
    got = sorted(m.near_duplicates(documents(spark, all_texts)).collect(), key=lambda x: x.id)
    assert [(x.n_shingles, x.component, x.kept) for x in got] == brute(all_texts)


def test_against_brute_force(spark, monkeypatch):
    check(spark, [*texts(), *family(120), *family(30, 2)])
    monkeypatch.setattr(m, "BLOCK", 4)
    monkeypatch.setattr(m, "BROADCAST_IDS", 0)
    check(spark, family(80, 3))


def test_edge_cases(spark):
    docs = documents(spark, [None, "", "a b"])
    assert [x.component for x in sorted(m.near_duplicates(docs).collect(), key=lambda x: x.id)] == [0, 1, 2]
    assert m.near_duplicates(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (4, "d e f"), (7, "d e f")], "doc_id long, text string")
    got = sorted((x.id is None, x.id, x.component, x.kept) for x in m.near_duplicates(rows).collect() if x.id is not None)
    assert got == [(False, 4, 4, True)] * 3 + [(False, 7, 4, False)]
    stay = sorted((r.doc_id or -1) for r in m.one_per_group(rows).collect())
    assert stay == [-1, 4]


def test_pruning_keeps_the_miss_probability():
    r = np.random.default_rng(2)
    pairs = 20000
    left = r.integers(0, 1 << 32, (pairs, m._N), dtype=np.uint32)
    at = lambda j: np.where(r.random((pairs, m._N)) < j, left, left + 1)
    assert m.possible(left, at(0.85).astype(np.uint32)).all()
    assert m.possible(left, at(0.5).astype(np.uint32)).mean() < 0.01


def test_signatures_estimate_similarity():
    words = prose(600, 9).split()
    column = pa.array([" ".join(words[:500]), " ".join(words[100:])])
    (_, a), (_, b) = m.shingle_sets(column)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((m.signature(a) == m.signature(b)).mean() - true) < 0.12


def test_pairs_between_two_thresholds(spark):
    words = prose(150, 21).split()
    edited = [f"edit{k}" if k in (30, 70, 110) else w for k, w in enumerate(words)]  # 131 of 161 shingles: 0.814
    docs = documents(spark, [" ".join(words), " ".join(edited), prose(80, 22)])
    component = lambda p: [r.component for r in sorted(m.near_duplicates(docs, percent=p).collect(), key=lambda x: x.id)]
    assert component(80) == [0, 0, 2] and component(85) == [0, 1, 2]
    assert sorted(r.doc_id for r in m.one_per_group(docs, percent=80).collect()) == [0, 2]
    assert m.one_per_group(docs).count() == 3


def test_bands_follow_the_threshold():
    assert m.shape(85) == (m.BANDS, m.ROWS)
    for percent in (75, 80, 85, 95):
        bands, rows = m.shape(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 3e-7 and bands * rows <= m._N


def test_one_stranger_does_not_square_a_large_group(spark, monkeypatch):
    from postloom.scratch import Scratch

    monkeypatch.setattr(m, "BLOCK", 8)
    r = np.random.default_rng(8)
    base = [f"w{k}" for k in r.integers(0, 5000, 400)]
    near = []
    for _ in range(200):
        copy = list(base)
        copy[int(r.integers(0, 400))] = f"n{r.integers(0, 1 << 30)}"
        near.append(" ".join(copy))
    strangers = []
    for k in range(3):  # 0.6 to 0.8 alike: they share bands with the group but no link
        other = list(base)
        for i in range(0, 400, 36 + 5 * k):
            other[i] = f"s{k}-{i}"
        strangers.append(" ".join(other))
    rows = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: rows.append((name, save(self, df, name))) or rows[-1][1])
    check(spark, near + strangers)
    mixed = [t for n, t in rows if n == "mixed"][0]
    per = mixed.selectExpr("count(*) n", "sum(if(grp = main, others, others + mains)) dealt").first()
    assert per.n == 0 or per.dealt <= 3 * per.n
