import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from postloom.llm import queries
from postloom.llm import simhash_trie as m
from postloom.scratch import Scratch

from .data import as_tables, documents, prose, texts


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k: k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, budget=4):
    """The smallest place reachable from each."""
    group = list(range(len(values)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, u in enumerate(values):
        for j in range(i):
            if (u ^ values[j]).bit_count() <= budget:
                x, y = top(i), top(j)
                group[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(values))]


def crowd(seed, n, flips=3, within=range(64)):
    """Fingerprints that differ a little from others among them, all distinct."""
    r = random.Random(seed)
    made = [r.getrandbits(64)]
    while len(made) < n:
        x = r.choice(made)
        for b in r.sample(list(within), r.randint(1, flips)):
            x ^= 1 << b
        if x not in made:
            made.append(x)
    return made


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups_of(spark, values, budget=4):
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(5)
    place = {signed(v): k for k, v in enumerate(values)}
    found = m.links(fps, Scratch(spark, "simhash-test"), budget).collect()
    group = list(range(len(values)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for r in found:
        assert (values[place[r.a]] ^ values[place[r.b]]).bit_count() <= budget
        x, y = top(place[r.a]), top(place[r.b])
        group[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(values))]


def mixed(seed):
    r = random.Random(seed)
    low, high = crowd(seed + 2, 90, 4, range(12)), crowd(seed + 3, 90, 4, range(50, 64))
    far = [r.getrandbits(64) for _ in range(200)]
    return list(dict.fromkeys([*crowd(seed, 150), *crowd(seed + 1, 60, 6), *low, *high, *far, 0, (1 << 64) - 1, 1, 31, 3 << 62]))


def test_links_against_all_pairs(spark, monkeypatch):
    values = mixed(1)
    want = brute_groups(values)
    assert len(set(want)) < len(values)
    assert groups_of(spark, values) == want
    monkeypatch.setattr(m, "CELL", 3)
    monkeypatch.setattr(m, "TOGETHER", 16)
    monkeypatch.setattr(m, "WALKED", 4)
    monkeypatch.setattr(m, "COMPARED", 7)
    assert groups_of(spark, values) == want


def test_other_budgets(spark):
    values = mixed(20)
    for budget in (0, 1, 6):
        assert groups_of(spark, values, budget) == brute_groups(values, budget)


def test_walk_finds_every_group_from_the_root():
    for seed in range(30):
        values = sorted(mixed(seed)[:: random.Random(seed).randint(1, 3)])
        r = np.array(values, np.uint64)
        found = m.walk(r, np.array([[0], [len(r)], [0], [len(r)], [0], [0]]), 4)
        group = list(range(len(r)))

        def top(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in found:
            x, y = top(a), top(b)
            assert x != y
            group[max(x, y)] = min(x, y)
        assert [top(i) for i in range(len(r))] == brute_groups(values)


def test_fingerprints():
    for text in [*texts(), "a b c d", "A B c D", "a b c", "a b c d " * 40000]:
        assert m.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_hashes_are_sparks(spark):
    row = spark.sql("SELECT xxhash64('one two three four') AS h").first()
    assert xxhash.xxh64_intdigest(b"one two three four", m.SEED) == row.h % (1 << 64)


def near_copies(n, seed):
    r = random.Random(seed)
    base = prose(400, seed).split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = prose(1)
        out.append(" ".join(words))
    return out


def test_registered_query_against_brute_force(spark, tmp_path, monkeypatch):
    all_texts = [*texts(), *near_copies(60, 5), *near_copies(20, 6), *[prose(40, 200 + k) for k in range(60)], "", None]
    docs = documents(spark, all_texts)
    fps = [brute_fingerprint(t) for t in all_texts]
    groups = brute_groups(fps)
    folder = as_tables(docs, tmp_path)
    for cell in (m.CELL, 2):
        monkeypatch.setattr(m, "CELL", cell)
        got = queries.op13_simhash(spark, folder).collect()
        assert sorted(map(tuple, got)) == [(i, f"{fps[i]:016x}", groups[i]) for i in range(len(all_texts))]


def test_edge_cases(spark):
    docs = documents(spark, [None, "", " \n", "a b c", "a b c"])
    assert [r.component for r in m.near_duplicates(docs).orderBy("id").collect()] == [0, 0, 0, 3, 3]
    assert m.near_duplicates(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (4, "d e f"), (7, "d e f"), (None, "x y z w")], "doc_id long, text string")
    got = m.near_duplicates(rows).where(F.col("id").isNotNull()).collect()
    assert sorted((r.id, r.component) for r in got) == [(4, 4)] * 3 + [(7, 4)]
    assert sorted(str(r.component) for r in m.near_duplicates(rows).where("id IS NULL").collect()) == ["4", "None"]
