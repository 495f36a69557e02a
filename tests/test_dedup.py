"""De-duplication against small sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from postloom.operators import dedup
from postloom.operators.dedup import dedup_batch, drop_seen, greedy_dedup

COLS = "arrival long, title string, url string, company string, scraped_at string"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def kept(df):
    return sorted(r.arrival for r in df.collect())


def greedy_model(rows):
    urls, sigs, out = set(), set(), []
    for a, t, u, c, _ in sorted(rows):
        u = (u or "").strip()
        sig = (t.lower().strip(), c.lower().strip())
        if (u and u in urls) or sig in sigs:
            continue
        out.append(a)
        sigs.add(sig)
        if u:
            urls.add(u)
    return out


def random_rows(n, seed, keys):
    rng = random.Random(seed)
    return [(i, f"T{rng.randrange(keys)}", rng.choice([None, "", *[f"u{k}" for k in range(keys)]]), "c",
             rng.choice([None, "2024-01-01", "2024-01-02"])) for i in range(n)]


def test_greedy_fixture(spark):
    rows = [(1, "s1", "u1", "c", None), (2, "s2", "u1", "c", None), (3, "s2", "u2", "c", None),
            (4, "s3", None, "c", None), (5, "s4", None, "c", None), (6, "s3", "u4", "c", None)]
    assert kept(greedy_dedup(frame(spark, rows))) == [1, 3, 4, 5]
    assert kept(greedy_dedup(frame(spark, rows[1:]))) == [2, 4, 5]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_random(spark, seed):
    rows = random_rows(300, seed, 40)
    assert kept(greedy_dedup(frame(spark, rows))) == greedy_model(rows)


def test_greedy_chain_and_hot_key(spark):
    # every row shares a key with its neighbours, and a third has one URL
    rows = [(i, f"s{(i + 1) // 2}", f"u{i // 2}", "c", None) for i in range(14)]
    rows += [(100 + i, f"h{i}", "hot", "c", None) for i in range(100)]
    rows += [(300 + i, "same", f"v{i}", "c", None) for i in range(100)]
    rows += [(500 + i, "blank", None, "c", None) for i in range(20)]
    assert kept(greedy_dedup(frame(spark, rows))) == greedy_model(rows)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    saved, save = [], dedup.Scratch.save
    monkeypatch.setattr(dedup.Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    rows = [(i, f"s{(i + 1) // 2}", f"u{i // 2}", "c", None) for i in range(4096)]
    assert kept(greedy_dedup(frame(spark, rows))) == list(range(0, 4096, 2))
    assert len(saved) <= 30


@pytest.mark.parametrize("seed", range(3))
def test_greedy_random_along_chains(spark, seed, monkeypatch):
    """Chains that branch, meet and end at rows with two rivals, followed from the first round on."""
    monkeypatch.setattr(dedup, "PLAIN_ROUNDS", 0)
    rng = random.Random(seed)
    rows = [(i, f"s{(i + 1) // 2 + rng.choice([0, 0, 0, 1, 5])}", rng.choice([f"u{i // 2}"] * 6 + [f"u{i // 2 + 2}", None]), "c", None)
            for i in range(250)]
    rows = [(a, *rest) for a, (_, *rest) in zip(rng.sample(range(10**6), len(rows)) if seed else range(len(rows)), rows)]
    assert kept(greedy_dedup(frame(spark, rows))) == greedy_model(rows)


def test_greedy_empty(spark):
    assert kept(greedy_dedup(frame(spark, []))) == []


def batch_model(rows, with_time=True):
    import re
    def sig(t, c):
        return re.sub("[^a-z0-9]", "", c.lower()) + "_" + re.sub("[^a-z0-9]", "", t.lower())
    items = [(sig(t, c), len(u or ""), s, a, u or "") for a, t, u, c, s in rows]
    items.sort(key=lambda r: r[3])
    if with_time:
        items.sort(key=lambda r: r[2] or "", reverse=True)
    items.sort(key=lambda r: (r[0], r[1]))
    sigs, urls, out = set(), set(), []
    for s, _, _, a, u in items:
        if s in sigs:
            continue
        sigs.add(s)
        if u not in urls:
            urls.add(u)
            out.append(a)
    return out


def test_batch_fixture(spark):
    rows = [(1, "Data Analyst", "https://x/aaaa", "Intact.", "2024-01-01 00:00:00"),
            (2, "data analyst", None, "Intact", "2024-01-02 00:00:00"),
            (3, "ML Engineer", None, "Acme", "2024-01-03 00:00:00"),
            (4, "BI Developer", "https://x/b", "Beta", None),
            (5, "BI  Developer", "https://x/c", "Beta", "2024-01-01 00:00:00")]
    out = dedup_batch(frame(spark, rows)).collect()
    assert [(r.arrival, r.title, r.url) for r in out] == [(3, "ML Engineer", ""), (5, "BI Developer", "https://x/c")]
    keep = dedup_batch(frame(spark, rows), blank_url="keep").collect()
    assert [r.arrival for r in keep] == [3, 5, 1]


@pytest.mark.parametrize("seed", range(3))
def test_batch_random(spark, seed):
    rows = random_rows(300, seed, 40)
    df = frame(spark, rows)
    assert [r.arrival for r in dedup_batch(df).collect()] == batch_model(rows)
    assert [r.arrival for r in dedup_batch(df.drop("scraped_at")).collect()] == batch_model(rows, False)


def test_batch_needs_only_arrival(spark):
    df = spark.createDataFrame([(1, "x"), (2, "X")], "arrival long, title string")
    out = dedup_batch(df).collect()
    assert [(r.arrival, r.title, r.url, r.company) for r in out] == [(1, "x", "", "")]


def test_batch_has_no_window_on_a_key(spark):
    df = dedup_batch(frame(spark, random_rows(10, 0, 3)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_drop_seen(spark):
    stored = frame(spark, [(0, "T1", "u1", "c", None), (1, "T2", None, "c", None), (2, None, "u9", "c", None)])
    new = frame(spark, [(10, "a", "u1", "c", None), (11, " t2 ", "u2", "C", None), (12, "b", None, "c", None),
                        (13, "d", "N/A", "c", None), (14, "", "u3", "c", None), (15, "T1", "u1", "d", None)])
    assert kept(drop_seen(new, stored)) == [12, 13, 14]


def test_seen_keys(spark):
    from postloom.sources.postings import seen_signatures, seen_urls
    stored = frame(spark, [(0, " T1 ", "u1", "C", None), (1, "t1", "u1", "c", None), (2, None, "", "c", None),
                           (3, "x", None, "N/A", None)])
    assert [r.url_key for r in seen_urls(stored).collect()] == ["u1"]
    assert [tuple(r) for r in seen_signatures(stored).collect()] == [("t1", "c")]
    assert stored.where(F.col("title").isNull()).count() == 1
