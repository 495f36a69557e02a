import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from postloom.llm import url_model as u

URLS = ["http://WWW.Example.com/en/a?x=1", "https://net/es/", "https://a.b.net/fr/x#y", None, "", "no scheme", "x://", "a://b://c",
        "http://h?q/p", "http://h#f/p", "http://com", "http://acom/x", "http://example.com/en/", "http://www.example.com/enx", "http://ÀB.com/É"]
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def parts(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fit = [r for r in RULES if (host == (h := r[1].split("/")[0]) or host.endswith("." + h)) and path.startswith(r[1][len(h):])]
    return host, path, max(fit, key=lambda r: len(r[1])) if fit else None


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)], "n int, url string")
    url = F.col("url")
    rows = df.select("n", "url", u.host(url).alias("h"), u.path(url).alias("p")).select(
        "*", u.rule_of(F.col("h"), F.col("p"), RULES).alias("r")).orderBy("n").collect()
    for r in rows:
        host, path, rule = parts(r.url)
        assert (r.h, r.p, (r.r.verdict, r.r.rule) if r.r else None) == (host, path, rule)


def test_smoothing_against_brute_force():
    urls = ["http://aab/1", "http://aba?x", "http://b"]
    seqs = []
    for x in urls:
        s = [u._CLASS[b] for b in x.split("://")[1].encode()]
        seqs.append([u._OTHER] * u.ORDER + [int(c) for c in s] + [u._OTHER])
    counts = Counter(tuple(s[k: k + u.ORDER + 1]) for s in seqs for k in range(len(s) - u.ORDER))
    dense = np.zeros(u._CODES)
    for x in urls:
        np.add.at(dense, u.codes(x), 1)

    def chance(context, symbol):
        if context is None:
            return 1 / u.SYMBOLS
        own = Counter()
        for g, n in counts.items():
            if g[u.ORDER - len(context): u.ORDER] == context:
                own[g[-1]] += n
        shorter = chance(context[1:] if context else None, symbol)
        return (own[symbol] + len(own) * shorter) / (sum(own.values()) + len(own)) if own else shorter

    table = u.log_likelihood(dense).reshape((u.SYMBOLS,) * (u.ORDER + 1))
    for g in itertools.islice(counts, 12):
        assert math.isclose(table[g], math.log(chance(g[:-1], g[-1])), rel_tol=1e-9)
    assert math.isclose(table[5, 6, 7, 8], math.log(chance((5, 6, 7), 8)), rel_tol=1e-9)
    np.testing.assert_allclose(np.exp(table).sum(axis=-1), 1)


def test_models_tell_held_out_urls_apart(spark):
    rows = [(f"http://news{k}.example.org/article/{k}.html", True) for k in range(300)]
    rows += [(f"http://win-casino{k}.test/bonus?id={k}", False) for k in range(300)] + [(None, True), ("http://x", None)]
    df = spark.createDataFrame([(*r, 5.0) for r in rows], "url string, accepted boolean, score double")
    model = u.learn(df)
    test = spark.createDataFrame([("http://news999.example.org/article/7.html", 0.0), ("http://win-casino7777.test/bonus?id=1", 0.0), (None, 0.0),
                                  ("", 0.0)], "url string, score double")
    got = [r.score for r in u.score(test, model).collect()]
    assert got[0] > model.threshold > got[1] and got[2] == got[3] == 0.0
    assert u.score(test.limit(0), model).count() == 0
    assert u.learn(df.where("accepted")).score(["http://x"]) == [0.0]
    assert u.learn(df.limit(0)).table is None
