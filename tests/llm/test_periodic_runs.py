import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from postloom.llm import periodic_runs as m
from postloom.llm import queries

from .data import as_tables, documents, prose, texts


def brute_runs(words):
    """Every period by itself: maximal stretches in which words that far apart agree, unless a divisor's stretch is the same."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(6, 4 * q) and (start, end) not in found:
                found[start, end] = q
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plant(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute(doc_id, text):
    words = plant(doc_id, (text or "").encode().split())
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(runs), *row, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def repetitive(seed):
    r = random.Random(seed)
    out = []
    for _ in range(r.randint(1, 6)):
        unit = [r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randint(1, 11))]
        out += [*unit * r.randint(1, 9), *unit[: r.randint(0, len(unit))]]
    return " ".join(out)


def test_runs_of_random_words():
    r = random.Random(4)
    for k in range(400):
        words = [r.choice("ab" if k % 2 else "abc") for _ in range(r.randint(0, 70))]
        words = words if k % 3 else repetitive(k).split()
        numbers = np.array([ord(w) for w in words], np.int64)
        numbers = np.unique(numbers, return_inverse=True)[1] if len(words) else numbers
        assert m.find_runs(numbers) == brute_runs(words), words


def test_registered_query_against_brute_force(spark, tmp_path):
    fibonacci = ["a", "a b"]
    while len(fibonacci) < 12:
        fibonacci.append(f"{fibonacci[-1]} {fibonacci[-2]}")
    all_texts = [*texts(), "x " * 5, "x " * 6, "x y " * 4, "x y " * 3 + "x", "\tx\r\nx\x0bx\x0cx  x x ", fibonacci[-1], " ".join(map(str, range(50))),
                 prose(40, 1) + " " + (prose(500, 2) + " ") * 5 + prose(9, 3), *[repetitive(k) for k in range(200)]]
    docs = documents(spark, all_texts)
    docs = docs.unionByName(docs.limit(7))
    got = queries.op12_periodic_runs(spark, as_tables(docs, tmp_path)).collect()
    assert len(got) == len(all_texts) + 7
    assert any(r.n_runs > 1 for r in got) and any(r.n_runs == 0 for r in got)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(all_texts))) > 5
    for r in got:
        assert tuple(r)[1:] == brute(r.doc_id, all_texts[r.doc_id]), all_texts[r.doc_id][:80]


def test_slices_do_not_mix_documents(spark, monkeypatch):
    docs = documents(spark, ["a b", "a b", "a b", "a b a b", None, "a b a b a b a b"] * 20)
    got = m.collapse(docs).collect()
    assert [r.runs != [] for r in got] == [False, False, False, False, False, True] * 20
    assert got[5].collapsed == "a b" and got[4].collapsed == "" and got[3].collapsed == "a b a b"


def test_null_ids_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "a " * 9), (None, None), (3, "")], "doc_id long, text string")
    got = m.collapse(m.planted(rows)).collect()
    assert [(r.doc_id, r.n_words) for r in got] == [(None, 9), (None, 0), (3, 0)]
    assert m.collapse(rows.limit(0)).count() == 0
