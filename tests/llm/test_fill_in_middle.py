import hashlib
import random

import numpy as np
import pytest
import regex

from postloom.llm import fill_in_middle as m
from postloom.llm import queries

from .data import as_tables, documents, prose, texts

MORE = ["é" * 3000, "漢字 <P> held", "<S>", "a<M", "<M>" * 3, "<P" * 5, ">x<", "𝒳é漢x" * 700, "﻿‍" * 9, "a" * 511, "é" * 256, "é" * 257]


def brute(doc_id, text):
    t = text or ""
    hex64 = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hex64[8 * k: 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(t), sha(t)
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, sha(f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"), sha(t)
    return n, "psm", a, b - a, sha(f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"), sha(t)


def test_registered_query_against_brute_force(spark, tmp_path):
    all_texts = [*texts(), *MORE, *[prose(random.Random(k).randint(1, 90), 50 + k) for k in range(150)]]
    docs = documents(spark, all_texts)
    docs = docs.unionByName(docs.limit(9))
    got = queries.op11_fill_in_middle(spark, as_tables(docs, tmp_path)).collect()
    want = [brute(i, all_texts[i]) for i in range(len(all_texts))]
    assert len(got) == len(all_texts) + 9
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_null_ids_empty_table_kept_columns(spark):
    rows = spark.createDataFrame([(None, "some words here", 1.0), (None, None, 2.0), (3, "", 3.0)], "doc_id long, text string, n_chars double")
    got = m.transform(rows, keep=("n_chars",)).collect()
    assert [r.n for r in got] == [15, 0, 0] and [r.n_chars for r in got] == [1.0, 2.0, 3.0]
    assert got[0].form == brute(None, "some words here")[1] and got[1].form == "plain"
    assert m.transform(rows.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 64, 512])
def test_every_cut(block, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_BYTES", block)
    for text in ("", "a", "é", "añ漢𝒳" * 40, "x" * 130):
        blocks = m.Blocks(np.frombuffer(text.encode(), np.uint8))
        assert blocks.n == len(text)
        for k in range(len(text) + 1):
            assert blocks.cut(k) == (len(text[:k].encode()), k)


def test_units_by_a_pattern(monkeypatch):
    monkeypatch.setattr(m, "BLOCK_BYTES", 8)
    text = "  één  twee drie\tvier " * 9
    pattern = regex.compile(r"\w+")
    starts = [x.start() for x in pattern.finditer(text)]
    blocks = m.Blocks(np.frombuffer(text.encode(), np.uint8), pattern)
    assert blocks.n == len(starts) == 36
    for k in range(1, 36):
        assert blocks.cut(k) == (len(text[: starts[k]].encode()), starts[k])
    assert blocks.cut(0) == (0, 0) and blocks.cut(36) == (len(text.encode()), len(text))


def test_pattern_through_spark(spark):
    docs = documents(spark, [prose(30, 70 + k) for k in range(20)])
    for r in m.transform(docs, unit=r"\S+", cut_percent=100, spm_percent=0).collect():
        assert r.n == 30 and r.form == "psm"
        prefix, rest = r.output.removeprefix("<P>").split("<S>")
        suffix, middle = rest.split("<M>")
        assert prefix.split() + middle.split() + suffix.split() == prose(30, 70 + r.doc_id).split()


def test_fenwick_tree_sums():
    counts = np.random.default_rng(1).integers(0, 9, 37)
    tree = m._fenwick(counts)
    for i in range(len(counts) + 1):
        total, k = 0, i
        while k:
            total, k = total + tree[k], k & (k - 1)
        assert total == counts[:i].sum()
