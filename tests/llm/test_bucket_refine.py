import random
from collections import Counter

import numpy as np
import pytest

from postloom.llm import bucket_refine

from .data import documents, texts


def brute(all_texts):
    raw = [(t or "").encode() for t in all_texts]
    seen = Counter(t[i: i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i: i + 200]] > 1:
                gone[i: i + 200] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def hard():
    r = random.Random(4)
    piece = lambda n: "".join(r.choice("abcdefg é") for _ in range(n))
    shared, other = piece(450), piece(230)
    made = ["ab" * 300, "ab" * 90 + "c" + "ab" * 110, "z" * 199, "z" * 200, "z" * 201 + piece(40)]
    made += [piece(r.randint(0, 90)) + shared[r.randint(0, 60): 450 - r.randint(0, 200)] + piece(r.randint(0, 90)) for _ in range(40)]
    made += [piece(50) + other + piece(60) + other[:205] + piece(20), other[15:], shared + other + shared]
    return made


@pytest.mark.parametrize("bucket", [1024, 1])
@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_against_brute_force(spark, monkeypatch, bucket, piece):
    monkeypatch.setattr(bucket_refine, "PIECE", piece)
    for name in ("_segments",):
        assert callable(getattr(bucket_refine, name))
    all_texts = [*texts(), *hard()]
    got = sorted(bucket_refine.remove_repeats(documents(spark, all_texts), bucket=bucket, keep=("lang", "k")).collect(),
                 key=lambda x: x.id)
    assert [(x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in got] == brute(all_texts)
    assert {x.k for x in got} == {"clash"}


def test_segments_do_not_depend_on_pieces(monkeypatch):
    data = np.frombuffer("".join(hard()).encode(), np.uint8)
    windows = set()
    for piece in (1 << 20, 777):
        monkeypatch.setattr(bucket_refine, "PIECE", piece)
        windows.add(tuple(np.concatenate([np.repeat(b, hi - lo + 1) for b, _, lo, hi in bucket_refine.segments(data)]).tolist()))
    assert len(windows) == 1


def test_repeated_rows_and_text_form(spark):
    docs = documents(spark, ["é" * 150 + "x", "short", None])
    got = bucket_refine.remove_repeats(docs.unionByName(docs), as_text=True).collect()
    assert sorted((x.n_removed, x.kept) for x in got) == sorted(2 * [(301, ""), (0, "short"), (0, "")])
    assert bucket_refine.remove_repeats(docs.limit(0)).count() == 0
    cut = documents(spark, ["é" * 120, "y" + "é" * 99 + "a"])  # the repeat may begin inside a character
    for x in bucket_refine.remove_repeats(cut, as_text=True).collect():
        assert "\ufffd" not in x.kept


def test_recursive_refinement_against_brute_force():
    r = np.random.default_rng(5)
    for trial in range(20):
        base = bytes(r.integers(97, 97 + (1, 2, 26)[trial % 3], 700, dtype=np.uint8))
        contents = [base[a: a + n] for a, n in zip(r.integers(0, 300, 5), r.integers(200, 400, 5))]
        contents += [bytes(r.integers(0, 256, 250, dtype=np.uint8)), contents[0], bytes(200), bytes([255]) * 300]
        seen = {}
        for k, c in enumerate(contents):
            for i in range(len(c) - 199):
                seen.setdefault(c[i: i + 200], []).append((k, i))
        want = [[len(seen[c[i: i + 200]]) > 1 for i in range(len(c) - 199)] for c in contents]
        assert [x.tolist() for x in bucket_refine.refined(contents)] == want
