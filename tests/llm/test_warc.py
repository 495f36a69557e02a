import base64
import hashlib

import pytest

from postloom.llm import queries, warc
from postloom.scratch import Scratch

BIG = "<p>é漢\r\n\r\nWARC/1.1\r\n</p>" * 4000
PAGES = [(1, "http://a/ b\n", "x" * 999), (2, "http://a", "x" * 999), (3, None, "y" * 1000), (4, "u", "y" * 1000), (9, "u", "y" * 1000),
         (5, "u", None), (6, "u", ""), (7, "u", BIG), (8, "u", BIG), (10, "u", BIG + "!")]


def brute(pages):
    by = {}
    for p, _, h in pages:
        by.setdefault((h or "").encode(), []).append(p)
    return {(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if len(b) >= 1000 and p != max(ps) else "response",
             max(ps) if len(b) >= 1000 and p != max(ps) else None) for b, ps in by.items() for p in ps}


def test_pages_come_back(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    folder = Scratch(spark, "warc").root
    warc.write(pages.unionByName(pages.limit(2)), folder)
    got = warc.captures(spark, folder).collect()
    assert {(r.page, r.bytes, r.sha1, r.kind, r.refers_page) for r in got} == brute(PAGES) and len(got) == len(PAGES) + 2
    assert all(r.problem is None for r in got)
    kinds = {r.kind for r in warc.read_records(spark, folder).collect()}
    assert kinds == {"response", "revisit", "continuation"}
    whole = {r.page: r.payload for r in warc.read(spark, folder).where("kind = 'response'").collect()}
    assert bytes(whole[8]) == BIG.encode()


def test_every_row_is_one_capture(spark, tmp_path, monkeypatch):
    """Repeated, null and clashing ids, urls and contents, through the registered query."""
    monkeypatch.setattr(warc, "EQUAL_ROWS", 4)
    one, two = "p" * 1500, "q" * 40000
    rows = [(1, "a", one), (1, "b", one), (0, "c", one), (None, "n", one), (7, "d", "s"), (7, "d", "s"), (None, None, None),
            *[(3, "z", two)] * 11, (3, None, two), (2, "z", two), *[(None, "x", "r" * 1000)] * 3, (5, "\u00a0h ttp://x%20y\n\u00a0", "t" * 2000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op5_warc(spark, str(tmp_path)).collect()
    assert all(r.problem is None for r in got)
    best = {}
    for page, url, html in rows:
        best[html] = max(best.get(html, (-1, "")), (-1 if page is None else page, url or ""))
    want, stored = [], set()
    for page, url, html in sorted(rows, key=str):
        data = (html or "").encode()
        own = len(data) < 1000 or (html not in stored and best[html] == (-1 if page is None else page, url or ""))
        if own:
            stored.add(html)
        top = None if own or best[html][0] < 0 else best[html][0]
        want.append((page, url, len(data), hashlib.sha1(data).hexdigest(), "response" if own else "revisit", top))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    folder = Scratch(spark, "warc").root
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.captures(spark, folder).count() == 0


@pytest.mark.parametrize("lose,problem", [(0, "first segment missing"), (1, "segment missing or doubled"), (-1, "last segment missing")])
def test_lost_segments_are_reported(spark, lose, problem):
    made = list(warc.records(1, "u", BIG.encode(), hashlib.sha1(BIG.encode()).hexdigest(), None, warc.ALONE))
    made.pop(lose)
    folder = Scratch(spark, "warc").root
    spark.createDataFrame([(bytearray(m),) for m in reversed(made)], "r binary").selectExpr("CAST(r AS STRING) AS value").write.option(
        "lineSep", "\r\n\r\n").text(folder)
    assert [(r.problem, r.payload) for r in warc.read(spark, folder).collect()] == [(problem, None)]


def test_framing():
    assert warc.unchunked(b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n") == b"abcde"
    assert warc.unchunked(warc.chunked(b"")) == b""
    for bad in (b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"other").digest()).decode()
    assert warc._decoded(b"HTTP/1.1 200 OK\r\n\r\nplain", digest) == (None, "digest differs")
    assert warc._decoded(b"HTTP/1.1 200 OK\r\n\r\nplain", None) == (b"plain", None)
