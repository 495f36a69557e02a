import html

import numpy as np
import pytest

from postloom.llm import block_labeller as b

from .data import prose

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">m</a>'
        '</li></ul></nav><!-- x <p> --><div class="ad">buy</div><article><h1>{h}</h1>{p}</article><footer>&copy; end</footer></body></html>')


def pages(spark, n):
    rows = []
    for k in range(n):
        paragraphs = [prose(5 + (k * 7 + j) % 30, 1000 + 10 * k + j) + "." for j in range(1 + k % 5)]
        rows.append((k, PAGE.format(h=f"Head {k}", p="".join(f"<p>{x} &amp; <b>bold</b>\n  text</p>" for x in paragraphs)), "clash"))
    rows += [(n, None, "clash"), (n + 1, "", "clash"), (n + 2, "<p", "clash"), (n + 3, "<script>never closed <p>x</p>", "clash")]
    return spark.createDataFrame(rows, "page_id long, html string, text string")


@pytest.fixture(scope="module")
def learned(spark):
    return b.learn(pages(spark, 60))


def test_articles_come_out_whole(spark, learned):
    df = pages(spark, 60)
    got = {r.page_id: r.text for r in b.extract(df.unionByName(df.limit(3)), learned, keep=()).collect()}
    for r in df.limit(60).collect():
        body = r.html.split("<article>")[1].split("</article>")[0].replace("<h1>", "").replace("</h1>", "\0").replace("</p>", "\0")
        want = [" ".join(html.unescape(x.replace("<p>", "").replace("<b>", "").replace("</b>", "")).split()) for x in body.split("\0")]
        assert got[r.page_id] == "\n".join(x for x in want if x)
    assert all(got[k] == "" for k in (60, 61, 63))
    assert b.extract(df.limit(0), learned).count() == 0


def test_held_out_layouts(learned):
    test = b.layouts([prose(k % 40 + 4, 5000 + k) for k in range(80)], 150, seed=77)
    hits = learned.predict([b.vectors(c) for c, _ in test])
    right = sum(int((h == (y > 0)).sum()) for h, (_, y) in zip(hits, test))
    assert right / sum(len(h) for h in hits) > 0.985


def test_blocks_of_broken_markup():
    texts = lambda x: [y.text for y in b.blocks(x)]
    assert texts("a<br>b<p>c <i>d</i>e<p>&lt;f&gt;&nbsp; g<!-- h") == ["a", "b", "c de", "<f> g"]
    assert texts('<div title="a>b">x</div></div></p>y < z') == ["x", "y < z"]
    assert b.blocks("<nav><a href=x>one</a> two</nav>")[0].linked == 3
    assert b.blocks('<p>a<p class="lead x2">b')[1].path == ("p lead x 2",)


def test_gradients_against_differences():
    r = np.random.default_rng(1)
    net = b.Labeller(seed=2)
    net.weights = [w.astype(np.float64) for w in net.weights]
    x, mask = r.normal(size=(4, 2, b.DIM)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], np.float64)
    y = (r.random((4, 2)) > 0.5).astype(np.float64)

    def loss():
        p = net._forward(x, mask)[0]
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    chance, both, ways = net._forward(x, mask, keep=True)
    error = (chance - y) * mask / mask.sum()
    to_both = error[:, :, None] * net.weights[6]
    grads = [d for n, w in enumerate(ways) for d in w.back(x, mask, to_both[:, :, n * b.HIDDEN: (n + 1) * b.HIDDEN])]
    for n in range(6):
        at = tuple(r.integers(0, s) for s in net.weights[n].shape)
        keep = net.weights[n][at]
        net.weights[n][at] = keep + 1e-3
        up = loss()
        net.weights[n][at] = keep - 1e-3
        down = loss()
        net.weights[n][at] = keep
        assert abs((up - down) / 2e-3 - grads[n][at]) < 2e-3


@pytest.mark.parametrize("piece", [7, 64])
def test_pages_longer_than_a_piece(monkeypatch, piece):
    r = np.random.default_rng(3)
    labeller = b.Labeller()
    pages = [r.normal(size=(n, b.DIM)).astype(np.float32) for n in (0, 1, 6, 7, 8, 63, 64, 65, 300)]
    whole = labeller.predict(pages)
    monkeypatch.setattr(b, "PIECE", piece)
    assert [h.tolist() for h in labeller.predict(pages)] == [h.tolist() for h in whole]
    assert 0 < sum(h.sum() for h in whole) < sum(map(len, pages))
    page = [b.Block(("div", "p"), f"word {k}.", 0) for k in range(200)]
    assert labeller.predict([page])[0].tolist() == labeller.predict([b.vectors(page)])[0].tolist()
