"""Main text of web pages by a recurrent network over their blocks.

A page is cut into blocks, the runs of text between block-level tags, each
with its path of open elements. A block's vector holds hashed names, classes and
ids of its path, hashed words, and a few measures. A bidirectional LSTM
reads the blocks in page order, so that each is judged in the context of the whole page,
and the blocks judged as content are the text.

The network is small numpy code and is trained here, on at most ``SAMPLE``
pages, those of smallest id hash among pages of at most ``SAMPLE_BYTES``. They are
labelled by what their markup says, and their texts are also put into varied page
layouts, whose labels are known. The sample decides the weights only; every page is
labelled, whole.

Input rules: null html is an empty page, whose text is empty; broken markup is
read leniently (unclosed scripts and comments run to the end); repeated pages have
equal results; other columns are ignored. Without any pages to learn from, only
the generated layouts are used.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, hashed_sample, slices, text_bytes

SAMPLE, SAMPLE_BYTES = 200, 200_000
LAYOUTS, EPOCHS, HIDDEN = 600, 12, 16
PATH_DIM, WORD_DIM = 96, 32
#: Bytes of pages cut at a time, and blocks, padding counted, that the network reads at a time.
GROUP_BYTES, PIECE = 2 << 20, 32_768

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|([^<]+|<)""", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
#: Elements that do not end a block, and that have no content.
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn del em font i img ins kbd label mark q s samp small span strike "
                    "strong sub sup time tt u var wbr big acronym".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in the markup that mark what is not the article; only labels of training pages use them.
_AWAY_TAGS = frozenset("nav header footer aside form button select option textarea head title menu dialog".split())
_AWAY_NAMES = frozenset("ad ads advert advertisement sponsor sponsored promo banner nav navbar menu sidebar side widget "
                        "footer header cookie cookies notice consent comment comments reply replies disqus share social "
                        "related newsletter subscribe breadcrumb breadcrumbs pagination login".split())


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _element(tag: str, attributes: str) -> str:
    names = [x for m in _NAMED.findall(attributes) for x in _PART.findall("".join(m).lower())]
    return " ".join([tag, *names])


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space collapsed, empty ones left out."""
    out: list[Block] = []
    stack: list[str] = []
    parts: list[str] = []
    linked, anchors = 0, 0
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                path = tuple(stack)
                out.append(Block(paths.setdefault(path, path), text, linked))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        text = m[5]
        if text is not None:
            parts.append(text)
            if anchors:
                linked += len(text)
            continue
        tag = m[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag in _INLINE:
            if tag == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].split(" ", 1)[0] == tag:
                    del stack[k:]
                    break
        elif tag not in _VOID and not m[4].endswith("/"):
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].split(" ", 1)[0] == tag:
                stack.pop()
            stack.append(_element(tag, m[4]))
    flush()
    return out


class _Hashed(dict):
    """Words to their places in a vector."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = zlib.crc32(word.encode()) % self.size
        return got


_words, _names = _Hashed(WORD_DIM), _Hashed(PATH_DIM)
DIM = PATH_DIM + WORD_DIM + 6


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), DIM), np.float32)
    last, row = None, None
    for i, b in enumerate(page):
        if b.path != last:
            last, row = b.path, np.zeros(PATH_DIM, np.float32)
            for element in b.path:
                for name in element.split(" "):
                    row[_names[name]] = 1.0
        out[i, :PATH_DIM] = row
        words = b.text.split(" ")
        counts = np.bincount(list(map(_words.__getitem__, words)), minlength=WORD_DIM)
        out[i, PATH_DIM: PATH_DIM + WORD_DIM] = counts / len(words)
        n = len(b.text)
        out[i, PATH_DIM + WORD_DIM:] = (
            np.log1p(n) / 6, np.log1p(len(words)) / 5, min(1.0, b.linked / n), b.text[-1] in ".!?", len(b.path) / 10, 1.0)
    return out


#: The blocks of a page, or their vectors.
Page = list[Block] | np.ndarray


def _vectors_of(page: Page) -> np.ndarray:
    return page if isinstance(page, np.ndarray) else vectors(page)


# ------------------------------------------------------------------- network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Direction:
    """One LSTM over padded sequences, forward or (with ``step`` -1) backward in time."""

    def __init__(self, weights: list[np.ndarray], step: int) -> None:
        self.w, self.u, self.b = weights
        self.step = step

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool,
            state: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The outputs of each step, beginning in a state that an earlier run left in ``self.state``."""
        t, n, _ = x.shape
        size = len(self.b) // 4
        h, c = state or (np.zeros((n, size), np.float32), np.zeros((n, size), np.float32))
        out, self.kept = np.zeros((t, n, size), np.float32), {}
        inputs = x @ self.w + self.b
        for k in range(t)[:: self.step]:
            gates = inputs[k] + h @ self.u
            i, f, o = np.split(_sigmoid(gates[:, : 3 * size]), 3, axis=1)
            g = np.tanh(gates[:, 3 * size:])
            m = mask[k][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                self.kept[k] = (i, f, o, g, c, h, tanh)
            c, h = m * new + (1 - m) * c, m * o * tanh + (1 - m) * h
            out[k] = h
        self.state = h, c
        return out

    def back(self, x: np.ndarray, mask: np.ndarray, grad: np.ndarray) -> list[np.ndarray]:
        t, n, _ = x.shape
        size = len(self.b) // 4
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        for k in reversed(range(t)[:: self.step]):
            i, f, o, g, c, h, tanh = self.kept[k]
            m = mask[k][:, None]
            total = dh + grad[k]
            inner = dc * m + total * m * o * (1 - tanh * tanh)
            gates = np.concatenate((inner * g * i * (1 - i), inner * c * f * (1 - f), total * m * tanh * o * (1 - o),
                                    inner * i * (1 - g * g)), axis=1)
            dw += x[k].T @ gates
            du += h.T @ gates
            db += gates.sum(axis=0)
            dh = gates @ self.u.T + total * (1 - m)
            dc = inner * f + dc * (1 - m)
        return [dw, du, db]


class Labeller:
    """A bidirectional LSTM with a logistic output."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.weights: list[np.ndarray] = []
        for _ in range(2):
            self.weights += [(r.normal(size=(DIM, 4 * HIDDEN)) * 0.2).astype(np.float32),
                             (r.normal(size=(HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32),
                             np.zeros(4 * HIDDEN, np.float32)]
        self.weights += [(r.normal(size=2 * HIDDEN) * 0.2).astype(np.float32), np.zeros(1, np.float32)]

    def _pad(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(len(p) for p in pages)
        x, mask = np.zeros((t, len(pages), DIM), np.float32), np.zeros((t, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def _forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list[_Direction]]:
        ways = [_Direction(self.weights[:3], 1), _Direction(self.weights[3:6], -1)]
        both = np.concatenate([w.run(x, mask, keep) for w in ways], axis=2)
        return _sigmoid(both @ self.weights[6] + self.weights[7]), both, ways

    def _long(self, page: Page) -> np.ndarray:
        """Scores of a page too long for one array: each direction reads piece after piece and keeps its state."""
        score = np.full(len(page), self.weights[7][0], np.float32)
        starts = range(0, len(page), PIECE)
        for way, order, out in ((_Direction(self.weights[:3], 1), starts, self.weights[6][:HIDDEN]),
                                (_Direction(self.weights[3:6], -1), reversed(starts), self.weights[6][HIDDEN:])):
            state = None
            for at in order:
                x = _vectors_of(page[at: at + PIECE])[:, None]
                score[at: at + PIECE] += way.run(x, np.ones(x.shape[:2], np.float32), False, state)[:, 0] @ out
                state = way.state
        return score

    def predict(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page, which blocks are content; memory is bounded by ``PIECE``, not by the longest page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= PIECE:
                end += 1
            if end == at:
                out[order[at]] = self._long(pages[order[at]]) > 0
                at += 1
                continue
            chance = self._forward(*self._pad([_vectors_of(pages[k]) for k in order[at:end]]))[0]
            for j, k in enumerate(order[at:end]):
                out[k] = chance[: len(pages[k]), j] > 0.5
            at = end
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adam on the cross entropy of all blocks, pages of like length together."""
        r = np.random.default_rng(seed)
        usable = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        groups = [usable[k: k + 32] for k in range(0, len(usable), 32)]
        first, second, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(epochs):
            for g in r.permutation(len(groups)):
                x, mask = self._pad([pages[k] for k in groups[g]])
                y = np.zeros(mask.shape, np.float32)
                for j, k in enumerate(groups[g]):
                    y[: len(labels[k]), j] = labels[k]
                chance, both, ways = self._forward(x, mask, keep=True)
                error = (chance - y) * mask / mask.sum()
                to_both = error[:, :, None] * self.weights[6]
                grads = [d for n, w in enumerate(ways) for d in w.back(x, mask, to_both[:, :, n * HIDDEN: (n + 1) * HIDDEN])]
                grads += [np.einsum("tn,tnh->h", error, both), np.array([error.sum()], np.float32)]
                step += 1
                for n, d in enumerate(grads):
                    d = np.clip(d, -1, 1)
                    first[n] = 0.9 * first[n] + 0.1 * d
                    second[n] = 0.999 * second[n] + 0.001 * d * d
                    self.weights[n] = (self.weights[n] - 0.01 * (first[n] / (1 - 0.9**step)) / (
                        np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


# ----------------------------------------------------------------- training

def markup_labels(page: list[Block]) -> np.ndarray:
    """What the markup says: blocks under elements that are named for something else are not content."""
    def away(element: str) -> bool:
        tag, *names = element.split(" ")
        return tag in _AWAY_TAGS or bool(_AWAY_NAMES.intersection(names))

    inside = [any(e.split(" ", 1)[0] in ("article", "main") for e in b.path) for b in page]
    some = any(inside)
    return np.array([float((i or not some) and not any(map(away, b.path))) for b, i in zip(page, inside, strict=True)])


_MENUS = ("<nav><ul>{li}</ul></nav>", '<div class="menu"><ul>{li}</ul></div>', '<header><a href="/">{s}</a><ul>{li}</ul></header>',
          '<div id="navbar">{a}</div>', '<div class="breadcrumbs">{a}</div>', '<header class="site-header"><p>{s}</p></header>',
          '<nav role="navigation">{a}</nav>')
_BEFORE = ('<div class="ad">{s}</div>', '<div class="cookie-notice"><p>{s}</p><button>OK</button></div>',
           '<div class="banner">{s}</div>', '<form action="/search"><label>{s}</label><input name="q"></form>',
           '<aside class="sidebar"><h3>{s}</h3><p>{p}</p></aside>', '<div class="notice"><p>{s}</p></div>',
           '<div id="sidebar"><ul>{li}</ul></div>', '<aside><p>{p}</p></aside>')
_INSIDE = ('<div class="ad">{s}</div>', '<aside><p>{s}</p></aside>', '<div class="share"><a href="#">{s}</a></div>',
           '<form class="newsletter"><p>{s}</p><input name="mail"></form>', '<div class="advertisement"><p>{s}</p></div>')
_AFTER = ('<section class="comments"><h3>{s}</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>{p}</p></div></section>',
          '<div id="comments"><ul><li>{p}</li><li>{p}</li></ul></div>', '<div class="related"><ul>{li}</ul></div>',
          '<div class="comment-list"><p>{p}</p></div>', '<form class="reply"><p>{s}</p><textarea></textarea></form>',
          '<div class="sponsored"><p>{s}</p></div>', '<aside class="widget"><p>{p}</p></aside>')
_ENDS = ("<footer>{s}</footer>", '<div class="footer"><p>{s}</p></div>', '<footer><ul>{li}</ul><p>{s}</p></footer>',
         '<div id="footer">{s} {a}</div>')
_MAINS = ("<article>{x}</article>", "<main>{x}</main>", "<main><article>{x}</article></main>",
          '<div class="content">{x}</div>', '<div id="post" class="entry">{x}</div>', '<div class="article-body">{x}</div>',
          '<section class="story">{x}</section>')
_PARAGRAPHS = ("<p>{t}</p>",) * 6 + ("<p>{t}", "<p><b>{t}<br>", "<div>{t}</div>", "<h2>{t}</h2>", "<blockquote>{t}</blockquote>",
                                     "<ul><li>{t}</li></ul>", '<p>{t} <a href="/x">{t}</a></p>')


def layouts(texts: list[str], n: int, seed: int = 11) -> list[tuple[list[Block], np.ndarray]]:
    """Pages of varied layout around the given texts, with labels."""
    r = random.Random(seed)
    texts = texts or ["A text of a few words.", "Another one, which is a little longer than the first. It ends here."]
    words = [w for t in texts[:500] for w in t.split(" ")[:40]]
    short = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 12)))
    escape = entities.escape

    def fill(pattern: str) -> str:
        out = pattern.replace("{li}", "".join(f'<li><a href="/{k}">{escape(r.choice(words))}</a></li>' for k in range(r.randint(2, 7))))
        out = out.replace("{a}", " ".join(f'<a href="/{k}">{escape(r.choice(words))}</a>' for k in range(r.randint(2, 5))))
        while "{s}" in out:
            out = out.replace("{s}", escape(short()), 1)
        while "{p}" in out:
            out = out.replace("{p}", escape(r.choice(texts)), 1)
        return out

    def some(patterns: tuple[str, ...], most: int) -> str:
        return "".join(fill(p) for p in r.sample(patterns, r.randint(0, most)))

    made = []
    for _ in range(n):
        body = [f"<h1>{escape(short())}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 12)):
            body.append(r.choice(_PARAGRAPHS).replace("{t}", "\1" + escape(r.choice(texts) if r.random() < 0.8 else short())))
            if r.random() < 0.08:
                body.append(fill(r.choice((*_INSIDE, *_BEFORE))))
        if r.random() < 0.4:
            body.append(fill(r.choice(_AFTER)))
        main = r.choice(_MAINS).replace("{x}", "".join(body)).replace("<h1>", "<h1>\1")
        inner = some(_BEFORE, 3) + main + some(_AFTER, 3)
        wrapper = r.choice(("{x}", "{x}", '<div class="wrapper">{x}</div>', '<div id="page"><div class="container">{x}</div></div>'))
        page = (f"<html><head><title>{escape(short())}</title></head><body>" + some(_MENUS, 2)
                + wrapper.replace("{x}", inner) + some(_ENDS, 1) + r.choice(("</body></html>", "")))
        cut = blocks(page)
        made.append(([Block(b.path, b.text.replace("\1", ""), b.linked) for b in cut],
                     np.array([float("\1" in b.text) for b in cut])))
    return made


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    """A labeller trained on a bounded sample of pages and on layouts made from their texts."""
    usable = hashed_sample(pages, 2 * SAMPLE, id_col, html_col).where(F.octet_length(html_col) <= SAMPLE_BYTES)
    sample = sorted(r[0] for r in usable.select(html_col).limit(SAMPLE).collect())
    cut = [blocks(p) for p in sample]
    labels = [markup_labels(c) for c in cut]
    texts = sorted({b.text for c, y in zip(cut, labels, strict=True) for b, k in zip(c, y, strict=True) if k})
    made = layouts(texts, LAYOUTS)
    labeller = Labeller()
    labeller.fit([vectors(c) for c in [*cut, *(m[0] for m in made)]], [*labels, *(m[1] for m in made)])
    return labeller


def extract(pages: DataFrame, labeller: Labeller, id_col: str = "page_id", html_col: str = "html",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, keep..., text)`` of every page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(id_col, *keep, F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    names = [id_col, *keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, end in slices(text_bytes(whole.column(whole.num_columns - 1))[1], GROUP_BYTES):
                batch = whole.slice(at, end - at)
                cut = [blocks(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
                hits = labeller.predict(cut)
                texts = ["\n".join(b.text for b, h in zip(c, hit, strict=True) if h) for c, hit in zip(cut, hits, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names[:-1]), "text string"]))
