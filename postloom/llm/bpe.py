"""Byte-level BPE by backtracking over Aho-Corasick matches.

Merging pairs by rank takes more than linear time on a long word. Here the
longest vocabulary entry at every position comes from one Aho-Corasick pass,
and a greedy chain of them is kept only while neighbours are *compatible*: two
tokens may stand side by side if merging would not have joined parts of them
across their border first. A token that fits nowhere is shortened to its next
prefix in the vocabulary, and then the one before it is taken back. A position
that failed once is never entered again, so the work is linear in the word.

Words repeat, so each Python worker keeps what it has encoded, up to
``CACHE`` entries; the cache changes no result. A text is cut before every
space that a non-space follows, which is always a border of the
pre-tokenizer, so that the cache holds words with their leading space.

Decoding looks tokens up in one byte string by a table of offsets.

Input rules: null is the empty text; the special token's string in a text
becomes its id, as in the ``tokenizers`` library. Other columns are ignored, a
repeated row gives a repeated result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches

#: Words a worker remembers; about 250 bytes each.
CACHE = 300_000
#: Fixed value: the pre-tokenizer's pattern, with Unicode's white space spelled out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_BORDER = re.compile(r" (?=\S)")


def byte_names() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file: its tokens as bytes, its merges in order of rank."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        as_byte = {name: b for b, name in enumerate(byte_names())}
        raw = lambda token: bytes(as_byte[c] for c in token)
        ids = spec["model"]["vocab"]
        # inside, a token is its rank: the bytes first, then the merges in order
        self.tokens = [bytes([b]) for b in range(256)]
        self.split: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.ids = [ids[name] for name in byte_names()]
        self.pairs: dict[tuple[int, int], int] = {}
        rank = {t: i for i, t in enumerate(self.tokens)}
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = rank[raw(left)], rank[raw(right)]
            token = self.tokens[a] + self.tokens[b]
            self.pairs[a, b] = rank[token] = len(self.tokens)
            self.tokens.append(token)
            self.split.append((a, b))
            self.ids.append(ids[left + right])
        self.rank = rank
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        by_id = [b""] * self.size
        for token, i in zip(self.tokens, self.ids, strict=True):
            by_id[i] = token
        for content, i in self.special.items():
            by_id[i] = content.encode()
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in by_id]))).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids, by the offset table."""
        if len(ids) == 0:
            return b""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.bytes[at].tobytes()


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(v.tokens):
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.shorter = [self._shorter(t) for t in v.tokens]
        self.size = [len(t) for t in v.tokens]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None

    def _shorter(self, token: bytes) -> int:
        """The longest proper prefix that is a token too, or -1."""
        return next((r for n in range(len(token) - 1, 0, -1) if (r := self.v.rank.get(token[:n])) is not None), -1)

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a border between these two tokens.

        Undo merges on both sides of the border, the later merge first. If at
        some stage the parts that touch form a merge that ranks before the one
        undone last, that merge would have crossed the border.
        """
        limit, split, pairs = 1 << 62, self.v.split, self.v.pairs
        while True:
            if pairs.get((left, right), limit) < limit:
                return False
            if left < 256 and right < 256:
                return True
            if right < 256 or left > right:
                limit, left = left, split[left][1]
            else:
                limit, right = right + 1, split[right][0]

    def word(self, text: bytes) -> list[int]:
        """Ranks of the tokens of one pre-token."""
        n, size = len(text), self.size
        longest = [-1] * n
        reach = [0] * n
        for end, (token, length) in self.automaton.iter(text.decode("latin-1")):
            start = end - length + 1
            if length > reach[start]:
                reach[start], longest[start] = length, token
        usable, out, at, fits = [True] * (n + 1), [], 0, self.compatible
        token = longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + size[token]
                if usable[end]:
                    ok = last < 0 or fits.get((last, token))
                    if ok is None:
                        if len(fits) >= CACHE:
                            fits.clear()
                        ok = fits[last, token] = self._fits(last, token)
                    if ok:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                usable[at] = False
                token = out.pop()
                at -= size[token]
                token = self.shorter[token]
        return out

    def chunk(self, text: str) -> bytes:
        """Ids of a piece of text that begins and ends at borders of the pre-tokenizer."""
        out, words, ids = [], self.words, self.v.ids
        for word in self.pattern.findall(text):
            got = words.get(word)
            if got is None:
                if len(words) >= CACHE:
                    words.clear()
                got = words[word] = np.array([ids[t] for t in self.word(word.encode())], "<u4").tobytes()
            out.append(got)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        first, *rest = _BORDER.split(text) if re.search(r" \s| $", text) else text.split(" ")
        chunks = self.chunks
        head = self.chunk(first) if first else b""
        return head + b"".join([chunks[c] for c in rest])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return b"".join(
            np.array([self.v.special[x]], "<u4").tobytes() if x in self.v.special else self.plain(x)
            for x in self.special.split(text))


class _Chunks(dict):
    """Ids by chunk, without its leading space."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        got = self.encoder.chunk(" " + chunk)
        if len(chunk) <= 64:
            self[chunk] = got
        return got


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path))
    return _encoders[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)``: the ids of every whole text, as little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = pa.array([own.encode(t) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``text`` to what ``encode`` returns; bytes that are not UTF-8 become replacement characters."""
    bounded_batches(encoded.sparkSession)
    rows = encoded.select(id_col, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path).v
        for batch in batches:
            texts = [vocabulary.decode(np.frombuffer(b or b"", "<u4").astype(np.int64)).decode(errors="replace")
                     for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [id_col, "ids", "text"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids binary, text string")
