"""Token ids in compressed files with one shared dictionary.

Short documents compress badly alone and are slow to reach when compressed
together. So one zstandard dictionary is trained on serialized id arrays, and
every document is a frame of its own compressed with it. A block is

    magic, header length, header (JSON), index, frames, line feed

with ``index`` one record per document: id, whether the id is null, offset of
the frame, number of ids. The header names the dictionary by its SHA-256, so a
reader refuses a block made with another one, and ``read_documents`` reads the
index and then single frames. Ids are 16 bits wide if the vocabulary allows
it, else 32.

Documents lie in ascending order of id (null first; equal ids by a hash of
the text), range-partitioned, so no task holds more than its range. Spark's
own writer commits the files, so a lost executor leaves no half file behind.
Positions come from the totals of files, one short row per file.

``SAMPLE`` documents, those of smallest id hash, train the dictionary, of each at most
``SAMPLE_BYTES`` of ids; the dictionary decides sizes only, never content.

Input rules: null is the empty text, which has the end id alone; an empty
table gives no rows; other columns are ignored; repeated rows are stored
repeatedly.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import string
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from postloom.llm.bpe import PATTERN
from postloom.llm.common import bounded_batches, hashed_sample, shuffles, text_bytes

MAGIC = b"TOKZDIC1"
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 64 << 10
LEVEL = 3
#: A block is closed when its frames reach this size, or holds one document.
BLOCK_BYTES = 1 << 20
#: Blocks per file, so that a reader can take a whole file.
BLOCKS_PER_FILE = 32
#: Positions of up to this many files (16 bytes each) are broadcast, more are shuffled.
BROADCAST_FILES = 500_000
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("ids", "<u4")])
#: Chunks between spaces that a worker remembers, as many older ones, pre-tokens without a space that it remembers, characters of the texts it cuts at a time (of one
#: text at least), pre-tokens of either kind that the library encodes at a time.
CHUNKS, CACHE, CHARS, WORDS = 400_000, 50_000, 1 << 21, 1 << 14
#: Content, in characters, that those chunks and pre-tokens may have in all.
CACHE_CHARS = 8 << 20
_GAP = re.compile(r" \s| $")
#: Chunks of the plain alphabet, for which every version of Unicode has the same letters, digits and white space, and their cuts.
_PLAIN = re.compile("[\x00-\u024f]*")
_SPACE, _DIGIT = r"\t-\r \x85\xa0", r"\d\xb2\xb3\xb9\xbc-\xbe"
_CUT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W_{_DIGIT}]+| ?[{_DIGIT}]+| ?(?:(?![{_SPACE}])[\W_])+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _byte_names() -> dict[int, str]:
    """Names of the bytes that are not their own in the byte-level alphabet: those that do not print, numbered from 256."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


#: Stands between pre-tokens of the plain alphabet, to which it does not belong; in bytes, and as a byte that no text has.
_BETWEEN, _BETWEEN_BYTES, _NO_BYTE = "\u0250", "\u0250".encode(), b"\xff"


class _Ids:
    """The library's ids, remembered by pre-token.

    Before a space that a non-space follows, the byte-level pre-tokenizer always
    cuts, so the chunks between have the ids they have in the text, and so have the
    pre-tokens of a chunk. A pre-token that begins with the space is a chunk as well. Those of the plain alphabet
    go to the library's model, spelled in its alphabet of bytes, others through its own pre-tokenizer as well.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # known before, those still used come back
        self.words: dict[str, bytes] = {}
        self.known_chars = self.words_chars = 0
        self.pattern = regex.compile(PATTERN)
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind, self.code = ("<u4", "I") if wide else ("<u2", "H")
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")  # no name of a byte is a space
        hidden = _byte_names()
        self.letters = np.array([ord(hidden.get(b, chr(b))) for b in range(256)], "<u2")
        self.letters[_NO_BYTE[0]] = ord(" ")
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.sizes[i] = len(name)  # a byte-level name has a character per byte

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _whole_only(self, text: str) -> bool:
        """Whether a text has to be encoded whole, as it has a space that belongs to white space or a special token."""
        return _GAP.search(text) is not None or any(s in text for s in self.special)

    def _split(self, ids: list[int], ends: np.ndarray) -> list[bytes]:
        """The packed ids of words that end behind so many bytes; tokens are told apart by their lengths in bytes."""
        ids = np.array(ids, self.kind)
        bounds = ((np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * ids.itemsize).tolist()
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]

    def _spelled(self, spaced: list[str], others: list[str]) -> list[bytes]:
        """Ids of pre-tokens of the plain alphabet, ``spaced`` with a space before them, in one call."""
        text = _BETWEEN.join([*map(" ".__add__, spaced), *others, ""])
        data = np.frombuffer(text.encode().replace(_BETWEEN_BYTES, _NO_BYTE), np.uint8)
        ends = np.flatnonzero(data == _NO_BYTE[0])
        names = self.letters[data].tobytes().decode("utf-16-le")
        return self._split(self.model.encode_batch_fast([names], add_special_tokens=False)[0].ids, ends - np.arange(len(ends)))

    def _whole(self, spaced: list[str], others: list[str]) -> list[bytes]:
        """Ids of pre-tokens; those after a space are encoded as one text, which costs far less than one by one."""
        text = "".join(map(" ".__add__, spaced))
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ends = np.cumsum([len(w.encode()) + 1 for w in spaced])
        return self._split(ids, ends) + [
            self.pack(x.ids) for x in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]

    def _cut(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk that follows a space, the first without it."""
        if chunk.isascii() or _PLAIN.fullmatch(chunk):
            word = chunk.rstrip(string.punctuation)
            if word.isalpha():
                return [word, chunk[len(word):]]
            first, *rest = _CUT.findall(f" {chunk}")
        else:
            first, *rest = self.pattern.findall(f" {chunk}")
        return [first[1:], *rest]

    def _recall(self, chunks: Iterable[str]) -> list[str]:
        """Know the older ones of these chunks again; those that never were known."""
        new = []
        for c, ids in zip(chunks, map(self.older.get, chunks), strict=True):
            if ids is None:
                new.append(c)
            else:
                self.known[c] = ids
                self.known_chars += len(c)
        return new

    def _remember(self, chunks: list[str]) -> None:
        """Remember the ids of chunks that follow a space."""
        known, words, plain = self.known, self.words, _PLAIN.fullmatch
        chunks = self._recall(chunks)
        whole, mixed = [c for c in chunks if c.isalpha()], [c for c in chunks if not c.isalpha()]
        cut = list(map(self._cut, mixed))
        heads = self._recall({parts[0] for parts in cut}.difference(known, whole)) + whole
        tails = list({w for parts in cut for w in parts[1:]}.difference(words))
        strange_heads, strange_tails = ([w for w in new if not w.isascii() and not plain(w)] for new in (heads, tails))
        if strange_heads or strange_tails:
            strange = {*strange_heads, *strange_tails}
            heads, tails = ([w for w in new if w not in strange] for new in (heads, tails))
        for encoded, spaced, others in ((self._spelled, heads, tails), (self._whole, strange_heads, strange_tails)):
            for k in range(0, max(len(spaced), len(others)), WORDS):
                here = spaced[k: k + WORDS]
                found = encoded(here, others[k: k + WORDS])
                known.update(zip(here, found, strict=False))
                words.update(zip(others[k: k + WORDS], found[len(here):], strict=True))
        for chunk, parts in zip(mixed, cut, strict=True):
            if len(parts) == 2:
                known[chunk] = known[parts[0]] + words[parts[1]]
            elif len(parts) > 2:
                known[chunk] = known[parts[0]] + b"".join(map(words.__getitem__, parts[1:]))
        self.known_chars += sum(map(len, chunks)) + sum(map(len, heads))
        self.words_chars += sum(map(len, tails)) + sum(map(len, strange_tails))

    def _joined(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of texts that may be cut at every space, from those of their distinct chunks."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends, chunks = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py(), lists.flatten()
        first = np.zeros(len(chunks), bool)
        first[[0, *ends[:-1]]] = True
        heads = self.tokenizer.encode_batch_fast(chunks.filter(pa.array(first)).to_pylist(), add_special_tokens=False)
        coded = chunks.filter(pa.array(~first)).dictionary_encode()
        spaced = pc.binary_join_element_wise(coded.dictionary, *(pa.scalar(x, pa.large_string()) for x in ("", " ")))  # as one text, far faster than one by one
        distinct = text_bytes(spaced)[0].tobytes().decode().split(" ")[:-1]
        number = coded.indices.to_numpy()
        found = list(map(self.known.get, distinct))
        new = [k for k, f in enumerate(found) if f is None]
        if new:
            self._remember([distinct[k] for k in new])
            for k in new:
                found[k] = self.known[distinct[k]]
        ids = np.frombuffer(b"".join(found), self.kind)
        size = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        n = size[number]
        made = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.repeat((np.cumsum(size) - size)[number] - made[:-1], n) + np.arange(made[-1])]
        bounds = made[ends - np.arange(1, len(ends) + 1)].tolist()
        for head, a, b in zip(heads, [0, *bounds], bounds, strict=False):
            yield self.pack(head.ids) + ids[a:b].tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text, in order."""
        at = 0
        while at < len(texts):
            begin, chars = at, 0
            while at < len(texts) and (at == begin or chars + len(texts[at]) <= CHARS):
                chars += len(texts[at])
                at += 1
            if len(self.known) > CHUNKS or self.known_chars > CACHE_CHARS:
                self.older, self.known, self.known_chars = self.known, {}, 0
            if len(self.words) > CACHE or self.words_chars > CACHE_CHARS:
                self.words.clear()
                self.words_chars = 0
            some = texts[begin:at]
            whole = [self._whole_only(t) for t in some]
            joined = self._joined([t for t, alone in zip(some, whole, strict=True) if not alone])
            for text, alone in zip(some, whole, strict=True):
                yield self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids) if alone else next(joined)


_tokenizers: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    if path not in _tokenizers:
        _tokenizers[path] = _Ids(path)
    return _tokenizers[path]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def train_dictionary(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary for these documents; of few or short ones, their ids as they are."""
    some = hashed_sample(_texts(docs, id_col, text_col), SAMPLE, "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = _ids(path).encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([b[:SAMPLE_BYTES] for b in packed], pa.binary())], ["ids"])

    found = some.repartition(8).mapInArrow(run, "ids binary").collect()
    samples = sorted(bytes(r[0]) for r in found)  # here, as Spark's sort would encode them twice to choose its ranges
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes, level: int | None = None) -> zstandard.ZstdCompressionDict | None:
    """The dictionary, made ready once for all documents if a level to compress with is given."""
    if not data:
        return None
    made = zstandard.ZstdCompressionDict(data)
    if level is not None:
        made.precompute_compress(level=level)
    return made


def _block(part: int, seq: int, digest: str, kind: str, rows: list[tuple[int | None, int, bytes]]) -> bytes:
    index, at = np.zeros(len(rows), INDEX), 0
    for i, (doc_id, n, frame) in enumerate(rows):
        index[i] = (doc_id or 0, doc_id is None, at, n)
        at += len(frame)
    header = json.dumps({"part": part, "seq": seq, "dictionary": digest, "kind": kind, "n": len(rows), "bytes": at})
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header.encode(), index.tobytes(), *(r[2] for r in rows)])


def blocks(data: bytes) -> Iterator[tuple[dict, np.ndarray, memoryview]]:
    """Header, index and frames of each block of a file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at: at + 8] != MAGIC:
            raise ValueError(f"no token block at byte {at}")
        size = int.from_bytes(data[at + 8: at + 12], "little")
        header = json.loads(data[at + 12: at + 12 + size])
        at += 12 + size
        index = np.frombuffer(data, INDEX, header["n"], at)
        at += index.nbytes
        yield header, index, view[at: at + header["bytes"]]
        at += header["bytes"] + 1


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, write blocks to ``folder/blocks``, the dictionary beside them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    dictionary = train_dictionary(docs, path, id_col, text_col)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(
        f"{folder}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seq, rows, size = _ids(path), 0, [], 0
        part = TaskContext.get().partitionId()
        pressed = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary, LEVEL))
        end, width = own.pack([end_id]), np.dtype(own.kind).itemsize

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([_block(part, seq, digest, own.kind, rows)], pa.binary())], ["block"])

        for batch in batches:
            packed = own.encode(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), packed, strict=True):
                ids += end
                frame = pressed.compress(ids)
                if rows and size + len(frame) > BLOCK_BYTES:
                    yield flush()
                    seq, rows, size = seq + 1, [], 0
                rows.append((doc_id, len(ids) // width, frame))
                size += len(frame)
        if rows:
            yield flush()

    rows = _texts(docs, id_col, text_col)
    ordered = rows.repartitionByRange(shuffles(spark), "id", F.xxhash64("text")).sortWithinPartitions(
        "id", F.xxhash64("text"))
    ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", BLOCKS_PER_FILE).text(f"{folder}/blocks")


def _read(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes]:
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()[0])
    return spark.read.format("binaryFile").load(f"{folder}/blocks").select("content"), dictionary


ROWS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("first_seq", T.IntegerType()),
    T.StructField("id", T.LongType()), T.StructField("before", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def read(spark: SparkSession, folder: str, wanted: set[int] | None = None) -> DataFrame:
    """``(id, start, n, ids)`` of the documents in a folder; ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before. With ``wanted``, a small set of
    document ids, only their frames are decompressed.
    """
    files, dictionary = _read(spark, folder)
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        schema = pa.schema([("part", pa.int32()), ("first_seq", pa.int32()), ("id", pa.int64()),
                            ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for data in batch.column(0):
                before, first = 0, None
                for header, index, frames in blocks(data.as_py()):
                    if header["dictionary"] != digest:
                        raise ValueError(f"block made with dictionary {header['dictionary']}, not {digest}")
                    first = header["seq"] if first is None else first
                    ends = [*index["offset"][1:].tolist(), header["bytes"]]
                    starts = before + np.cumsum(index["ids"].astype(np.int64)) - index["ids"]
                    before += int(index["ids"].sum())
                    own = [None if null else i for i, null in zip(
                        index["id"].tolist(), index["null"].tolist(), strict=True)]
                    if wanted is not None:
                        take = [k for k, i in enumerate(own) if i in wanted]
                    else:
                        take = range(len(own))
                    got = [np.frombuffer(press.decompress(frames[int(index["offset"][k]): ends[k]]), header["kind"])
                           .astype("<u4").tobytes() for k in take]
                    n = len(got)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([header["part"]] * n, pa.int32()), pa.array([first] * n, pa.int32()),
                        pa.array([own[k] for k in take], pa.int64()), pa.array([int(starts[k]) for k in take], pa.int64()),
                        pa.array([int(index["ids"][k]) for k in take], pa.int64()), pa.array(got, pa.binary()),
                    ], schema=schema)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(0):
                heads = [(h["part"], h["seq"], int(i["ids"].sum())) for h, i, _ in blocks(data.as_py())]
                found.append((heads[0][0], heads[0][1], sum(h[2] for h in heads)) if heads else None)
            found = [x for x in found if x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))],
                ["part", "first_seq", "total"])

    totals = files.mapInArrow(sizes, "part int, first_seq int, total long")
    order = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    base = totals.selectExpr(
        "part", "first_seq", f"coalesce(sum(total) OVER (ORDER BY part, first_seq {order}), 0L) AS base")
    if len(files.inputFiles()) <= BROADCAST_FILES:  # a row per file: so the ids stay where they are
        base = F.broadcast(base)
    return files.mapInArrow(run, ROWS).join(base, ["part", "first_seq"]).select(
        "id", (F.col("base") + F.col("before")).alias("start"), "n", "ids")


def read_documents(spark: SparkSession, folder: str, wanted: list[int]) -> DataFrame:
    """Single documents, found by the index."""
    return read(spark, folder, set(wanted))
