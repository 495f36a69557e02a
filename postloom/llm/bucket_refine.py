"""Exact removal of repeated passages by bucket-pointer refinement.

A suffix array by bucket-pointer refinement (Schürmann, Stoye 2005) puts
suffixes into buckets by their first q bytes and refines a bucket by the
buckets its suffixes have at a later offset, reusing every refinement in the
next. Whole suffixes need not be sorted here: a byte goes if it lies in a string
of ``LENGTH`` bytes that starts at two places, so refinement ends at that depth.
Bucket identifiers are 64-bit values made from the content, so every task
names them alike without a global array:

* Doubling: the bucket of 2q bytes at i comes from the buckets of q bytes at i and
  i + q. From single bytes to 64 that is six steps, two more reach ``LENGTH``.
* Of every window of ``LENGTH`` bytes only the 64-byte bucket of smallest identifier
  is looked up, the rightmost of equal ones. Equal windows choose it at the same
  place, so a window can repeat only if the bucket it chose does. Neighbouring
  windows that chose one place form a segment; there are about 17 per 1000 bytes.
* Round 1 counts the buckets; one with a single suffix is final.
* Round 2 refines the others by the buckets of the segment's first and last window, that
  is by all bytes of the segment. Segments that still share a bucket repeat as a whole.
* Round 3 takes the rest, one segment per refined bucket, and compares window by
  window within the bucket of round 1. A bucket of up to ``BUCKET`` segments is one
  small task, which refines recursively (``refined``): buckets of 8 bytes are sorted on the bucket
  identifiers of later offsets, and each round's identifiers are the next one's pointers.
  Windows of a larger bucket are dealt out by their content's identifiers, so
  a passage that very many documents hold is no large group anywhere.

In small buckets equal windows are equal bytes; elsewhere two windows are held equal if two independent
64-bit identifiers agree, that of the window or segment and that of its bucket.

Input rules: null is the empty text; texts shorter than ``LENGTH`` bytes lose nothing;
a repeated row is a second place of all its strings; matches never cross texts;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, mix, text_bytes
from postloom.scratch import Scratch

#: Fixed value: bytes of a string that must not repeat.
LENGTH = 200
GRAM, CHOICES = 64, LENGTH - 64 + 1
#: Bytes of the buckets that in-bucket refinement begins with; they fill one 64-bit key.
FIRST = 8
#: Segments of a bucket that one task compares, bytes of a text that numpy works on at a time.
BUCKET, PIECE = 1024, 1 << 20
#: A list of row keys up to this long (8 bytes each) is broadcast, a longer one is shuffled.
BROADCAST_KEYS = 1_000_000

_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _FACTOR + b)


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the 64 bytes from each place."""
    out, q = _BYTES[data], 1
    while q < GRAM:
        out = _join(out[:-q], out[q:]) if len(out) > q else out[:0]
        q *= 2
    return out


def windows(buckets: np.ndarray) -> np.ndarray:
    """Buckets of the ``LENGTH`` bytes from each place, from those of 64 bytes."""
    if len(buckets) < CHOICES:
        return buckets[:0]
    double = _join(buckets[:-GRAM], buckets[GRAM:])
    rest = LENGTH - 2 * GRAM
    return _join(double[:-rest], double[rest:])


def chosen(buckets: np.ndarray) -> np.ndarray:
    """For each window the place of its smallest bucket, the rightmost of equal ones."""
    least, place, size = buckets, np.arange(len(buckets)), 1
    steps = [1 << k for k in range(CHOICES.bit_length() - 1)]
    for step in [*steps, CHOICES - (1 << len(steps))]:
        if step:
            right = least[step:] <= least[:-step]
            least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
            size += step
    return place


def segments(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Bucket, refined bucket, first and last window of each segment of a text, piece by piece."""
    for at in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        piece = data[at: at + PIECE + LENGTH - 1]
        first = grams(piece)
        deep, place = windows(first), chosen(first)
        lo = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        hi = np.concatenate((lo[1:], [len(place)])) - 1
        whole = _join(_join(deep[lo], deep[hi]), (hi - lo).astype(np.uint64))
        yield first[place[lo]], whole, lo + at, hi + at


def _rows(docs: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("k"), text.alias("text"), *others)


def _segments(rows: DataFrame) -> DataFrame:
    names = ["k", "b", "c", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            got: list[list[np.ndarray]] = [[] for _ in names]
            n = 0
            for i, key in enumerate(keys):
                for b, c, lo, hi in segments(data[offsets[i]: offsets[i + 1]]):
                    for column, x in zip(got, (np.full(len(b), key, np.int64), b.view(np.int64), c.view(np.int64),
                                               lo.astype(np.int32), hi.astype(np.int32)), strict=True):
                        column.append(x)
                    n += len(b)
                if n > 50_000 or n and i == len(keys) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in got], names)
                    got, n = [[] for _ in names], 0

    return rows.where(F.octet_length("text") >= LENGTH).select("k", "text").mapInArrow(
        run, "k long, b long, c long, lo int, hi int")


def _only(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose key is listed, or is not; a list of bounded length is broadcast."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "k", how)


_OPEN = "b long, k long, lo int, single boolean, bytes binary"


def _contents(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of segments (b, k, lo, hi, single)."""
    lists = wanted.groupBy("k").agg(F.collect_set(F.struct("lo", "hi", "b", "single")).alias("parts"))
    texts = _only(rows, wanted.select("k").distinct(), "left_semi").select("k", "text").dropDuplicates(["k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                yield pa.RecordBatch.from_arrays([
                    pa.array([p["b"] for p in parts], pa.int64()), pa.array([key] * len(parts), pa.int64()),
                    pa.array([p["lo"] for p in parts], pa.int32()), pa.array([p["single"] for p in parts], pa.bool_()),
                    pa.array([raw[p["lo"]: p["hi"] + LENGTH] for p in parts], pa.binary()),
                ], ["b", "k", "lo", "single", "bytes"])

    return texts.join(lists, "k").select("k", "text", "parts").mapInArrow(run, _OPEN)


def _deep(content: bytes) -> np.ndarray:
    return windows(grams(np.frombuffer(content, np.uint8)))


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Numbers of the keys in sorted order, equal keys alike; a key that occurs once gets -1."""
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(counts[back] > 1, back, -1)


def refined(contents: list[bytes]) -> list[np.ndarray]:
    """For each place of each content whether the ``LENGTH`` bytes from it also start at another place.

    Buckets of ``FIRST`` bytes come from sorting the bytes themselves. A bucket of depth q is refined by
    sorting its places on the buckets they have q bytes further on, which gives depth 2q, and the
    refined buckets are the pointers of the next round; the last round looks ``LENGTH`` - q ahead.
    Places alone in their bucket are final and drop out. Names are ranks, so equal names are equal bytes.
    """
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents), np.uint8)
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes])  # bytes from a place to its content's end
    at, q = np.flatnonzero(left >= FIRST), FIRST
    keys = np.zeros(len(at), np.uint64)
    for k in range(FIRST):
        keys = keys << np.uint64(8) | data[at + k]
    name = np.full(len(data), -1, np.int64)
    name[at] = _ranked(keys)
    while q < LENGTH:
        step = min(q, LENGTH - q)
        at = at[(left[at] >= q + step) & (name[at] >= 0)]
        at = at[name[at + step] >= 0]  # alone at a later offset, so alone here
        keys = name[at] * np.int64(len(data)) + name[at + step]
        name = np.full(len(data), -1, np.int64)
        name[at] = _ranked(keys)
        q += step
    ends = np.cumsum(sizes)
    return [name[e - n: max(e - n, e - LENGTH + 1)] >= 0 for n, e in zip(sizes, ends, strict=True)]


def _runs(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return zip(places[np.concatenate(([0], cut + 1))].tolist(), places[np.concatenate((cut, [len(places) - 1]))].tolist(),
               strict=True)


def _repeated(members: list[dict]) -> list[tuple[int, int, int]]:
    """Runs of repeated windows (k, first, end byte) among the segments of a bucket."""
    out = []
    for m, again in zip(members, refined([m["bytes"] for m in members]), strict=True):
        hit = np.flatnonzero(again)
        if m["single"] and len(hit):
            out += [(m["k"], m["lo"] + a, m["lo"] + z + LENGTH) for a, z in _runs(hit)]
    return out


def _spans_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))],
        ["k", "start", "end"])


def _small(open_: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _spans_batch([x for members in batch.column(0) for x in _repeated(members.as_py())])

    return open_.groupBy("b").agg(F.collect_list(F.struct("k", "lo", "single", "bytes")).alias("members")).select(
        "members").mapInArrow(run, "k long, start int, end int")


def _large(open_: DataFrame, scratch: Scratch) -> DataFrame:
    names = ["b", "w", "k", "start", "single"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = _deep(row["bytes"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(w), row["b"])), pa.array(w.view(np.int64)), pa.array(np.full(len(w), row["k"])),
                    pa.array(np.arange(len(w), dtype=np.int32) + np.int32(row["lo"])),
                    pa.array(np.full(len(w), row["single"])),
                ], names)

    rows = scratch.save(open_.mapInArrow(run, "b long, w long, k long, start int, single boolean"), "windows")
    again = rows.groupBy("b", "w").count().where("count > 1").select("b", "w")
    return rows.where("single").join(again, ["b", "w"]).select("k", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                   bucket: int = BUCKET) -> DataFrame:
    """``(k, spans)``: the byte ranges of a text, by its row key, that repeat; ranges may overlap."""
    rows = _rows(docs, id_col, text_col)
    # both tables are written: texts are cut once, and a join of two scans is split where a bucket is hot
    found = scratch.save(_segments(rows), "found")
    shared = scratch.save(found.groupBy("b").count().where("count > 1").select("b"), "shared")
    live = scratch.save(found.join(shared, "b"), "live")
    scratch.drop("found")
    refined = scratch.save(live.groupBy("b", "c").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "lo", "hi")).alias("one")), "refined")
    whole = live.join(refined.where("n > 1").select("b", "c"), ["b", "c"], "left_semi").select(
        "k", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    mixed = refined.groupBy("b").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("ones")).where(
        "m > 1 AND ones > 0").select("b", "m")
    wanted = scratch.save(refined.join(mixed, "b").select(
        "b", "m", "one.*", (F.col("n") == 1).alias("single")), "wanted")
    large = scratch.save(wanted.where(F.col("m") > bucket).select("b").distinct(), "large")
    contents = scratch.save(_contents(rows, wanted), "contents")
    spans = [whole, _small(contents.join(large, "b", "left_anti"))]
    if not large.isEmpty():
        spans.append(_large(contents.join(large, "b", "left_semi"), scratch))
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    return scratch.save(every.groupBy("k").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text",
                   bucket: int = BUCKET, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept)`` and the columns ``keep`` of every row.

    ``kept`` are the bytes that are left, in order; with ``as_text`` they are a string, without
    the characters that lost some of their bytes.
    """
    bounded_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    spans = repeated_spans(docs, scratch, id_col, text_col, bucket)
    others = [F.col(c).alias(f"__{c}") for c in keep]
    rows, keys = _rows(docs, id_col, text_col, *others), spans.select("k")
    span_type = "array<struct<start:int,end:int>>"
    arrow_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, merged, sizes = [], [], []
            for text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, own, at, left = text.encode(), _merged(parts), 0, []
                for s, e in own:
                    left.append(raw[at:s])
                    at = e
                rest = b"".join([*left, raw[at:]])
                kept.append(rest.decode(errors="ignore") if as_text else rest)
                merged.append([{"start": s, "end": e} for s, e in own])
                sizes.append((len(raw), len(raw) - len(rest)))
            yield pa.RecordBatch.from_arrays([
                *batch.columns[2:], pa.array([n[0] for n in sizes], pa.int64()), pa.array([n[1] for n in sizes], pa.int64()),
                pa.array(merged, arrow_spans), pa.array(kept, pa.string() if as_text else pa.binary())],
                [*batch.schema.names[2:], "n_bytes", "n_removed", "spans", "kept"])

    own = ["id", *(f"__{c}" for c in keep)]
    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in own)
    changed = _only(rows, keys, "left_semi").join(spans, "k").select("text", "spans", *own).mapInArrow(
        run, f"{fields}, n_bytes long, n_removed long, spans {span_type}, kept {'string' if as_text else 'binary'}")
    same = _only(rows, keys, "left_anti").select(
        *own, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast(span_type).alias("spans"), (F.col("text") if as_text else F.encode("text", "UTF-8")).alias("kept"))
    return changed.unionByName(same).select(
        "id", *[F.col(f"__{c}").alias(c) for c in keep], "n_bytes", "n_removed", "spans", "kept")
