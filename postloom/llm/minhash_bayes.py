"""Near-duplicate groups: banded MinHash, sequential Bayesian verification, exact check.

Texts are folded by the digest of their normalised words first, so copies cost
one row each. Distinct texts get ``BANDS * ROWS`` MinHash values; texts that
agree in a band share a bucket. A candidate pair's signatures are compared batch
by batch (BayesLSH: Satuluri, Parthasarathy 2012): with a uniform prior, after m
matches of n the chance that the similarity reaches the threshold is
P(Bin(n + 1, threshold) <= m), and a pair is dropped once that is below
``MISS``. What survives is verified on the full shingle sets.

No bucket is expanded into all its pairs. First every member is paired with the
bucket's smallest id, and links found there give first groups. A pair inside a
group cannot change the groups any more, so only members of *different* groups
still have to meet. Buckets that hold some are cut into blocks of about
``BLOCK`` texts, and two blocks meet in one task, which compares signatures in
arrays, each pair in the first band it shares, and then the full sets of the members with
survivors. It returns the links that join groups, fewer than it has members.
That is exact however large a bucket is, and no task holds more than two blocks.

The threshold is a percentage that the caller may give. A pair at the threshold
shares no band with probability ``(1 - threshold**rows)**bands``, and less above
it: 2.6e-7 for 85 with 32 bands of 6. ``shape`` picks fewer rows for lower ones,
2.8e-7 for 80 with 38 bands of 5, and refuses what no shape finds that surely.

Input rules: null, empty and wordless texts have no shingles and link with
nothing; fewer than ``SHINGLE`` words are one shingle; rows of one id are one
document with several texts; a null id links with nothing, has a null
component and is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, mix, shuffles, slices, text_bytes
from postloom.operators.components import components
from postloom.scratch import Scratch

#: Words of a shingle; a link has 100 * intersection >= percent * union, by default 85.
SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 32, 6
#: Chance to drop a pair at the threshold, and hashes per comparison.
MISS, BATCH = 1e-6, 32
BLOCK = 256
#: A list of ids up to this long (8 bytes each) is broadcast, a longer one is shuffled.
BROADCAST_IDS = 1_000_000

_N = BANDS * ROWS
#: The most a pair at the threshold may miss all bands by.
UNSHARED = 3e-7
_random = np.random.default_rng(20240101)
_FACTORS = _random.integers(1, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Digest of the normalised words and sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        norms = [b" ".join(data[offsets[k]: offsets[k + 1]].tobytes().lower().split()) for k in range(i, j)]
        flat = np.frombuffer(b"".join([n + b" " for n in norms if n]), np.uint8)
        hashes = np.zeros(0, np.uint64)
        if len(flat):
            ends = np.flatnonzero(flat == 32)
            starts = np.concatenate(([0], ends[:-1] + 1))
            summed = np.cumsum(_BYTES[flat] * _powers(_BASE, len(flat)), dtype=np.uint64)
            before = np.concatenate((np.zeros(1, np.uint64), summed))[starts]
            hashes = mix((summed[ends] - before) * _powers(_INVERSE, len(flat))[starts])
        at = 0
        for norm in norms:
            n = norm.count(b" ") + 1 if norm else 0
            own, at = hashes[at: at + n], at + n
            if n == 0:
                yield b"", own
                continue
            width = min(n, SHINGLE)
            grams = sum(own[k: n - width + 1 + k] * _PLACES[k] for k in range(width))
            yield hashlib.md5(norm).digest(), np.unique(mix(grams + np.uint64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest 32-bit value of each hash function over a set of shingles."""
    least = np.full(_N, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 256):
        np.minimum(least, (shingles[k: k + 256, None] * _FACTORS[None, :]).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, n, sig)`` of every text; n is the number of distinct shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, sigs = [], [], []
            for digest, shingles in shingle_sets(batch.column(1)):
                digests.append(digest)
                sizes.append(len(shingles))
                sigs.append(signature(shingles).tobytes() if len(shingles) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
                ["id", "digest", "n", "sig"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, digest binary, n long, sig binary")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for _, s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles binary")


def _only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose id is listed, or is not; a list of bounded length is broadcast."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


@cache
def shape(percent: int) -> tuple[int, int]:
    """``(bands, rows)`` out of the signature's values: the most rows that still find a pair at the threshold."""
    for rows in range(ROWS, 0, -1):
        if (1 - (percent / 100) ** rows) ** (_N // rows) <= UNSHARED:
            return _N // rows, rows
    raise ValueError(f"a signature of {_N} values does not find pairs of {percent} percent surely")


def bucket_keys(sigs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A 64-bit key per text and band, from a matrix of signatures."""
    bands, rows = shape(percent)
    parts = sigs[:, :bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(parts), 1))
    for r in range(rows):
        key = mix(key * np.uint64(_BASE) + parts[:, :, r])
    return key.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, _N)


def buckets(sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(bucket, id)``, one row per band."""
    bands, _ = shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                keys = bucket_keys(_matrix(part.column(1)), percent)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["bucket", "id"])

    return sigs.select("id", "sig").mapInArrow(run, "bucket long, id long")


def least_matches(n: int, percent: int = PERCENT) -> int:
    """The fewest matches of n with which a pair may go on."""
    p, total, m = percent / 100, 0.0, 0
    while True:
        total += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        if total >= MISS:
            return m
        m += 1


@cache
def _least(percent: int) -> dict[int, int]:
    return {n: least_matches(n, percent) for n in range(BATCH, _N + 1, BATCH)}


def possible(left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which rows of two signature matrices may still be a link, after all batches."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n, least in _least(percent).items():
        matches[alive] += (left[alive, n - BATCH: n] == right[alive, n - BATCH: n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _prune(pairs: DataFrame, sigs: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """The pairs (a, b) that signatures leave possible."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = scratch.save(_only(sigs.select("id", "sig"), nodes, "left_semi"), f"{name}-sigs")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(
        own.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = possible(_matrix(batch.column(2)), _matrix(batch.column(3)), percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """The pairs that are links on their full sets, as a written table."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = scratch.save(_sets(_only(docs, nodes, "left_semi")), f"{name}-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep.append(_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return scratch.save(both.mapInArrow(run, "a long, b long").distinct(), f"{name}-links")


def _meet(bucket: int, lo: int, hi: int, members: list[dict], percent: int = PERCENT) -> list[dict]:
    """Possible pairs of different groups in one block, or between two, if this is the first band they share."""
    sigs = np.frombuffer(b"".join(m["sig"] for m in members), "<u4").reshape(-1, _N)
    ids = np.array([m["id"] for m in members], np.int64)
    groups = np.array([m["grp"] for m in members], np.int64)
    blocks = np.array([m["block"] for m in members], np.int64)
    keys = bucket_keys(sigs, percent)
    band = int(np.flatnonzero(keys[0] == bucket)[0])
    out = []
    for x in range(len(ids)):
        y = np.arange(x + 1, len(ids))
        y = y[(groups[y] != groups[x]) & ((lo == hi) | (blocks[y] != blocks[x]))]
        if len(y):
            y = y[~(keys[y, :band] == keys[x, :band]).any(axis=1)]
            y = y[possible(np.broadcast_to(sigs[x], (len(y), _N)), sigs[y], percent)]
            out += [{"a": int(ids[x]), "b": int(ids[k]), "ga": int(groups[x]), "gb": int(groups[k])} for k in y]
    return out


def _linked(u: np.ndarray, v: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets are a link."""
    common = len(np.intersect1d(u, v, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(u) + len(v) - common)


def _forest(pairs: list[dict], members: list[dict], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links among the possible pairs that join what was not joined before; the others change no group."""
    sets: dict[int, list[np.ndarray]] = {}
    for m in members:
        sets.setdefault(m["id"], []).append(np.frombuffer(m["shingles"], np.uint64))
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for p in pairs:
        x, y = top(p["ga"]), top(p["gb"])
        if x != y and any(_linked(u, v, percent) for u in sets[p["a"]] for v in sets[p["b"]]):
            parent[x] = y
            out.append((min(p["a"], p["b"]), max(p["a"], p["b"])))
    return out


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _across(shared: DataFrame, groups: DataFrame, sigs: DataFrame, docs: DataFrame, scratch: Scratch,
            percent: int) -> DataFrame:
    """Links between members of a bucket that are in different groups, enough to join all groups that are linked.

    Pairs with the centre were tested before. Members of a bucket's largest group need not meet each other, so m of
    them and r others take r / ``BLOCK`` rows a member, not (m + r) / ``BLOCK``. Blocks meet twice: with signatures, to
    find the possible pairs, and with the full sets of the members that have some. A task
    returns fewer links than it has members, however many pairs it tests.
    """
    rows = shared.where(F.col("id") != F.col("centre")).join(
        groups.select(F.col("node").alias("id"), "component"), "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("grp"))
    sizes = rows.groupBy("bucket", "grp").agg(F.count(F.lit(1)).alias("own"))
    mixed = sizes.groupBy("bucket").agg(
        F.max(F.struct("own", "grp")).alias("most"), F.sum("own").alias("size")).where("size > most.own").select(
        "bucket", F.col("most.grp").alias("main"), F.ceil((F.col("size") - F.col("most.own")) / BLOCK).cast("long").alias("others"),
        F.ceil(F.col("most.own") / BLOCK).cast("long").alias("mains"))
    rows = scratch.save(rows.join(mixed, "bucket"), "mixed")
    own = scratch.save(_only(sigs.select("id", "sig"), rows.select("id").distinct(), "left_semi"), "mixed-sigs")
    # blocks of the largest group come after those of all others, and meet these only
    main = F.col("grp") == F.col("main")
    met_by = F.when(main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    dealt = rows.join(own, "id").withColumn("block", F.when(main, F.col("others") + F.pmod(
        F.xxhash64("id"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others")))).select(
        "bucket", "id", "grp", "block", "sig", F.explode(F.sequence(F.lit(0).cast("long"), met_by - 1)).alias("other"))
    blocks = dealt.groupBy(
        "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    ).agg(F.collect_list(F.struct("id", "grp", "block", "sig")).alias("members"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("a", "b", "ga", "gb")]))
        for batch in batches:
            for row in range(batch.num_rows):
                place = [batch.column(c)[row].as_py() for c in range(3)]
                pairs = _meet(*place, batch.column(3)[row].as_py(), percent)
                if pairs:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([x], pa.int64()) for x in place), pa.array([pairs], kind)], ["bucket", "lo", "hi", "pairs"])

    met = scratch.save(blocks.repartition(shuffles(sigs.sparkSession)).mapInArrow(
        meet, "bucket long, lo long, hi long, pairs array<struct<a:long,b:long,ga:long,gb:long>>"), "met")
    ends = F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["a"], p["b"]))))
    members = met.select("bucket", "lo", "hi", F.explode(ends).alias("id"))
    sets = scratch.save(_sets(_only(docs, members.select("id").distinct(), "left_semi")), "met-sets")
    gathered = members.join(sets, "id").groupBy("bucket", "lo", "hi").agg(
        F.collect_list(F.struct("id", "shingles")).alias("members"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _pairs_batch(_forest(batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), percent))

    return scratch.save(met.join(gathered, ["bucket", "lo", "hi"]).select("pairs", "members").mapInArrow(
        verify, "a long, b long").distinct(), "more-links")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id",
                    text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, component, kept)`` of every row; a component's name is its smallest id.

    Texts are linked if their shingle sets are similar by ``percent`` or more.
    """
    bounded_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    texts = _texts(docs, id_col, text_col)
    sigs = scratch.save(signatures(docs, id_col, text_col), "signatures")
    named = sigs.where("id IS NOT NULL AND n > 0")
    first = scratch.save(named.groupBy("digest").agg(F.min("id").alias("rep")), "first")
    copies = scratch.save(
        named.select("id", "digest").join(first, "digest").where("id != rep").select("id").distinct(), "copies")
    bands = scratch.save(buckets(_only(named, copies, "left_anti"), percent).distinct(), "bands")
    centres = bands.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last")
    shared = scratch.save(bands.join(centres.drop("last"), "bucket"), "shared")
    stars = scratch.save(
        shared.where(F.col("id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(),
        "stars")
    survivors = scratch.save(_prune(stars, named, scratch, "stars", percent), "star-survivors")
    links = _verify(survivors, texts, scratch, "stars", percent)
    groups = components(links, Scratch(docs.sparkSession, "groups"))
    more = _across(shared, groups, named, texts, scratch, percent)
    linked = components(links.unionByName(more), Scratch(docs.sparkSession, "groups"))
    component = F.coalesce("component", "rep", "id")
    return (
        sigs.select("id", "digest", F.col("n").alias("n_shingles"))
        .join(first, "digest", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select("id", "n_shingles", component.alias("component"),
                F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    )


def one_per_group(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id",
                  text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents that stay, as they are: the smallest id of each group, and one row of each id."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    found = scratch.save(near_duplicates(docs, scratch, id_col, text_col, percent), "groups")
    gone = scratch.save(found.where("NOT kept").select("id").distinct(), "gone")
    stay = docs.join(
        F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs[id_col] == gone["id"], "left_anti")
    twice = scratch.save(found.where("kept AND id IS NOT NULL").groupBy("id").count().where("count > 1").select("id"), "twice")
    if twice.isEmpty():
        return stay
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))
    again = stay.join(twice, stay[id_col] == twice["id"], "left_semi").withColumn("__rank", rank).where("__rank = 1")
    return stay.join(twice, stay[id_col] == twice["id"], "left_anti").unionByName(again.drop("__rank"))
