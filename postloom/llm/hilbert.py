"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised into 2**bits steps each, and the
cell's place on the Hilbert curve orders the rows. Neighbours on the curve are
neighbours in every dimension, so a run of the curve covers a compact box and
a reader that filters on any of the dimensions can skip most files. The curve
is cut into runs of equal row counts: shard sizes differ by one row at most,
whatever the data look like.

Everything is DataFrame functions: the curve index is a fold over the bits
(Skilling's transform), rows are range-partitioned by index and a unique
tie-break, and a row's rank is its place in its partition plus the sizes of
the partitions before it. A hot cell is split by the tie-break, never gathered.

Input rules: null values fall into step 0 of their dimension, null text has
size 1 and crc32 0; equal rows are ordered arbitrarily among themselves;
other columns pass through ``shards`` unless they carry a name it adds, which
is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.scratch import Scratch

ADDED = ("curve", "shard", "slot")


def log_step(value: Column, bits: int, largest: int = (1 << 31) - 1) -> Column:
    """Steps by the logarithm of a size, as many to a doubling as reach ``largest``, the longest text a row can hold."""
    step = F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double")) * (((1 << bits) - 1) / math.log2(largest))).cast("int")
    return F.coalesce(F.least(step, F.lit((1 << bits) - 1)), F.lit(0))


def name_step(value: Column, bits: int) -> Column:
    """Steps by the hash of a name: the rows of a name share a step."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit((1 << bits) - 1)).cast("int") + 1)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def hilbert_index(steps: list[Column], bits: int) -> Column:
    """The place on the curve of a cell, from one integer per dimension.

    Skilling (2004): from the highest bit down, a set bit of a dimension flips
    the low bits of the first one, a clear bit swaps them; then Gray-decode, and
    interleave the bits.
    """
    n = len(steps)
    state = F.array(*[s.cast("int") for s in steps])
    moves = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(1 << b).alias("q")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, m: Column) -> Column:
        q, i = m["q"], m["i"]
        low = q - 1
        own, first = F.element_at(x, i + 1), F.element_at(x, 1)
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        up = own.bitwiseAND(q) != 0
        return F.transform(x, lambda v, k: F.when(
            k == 0, F.when(up, v.bitwiseXOR(low)).otherwise(v.bitwiseXOR(swap))
        ).when((k == i) & ~up, v.bitwiseXOR(swap)).otherwise(v))

    def gray(x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(2), F.lit(n)), F.slice(x, 1, 1),
            lambda out, k: F.array_append(out, F.element_at(x, k).bitwiseXOR(F.element_at(out, k - 1)))) if n > 1 else x

    def corrected(x: Column) -> Column:
        last = F.aggregate(
            F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0),
            lambda t, q: F.when(F.element_at(x, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return _bind(last, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    places = F.array(*[
        F.struct(F.lit(i + 1).alias("i"), F.lit(b).alias("b")) for b in range(bits - 1, -1, -1) for i in range(n)])
    interleaved = lambda x: F.aggregate(
        places, F.lit(0).cast("long"),
        lambda acc, p: F.shiftleft(acc, 1).bitwiseOR(
            F.call_function("shiftright", F.element_at(x, p["i"]), p["b"]).bitwiseAND(F.lit(1)).cast("long")))
    return _bind(F.aggregate(moves, state, turn), lambda a: _bind(gray(a), lambda b: _bind(corrected(b), interleaved)))


def shards(df: DataFrame, steps: list[Column], bits: int, ties: list[Column], n_shards: int,
           scratch: Scratch | None = None) -> DataFrame:
    """Adds ``curve``, ``shard`` (0 to n - 1) and ``slot`` (gapless from 0 in each shard).

    ``ties`` order the rows of a cell; they should be unique.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "hilbert")
    keep = [c for c in df.columns if c not in ADDED]
    # the range partitioner reads this twice, for a sample and for good: computing the index again costs less than a written copy
    placed = df.select(*keep, hilbert_index(steps, bits).alias("curve"), *[t.alias(f"__t{k}") for k, t in enumerate(ties)])
    order = ["curve", *[f"__t{k}" for k in range(len(ties))]]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = placed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the high bits of this id are the partition, the low ones the place in it
    number = F.monotonically_increasing_id()
    numbered = scratch.save(run.select(
        *keep, "curve", F.shiftright(number, 33).alias("__part"),
        number.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")), "numbered")
    counts = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = counts.selectExpr(
        "__part", f"coalesce(sum(__n) OVER (ORDER BY __part {before}), 0L) AS __base", "sum(__n) OVER () AS __all")
    rank = F.col("__base") + F.col("__place")
    return (
        numbered.join(F.broadcast(offsets), "__part")  # a row for each of n partitions
        .withColumn("__rank", rank)
        .withColumn("shard", F.expr(f"CAST(__rank * {n_shards} DIV __all AS INT)"))
        .withColumn("slot", F.col("__rank") - F.expr(
            f"(CAST(shard AS LONG) * __all + {n_shards - 1}) DIV {n_shards}"))
        .select(*keep, *ADDED)
    )


def write(sharded: DataFrame, path: str) -> None:
    """A folder per shard, in each files that hold runs of the curve, so that their statistics prune in every dimension.

    Rows of ``shards`` lie in runs of the curve already, so they are sorted where they are and not shuffled again.
    """
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
