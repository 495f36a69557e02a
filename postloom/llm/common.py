"""What the operators of this folder share: table access, row keys, Arrow text as numpy bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that numpy code in a task works on at a time.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those of smallest key hash; equal tables give equal samples.

    Rows are first thinned out by the hash to about four times as many, so that
    the sort gets few rows however many tasks there are.
    """
    total, reach, h = df.count(), 1 << 31, F.xxhash64(*keys)
    thin = F.pmod(h, F.lit(reach)) < min(reach, 4 * n * reach // max(1, total))
    order = F.pmod(h, F.lit(reach))
    return df.where(thin).orderBy(order, h).limit(n)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, as texts are long: a worker holds some MB, not the default 10,000 texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def same_row(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """Equality of all keys, where null equals null."""
    test = F.lit(True)
    for k in keys:
        test = test & a[k].eqNullSafe(b[k])
    return test


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column without nulls, and n + 1 offsets into them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0]: at[-1]], at.astype(np.int64) - int(at[0])


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
