"""An index of stored keys: hash buckets in files, and a Bloom filter for each of them.

A key is a URL or a (title, company) pair; two hashes of 64 bits stand for it. Every
stored batch has a folder ``bucket=k/part-*.parquet`` with the hashes of its keys and a
table of Bloom filters, one row a bucket. A lookup deals the asked keys and the filters by bucket,
finds the places (batch and bucket) that may hold one, and reads those files alone. What it
reads grows with the filters, some bytes a stored key, and with the buckets that are met, never with the
stored postings.

Keys are distinct and hashed, so buckets are of about one size whatever holds many rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.fields import ingest_sig, url_key
from postloom.sources.postings import stored_signatures, stored_urls

#: Buckets of a batch, and bits and hash functions of a filter: one key of 100,000 that is not there seems to be.
BUCKETS, BITS, FUNCTIONS = 64, 24, 12
URL, SIG = "u", "s"
KEYS = "bucket int, h long, g long"


def _hashed(kind: str, *parts: Column) -> list[Column]:
    h = F.xxhash64(F.lit(kind), *parts)
    return [F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"), h.alias("h"), F.xxhash64(*parts, F.lit(kind), h).alias("g")]


def keys_of(stored: DataFrame) -> DataFrame:
    """``(bucket, h, g)`` of the distinct keys of stored postings."""
    urls = stored_urls(stored).select(*_hashed(URL, F.col("url_key")))
    sigs = stored_signatures(stored).select(*_hashed(SIG, F.col("title"), F.col("company")))
    return urls.unionByName(sigs).distinct()


def _places(h: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key, a row a key."""
    step = g.view(np.uint64) | np.uint64(1)
    return (h.view(np.uint64)[:, None] + np.arange(FUNCTIONS, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def _filter(h: np.ndarray, g: np.ndarray) -> bytes:
    bits = np.zeros(-(-BITS * len(h) // 8) * 8, bool)
    bits[_places(h, g, len(bits))] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    packed = np.frombuffer(bits, np.uint8)
    at = _places(h, g, 8 * len(packed))
    return ((packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def write(stored: DataFrame, folder: str) -> None:
    """Write the keys of one batch to ``folder/keys`` and their filters to ``folder/filters``."""
    spark = stored.sparkSession
    keys_of(stored).repartition("bucket").sortWithinPartitions("bucket", "h").write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{folder}/keys")
    kept = spark.read.schema(KEYS).parquet(f"{folder}/keys").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def done(bucket: int) -> pa.RecordBatch:
            own = held.pop(bucket)
            h, g = (np.concatenate([x[k] for x in own]) for k in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([_filter(h, g)], pa.binary())], ["bucket", "bits"])

        for batch in batches:
            buckets, h, g = (batch.column(c).to_numpy() for c in ("bucket", "h", "g"))
            for bucket in np.unique(buckets).tolist():
                own = buckets == bucket
                held.setdefault(bucket, []).append((h[own], g[own]))
            last = int(buckets[-1]) if len(buckets) else -1
            for bucket in [b for b in held if b < last]:
                yield done(bucket)
        for bucket in list(held):
            yield done(bucket)

    kept.select("bucket", "h", "g").mapInArrow(run, "bucket int, bits binary").write.mode("overwrite").parquet(f"{folder}/filters")


def _probe(key, asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    h, g = asked["h"].to_numpy(), asked["g"].to_numpy()
    met = [place for place, bits in zip(filters["place"], filters["bits"]) if len(h) and may_hold(bits, h, g).any()]
    return pd.DataFrame({"place": np.array(met, np.int32), "bucket": np.full(len(met), key[0], np.int32)})


def met_buckets(asked: DataFrame, folders: Sequence[str]) -> list[str]:
    """Bucket folders that may hold an asked key ``(bucket, h, g)``; at most ``BUCKETS`` names a batch."""
    spark = asked.sparkSession
    filters = None
    for k, folder in enumerate(folders):
        part = spark.read.schema("bucket int, bits binary").parquet(f"{folder}/filters").withColumn("place", F.lit(k))
        filters = part if filters is None else filters.unionByName(part)
    if filters is None:
        return []
    met = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_probe, "place int, bucket int")
    return sorted(f"{folders[r.place]}/keys/bucket={r.bucket}" for r in met.collect())


def met_keys(new: DataFrame, folders: Sequence[str], scratch) -> DataFrame:
    """``(url, title, company)``: of the keys that ``new`` postings have, those that the batches in ``folders`` hold.

    A URL comes as a row without the other two, a title and company as a row without a URL.
    """
    sig = ingest_sig(F.col("title"), F.col("company"))
    text = F.lit(None).cast("string")
    urls = new.select(url_key(F.col("url")).alias("url")).where("url IS NOT NULL").distinct().select(
        *_hashed(URL, F.col("url")), "url", text.alias("title"), text.alias("company"))
    sigs = new.select(sig.alias("s")).select("s.title", "s.company").distinct().select(
        *_hashed(SIG, F.col("title"), F.col("company")), text.alias("url"), "title", "company")
    asked = scratch.save(urls.unionByName(sigs), "asked")
    paths = met_buckets(asked.select("bucket", "h", "g"), folders)
    if not paths:
        return asked.select("url", "title", "company").limit(0)
    found = new.sparkSession.read.schema("h long, g long").parquet(*paths)
    return asked.join(found, ["h", "g"], "left_semi").select("url", "title", "company")
