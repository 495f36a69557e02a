"""CSV files cut into records by many tasks, though quoted fields hold line ends.

A line says what becomes of the reader's state, whether it is inside quotes, for both states it
may begin in. So every range of a file sums up its lines to one such step, and
the records that begin in it, for both states; a scan over the ranges of a
file tells each its own first state and the number of its first record. Then the ranges are read
again and cut where a line ends outside quotes. Only records that lie in two ranges are put together by a shuffle.

A quote opens a field at its start only, as in the reader Spark has; elsewhere it is a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges of files, some 50 bytes each, whose steps are broadcast; more are shuffled to the lines.
BROADCAST_RANGES = 500_000

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:{_QUOTED}"[^,]*+|(?!")[^,]*+),)*+'
#: Lines that end inside quotes if they begin outside, and if they begin inside.
OPENS = rf"^{_FIELDS}{_QUOTED}\z"
STAYS = rf'^[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,{_FIELDS}{_QUOTED}\z)'


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in the order of their range: ``(file, block, id, value, opens, stays)``."""
    value = F.col("value")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value", value.rlike(OPENS).alias("opens"), value.rlike(STAYS).alias("stays"))


def _steps(lines: DataFrame) -> DataFrame:
    """A row per range: end states and numbers of records for both first states; of a file's first range also its header."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], list] = {}
        for batch in batches:
            for file, block, value, opens, stays in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # per first state (outside, inside): the state now, and the records begun
                own = kept.setdefault((file, block), [False, True, 0, 0, [], True])
                if block == 0 and own[5]:
                    own[4].append(value)
                for k in (0, 1):
                    if own[k]:
                        own[k] = stays
                    else:
                        own[k + 2] += value not in ("", "\r")
                        own[k] = opens
                own[5] = own[5] and (own[0] or not own[2])
        rows = [(*k, *v[:4], "\n".join(v[4]) if k[1] == 0 else None) for k, v in kept.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                         ["file", "block", "outside", "inside", "n_outside", "n_inside", "header"])

    return lines.select("file", "block", "value", "opens", "stays").mapInArrow(
        run, "file string, block long, outside boolean, inside boolean, n_outside long, n_inside long, header string")


def _starts(steps: DataFrame) -> DataFrame:
    """``(file, block, begins_inside, before)``: first state of each range, and records begun before it.

    A step gives one state whatever it began with, or keeps the state, or turns it over: the state is that of the last
    step of the first kind, turned over as often as steps of the last kind follow. Windows are over one row per range.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed, turns = F.col("outside") == F.col("inside"), F.col("outside") & ~F.col("inside")
    at = steps.withColumn("turned", F.coalesce(F.sum(turns.cast("int")).over(before), F.lit(0)))
    last = F.last(F.when(fixed, F.struct(F.col("outside").alias("state"), "turned")), ignorenulls=True).over(before)
    at = at.withColumn("last", last).withColumn(
        "begins_inside",
        F.coalesce(F.col("last.state"), F.lit(False)) != ((F.col("turned") - F.coalesce("last.turned", F.lit(0))) % 2 == 1))
    n = F.when(F.col("begins_inside"), F.col("n_inside")).otherwise(F.col("n_outside"))
    return at.select("file", "block", "begins_inside", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("before"))


def headers(steps: DataFrame) -> list[tuple[str, str]]:
    """``(file, header record)`` of every file that has a record; one row a file."""
    found = steps.where("block = 0 AND header IS NOT NULL").select("file", "header").collect()
    return [(r.file, r.header) for r in found if r.header.strip("\r\n")]


def steps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _steps(_lines(spark, path))


def records(spark: SparkSession, path: str | list[str], steps: DataFrame) -> DataFrame:
    """``(file, row, record)`` of files whose written ``steps`` are given; row 0 is the header.

    In files whose header ends in carriage return and line feed, the same inside quotes becomes a line feed.
    """
    crlf = steps.where("block = 0").select("file", F.coalesce(F.col("header").endswith("\r"), F.lit(False)).alias("crlf"))
    starts = _starts(steps).join(crlf, "file")
    lines = _lines(spark, path)
    if steps.count() <= BROADCAST_RANGES:
        placed = lines.join(F.broadcast(starts), ["file", "block"])  # lines stay in order
    else:
        placed = lines.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, inside, row, held, whole = None, False, 0, [], True

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                              ["file", "block", "row", "record", "whole"])

        for batch in batches:
            out = []
            for file, block, value, opens, stays, begins, before, strip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != place:
                    if held:  # the record goes on in the next range
                        out.append((*place, row, "\n".join(held), False))
                    place, inside, row, held, whole = (file, block), begins, before - 1, [], not begins
                if strip and value.endswith("\r"):
                    value = value[:-1]
                if not inside:
                    if value in ("", "\r"):
                        continue
                    row += 1
                held.append(value)
                inside = stays if inside else opens
                if not inside:
                    out.append((*place, row, "\n".join(held), whole))
                    held, whole = [], True
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([(*place, row, "\n".join(held), False)])

    pieces = placed.select("file", "block", "value", "opens", "stays", "begins_inside", "before", "crlf").mapInArrow(
        run, "file string, block long, row long, record string, whole boolean")
    cut = pieces.where("NOT whole").groupBy("file", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "\n").alias("record"))
    return pieces.where("whole").select("file", "row", "record").unionByName(cut)
