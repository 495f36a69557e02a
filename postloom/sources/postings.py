"""Read postings from CSV, conform them to the stored columns, list seen keys."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.config import CSV_NULLS
from postloom.functions.fields import ingest_sig, url_key
from postloom.functions.text import is_missing
from postloom.schema import ARRIVAL, MISSING_TEXT, OUTPUT_COLUMNS
from postloom.scratch import Scratch
from postloom.sources import csv_records

#: Local files are listed as file:/x and scanned as file:///x.
SCHEME = ("^file:/+", "")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Read postings CSV: header row, quoted multi-line text, every column text.

    Every file is read by the names of its own header, so files may differ in the
    order and choice of columns. The reader takes one null marker only, so the
    whole list is applied per column. Absent columns become null; extra columns
    stay. ``arrival`` numbers the rows by file name and position. Large files are
    cut into records by many tasks (``csv_records``).
    """
    # the driver lists the files to plan the scan anyway
    listed = sorted(spark.read.text(path).inputFiles(), key=_plain_path)
    steps = Scratch(spark, "csv-steps").save(csv_records.steps(spark, path), "steps")
    by_path = {_plain_path(f): f for f in listed}
    groups: dict[str, list[str]] = {}
    for file, header in sorted(csv_records.headers(steps), key=lambda x: _plain_path(x[0])):
        groups.setdefault(header.replace("\r\n", "\n").removesuffix("\r").removeprefix("\ufeff"), []).append(by_path[_plain_path(file)])
    parts = [_read_files(spark, files, header, steps) for header, files in groups.items()]
    raw = parts[0] if parts else spark.createDataFrame([], "_file string, _row long")
    for part in parts[1:]:
        raw = raw.unionByName(part, allowMissingColumns=True)
    numbers = spark.createDataFrame(
        [(_plain_path(f), n) for n, f in enumerate(listed)], "_file string, _file_no long")
    names = [c for c in raw.columns if c not in ("_file", "_row")]
    nulls = [
        F.when(~F.col(f"`{c}`").isin(*CSV_NULLS), F.col(f"`{c}`")).alias(c) for c in names
    ]
    absent = [F.lit(None).cast("string").alias(c) for c in OUTPUT_COLUMNS if c not in names]
    return raw.join(numbers, "_file").select(
        (F.shiftleft("_file_no", 33) + F.col("_row")).alias(ARRIVAL), *nulls, *absent,
    )


def _read_files(spark: SparkSession, files: list[str], header: str, steps: DataFrame) -> DataFrame:
    """Files of one header, with the file and the place of each row in it."""
    names = next(csv.reader(io.StringIO(header, newline="")))
    twice = {n for n in names if names.count(n) > 1}
    names = [f"_c{k}" if not n else f"{n}{k}" if n in twice else n for k, n in enumerate(names)]
    found = csv_records.records(spark, [unquote(f) for f in files], steps).where("row > 0")
    parsed = F.from_csv("record", _ddl(names), {"escape": '"', "maxCharsPerColumn": "-1"})
    return found.select(
        parsed.alias("_fields"), F.regexp_replace("file", *SCHEME).alias("_file"), (F.col("row") - 1).alias("_row")
    ).select(*[F.col("_fields").getField(n).alias(n) for n in names], "_file", "_row")


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def _plain_path(uri: str) -> str:
    return re.sub(SCHEME[0], "", uri)


def conform(df: DataFrame, columns: Sequence[str] = tuple(OUTPUT_COLUMNS)) -> DataFrame:
    """Exactly ``columns``, in order; absent ones filled ``N/A``, nulls kept."""
    return df.select(*[
        F.col(c) if c in df.columns else F.lit(MISSING_TEXT).alias(c) for c in columns
    ])


def sink_text(df: DataFrame) -> DataFrame:
    """Write form of the stored columns: null becomes ``N/A``."""
    return df.select(*[
        F.coalesce(F.col(c), F.lit(MISSING_TEXT)).alias(c) if c in OUTPUT_COLUMNS else F.col(c)
        for c in df.columns
    ])


def unsink_text(df: DataFrame) -> DataFrame:
    """Read form of the stored columns: "no value" text becomes null."""
    return df.select(*[
        F.when(~F.col(c).isin(*CSV_NULLS), F.col(c)).alias(c) if c in OUTPUT_COLUMNS else F.col(c)
        for c in df.columns
    ])


def missing_report(df: DataFrame, columns: Sequence[str] = tuple(OUTPUT_COLUMNS)) -> DataFrame:
    """Rows, and rows without a value per column, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(is_missing(F.col(c))).alias(f"missing_{c}") for c in columns],
    )


def stored_urls(stored: DataFrame) -> DataFrame:
    """The URL of every stored posting that has one."""
    return stored.select(url_key(F.col("url")).alias("url_key")).where("url_key IS NOT NULL")


def stored_signatures(stored: DataFrame) -> DataFrame:
    """The (title, company) key of every stored posting that has both."""
    sig = ingest_sig(F.col("title"), F.col("company"))
    return (
        stored.where(~is_missing(F.col("title")) & ~is_missing(F.col("company")))
        .select(sig.alias("sig")).select("sig.title", "sig.company")
    )


def seen_urls(stored: DataFrame) -> DataFrame:
    """Distinct URLs of the stored postings."""
    return stored_urls(stored).distinct()


def seen_signatures(stored: DataFrame) -> DataFrame:
    """Distinct (title, company) keys of the stored postings."""
    return stored_signatures(stored).distinct()
