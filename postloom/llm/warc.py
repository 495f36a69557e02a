"""WARC archives: writing with revisits and segments, reading with reassembly.

Writing. Every capture is an HTTP response in chunked transfer framing. A block
longer than ``SEGMENT_BYTES`` is cut into segments: the first record has the
type and number 1, the others are ``continuation`` records that name the first
by ``WARC-Segment-Origin-ID``, and the last gives the total length. Of captures
with one payload of at least ``MIN_REVISIT`` bytes, that of the largest id (then url) is
stored and the others are ``revisit`` records that refer to it. Its record id comes from the
digest of the payload, so all tasks know it; every other record has a random one.
Rows that are wholly equal to the stored one are counted, and written again from the count: one of them
is stored, though none can be told from another.
Records end in two line ends, which is the record separator Spark's text
writer adds, so files are committed by Spark and a lost task leaves none.

Reading. Files are parsed by content length. Segments are grouped by origin,
ordered by number, and must count from 1 without a gap and add up to the total
length; then the chunked framing is decoded. What fails is returned with
``problem`` set and without a payload. A group is one capture, so it is no
larger than one document. Revisits take length and digest from the record they
refer to, which must have the digest they state.

Input rules: null content is an empty payload; a null url leaves the target out;
every row is one capture, returned once, whatever ids, urls and contents repeat; null ids count as
the smallest; characters that a target cannot hold are percent-encoded there and the url is
kept beside it; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, shuffles
from postloom.scratch import Scratch

MIN_REVISIT = 1000
#: What a capture is to others with its payload.
STORED, ALONE, REVISIT = "stored", "alone", "revisit"
#: Revisits made from one count in one piece.
EQUAL_ROWS = 100_000
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 8 << 10
RECORDS_PER_FILE = 1000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def record_id(capture: str, n: int = 1) -> str:
    """A stable record identifier for a capture and a segment of it."""
    h = hashlib.md5(f"{capture}/{n}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i: i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The content of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if body[end + 2 + size: end + 4 + size] != b"\r\n":
            raise ValueError("chunk of a wrong length")
        out.append(body[end + 2: end + 2 + size])
        at = end + 4 + size


def _record(kind: str, name: str, block: bytes, **fields: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {_DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _target(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def records(page: int | None, url: str | None, payload: bytes | None, sha1: str, refers: int | None, kind: str) -> Iterator[bytes]:
    """The records of one capture: ``stored`` for others to refer to, ``alone``, or a ``revisit`` of the page ``refers``."""
    target = _target(url)
    same = url is None or target == url == url.strip()
    about = {
        "WARC_Target_URI": target, "X_Target": None if same else base64.b64encode(url.encode()).decode(), "X_Page_ID": page,
        "Content_Type": "application/http; msgtype=response",
        "WARC_Payload_Digest": f"sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"}
    capture = sha1 if kind == STORED else uuid.uuid4().hex
    if kind == REVISIT:
        yield _record("revisit", record_id(capture), _HTTP, **about, WARC_Profile=_PROFILE, X_Refers_Page_ID=refers,
                      WARC_Refers_To=record_id(sha1))
        return
    block = _HTTP + chunked(payload)
    parts = [block[i: i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    if len(parts) == 1:
        yield _record("response", record_id(capture), block, **about)
        return
    for n, part in enumerate(parts, 1):
        total = len(block) if n == len(parts) else None
        if n == 1:
            yield _record("response", record_id(capture), part, **about, WARC_Segment_Number=1)
        else:
            yield _record("continuation", record_id(capture, n), part, WARC_Segment_Number=n,
                          WARC_Segment_Origin_ID=record_id(capture), WARC_Segment_Total_Length=total)


def _equal_rows(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Of rows that are equal to the stored one of their payload, one to store and the others as revisits, by their count."""
    about = [F.col("top.page").alias("page"), F.col("top.url").alias("url")]
    refers = F.col("top.page").alias("refers")
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.first("top").alias("top")).select(
        *about, "payload", "digest", refers, F.lit(STORED).alias("kind"))
    last = F.col("top.n") - 2
    pieces = top.where("top.n > 1").select(
        "digest", "top", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(EQUAL_ROWS).cast("long"))).alias("piece"))
    ones = F.explode(F.sequence(F.col("piece"), F.least(F.col("piece") + F.lit(EQUAL_ROWS - 1).cast("long"), last)))
    again = pieces.repartition(shuffles(rows.sparkSession), "digest", "piece").select("digest", "top", ones).select(
        *about, F.lit(None).cast("binary").alias("payload"), "digest", refers, F.lit(REVISIT).alias("kind"))
    return stored.unionByName(again)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
          content_col: str = "html") -> None:
    """Write one capture per row to gzipped WARC files."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(content_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # short rows, combined before they are shuffled: the largest of every payload, and how many rows equal it
    top = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest", "page", "url").agg(
        F.count(F.lit(1)).alias("n")).groupBy("digest").agg(
        F.max(F.struct("page", "url", "n")).alias("top"), F.sum("n").alias("all")).where(F.col("all") > 1)
    top = Scratch(pages.sparkSession, "warc-payloads").save(top, "top")
    found = rows.join(top, "digest", "left")
    is_top = F.col("page").eqNullSafe(F.col("top.page")) & F.col("url").eqNullSafe(F.col("top.url"))
    twin = F.col("top").isNotNull() & is_top & (F.col("top.n") > 1)
    kind = F.when(F.col("top").isNull(), ALONE).when(is_top, STORED).otherwise(REVISIT)
    ready = found.where(~twin).select("page", "url", "payload", "digest", F.col("top.page").alias("refers"), kind.alias("kind"))
    if not top.where("top.n > 1").isEmpty():
        ready = ready.unionByName(_equal_rows(found.where(twin), top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in records(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    ready.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, in lower case, and block of each record of a WARC file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        yield fields, data[end + 4: end + 4 + size]
        at = end + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


_FIELDS = {
    "record": "warc-record-id", "kind": "warc-type", "origin": "warc-segment-origin-id", "url": "warc-target-uri",
    "written": "x-target", "digest": "warc-payload-digest", "refers_to": "warc-refers-to", "page": "x-page-id", "refers_page": "x-refers-page-id",
    "number": "warc-segment-number", "total": "warc-segment-total-length",
}
_NUMBERS = ("page", "refers_page", "number", "total")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files, segments as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = list(parse(data.as_py()))
                columns = []
                for name, field in _FIELDS.items():
                    values = [f.get(field) for f, _ in found]
                    columns.append(pa.array([None if v is None else int(v) for v in values], pa.int64())
                                   if name in _NUMBERS else pa.array(values, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([b for _, b in found], pa.binary())], [*_FIELDS, "block"])

    schema = ", ".join(f"{n} {'long' if n in _NUMBERS else 'string'}" for n in _FIELDS) + ", block binary"
    rows = spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)
    return rows.withColumn("url", F.coalesce(F.unbase64("written").cast("string"), "url")).drop("written")


def _decoded(block: bytes, digest: str | None) -> tuple[bytes | None, str | None]:
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        payload = unchunked(body) if b"\ntransfer-encoding: chunked" in head.lower() else body
    except ValueError as e:
        return None, f"framing: {e}"
    if digest and digest != f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}":
        return None, "digest differs"
    return payload, None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per capture: ``record, kind, page, url, refers_to, refers_page, digest, payload, problem``.

    Revisits have no payload of their own.
    """
    rows = read_records(spark, folder)
    segmented = F.col("number").isNotNull()
    parts = rows.where(segmented).groupBy(F.coalesce("origin", "record").alias("record")).agg(
        F.sort_array(F.collect_set(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        *[F.max(c).alias(c) for c in ("page", "url", "digest", "refers_to", "refers_page")],
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"))
    numbers = F.transform("parts", lambda p: p["number"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    joined = F.expr("CAST(array_join(transform(parts, p -> CAST(p.block AS STRING)), '') AS BINARY)")
    columns = ["record", "kind", "page", "url", "refers_to", "refers_page", "digest"]
    whole = parts.select(
        *columns, joined.alias("block"),
        F.when(F.col("kind").isNull(), "first segment missing")
        .when(F.col("total").isNull(), "last segment missing")
        .when(numbers != F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long")), "segment missing or doubled")
        .when(length != F.col("total"), "length differs").alias("problem"))
    single = rows.where(~segmented).select(*columns, "block", F.lit(None).cast("string").alias("problem"))
    both = single.unionByName(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, digests, blocks, problems = (batch.column(n).to_pylist() for n in ("kind", "digest", "block", "problem"))
            got = [(None, p) if p or k == "revisit" else _decoded(b, d)
                   for k, d, b, p in zip(kinds, digests, blocks, problems, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([g[0] for g in got], pa.binary()),
                 pa.array([g[1] for g in got], pa.string())], [*columns, "payload", "problem"])

    kinds = dict(both.dtypes)
    return both.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", payload binary, problem string")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """``page, url, bytes, sha1, kind, refers_page, problem`` of every capture, revisits resolved."""
    rows = read(spark, folder).select(
        "record", "kind", "page", "url", "refers_to", "refers_page", "digest", "problem",
        F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    stored = rows.where("kind = 'response'").drop("refers_to", "refers_page")
    targets = stored.select(
        F.col("record").alias("refers_to"), F.col("digest").alias("t_digest"), F.col("bytes").alias("t_bytes"),
        F.col("sha1").alias("t_sha1")).dropDuplicates(["refers_to"])
    wrong = F.col("t_digest").isNull() | (F.col("t_digest") != F.col("digest"))
    seen = rows.where("kind = 'revisit'").join(targets, "refers_to", "left").select(
        "page", "url", F.col("t_bytes").alias("bytes"), F.col("t_sha1").alias("sha1"), "kind", "refers_page",
        F.when(wrong, "revisited record missing or another").alias("problem"))
    return stored.select(
        "page", "url", "bytes", "sha1", "kind", F.lit(None).cast("long").alias("refers_page"), "problem").unionByName(seen)
