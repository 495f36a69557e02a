"""Cards against their captured details, and stale descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import present, strip
from postloom.functions.titles import fix_doubled
from postloom.schema import ARRIVAL, MISSING_TEXT

#: A chunk holds at most 2**20 rows of a session (arrival is unique), and so on
#: upwards: 2**20 chunks make a part, and a session has at most 2**23 parts.
CHUNK_BITS = 20
#: An arrival number before all others.
BEFORE = -(1 << 62)


def _either_contains(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def details_agree(layout: str) -> Column:
    """Whether a card's fields agree with ``d_title`` and ``d_company``.

    Blank detail text proves nothing and is passed over.
    """
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    d_title = F.lower(F.coalesce(strip(F.col("d_title")), F.lit("")))
    if layout == "B":
        d_title = fix_doubled(d_title)
        return (F.length(d_title) > 0) & _either_contains(title, d_title)
    company = F.lower(F.coalesce(F.col("company"), F.lit("")))
    d_company = F.lower(F.coalesce(strip(F.col("d_company")), F.lit("")))
    by_company = (F.length(d_company) > 0) & _either_contains(company, d_company)
    by_title = (F.length(d_title) > 0) & d_title.contains(F.substring(title, 1, 10))
    return by_company | by_title


def match_details(cards: DataFrame, details: DataFrame, layout: str, key: str = "card_id") -> DataFrame:
    """Cards whose captured detail agrees, with the detail's other columns.

    An equi-join on the card; the text tests are its residual condition. In
    layout B the company is the detail's.
    """
    other = details.select(
        key, F.col("title").alias("d_title"), F.col("company").alias("d_company"),
        *[c for c in details.columns if c not in (key, "title", "company")],
    )
    joined = cards.join(other, key).where(details_agree(layout))
    if layout == "B":
        joined = joined.withColumn("company", F.coalesce(strip(F.col("d_company")), F.lit("")))
    return joined.drop("d_title", "d_company")


def _join_chunks(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk summaries onto rows; a struct key also matches a null session."""
    key = F.struct(*keys)
    return rows.withColumn("_key", key).join(summary.withColumn("_key", key).drop(*keys), "_key")


def text_digest(column: str) -> Column:
    """128 bits that stand for a text, null where it is missing."""
    return F.unhex(F.md5(present(F.col(column)).cast("binary")))


def blank_stale(df: DataFrame, session: str, layout: str, column: str = "description") -> DataFrame:
    """Replace a description that repeats the last remembered one by ``N/A``.

    Layout B remembers the last text seen, so every repeat goes. Layout A also
    remembers a blanked description, so within a run of equal texts every
    second one goes.

    Digests of the texts decide, on narrow rows; the wide rows are only joined with their arrival numbers.
    """
    rows = df.select(ARRIVAL, F.col(session).alias("session"), text_digest(column).alias("digest"))
    return blank_marked(df, stale_marks(rows, layout), column)


def blank_marked(df: DataFrame, marks: DataFrame, column: str = "description") -> DataFrame:
    """Write ``N/A`` where a row is marked as stale or has no text."""
    stale = marks.where("stale").select(ARRIVAL, F.lit(True).alias("_stale"))
    text = F.when(F.col("_stale").isNull(), present(F.col(column)))
    return df.join(stale, ARRIVAL, "left").withColumn(column, F.coalesce(text, F.lit(MISSING_TEXT))).select(*df.columns)


def stale_marks(rows: DataFrame, layout: str, memory: DataFrame | None = None) -> DataFrame:
    """Add ``stale`` to rows ``(arrival, session, digest)``; a digest is null where there is no text.

    A session may hold a large part of all rows, so no window spans one.
    Chunks of bounded size are summed up, bounded numbers of chunks into
    parts, and the summaries carry the state from one to the next; the rows
    then need their own chunk only.

    ``memory(session, digest, stale)`` is what ``remembered`` gave for the rows before
    these. It comes in as rows that arrived first: one, or two of one text if the
    last row was blanked, so that the run goes on where it stopped.
    """
    if memory is not None:
        times = F.when(F.lit(layout == "A") & F.col("stale"), 2).otherwise(1)
        before = memory.select(
            F.explode(F.sequence(F.lit(1), times)).alias("k"), "session", "digest"
        ).select((F.col("k") + F.lit(BEFORE)).alias(ARRIVAL), "session", "digest")
        rows = before.unionByName(rows)
    rows = rows.withColumn("_chunk", F.shiftright(ARRIVAL, CHUNK_BITS))
    out = _stale_b(rows) if layout == "B" else _stale_a(rows)
    return out.where(F.col(ARRIVAL) > BEFORE + 2).select(
        ARRIVAL, "session", "digest", (F.col("stale") & F.col("digest").isNotNull()).alias("stale"))


def remembered(marks: DataFrame, layout: str, memory: DataFrame | None = None) -> DataFrame:
    """``(session, digest, stale)``: what the rows after these have to know of each session met so far."""
    rows = marks.select("session", ARRIVAL, "digest", "stale")
    if memory is not None:
        rows = rows.unionByName(memory.select("session", F.lit(BEFORE).alias(ARRIVAL), "digest", "stale"))
    at = F.col(ARRIVAL) if layout == "A" else F.when(F.col("digest").isNotNull(), F.col(ARRIVAL))
    return rows.groupBy("session").agg(F.max_by(F.struct("digest", "stale"), at).alias("m")).select(
        "session", "m.digest", F.coalesce("m.stale", F.lit(False)).alias("stale"))


def _stale_b(rows: DataFrame) -> DataFrame:
    keys = ["session", "_chunk"]
    last = rows.groupBy(*keys).agg(
        F.max_by("digest", F.when(F.col("digest").isNotNull(), F.col(ARRIVAL))).alias("_last")
    )
    inside = Window.partitionBy(*keys).orderBy(ARRIVAL).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_prev", F.last("digest", ignorenulls=True).over(inside))
        .transform(_join_chunks, _carry_text(last), keys)
        .withColumn("stale", F.coalesce(
            F.col("digest") == F.coalesce("_prev", "_carry"), F.lit(False)))
    )


def _carry_text(last: DataFrame, top: bool = False) -> DataFrame:
    """Per chunk, the digest of the last text before it; ``_last`` is that of the last one in it."""
    last = last.withColumn("_part", F.lit(0) if top else F.shiftright("_chunk", CHUNK_BITS))
    before = (
        Window.partitionBy("session", "_part").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    near = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
    if top:
        return near.select("session", "_chunk", "_carry")
    parts = last.groupBy("session", F.col("_part").alias("_chunk")).agg(
        F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_chunk"))).alias("_last")
    )
    far = _carry_text(parts, top=True).toDF("session", "_part", "_far")
    return _join_chunks(near, far, ["session", "_part"]).select(
        "session", "_chunk", F.coalesce("_carry", "_far").alias("_carry")
    )


def _stale_a(rows: DataFrame) -> DataFrame:
    keys = ["session", "_chunk"]
    in_order = Window.partitionBy(*keys).orderBy(ARRIVAL)
    same = F.col("digest").eqNullSafe(F.lag("digest").over(in_order))
    rows = (
        rows.withColumn("_new", F.when(F.row_number().over(in_order) == 1, 1)
                        .otherwise(F.when(same, 0).otherwise(1)))
        .withColumn("_run", F.sum("_new").over(in_order))
    )
    in_run = Window.partitionBy(*keys, "_run").orderBy(ARRIVAL)
    rows = rows.withColumn("_pos", F.row_number().over(in_run))
    # One summary per chunk: its ends, the length of its last run, and
    # whether that run is all of it.
    ends = rows.groupBy(*keys).agg(
        F.min_by(F.struct("digest"), ARRIVAL).alias("_first"),
        F.max_by(F.struct("digest", "_pos", "_run"), ARRIVAL).alias("_end"),
    ).select(
        *keys, "_first.digest", F.col("_end.digest").alias("_last"), F.col("_end._pos").alias("_tail"),
        (F.col("_end._run") == 1).alias("_solid"),
    ).withColumnRenamed("digest", "_first")
    return _join_chunks(rows, _carry_run(ends), keys).withColumn(
        "stale",
        (F.col("_pos") + F.when(F.col("_run") == 1, F.col("_carry")).otherwise(0)) % 2 == 0,
    )


def _carry_run(ends: DataFrame, top: bool = False) -> DataFrame:
    """Per chunk, how many rows of its first run lie in earlier chunks.

    That is the last run of the chunk before, if it goes on here, plus what
    that run carried itself if it fills its chunk.
    """
    ends = ends.withColumn("_part", F.lit(0) if top else F.shiftright("_chunk", CHUNK_BITS))
    in_part = Window.partitionBy("session", "_part").orderBy("_chunk")
    joins = (F.row_number().over(in_part) > 1) & F.col("_first").eqNullSafe(F.lag("_last").over(in_part))
    through = joins & F.lag("_solid").over(in_part)
    ends = ends.withColumn("_add", F.when(joins, F.lag("_tail").over(in_part)).otherwise(0)).withColumn(
        "_segment", F.sum(F.when(through, 0).otherwise(1)).over(in_part)
    )
    so_far = Window.partitionBy("session", "_part", "_segment").orderBy("_chunk")
    near = ends.withColumn("_carry", F.sum("_add").over(so_far))
    if top:
        return near.select("session", "_chunk", "_carry")
    # in the first segment the run reaches back to the start of the part
    reaches = F.col("_segment") == 1
    parts = near.groupBy("session", F.col("_part").alias("_chunk")).agg(
        F.min_by(F.struct("_first"), "_chunk").alias("_f"),
        F.max_by(F.struct(
            "_last", (F.col("_tail") + F.when(F.col("_solid"), F.col("_carry")).otherwise(0)).alias("_tail"),
            (F.col("_solid") & reaches).alias("_solid")), "_chunk").alias("_e"),
    ).select("session", "_chunk", "_f._first", "_e._last", "_e._tail", "_e._solid")
    far = _carry_run(parts, top=True).toDF("session", "_part", "_far")
    return _join_chunks(near, far, ["session", "_part"]).select(
        "session", "_chunk", (F.col("_carry") + F.when(reaches, F.col("_far")).otherwise(0)).alias("_carry")
    )
