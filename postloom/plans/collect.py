"""Collect: captured pages to candidates, decisions, and the append."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.config import Config, Layout
from postloom.functions.fields import extract_salary, ingest_sig, join_quals, stamp, url_key
from postloom.functions.text import is_missing
from postloom.operators import gates
from postloom.operators.chunks import Infer, summarize
from postloom.operators.dedup import drop_seen, greedy_arrivals
from postloom.operators.matching import blank_marked, match_details, remembered, stale_marks, text_digest
from postloom.schema import ARRIVAL, MISSING_TEXT
from postloom.scratch import Scratch
from postloom.sources.pages import extract_postings
from postloom.sources.postings import seen_signatures, seen_urls
from postloom.sources.store import DEFAULT_WRITER, PostingStore

#: Stored postings, or what finds the stored ones among the keys of others.
Stored = DataFrame | Callable[[DataFrame], DataFrame]
#: Cards of one result page and result pages, at most (powers of two).
PAGE_BITS, NUMBER_BITS = 20, 42


def card_number() -> Column:
    """``page_id * 2**20 + pos``, or an error where that would not be unique."""
    fits = F.col("page_id").between(0, (1 << NUMBER_BITS) - 1) & (F.col("pos") < 1 << PAGE_BITS)
    wrong = F.concat(F.lit("no card number for page "), F.col("page_id"), F.lit(", card "), F.col("pos"))
    return F.when(fits, F.shiftleft("page_id", PAGE_BITS) + F.col("pos")).otherwise(F.raise_error(wrong).cast("long"))


def arrival(layout: Layout) -> Column:
    """Order of arrival: the cards of layout A come before all others."""
    return F.col("card_id") + F.lit(0 if layout.name == "A" else 1 << (PAGE_BITS + NUMBER_BITS)).cast("long")


def capture(pages: DataFrame, details: DataFrame, layout: Layout) -> DataFrame:
    """Candidates from captured result pages and details of one layout.

    ``details`` is keyed by ``card_id``, which is ``page_id * 2**20 + pos``.
    """
    cards = extract_postings(pages, layout).withColumn("card_id", card_number())
    extra = [c for c in ("keyword", "page_num") if c in pages.columns]
    cards = cards.join(pages.select("page_id", *extra), "page_id") if extra else cards
    both = match_details(cards, details, layout.name)
    if layout.name == "A":
        salary = extract_salary(F.col("compensation"), F.col("body"))
        quals = join_quals(F.col("qualifications"))
    else:
        salary, quals = F.lit(MISSING_TEXT), F.lit(MISSING_TEXT)
    # layout A forgets the last description with every result page
    session = F.col("page_id") if layout.name == "A" else F.lit(0).cast("long")
    return both.select(
        arrival(layout).alias(ARRIVAL), F.lit(layout.name).alias("layout"), session.alias("session"),
        *extra, "title", "url", "company", "description",
        salary.alias("salary"), quals.alias("qualifications"), stamp().alias("scraped_at"),
    )


def _gated(candidates: DataFrame, cfg: Config) -> DataFrame:
    """Add ``tier`` and ``missing``, the answers of the gates that look at no description."""
    df = gates.page_limit(candidates, cfg) if "page_num" in candidates.columns else candidates
    return df.withColumn("tier", gates.title_tier(F.coalesce("title", F.lit("")), cfg)).withColumn(
        "missing", gates.missing_field(cfg, F.col("layout"))
    )


def stale_rows(candidates: DataFrame, cfg: Config, memory: DataFrame | None = None) -> DataFrame:
    """``(layout, arrival, session, digest, stale)`` of the candidates that pass the field and title gates.

    ``memory(layout, session, digest, stale)`` is what earlier candidates left behind.
    """
    shown = _gated(candidates, cfg).where(
        F.col("missing").isNull() & F.col("tier").isin(gates.KEEP, gates.CHECK))
    narrow = shown.select(
        "layout", ARRIVAL, F.col("session").cast("string").alias("session"), text_digest("description").alias("digest"))
    out = None
    for layout in cfg.layouts:
        known = memory.where(F.col("layout") == layout).drop("layout") if memory is not None else None
        marks = stale_marks(narrow.where(F.col("layout") == layout).drop("layout"), layout, known)
        marks = marks.select(F.lit(layout).alias("layout"), *marks.columns)
        out = marks if out is None else out.unionByName(marks)
    return out


def next_memory(marks: DataFrame, cfg: Config, memory: DataFrame | None = None) -> DataFrame:
    """The memory after the candidates that ``stale_rows`` marked."""
    out = None
    for layout in cfg.layouts:
        here = F.col("layout") == layout
        known = memory.where(here).drop("layout") if memory is not None else None
        left = remembered(marks.where(here), layout, known)
        left = left.select(F.lit(layout).alias("layout"), *left.columns)
        out = left if out is None else out.unionByName(left)
    return out


def screen(candidates: DataFrame, cfg: Config, marks: DataFrame | None = None) -> DataFrame:
    """Add ``tier``, ``missing`` and ``passes`` to the candidates.

    With a ``session`` column, stale descriptions are blanked first, among
    the rows that pass the field and title gates; ``marks`` tells which, if that is known already.
    """
    df = _gated(candidates, cfg)
    if "session" in df.columns:
        shown = F.col("missing").isNull() & F.col("tier").isin(gates.KEEP, gates.CHECK)
        known = F.coalesce(shown & F.col("layout").isin(*cfg.layouts), F.lit(False))
        marks = stale_rows(candidates, cfg) if marks is None else marks
        df = blank_marked(df.where(known), marks).unionByName(df.where(~known))
    return df.withColumn(
        "passes",
        F.col("missing").isNull() & gates.accept(F.col("tier"), F.col("description"), cfg),
    )


def _marked(candidates: DataFrame, cfg: Config, scratch: Scratch, memory: DataFrame | None = None) -> DataFrame | None:
    """The written marks of the candidates, if they have sessions."""
    return scratch.save(stale_rows(candidates, cfg, memory), "marks") if "session" in candidates.columns else None


def _verdicts(candidates: DataFrame, cfg: Config, scratch: Scratch, marks: DataFrame | None) -> DataFrame:
    """What the gates say of each candidate, and its keys, without the wide text: written once, read by all later steps."""
    return scratch.save(screen(candidates, cfg, marks).select(
        ARRIVAL, "layout", "title", "url", "company", "tier", "missing", "passes"), "verdicts")


def _kept(verdicts: DataFrame, stored: Stored, max_rows: int | None) -> DataFrame:
    """Arrivals that a run saves: stored keys, first wins, cap."""
    keys = verdicts.where("passes").select(ARRIVAL, "title", "url", "company")
    stored = stored(keys) if callable(stored) else stored
    kept = greedy_arrivals(drop_seen(keys, stored))
    return kept if max_rows is None else gates.cap(kept, max_rows)


def accepted(candidates: DataFrame, stored: Stored, cfg: Config, marks: DataFrame | None = None) -> DataFrame:
    """The candidates a run saves: gates, stored keys, first wins, cap.

    ``stored`` are the stored postings, or a function that finds those of the keys of given postings that are stored.

    Keys decide, so only they go through the joins and rounds; the wide rows
    are picked by their arrival number at the end.
    """
    scratch = Scratch(candidates.sparkSession, "accepted")
    marks = _marked(candidates, cfg, scratch) if marks is None else marks
    verdicts = _verdicts(candidates, cfg, scratch, marks)
    kept = scratch.save(_kept(verdicts, stored, cfg.max_rows).select(ARRIVAL), "kept")
    # stale descriptions are blanked again on the way out
    shown = screen(candidates, cfg, marks) if marks is not None else candidates
    return shown.join(kept, ARRIVAL, "left_semi").select(*candidates.columns)


def _first_holder(stored_keys: DataFrame, kept: DataFrame, key: Column, name: str) -> DataFrame:
    """Per key, the arrival that holds it: -1 where it is stored already."""
    held = kept.select(key.alias("key"), F.col(ARRIVAL).alias("at")).where("key IS NOT NULL")
    return (
        stored_keys.select("key", F.lit(-1).cast("long").alias("at")).unionByName(held)
        .groupBy("key").agg(F.min("at").alias(name))
    )


def decide(candidates: DataFrame, stored: DataFrame, cfg: Config) -> DataFrame:
    """Every candidate with one ``reason``: why it was kept or turned away.

    A key counts as taken if it is stored or an earlier row that was kept
    holds it. Rows after the cap was reached were never looked at.
    """
    scratch = Scratch(candidates.sparkSession, "decide")
    marks = _marked(candidates, cfg, scratch)
    verdicts = _verdicts(candidates, cfg, scratch, marks)
    kept = verdicts.join(
        scratch.save(_kept(verdicts, stored, cfg.max_rows).select(ARRIVAL), "kept"), ARRIVAL, "left_semi")
    own = F.concat(F.lit("\0"), F.col(ARRIVAL))
    by_url = _first_holder(
        seen_urls(stored).withColumnRenamed("url_key", "key"), kept, url_key(F.col("url")), "url_at"
    )
    by_sig = _first_holder(
        seen_signatures(stored).select(F.struct("title", "company").alias("key")),
        kept, ingest_sig(F.col("title"), F.col("company")), "sig_at",
    )
    df = (
        verdicts.withColumn("_u", F.coalesce(url_key(F.col("url")), own))
        .join(by_url.withColumnRenamed("key", "_u"), "_u", "left")
        .withColumn("_s", ingest_sig(F.col("title"), F.col("company")))
        .join(by_sig.withColumnRenamed("key", "_s"), "_s", "left")
    )
    taken_url = F.coalesce(F.col("url_at") < F.col(ARRIVAL), F.lit(False))
    taken_sig = F.coalesce(F.col("sig_at") < F.col(ARRIVAL), F.lit(False))
    late = F.lit(False)
    if cfg.max_rows is not None:
        full = kept.agg(
            F.when(F.count(F.lit(1)) >= cfg.max_rows, F.max(ARRIVAL)).otherwise(2**63 - 1)
        ).scalar()
        late = F.col(ARRIVAL) > full
    no_title = is_missing(F.col("title"))
    bad, skip = F.col("tier") == gates.REJECT, F.col("tier") == gates.SKIP
    # layout B tests in another order than A and all others, which shows in the reason only
    reason_a = (
        F.when(taken_url, "duplicate_url").when(no_title, "missing_title")
        .when(bad, "bad_keyword").when(skip, "irrelevant_title")
        .when(F.col("missing").isNotNull(), F.col("missing"))
        .when(taken_sig, "duplicate_signature")
    )
    reason_b = (
        F.when(no_title, "missing_title").when(taken_url, "duplicate_url")
        .when(F.col("missing").isNotNull(), F.col("missing"))
        .when(taken_sig, "duplicate_signature")
        .when(bad, "bad_keyword").when(skip, "irrelevant_title")
    )
    is_b = F.coalesce(F.col("layout") == "B", F.lit(False))
    reason = (
        F.when(late, "not_reached")
        .when(is_b & reason_b.isNotNull(), reason_b)
        .when(~is_b & reason_a.isNotNull(), reason_a)
        .when(~F.col("passes"), "no_tech_keyword")
        .otherwise("kept")
    )
    found = df.select(ARRIVAL, "tier", reason.alias("reason"))
    shown = screen(candidates, cfg, marks).drop("tier") if marks is not None else candidates
    others = [c for c in candidates.columns if c not in ("tier", "reason")]
    return shown.select(*others).join(found, ARRIVAL).select(*others, "tier", "reason")


def ingest(store: PostingStore, candidates: DataFrame, cfg: Config, batch: int | None = None,
           infer: Infer | None = None, writer: str = DEFAULT_WRITER, model: str | None = None) -> int:
    """Append what a run accepts; with the name of a ``model``, its outputs are kept beside the store and asked for once. Repeating a batch number adds nothing new:
    all rows but the writer's own from that number on count as stored, and the batch replaces itself."""
    new = accepted(candidates, partial(store.met, before_batch=batch, writer=writer), cfg)
    if infer is not None:
        new = summarize(new, infer, outputs=store.outputs(model))
    return store.append(new, batch, writer)


def ingest_part(store: PostingStore, candidates: DataFrame, cfg: Config, batch: int, infer: Infer | None = None,
                writer: str = DEFAULT_WRITER, model: str | None = None) -> None:
    """Append one part of a run that comes in several: the parts together accept what the whole run would.

    What the run has to know of its earlier parts is kept beside the batches, under the same
    writer and number: the last description of each session, and how many rows were admitted. Only
    notes of smaller numbers are read, so a part that is repeated decides as before.
    """
    memory, scratch = store.memory(batch, writer), Scratch(candidates.sparkSession, "part")
    before = store.admitted(batch, writer) if cfg.max_rows is not None else 0
    if cfg.max_rows is not None:
        cfg = replace(cfg, max_rows=max(0, cfg.max_rows - before))
    marks = _marked(candidates, cfg, scratch, memory)
    new = accepted(candidates, partial(store.met, before_batch=batch, writer=writer), cfg, marks)
    if infer is not None:
        new = summarize(new, infer, outputs=store.outputs(model))
    store.append(new, batch, writer)
    if marks is not None:
        store.remember(next_memory(marks, cfg, memory), marks, batch, writer)
    if cfg.max_rows is not None:
        store.note_admitted(before + store.rows_of(batch, writer), batch, writer)
