"""Duplicate removal: against stored rows, first-wins, and by sort order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.fields import batch_sig, ingest_sig, url_key
from postloom.functions.titles import sanitize_title
from postloom.schema import ARRIVAL
from postloom.scratch import Scratch
from postloom.sources.postings import stored_signatures, stored_urls


#: Rounds of the greedy de-duplication before it follows chains.
PLAIN_ROUNDS = 2


def drop_seen(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New postings whose URL and (title, company) key are not stored yet.

    The store is far larger than a run's postings, so its keys are first cut
    down to those the new rows have; when those are few, the store is only
    scanned, not shuffled. Rows without a URL get a key of their own, which
    matches nothing and spreads them over the join's partitions.
    """
    sig = ingest_sig(F.col("title"), F.col("company"))
    keyed = new.withColumn(
        "_url", F.coalesce(url_key(F.col("url")), F.concat(F.lit("\0"), F.col(ARRIVAL)))
    ).withColumn("_title", sig["title"]).withColumn("_company", sig["company"])
    out = keyed
    for keys, known in (
        (["_url"], stored_urls(stored).toDF("_url")),
        (["_title", "_company"], stored_signatures(stored).toDF("_title", "_company")),
    ):
        met = known.join(keyed.select(*keys), keys, "left_semi").distinct()
        out = out.join(met, keys, "left_anti")
    return out.select(*new.columns)


def greedy_dedup(df: DataFrame) -> DataFrame:
    """Rows that no earlier accepted row shares its URL or (title, company) with."""
    return df.join(greedy_arrivals(df), ARRIVAL, "left_semi")


def greedy_arrivals(df: DataFrame) -> DataFrame:
    """The ``arrival`` of the rows accepted in turn, as a written table.

    Rows are edges between a URL and a (title, company) key; the answer is the
    greedy matching in arrival order. An edge that comes first at both its
    ends is accepted; edges that share an end with an accepted one are
    dropped; repeat until no edge is left. Every round accepts at least the
    first edge left, so this ends, and nothing is capped. After ``PLAIN_ROUNDS`` rounds, which settle
    nearly all rows, long chains of alternating keys are followed by pointer doubling.

    Later copies of the same (URL, key) pair can never be accepted, so only
    the first of each pair takes part: a key that holds a large part of the
    rows is pre-aggregated before its first shuffle. First-at-an-end is again
    an aggregate, never a window over a group.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "greedy")
    sig = ingest_sig(F.col("title"), F.col("company"))
    edges = scratch.save(
        df.select(F.col(ARRIVAL).alias("a"), url_key(F.col("url")).alias("u"), sig.alias("s"))
        .groupBy("u", "s").agg(F.min("a").alias("a")),
        "edges-0",
    )
    n = 0
    while True:
        first_s = edges.groupBy("s").agg(F.min(F.struct("a", "u")).alias("f")).select("s", "f.a", "f.u")
        first_u = edges.where("u IS NOT NULL").groupBy("u").agg(F.min("a").alias("a"))
        accepted = first_s.where("u IS NULL").unionByName(
            first_s.where("u IS NOT NULL").join(first_u, ["u", "a"], "left_semi")).select("s", "a", "u")
        if n >= PLAIN_ROUNDS:
            accepted = accepted.unionByName(_along_chains(edges, first_s, first_u, scratch, n))
        accepted = scratch.save(accepted, f"accepted-{n}")
        # a row without a URL must not meet other such rows: give it its own key
        own = F.coalesce(F.col("u"), F.concat(F.lit("\0"), F.col("a")))
        rest = (
            edges.withColumn("k", own)
            .join(accepted.select("s"), "s", "left_anti")
            .join(accepted.where("u IS NOT NULL").select(F.col("u").alias("k")), "k", "left_anti")
            .select("u", "s", "a")
        )
        rest = scratch.save(rest, f"edges-{n + 1}")
        scratch.drop(f"edges-{n}")
        if rest.isEmpty():
            break
        edges, n = rest, n + 1
    return scratch.load("accepted-*", accepted).select(F.col("a").alias(ARRIVAL))


def _along_chains(edges: DataFrame, first_s: DataFrame, first_u: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """Accepted rows ``(s, a, u)`` that follow from a row first at both ends over a chain of single rivals.

    A row that is second at one end and first at the other has one earlier rival: it is accepted if that one is
    not. Pointers to the rival's rival and so on, doubled in every step, lead each such row to the
    first one of its chain; an even number of steps from a row that is first at both ends means accepted.
    """
    # rows without a URL have keys of their own, so they do not meet
    own = F.coalesce(F.col("u"), F.concat(F.lit("\0"), F.col("a")))
    both = edges.withColumn("k", own).join(first_s.select("s", F.col("a").alias("s1")), "s").join(
        first_u.select(F.col("u").alias("k"), F.col("a").alias("u1")), "k", "left").withColumn("u1", F.coalesce("u1", "a"))
    both = scratch.save(both.select("s", "a", "u", "k", "s1", "u1"), f"firsts-{n}")
    second_s = both.where("a > s1").groupBy("s").agg(F.min("a").alias("s2"))
    second_u = both.where("a > u1").groupBy("k").agg(F.min("a").alias("u2"))
    ranked = both.join(second_s, "s", "left").join(second_u, "k", "left")
    rival = F.when((F.col("a") == F.col("u1")) & (F.col("a") == F.col("s2")), F.col("s1")).when(
        (F.col("a") == F.col("s1")) & (F.col("a") == F.col("u2")), F.col("u1"))
    chained = scratch.save(ranked.select("s", "a", "u", rival.alias("to")).where("to IS NOT NULL"), f"chained-{n}")
    links, k = chained.select("a", "to", F.lit(True).alias("odd")), 0
    while True:
        up = links.select(F.col("a").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"))
        links = scratch.save(links.join(up, "to", "left").select(
            "a", F.coalesce("next", "to").alias("to"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"),
            F.col("next").isNotNull().alias("moved")), f"chains-{n}-{k}")
        ended = links.where("moved").isEmpty()
        links, k = links.select("a", "to", "odd"), k + 1
        if ended:
            break
    heads = both.where("a = s1 AND a = u1").select(F.col("a").alias("to"))
    even = links.where("NOT odd").join(heads, "to", "left_semi").select("a")
    return chained.join(even, "a", "left_semi").select("s", "a", "u")


def dedup_batch(df: DataFrame, blank_url: str = "collapse", ordered: bool = True) -> DataFrame:
    """Sanitise titles, keep the best row per signature, then one per URL.

    Best is the shorter URL, then the later ``scraped_at`` (none comes last),
    then the earlier arrival. A missing URL has length 0, so it wins and all
    such rows share one URL key; ``blank_url="keep"`` ranks it last instead
    and exempts it from the URL pass.

    Both passes are aggregates over narrow rows, which combine before the
    shuffle; the chosen arrival numbers then pick the wide rows.
    """
    needed = {
        c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
        for c in ("title", "company", "url")
    }
    clean = df.withColumns(needed).withColumn("title", sanitize_title(F.col("title")))
    clean = clean.withColumn("_sig", batch_sig(F.col("title"), F.col("company")))

    keep_blank = blank_url == "keep"
    length = F.length("url")
    rank = F.when(length > 0, length).otherwise(F.lit(2**31 - 1)) if keep_blank else length
    # The greatest of these wins; a null time is the smallest.
    best = [(-rank).alias("_short")]
    if "scraped_at" in df.columns:
        best.append(F.col("scraped_at").alias("_time"))
    best.append((-F.col(ARRIVAL)).alias("_early"))
    by_sig = (
        clean.groupBy("_sig").agg(F.max(F.struct(*best, F.col("url").alias("_url"))).alias("b"))
        .select("_sig", "b._url", (-F.col("b._early")).alias(ARRIVAL))
    )
    url = F.col("_url")
    if keep_blank:
        url = F.when(F.length("_url") > 0, url).otherwise(F.concat(F.lit("\0"), F.col(ARRIVAL)))
    by_url = (
        by_sig.groupBy(url.alias("_url")).agg(F.min(F.struct("_sig", ARRIVAL)).alias("b"))
        .select(f"b.{ARRIVAL}")
    )
    out = clean.join(by_url, ARRIVAL, "left_semi")
    if ordered:
        out = out.orderBy("_sig")
    return out.drop("_sig")
