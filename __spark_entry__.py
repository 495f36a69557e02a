"""Queries over the driver's tables, each with the SQL that must agree with it.

The tables hold no job postings, so ``postings`` below derives them: every
document is a posting whose title is its first clause. The ``clause_`` queries
read whole texts: every clause is a posting. Keyword lists and role
rules are parameters, so the queries pass some that occur in these texts.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postloom.config import Config, Element, Layout, LAYOUT_A, LAYOUT_B  # noqa: E402
from postloom.functions.fields import canonical_url, fill_salary, join_quals, pay_statement  # noqa: E402
from postloom.functions.text import first_non_blank  # noqa: E402
from postloom.functions.titles import fix_doubled, role_pattern, sanitize_title  # noqa: E402
from postloom.operators import chunks, dedup, features, gates, liveness, matching, reports  # noqa: E402
from postloom.operators import clusters as linkage  # noqa: E402
from postloom.operators import similarity  # noqa: E402
from postloom.operators.components import components  # noqa: E402
from postloom.plans import clean, collect, titles  # noqa: E402
from postloom.scratch import Scratch  # noqa: E402
from postloom.sources import postings as source  # noqa: E402
from postloom.sources.pages import decode_entities, extract_postings  # noqa: E402
from postloom.sources.store import PostingStore  # noqa: E402
from postloom.streaming.ingest import ingest_stream  # noqa: E402

# ---------------------------------------------------------------- parameters

CFG = Config(
    bad=("ist",), strong=("the ",), ambiguous=("that", "er "), tech=("tion",), max_rows=None,
    dead_phrases=("that the",), redirect_marks=("example.net", "/en/"), redirect_target="#top",
)
ROLES = (
    ("Of The", r"\bthe\b.*\bof\b"),
    ("The", role_pattern("the", "thé")),
    ("Le", role_pattern("le", "la", "les")),
    ("Der", role_pattern("der", "die", "und")),
)
TITLE = r"^[^.,|\n]*"
CLAUSE_END = r"[.,|\n]"
CAP = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_postings(docs: DataFrame) -> DataFrame:
    source_no = F.col("source")
    return docs.select(
        F.col("doc_id").alias("arrival"),
        F.when(source_no.isin("src0", "src1", "src2", "src3", "src4"), "A").otherwise("B").alias("layout"),
        F.regexp_extract("text", TITLE, 0).alias("title"),
        F.when(source_no == "src7", F.lit(None)).when(source_no == "src13", "")
        .otherwise(F.concat(F.lit("https://jobs.test/job/"), F.expr("CAST(doc_id * 7 DIV 10 AS STRING)")))
        .alias("url"),
        F.when(source_no == "src11", "N/A").otherwise(F.col("lang")).alias("company"),
        F.col("text").alias("description"),
        F.when(source_no == "src5", " ").otherwise(F.concat(F.lit("$"), F.col("n_chars").cast("string")))
        .alias("salary"),
        F.lit(None).cast("string").alias("qualifications"),
        F.concat(
            F.lit("2024-01-"), F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0"), F.lit(" 00:00:00")
        ).alias("scraped_at"),
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_postings(_table(spark, sf_dir, "documents"))


def clause_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause of every text as a posting, in the order of documents and places."""
    arrival = F.when(F.col("doc_id").between(0, (1 << 31) - 1), F.shiftleft("doc_id", 32) + F.col("place")).otherwise(
        F.raise_error(F.lit("doc_id leaves no room for the place of a clause")).cast("long"))
    clauses = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", CLAUSE_END, -1)).alias("place", "title"))
    return clauses.select(arrival.alias("arrival"), "title")


def _stored_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents play the stored postings, the others the new ones."""
    labelled = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("arrival")).distinct()
    rows = postings(spark, sf_dir)
    return rows.join(labelled, "arrival", "left_semi"), rows.join(labelled, "arrival", "left_anti")


def _text_length(df: DataFrame, column: str = "description") -> DataFrame:
    """Long texts compare by length and digest, the rest as they are."""
    return df.withColumn("n_text", F.length(column)).withColumn("digest", F.md5(column)).drop(column)


# ------------------------------------------------------------------- queries

def q_role_counts(spark, sf_dir):
    return titles.role_counts(postings(spark, sf_dir), ROLES)


def q_normalized_titles(spark, sf_dir):
    return titles.titled(postings(spark, sf_dir), ROLES).select("arrival", "title_norm", "title_updated")


def q_title_repair(spark, sf_dir):
    t = F.col("title")
    written = F.when(F.col("company") == "en", F.concat(t, F.lit("  "), t)).when(
        F.col("company") == "fr", F.concat(t, t)).otherwise(t)
    return postings(spark, sf_dir).select("arrival", fix_doubled(written).alias("fixed"))


def q_title_sanitize(spark, sf_dir):
    t = F.col("title")
    written = (
        F.when(F.col("company") == "en", F.concat(F.lower(t), F.lit(" WITH verification "), t))
        .when(F.col("company") == "fr", F.concat(t, F.lower(t), F.lit(" (M/F/D)")))
        .otherwise(F.concat(t, F.lit(" - Jobs")))
    )
    return postings(spark, sf_dir).select("arrival", sanitize_title(written).alias("clean"))


def q_salary_spans(spark, sf_dir):
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    size = F.col("p_size").cast("string")
    written = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Pay $"), price, F.lit(" per hour")))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("ca$"), size, F.lit("K - C$"), price, F.lit("/Year")))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("$ "), size, F.lit(",000 to "), size, F.lit(",500 a year")))
        .when(F.col("p_type") == "STANDARD", F.concat(F.lit("USD "), price))
        .otherwise(F.concat(F.lit("  $"), size, F.lit("\n000 mo")))
    )
    return _table(spark, sf_dir, "part").select("p_partkey", pay_statement(written).alias("salary"))


def q_salary_filled(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", fill_salary(F.col("salary")).alias("salary"))


def q_quals_joined(spark, sf_dir):
    lines = postings(spark, sf_dir).select(
        "arrival", join_quals(F.split("description", "\n")).alias("quals"))
    return _text_length(lines, "quals")


def q_missing_report(spark, sf_dir):
    return source.missing_report(postings(spark, sf_dir))


def q_schema_conform(spark, sf_dir):
    df = source.conform(postings(spark, sf_dir).drop("qualifications").select("*", F.lit(1).alias("extra")))
    return _text_length(df)


def q_first_non_blank(spark, sf_dir):
    return postings(spark, sf_dir).select(
        "arrival", first_non_blank(F.col("url"), F.col("salary"), F.col("company")).alias("picked"))


def q_seen_urls(spark, sf_dir):
    return source.seen_urls(postings(spark, sf_dir))


def q_seen_signatures(spark, sf_dir):
    return source.seen_signatures(postings(spark, sf_dir))


def q_csv_postings(spark, sf_dir):
    scratch = Scratch(spark, "csv")
    path = f"{scratch.root}/postings"
    postings(spark, sf_dir).drop("arrival", "qualifications").write.option("header", True).option(
        "escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return _text_length(source.read_postings(spark, path).drop("arrival"))


def q_title_tiers(spark, sf_dir):
    return postings(spark, sf_dir).select("arrival", gates.title_tier(F.col("title"), CFG).alias("tier"))


def q_required_fields(spark, sf_dir):
    return gates.gate_required(postings(spark, sf_dir), CFG).select("arrival", "layout")


def q_accepted_postings(spark, sf_dir):
    return postings(spark, sf_dir).where(
        gates.accept(gates.title_tier(F.col("title"), CFG), F.col("description"), CFG)
    ).select("arrival", "title")


def q_decisions(spark, sf_dir):
    stored, new = _stored_and_new(spark, sf_dir)
    return collect.decide(new, stored, CFG).select("arrival", "tier", "reason")


def q_decision_funnel(spark, sf_dir):
    stored, new = _stored_and_new(spark, sf_dir)
    return gates.funnel(collect.decide(new, stored, CFG), "layout")


def q_decision_log(spark, sf_dir):
    df = postings(spark, sf_dir).withColumn("reason", gates.title_tier(F.col("title"), CFG))
    return gates.decision_log(df)


def q_capped_postings(spark, sf_dir):
    rows = gates.gate_required(postings(spark, sf_dir), CFG)
    return gates.cap(rows, CAP, "layout", "arrival").select("layout", "arrival", "title")


def _event_texts(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("arrival"), "user_id",
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("description"))


def q_stale_blanked_a(spark, sf_dir):
    return matching.blank_stale(_event_texts(spark, sf_dir), "user_id", "A")


def q_stale_blanked_b(spark, sf_dir):
    return matching.blank_stale(_event_texts(spark, sf_dir), "user_id", "B")


def q_unseen_postings(spark, sf_dir):
    stored, new = _stored_and_new(spark, sf_dir)
    return dedup.drop_seen(new, stored).select("arrival", "title", "url", "company")


def q_greedy_dedup(spark, sf_dir):
    return dedup.greedy_dedup(postings(spark, sf_dir)).select("arrival", "title", "url", "company")


def q_batch_dedup(spark, sf_dir):
    return dedup.dedup_batch(postings(spark, sf_dir)).select("arrival", "title", "url", "company", "scraped_at")


def q_batch_dedup_keep_blank(spark, sf_dir):
    return dedup.dedup_batch(postings(spark, sf_dir), blank_url="keep").select("arrival", "title", "url")


def q_dedup_report(spark, sf_dir):
    rows = postings(spark, sf_dir)
    return liveness.dedup_report(rows, dedup.dedup_batch(rows, ordered=False))


NAV = Layout(name="A", cards=(Element("li"),), titles=(Element("a"),), links=(Element("a"),),
             base_url="https://jobs.test")


def q_page_links(spark, sf_dir):
    return extract_postings(_table(spark, sf_dir, "pages"), NAV).drop("company")


def _result_pages(spark, sf_dir, layout):
    """One result page per document, written with the markup of a layout."""
    rows = postings(spark, sf_dir)
    t = F.coalesce("title", F.lit(""))
    href = F.concat(F.lit("/job/"), F.col("arrival").cast("string"), F.lit("?x=1&amp;y=2"))
    if layout == "A":
        html = F.concat(
            F.lit('<ul id="job-list"><div class="card SerpJob-x"><a href="/first">x</a><h2>'
                  '<a class="css-1 jobTitle" href="'), href, F.lit('"><b> '), t, F.lit("</b> <i>R&amp;D</i></a></h2>"
                  '<span data-testid="companyName"> '), F.col("company"), F.lit(
                  ' </span></div><div class="SerpJob"><a href=\'https://abs.test/j?q=1\'>Plain'
                  "</a></div></ul>"))
    else:
        html = F.concat(
            F.lit('<ul><li class="job-card-container x"><a class="y job-card-container__link" href="'
                  'https://jobs.test'), href, F.lit('"><span> '), t, F.lit(
                  "</span><span>R&amp;D</span></a></li><li class='job-card-container'>none</li></ul>"))
    return rows.select(F.col("arrival").alias("page_id"), html.alias("html"))


def q_cards_layout_a(spark, sf_dir):
    return extract_postings(_result_pages(spark, sf_dir, "A"), LAYOUT_A)


def q_cards_layout_b(spark, sf_dir):
    return extract_postings(_result_pages(spark, sf_dir, "B"), LAYOUT_B).drop("company")


def _captured(spark, sf_dir, layout):
    """Result pages of a layout and the details behind their first cards, some of another card, some without a box for pay."""
    rows = postings(spark, sf_dir)
    kind, n = F.col("arrival") % 5, F.col("arrival").cast("string")
    details = rows.select(
        F.shiftleft("arrival", collect.PAGE_BITS).alias("card_id"),
        F.when(kind == 1, "zz").when(kind == 2, " ").otherwise(F.concat(F.lit(" "), F.col("title"), F.lit(" R&D"))).alias("title"),
        F.when(kind == 3, None).when(kind == 4, "another").otherwise(F.concat("company", F.lit(" inc"))).alias("company"),
        "description",
        F.when(kind == 0, F.concat(F.lit("Pay $"), n, F.lit(" per hour"))).when(kind == 1, "none given").alias("compensation"),
        F.concat(F.lit("earn $"), (F.col("arrival") % 900).cast("string"), F.lit(",000 a year")).alias("body"),
        F.array(F.lit(" a "), F.lit("  "), "company").alias("qualifications"))
    pages = _result_pages(spark, sf_dir, layout.name).withColumn("page_num", (F.col("page_id") % 4 + 1).cast("int"))
    return _text_length(collect.capture(pages, details, layout).drop("scraped_at"))


def q_captured_a(spark, sf_dir):
    return _captured(spark, sf_dir, LAYOUT_A)


def q_captured_b(spark, sf_dir):
    return _captured(spark, sf_dir, LAYOUT_B)


def q_captured_pages_limited(spark, sf_dir):
    """The candidates of the first two result pages per keyword."""
    limited = gates.page_limit(_captured(spark, sf_dir, LAYOUT_A), replace(CFG, max_pages=2))
    return limited.select("arrival", "page_num", "title")


def q_canonical_urls(spark, sf_dir):
    href = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", canonical_url(href, "https://jobs.test", "A").alias("url_a"),
        canonical_url(href, "https://jobs.test", "B").alias("url_b"),
        canonical_url(F.substring_index(href, "//", -1), "https://jobs.test/", "A").alias("completed"))


def _page_fields(spark, sf_dir):
    def inner(tag):
        return decode_entities(F.regexp_extract("html", f"(?s)<{tag}>(.*?)</{tag}>", 1))
    return _table(spark, sf_dir, "pages").select(
        "page_id", "url", inner("title").alias("head"), inner("h1").alias("h1"),
        F.regexp_extract("html", r'<html lang="([a-z]*)"', 1).alias("lang"), "html")


def _cards_and_details(spark, sf_dir):
    p = _page_fields(spark, sf_dir)
    cards = p.select(F.col("page_id").alias("card_id"), F.col("head").alias("title"), F.col("lang").alias("company"))
    # some details agree, some are blank, some are those of another card
    other = F.col("page_id") % 5
    details = p.select(
        F.col("page_id").alias("card_id"),
        F.when(other == 1, F.concat(F.lit("zz "), F.reverse("h1"))).when(other == 2, " ").otherwise(F.col("h1")).alias("title"),
        F.when(other == 3, "zz").when(F.col("url").contains("https") & (other != 1), F.col("lang")).otherwise("").alias("company"))
    return cards, details


def q_card_detail_match_a(spark, sf_dir):
    return matching.match_details(*_cards_and_details(spark, sf_dir), "A")


def q_card_detail_match_b(spark, sf_dir):
    return matching.match_details(*_cards_and_details(spark, sf_dir), "B")


def _verified(spark, sf_dir):
    p = _page_fields(spark, sf_dir)
    rows = p.select(
        F.col("page_id").alias("arrival"),
        F.when(F.col("lang") == "es", F.concat("h1", F.lit(" x"))).when(F.col("lang") == "fr", F.concat(
            "h1", F.lit(" "), "h1")).otherwise(F.col("h1")).alias("title"),
        F.when(F.col("url").contains("m."), F.substring_index("url", "//", -1)).otherwise(F.col("url")).alias("url"))
    snaps = p.select(
        "url", F.col("url").alias("final_url"),
        decode_entities(F.regexp_replace("html", "(?s)<[^>]*>", " ")).alias("body_text"),
        (F.col("lang") != "de").alias("ok"))
    return liveness.classify_liveness(rows, snaps, CFG)


def q_liveness(spark, sf_dir):
    return _verified(spark, sf_dir).select("arrival", "reason", "is_valid")


def q_clean_report(spark, sf_dir):
    return liveness.clean_report(_verified(spark, sf_dir))


def q_verified_store(spark, sf_dir):
    """The stored rows left after verification, read from the new version."""
    store = PostingStore(spark, f"{Scratch(spark, 'store').root}/postings")
    rows = _page_fields(spark, sf_dir).select(
        F.col("page_id").alias("arrival"), F.col("h1").alias("title"), "url")
    store.append(rows)
    snaps = _page_fields(spark, sf_dir).select(
        "url", F.col("url").alias("final_url"), F.lower("h1").alias("body_text"), F.lit(True).alias("ok"))
    clean.verify_store(store, snaps, CFG)
    return store.read().select("arrival", "title", "url", "company")


def q_desc_chunks(spark, sf_dir):
    return _text_length(chunks.chunk_descriptions(postings(spark, sf_dir)), "chunk")


def _last_words(prompts):
    return prompts.map(lambda p: " ".join(p.split()[-5:]))


def q_summary_regroup(spark, sf_dir):
    df = chunks.summarize(postings(spark, sf_dir), _last_words)
    return _text_length(df.select("arrival", "description", "salary"))


def q_summary_resumed(spark, sf_dir):
    """Summaries of all documents after a run over the labelled ones, whose outputs are kept."""
    folder = f"{Scratch(spark, 'outputs').root}/model=last-words"
    chunks.summarize(_stored_and_new(spark, sf_dir)[0], _last_words, outputs=folder)
    df = chunks.summarize(postings(spark, sf_dir), _last_words, outputs=folder)
    return _text_length(df.select("arrival", "description", "salary"))


def _distinct(spark, sf_dir, source_rows=postings):
    rows = features.distinct_titles(titles.titled(source_rows(spark, sf_dir)))
    return Scratch(spark, "titles").save(rows, "titles")


def _rounded(df):
    """Weights, which are not below 0, of six digits, rounded in binary as DuckDB does; Spark's round writes and reads each number as text."""
    return df.withColumn("weight", F.floor(F.col("weight") * 1e6 + 0.5) / 1e6)


def q_tfidf_word(spark, sf_dir):
    return _rounded(features.tfidf_word(_distinct(spark, sf_dir)).drop("block"))


def q_tfidf_char(spark, sf_dir):
    return _rounded(features.tfidf_char(_distinct(spark, sf_dir)).drop("block"))


def q_tfidf_union(spark, sf_dir):
    return _rounded(features.union_features(features.vectors(_distinct(spark, sf_dir))))


def _pairs(spark, sf_dir, scratch, source_rows=postings):
    vectors, _ = similarity.title_vectors(_distinct(spark, sf_dir, source_rows), scratch)
    return similarity.similar_pairs(vectors, 0.55, scratch)


def q_similar_titles(spark, sf_dir):
    return _pairs(spark, sf_dir, Scratch(spark, "similar")).withColumn("sim", F.round("sim", 6))


def q_title_components(spark, sf_dir):
    return components(_pairs(spark, sf_dir, Scratch(spark, "similar")))


def q_title_clusters(spark, sf_dir):
    rows = titles.titled(postings(spark, sf_dir))
    return linkage.assign(rows, linkage.cluster_titles(rows)).select("arrival", "title_updated", "cluster_id")


def q_title_cluster_sizes(spark, sf_dir):
    return reports.cluster_sizes(titles.clustered(postings(spark, sf_dir)), 25)


def q_clause_role_counts(spark, sf_dir):
    return titles.role_counts(clause_postings(spark, sf_dir), ROLES)


def q_clause_tfidf_word(spark, sf_dir):
    return _rounded(features.tfidf_word(_distinct(spark, sf_dir, clause_postings)).drop("block"))


def q_clause_tfidf_char(spark, sf_dir):
    return _rounded(features.tfidf_char(_distinct(spark, sf_dir, clause_postings)).drop("block"))


def q_clause_tfidf_union(spark, sf_dir):
    return _rounded(features.union_features(features.vectors(_distinct(spark, sf_dir, clause_postings))))


def q_clause_similar_titles(spark, sf_dir):
    return _pairs(spark, sf_dir, Scratch(spark, "similar"), clause_postings).withColumn("sim", F.round("sim", 6))


def q_clause_title_components(spark, sf_dir):
    return components(_pairs(spark, sf_dir, Scratch(spark, "similar"), clause_postings))


def q_clause_title_clusters(spark, sf_dir):
    rows = titles.titled(clause_postings(spark, sf_dir))
    return linkage.assign(rows, linkage.cluster_titles(rows)).select("arrival", "title_updated", "cluster_id")


def q_clause_title_cluster_sizes(spark, sf_dir):
    return reports.cluster_sizes(titles.clustered(clause_postings(spark, sf_dir)), 25)


def _given_clusters(spark, sf_dir):
    """The document's source as a given cluster."""
    return _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("arrival"), F.regexp_extract("text", TITLE, 0).alias("title"),
        F.regexp_extract("source", r"\d+", 0).cast("long").alias("cluster_id"), F.col("lang").alias("company"))


def q_cluster_sizes(spark, sf_dir):
    return reports.cluster_sizes(_given_clusters(spark, sf_dir), 15)


def q_cluster_top_titles(spark, sf_dir):
    return reports.top_titles(_given_clusters(spark, sf_dir), 15)


def q_outside_top(spark, sf_dir):
    return reports.outside_summary(_given_clusters(spark, sf_dir), 15)


def q_outside_top_titles(spark, sf_dir):
    return reports.top_titles(reports.outside_top(_given_clusters(spark, sf_dir), 15), 15)


def q_cluster_members(spark, sf_dir):
    return reports.cluster_members(_given_clusters(spark, sf_dir), 3)


def q_preview(spark, sf_dir):
    return reports.preview(titles.titled(postings(spark, sf_dir), ROLES), ["title", "title_updated"], 20)


def q_ingest_batches(spark, sf_dir):
    """Three appends in arrival order; the last one is repeated."""
    store = PostingStore(spark, f"{Scratch(spark, 'store').root}/postings")
    rows = postings(spark, sf_dir)
    third = rows.agg(F.max("arrival")).first()[0] // 3 + 1
    for batch in (0, 1, 2, 2):
        part = rows.where((F.col("arrival") >= batch * third) & (F.col("arrival") < (batch + 1) * third))
        collect.ingest(store, part, CFG, batch)
    return store.read().select("arrival", "title", "url", "company", "scraped_at")


def _streamed(spark, sf_dir, as_postings, cfg, first=1):
    """Four quarters of the documents: those before ``first`` by a batch ingest, the others arrive one by one in a stream."""
    scratch = Scratch(spark, "stream")
    store = PostingStore(spark, f"{scratch.root}/postings")
    docs = _table(spark, sf_dir, "documents")
    quarter = (docs.agg(F.max("doc_id")).first()[0] or 0) // 4 + 1
    place = F.coalesce(F.expr(f"doc_id DIV {quarter}"), F.lit(0))
    if first:
        collect.ingest(store, as_postings(docs.where(place < first)), cfg)
    for k in range(first, 4):
        docs.where(place == k).write.mode("append").parquet(f"{scratch.root}/arrived")
        stream = spark.readStream.schema(docs.schema).parquet(f"{scratch.root}/arrived")
        ingest_stream(as_postings(stream), store, cfg, f"{scratch.root}/checkpoint").awaitTermination()
    return store.read()


def q_ingest_stream(spark, sf_dir):
    """A batch ingest of the first quarter, then a stream to which the other quarters arrive one by one."""
    return _streamed(spark, sf_dir, _as_postings, CFG).select("arrival", "title", "url", "company", "scraped_at")


def _with_sessions(docs):
    """Postings with sessions in which descriptions repeat: a third say one thing, a third another."""
    kind = F.expr("CAST(substr(salary, 2) AS BIGINT) % 3")
    return _as_postings(docs).withColumns({
        "session": F.when(F.col("layout") == "A", F.col("company")).otherwise(F.lit("all")),
        "description": F.when(F.col("salary") == " ", "others").when(kind == 0, "a notion").when(kind == 1, "others")
        .otherwise(F.col("description"))})


def q_ingest_stream_sessions(spark, sf_dir):
    """Stale descriptions across the borders of four micro-batches."""
    return _text_length(_streamed(spark, sf_dir, _with_sessions, CFG, 0).select("arrival", "title", "url", "company", "description"))


def q_ingest_stream_capped(spark, sf_dir):
    """The same run, ended when it has admitted its number of rows."""
    cfg = replace(CFG, max_rows=CAP)
    return _text_length(_streamed(spark, sf_dir, _with_sessions, cfg, 0).select("arrival", "title", "url", "company", "description"))


def q_cleaned_store(spark, sf_dir):
    store = PostingStore(spark, f"{Scratch(spark, 'store').root}/postings")
    store.append(postings(spark, sf_dir))
    clean.clean_store(store)
    return store.read().select("arrival", "title", "url", "company", "scraped_at")


def entry(spark: SparkSession) -> DataFrame:
    """Postings per canonical role."""
    return q_role_counts(spark, "/root/testdata/sf0.001")


def _training_data():
    """The operators for training data, if their subpackage is there."""
    try:
        import corpus_pipeline
        from postloom.llm import queries as llm
    except ImportError as e:
        if (e.name or "").startswith(("corpus_pipeline", "postloom.llm")):
            return {}, {}  # the subpackage is not there; anything else that is missing is an error
        raise
    found = {**llm.queries(), "pipeline": corpus_pipeline.run}
    sql = {**llm.oracle_sql(), "pipeline": corpus_pipeline.ORACLE_SQL}
    return found, {name: text for name, text in sql.items() if text}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name[2:]: f for name, f in globals().items() if name.startswith("q_")}, **_training_data()[0]}


def oracle_sql() -> dict[str, str]:
    from oracle_queries import SQL

    return {**SQL, **_training_data()[1]}
