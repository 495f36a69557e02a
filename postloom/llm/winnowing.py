"""Benchmark decontamination by winnowing.

Of every ``w`` neighbouring k-grams of words the one of smallest hash is kept as
a fingerprint (Schleimer, Wilkerson, Aiken 2003). Equal runs of ``w + k - 1``
words keep the same fingerprint in both texts, so a shared window of ``span``
words is found for sure with ``k + w - 1 = span``. Fingerprints of documents and
benchmark items are joined; in the documents that share some, every window that kept a shared
fingerprint is extended to its whole span, first by hash and then word by word.
Only equal words count then, so the result is exact.

Three passes over the documents, whatever lengths the items have: fingerprints of all spans (values
only), the windows in the few documents that share one, and the word counts of all. The items'
windows are a written table, so the planner broadcasts it only if its
measured size allows that, and else shuffles both sides. Nothing is grouped by
fingerprint. A document's words are in one row a pass, never in a row for each item it
meets, and its windows are bounded by its words.

Everything is DataFrame functions.

Input rules: null or wordless texts share nothing; an item of fewer than
``SPAN`` words is one window of its own length; items of one id are one item,
a null id reads as the empty string; rows with equal id and text have equal results, one
each; other columns are ignored; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import same_row
from postloom.scratch import Scratch

#: Words of a window, and the share of hit words (1 in 20) that contaminates.
SPAN, SHARE = 13, 20
#: Words of a k-gram where the window is long enough.
GRAM = 5
#: A list of contaminated rows up to this long (16 bytes each) is broadcast, with a longer one the texts are shuffled.
BROADCAST_KEYS = 500_000
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column, exact: bool) -> Column:
    """The words of a text; ``exact`` lower-cases A-Z, else words keep their case."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER) if exact else text, _SEPARATORS), "")


def word_hashes(words_column: Column) -> Column:
    """Hashes that agree wherever the exact words agree: full lower-casing is the cheaper, coarser test."""
    return F.transform(words_column, lambda w: F.xxhash64(F.lower(w)))


def _shape(span: int) -> tuple[int, int]:
    k = min(GRAM, span)
    return k, span - k + 1


def _grams(hashes: Column, k: int) -> Column:
    return F.when(F.size(hashes) >= k, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(hashes) - k, F.lit(0))),
        lambda i: F.xxhash64(*[hashes[i + j] for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column, w: int) -> Column:
    n = F.size(grams)
    return F.when(n >= w, F.transform(
        F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: F.array_min(F.slice(grams, i, w))))


def _minima_of(rows: DataFrame, spans: Iterable[int], *keep: str) -> tuple[DataFrame, list[tuple[int, Column]]]:
    """Rows with the array ``h`` of word hashes turned into k-grams once, and for each span its windows' minima."""
    shapes = {span: _shape(span) for span in spans}
    grams = rows.select(*keep, *[_grams(F.col("h"), k).alias(f"g{k}") for k in sorted({k for k, _ in shapes.values()})])
    return grams, [(span, F.coalesce(_minima(F.col(f"g{k}"), w), F.array().cast("array<bigint>")))
                   for span, (k, w) in shapes.items()]


def _mark(span: int, least: Column) -> Column:
    """A fingerprint of a span; those of other spans do not meet it."""
    return F.xxhash64(F.lit(span), least)


def _marking(span: int) -> Callable[[Column], Column]:
    return lambda least: _mark(span, least)


def fingerprints(rows: DataFrame, spans: int | Iterable[int], *keys: str, positions: bool) -> DataFrame:
    """``(keys, fp)`` of rows with the array ``h`` of word hashes, for all spans at once.

    With ``positions``, ``(keys, span, start, fp, whole)`` of every window, with its first word's place and the
    hash of its words, which are in the array ``w``.
    """
    spans = [spans] if isinstance(spans, int) else spans
    if not positions:
        grams, minima = _minima_of(rows, spans, *keys)
        marks = [F.transform(F.array_distinct(least), _marking(span)) for span, least in minima]
        return grams.select(*keys, F.explode(F.concat(*marks)).alias("fp"))
    grams, minima = _minima_of(rows, spans, *keys, "w")
    every = [F.transform(least, _window_of(span)) for span, least in minima]
    return grams.select(*keys, F.explode(F.concat(*every)).alias("m")).select(*keys, "m.*")


def _window_of(span: int) -> Callable[[Column, Column], Column]:
    return lambda least, i: F.struct(
        F.lit(span).alias("span"), i.alias("start"), _mark(span, least).alias("fp"),
        F.xxhash64(F.slice("w", i + 1, span)).alias("whole"))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _spelled(start: Column, span: Column) -> Column:
    """The words of a window of ``w``, which hold no blanks, as one string."""
    return F.array_join(F.slice("w", start + 1, span), " ")


def _hashed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "w", word_hashes(F.col("w")).alias("h"))


def hits(docs: DataFrame, items: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id, th, item, span, start)``: every window of an item in a document, by its first word; ``th`` is the text's hash."""
    spark = docs.sparkSession
    own = _documents(docs, id_col, text_col)
    known = scratch.save(
        items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                     words(F.col(item_text), exact=True).alias("w"))
        .where(F.size("w") > 0).distinct()
        .withColumn("own", F.least(F.size("w"), F.lit(SPAN)))
        .withColumn("row", F.monotonically_increasing_id()), "items")
    spans = sorted(r[0] for r in known.select("own").distinct().collect())  # 1 to SPAN
    if not spans:
        return spark.createDataFrame([], "id long, th long, item string, span int, start int").withColumn(
            "id", F.col("id").cast(dict(own.dtypes)["id"]))
    # an item has windows of its own span only
    placed = None
    for span in spans:
        part = fingerprints(_hashed(known.where(F.col("own") == span), "row"), [span], "row", positions=True)
        placed = part if placed is None else placed.unionByName(part)
    placed = scratch.save(placed.join(known, "row").select(
        "item", "span", "fp", "whole", _spelled(F.col("start"), F.col("span")).alias("spelled")).distinct(), "item-windows")
    hashed = own.select("id", "th", word_hashes(words(F.col("text"), exact=False)).alias("h"))
    met = scratch.save(fingerprints(hashed, spans, "id", "th", positions=False).join(
        placed.select("fp").distinct(), "fp", "left_semi").select("id", "th").distinct(), "met")
    near = scratch.save(own.join(met, same_row(own, met, "id", "th"), "left_semi").distinct().select(
        "id", "th", words(F.col("text"), exact=True).alias("w")), "near")
    # a shared fingerprint is extended to its windows by hash, on rows without words
    alike = fingerprints(_hashed(near, "id", "th"), spans, "id", "th", positions=True).join(
        placed.select("fp", "whole").distinct(), ["fp", "whole"], "left_semi").groupBy(F.col("id").alias("did"), F.col("th").alias("dth")).agg(
        F.collect_set(F.struct("span", "start", "whole")).alias("places"))
    spelled = near.join(alike, F.col("id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth"))).select(
        "id", "th", F.explode(F.transform("places", lambda p: F.struct(
            p["span"].alias("span"), p["start"].alias("start"), p["whole"].alias("whole"),
            _spelled(p["start"], p["span"]).alias("spelled")))).alias("p")).select("id", "th", "p.*")
    return spelled.join(
        placed.select("item", "span", "whole", "spelled"), ["span", "whole", "spelled"]).select(
        "id", "th", "item", "span", "start").distinct()


def _covered(starts: Column) -> Column:
    """How many words lie in the windows (start, span), sorted by start."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["start"] + x["span"] - F.greatest(acc["end"], x["start"]))).alias("n"),
        F.greatest(acc["end"], x["start"] + x["span"]).alias("end"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id",
                  text_col: str = "text", **names: str) -> DataFrame:
    """``(id, th, n_words, n_hit, items, contaminated)`` of every document; ``items`` are sorted strings."""
    scratch = scratch or Scratch(docs.sparkSession, "winnowing")
    found = scratch.save(hits(docs, items, scratch, id_col, text_col, **names), "hits")
    per = found.groupBy("id", "th").agg(
        F.sort_array(F.collect_set("item")).alias("items"),
        F.sort_array(F.collect_set(F.struct("start", "span"))).alias("starts")
    ).select(F.col("id").alias("hid"), F.col("th").alias("hth"), "items", _covered(F.col("starts")).cast("long").alias("n_hit"))
    counted = _documents(docs, id_col, text_col).select(
        "id", "th", F.size(words(F.col("text"), exact=False)).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(per, counted["id"].eqNullSafe(per["hid"]) & (counted["th"] == per["hth"]), "left").select(
        "id", "th", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id",
          text_col: str = "text", **names: str) -> DataFrame:
    """The documents that are not contaminated, as they are; the list of the others is written and counted, so no text is shuffled for it."""
    scratch = scratch or Scratch(docs.sparkSession, "winnowing")
    bad = scratch.save(
        contamination(docs, items, scratch, id_col, text_col, **names).where("contaminated").select("id", "th").distinct(), "bad")
    return docs.join(
        F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad, docs[id_col].eqNullSafe(bad["id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["th"]), "left_anti")
