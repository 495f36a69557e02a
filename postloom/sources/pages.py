"""Postings from captured result pages.

This is the fixed extraction job over stored HTML, as column expressions: cut
a page into cards, then take the first candidate element that yields text. It
is not a general HTML parser. An element ends at its own closing tag: where tags of its name are
nested in it, a fold over them counts the depth.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.config import ANY, Element, Layout
from postloom.functions.fields import canonical_url
from postloom.functions.text import bind, collapse, first_non_blank, strip
from postloom.functions.titles import fix_doubled


#: Tags that begin no line of their own.
INLINE = r"(?is)</?(?:a|abbr|b|em|i|mark|small|span|strong|sub|sup|u)(?=[\s>/])[^>]*>"


def _tag(el: Element) -> str:
    """Pattern of the opening tag of an element, up to and with ``>``."""
    if el.attr is None:
        return rf"<{el.tag}(?=[\s>/])[^>]*>"
    value = f"\\Q{el.value}\\E"
    if el.match == "equals":
        test = rf"(?:\"{value}\"|'{value}')"
    elif el.match == "word":
        test = rf"(?:\"(?:[^\"]*\s)?{value}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{value}(?:\s[^']*)?')"
    else:
        test = rf"(?:\"[^\"]*{value}[^\"]*\"|'[^']*{value}[^']*')"
    return rf"<{el.tag}(?=\s)[^>]*?\s{el.attr}\s*=\s*{test}[^>]*>"


def decode_entities(c: Column) -> Column:
    """Character references to characters, by a library Spark ships with."""
    return F.java_method(
        F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), c,
    )


def _nesting(name: Column, depth: Column, piece: Column) -> Column:
    """The depth after a piece that begins with an opening or closing tag of a name, or with neither."""
    opens = F.rlike(piece, F.concat(F.lit(r"(?is)^<"), name, F.lit(r"(?=[\s>/])(?![^>]*/>)")))
    closes = F.rlike(piece, F.concat(F.lit(r"(?i)^</"), name, F.lit(r"[\s>]")))
    return depth + F.when(opens, 1).when(closes, -1).otherwise(0)


def _at_tags(html: Column, name: Column) -> Column:
    return F.split(html, F.concat(F.lit(r"(?i)(?=</?"), name, F.lit(r"[\s>/])")))


def _own_end(after: Column, name: Column) -> Column:
    """What follows an opening tag, up to the closing tag that belongs to it."""
    def inside(pieces: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

        def step(acc: Column, piece: Column) -> Column:
            depth = F.when(acc["depth"] > 0, _nesting(name, acc["depth"], piece)).otherwise(0)
            return F.struct(depth.alias("depth"), (acc["n"] + (depth > 0).cast("int")).alias("n"))

        return F.array_join(F.slice(pieces, F.lit(1), F.aggregate(pieces, start, step)["n"]), "")

    return bind(_at_tags(after, name), inside)


def element_inner(html: Column, el: Element) -> Column:
    """What is between the tags of the first such element; empty without one or without its closing tag."""
    if el.within is not None:
        return bind(element_inner(html, el.within), lambda part: element_inner(part, replace(el, within=None)))
    if el.tag != ANY:
        plain, name = F.regexp_extract(html, rf"(?is){_tag(el)}(.*?)</{el.tag}\s*>", 1), F.lit(el.tag)
        nested = plain.rlike(rf"(?i)<{el.tag}[\s>/]")
        return F.when(nested, _own_end(F.regexp_extract(html, rf"(?is){_tag(el)}(.*)\z", 1), name)).otherwise(plain)
    name = F.regexp_extract(html, "(?is)" + _tag(replace(el, tag=f"({ANY})")), 1)
    rest = F.regexp_extract(html, rf"(?is){_tag(el)}(.*)\z", 1)
    return F.when(F.length(name) > 0, bind(name, lambda own: _own_end(rest, own))).otherwise("")


def _shown_text(inner: Column, joiner: str) -> Column:
    parts = F.transform(F.split(inner, r"(?s)<[^>]*>"), lambda p: strip(p))
    text = F.array_join(F.filter(parts, lambda p: F.length(p) > 0), joiner)
    return bind(text, lambda t: F.when(t.contains("&"), strip(decode_entities(t))).otherwise(t))


def element_text(html: Column, el: Element, joiner: str = "") -> Column:
    """Text of the first such element: tags removed, each text part stripped."""
    return _shown_text(element_inner(html, el), joiner)


def first_line(html: Column) -> Column:
    """The first line of text: tags that break no line are left out, all others end one."""
    lines = F.split(F.regexp_replace(html, INLINE, ""), r"(?s)<[^>]*>|\n")
    texts = F.filter(F.transform(lines, lambda p: collapse(p)), lambda p: F.length(p) > 0)
    text = F.coalesce(F.get(texts, F.lit(0)), F.lit(""))
    return bind(text, lambda t: F.when(t.contains("&"), strip(decode_entities(t))).otherwise(t))


def element_attr(html: Column, el: Element, attr: str) -> Column:
    """An attribute of the first such element; empty when there is none."""
    tag = F.regexp_extract(html, f"(?is){_tag(el)}", 0)
    value = F.coalesce(*[
        F.nullif(F.regexp_extract(tag, rf"(?is)\s{attr}\s*=\s*{q}([^{q}]*){q}", 1), F.lit(""))
        for q in "\"'"
    ], F.lit(""))
    return bind(value, lambda v: F.when(v.contains("&"), decode_entities(v)).otherwise(v))


def first_present(html: Column, elements: tuple[Element, ...], read) -> Column:
    """What ``read`` finds in the first of ``elements`` that occurs, even if blank."""
    return F.coalesce(
        *[F.when(html.rlike(f"(?is){_tag(el)}"), read(el)) for el in elements], F.lit(""),
    )


def own_items(html: Column, el: Element) -> Column:
    """The elements of a name that are not inside another one of it, as an array; null if there is none.

    Where closing tags are left out, every opening tag begins an element.
    """
    name = F.lit(el.tag)

    def cut(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("found"))

        def step(acc: Column, piece: Column) -> Column:
            depth = F.greatest(F.lit(0), _nesting(name, acc["depth"], piece))
            last = F.element_at(acc["found"], -1)
            longer = F.concat(F.slice(acc["found"], F.lit(1), F.size(acc["found"]) - 1), F.array(F.concat(last, piece)))
            found = F.when((acc["depth"] == 0) & (depth == 1), F.concat(acc["found"], F.array(piece))).when(
                acc["depth"] > 0, longer).otherwise(acc["found"])
            return F.struct(depth.alias("depth"), found.alias("found"))

        end = F.aggregate(pieces, start, step)
        return bind(end, lambda e: F.when(e["depth"] == 0, e["found"]).otherwise(
            F.filter(pieces, lambda p: p.rlike(rf"(?is)^{_tag(replace(el, within=None))}"))))

    return bind(bind(_at_tags(html, name), cut), lambda found: F.when(F.size(found) > 0, found))


def split_cards(html: Column, layout: Layout) -> Column:
    """The page's cards as an array: the first card pattern that occurs."""
    def pieces(el: Element) -> Column:
        if el.within is not None:
            return own_items(element_inner(html, el.within), el)

        def pick(parts: Column) -> Column:
            # text before the first card is no card; a page may start with one
            starts = parts[0].rlike(rf"(?is)^{_tag(el)}")
            found = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1)))
            return F.when(starts, parts).when(F.size(parts) > 1, found)
        return bind(F.split(html, rf"(?is)(?={_tag(el)})"), pick)
    return F.coalesce(*[pieces(el) for el in layout.cards])


def extract_postings(pages: DataFrame, layout: Layout) -> DataFrame:
    """One row per card: ``page_id``, ``pos`` (arrival order), title, url, company."""
    cards = pages.select("page_id", F.posexplode(split_cards(F.col("html"), layout)).alias("pos", "card"))
    card = F.col("card")
    if layout.title_by_text:
        title = first_non_blank(*[element_text(card, el, " ") for el in layout.titles])
    else:
        title = first_present(card, layout.titles, lambda el: element_text(card, el))
    if layout.title_first_line:
        held = F.lit(False)
        for el in layout.titles:
            held = held | card.rlike(f"(?is){_tag(el)}")
        title = F.when(held, title).otherwise(first_line(card))
    href = first_present(card, layout.links, lambda el: element_attr(card, el, "href"))
    company = (
        first_non_blank(*[element_text(card, el) for el in layout.companies])
        if layout.companies else F.lit(None).cast("string")
    )
    return cards.select(
        "page_id", "pos",
        fix_doubled(title).alias("title"),
        canonical_url(href, layout.base_url, layout.name).alias("url"),
        company.alias("company"),
    )
