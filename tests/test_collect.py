"""Gates, card matching, stale descriptions, decisions, caps."""

import random

import pytest
from pyspark.sql import functions as F

from postloom.config import ANY, Config, Element, LAYOUT_A, LAYOUT_B
from postloom.operators import gates, matching
from postloom.plans import collect
from postloom.sources.pages import element_inner, extract_postings


def test_tiers_and_description_gate(spark):
    rows = [("International Data Scientist", "x", "REJECT", False), ("Lead Data Engineer", "x", "REJECT", False),
            ("Data Scientist", "N/A", "KEEP_IMMEDIATE", True), ("Data Scientist", None, "KEEP_IMMEDIATE", True),
            ("Research Associate", "We use SQL daily", "CHECK_DESCRIPTION", True),
            ("Research Associate", "Paper filing", "CHECK_DESCRIPTION", False),
            ("Research Associate", "N/A", "CHECK_DESCRIPTION", False), ("Software Developer", "sql", "SKIP", False),
            ("Research Associate", "use r daily", "CHECK_DESCRIPTION", True),
            ("Research Associate", "r", "CHECK_DESCRIPTION", False)]
    df = spark.createDataFrame(rows, "title string, description string, tier string, kept boolean")
    tier = gates.title_tier(F.col("title"), Config())
    got = df.select("tier", tier.alias("t"), "kept", gates.accept(tier, F.col("description"), Config()).alias("k"))
    for r in got.collect():
        assert (r.t, r.k) == (r.tier, r.kept)


def test_required_fields(spark):
    rows = [("A", "t", "u", "c", "$5", None), ("A", " ", "u", "c", "", "missing_title"), ("A", "t", None, "c", "", "missing_url"),
            ("B", "t", None, "c", "", None), ("A", "t", "u", "N/A", "", "missing_company")]
    df = spark.createDataFrame(rows, "layout string, title string, url string, company string, salary string, want string")
    got = df.select("want", gates.missing_field(Config(), F.col("layout")).alias("m")).collect()
    assert all(r.m == r.want for r in got)
    strict = Config(require_company=False, require_salary=True)
    got = [r.m for r in df.select(gates.missing_field(strict, F.col("layout")).alias("m")).collect()]
    assert got == [None, "missing_title", "missing_url", None, "missing_salary"]
    assert gates.gate_required(df, Config()).count() == 2


def stale_model(texts, layout):
    out, prev = [], None
    for t in texts:
        shown = "N/A" if t is None or t == prev else t
        out.append(shown)
        if layout == "A":
            prev = shown
        elif shown != "N/A":
            prev = shown
    return out


@pytest.mark.parametrize("layout", ["A", "B"])
def test_stale_descriptions(spark, layout, monkeypatch):
    fixtures = {"A": ["A", "N/A", "N/A", "A", "B"], "B": ["A", "N/A", "N/A", "N/A", "B"]}
    assert stale_model(["A", "A", None, "A", "B"], layout) == fixtures[layout]
    monkeypatch.setattr(matching, "CHUNK_BITS", 2)  # sessions span many chunks and parts
    rng = random.Random(5)
    sessions = {
        "long": ["A"] * 23, None: ["A"] * 9 + ["B"] * 14 + [None] * 6 + ["B"] * 11,
        **{f"r{i}": [rng.choice(["A", "A", "A", "B", None]) for _ in range(40)] for i in range(6)},
    }
    rows, want, a = [], {}, 0
    for s, texts in sessions.items():
        for t, shown in zip(texts, stale_model(texts, layout)):
            a += rng.choice([1, 1, 1, 7])
            rows.append((a, s, t))
            want[a] = shown
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "arrival long, session string, description string")
    out = matching.blank_stale(df, "session", layout)
    assert out.columns == df.columns
    assert {r.arrival: r.description for r in out.collect()} == want


def test_match_details(spark):
    cards = spark.createDataFrame([
        (1, "Data Scientist", "Acme"), (2, "Data Scientist", "Acme"), (3, "Data Scientist II", "Acme"),
        (4, "Data", "Acme"), (5, "x", "y")], "card_id long, title string, company string")
    details = spark.createDataFrame([
        (1, "other", "ACME Inc", "d"), (2, "other", "Beta", "d"), (3, "senior data scientist", " ", "d"),
        (4, None, "", "d")], "card_id long, title string, company string, description string")
    ids = lambda layout: sorted(r.card_id for r in matching.match_details(cards, details, layout).collect())
    assert ids("A") == [1, 3]
    details = spark.createDataFrame([
        (1, "data scientist data scientist", " Acme "), (2, "", "B"), (3, "Data Scientist", "C"), (4, "engineer", "D")],
        "card_id long, title string, company string")
    out = {r.card_id: r.company for r in matching.match_details(cards, details, "B").collect()}
    assert out == {1: "Acme", 3: "C"}


def test_extract_layout_a(spark):
    html = ("<body><a href='/nav'>n</a><div class='SerpJob-1'><a href='/x'>no</a><a class=\"big jobTitle\" "
            "href=\"/job/1?q=2\"> Data <b>Analyst</b></a><span data-testid=\"companyName\">A&amp;B</span></div>"
            "<div class='SerpJob-2'><a href='https://h/job?x=1'>ML MLX</a></div><div class='SerpJob-3'>none</div></body>")
    listed = "<ul id='job-list'><li><a href='/j'>One One</a></li><li>Two</li></ul>"
    df = spark.createDataFrame([(1, html), (2, listed), (3, "<p>nothing</p>")], "page_id long, html string")
    out = [tuple(r) for r in extract_postings(df, LAYOUT_A).orderBy("page_id", "pos").collect()]
    base = LAYOUT_A.base_url
    assert out == [
        (1, 0, "DataAnalyst", base + "/job/1", "A&B"), (1, 1, "ML MLX", "https://h/job?x=1", ""), (1, 2, "none", "", ""),
        (2, 0, "One", base + "/j", ""), (2, 1, "Two", "", "")]


def test_own_items_and_nested_elements(spark):
    """Cards are the items of the job list itself, an element ends at its own closing tag, a card may have its first line for a title."""
    menu = "<ul><li><a class='jobTitle' href='/menu'>Menu</a></li></ul>"
    listed = (menu + "<div id='x'></div><UL class=c id=\"job-list\"><li> <a class='jobTitle' href='/1'>One <b>x</b></a><ul><li>in one</li>"
              "<li>too</li></ul></li>\n<LI><p>R&amp;D <b>lead</b> role</p><div>Acme</div></LI><li/><li><a href='/3'>\n <i>Third</i></a></li></UL>"
              "<ul><li>foot</li></ul>")
    open_items = "<ol id='job-list'><li>a<li>b</ol>"
    df = spark.createDataFrame([(1, listed), (2, menu), (3, open_items)], "page_id long, html string")
    out = [tuple(r)[:4] for r in extract_postings(df, LAYOUT_A).orderBy("page_id", "pos").collect()]
    base = LAYOUT_A.base_url
    assert out == [(1, 0, "Onex", base + "/1"), (1, 1, "R&D lead role", ""), (1, 2, "Third", base + "/3"), (3, 0, "a", ""), (3, 1, "b", "")]
    html = "<div class='q'>a<div>b<div></div>c</div><div/>d</div>e</div>"
    df = spark.createDataFrame([(html,), ("<div class='q'>open",), ("no",)], "html string")
    got = df.select(element_inner(F.col("html"), Element("div", "class", "q")).alias("one"),
                    element_inner(F.col("html"), Element(ANY, "class", "q", "word")).alias("any")).collect()
    assert [r.one for r in got] == ["a<div>b<div></div>c</div><div/>d", "", ""] and got[0].any == got[0].one and got[2].any == ""


def test_titles_of_layout_b_by_all_selectors(spark):
    card = "<div class='job-card-container'>{}</div>"
    link = "<a class='job-card-container__link' href='https://h/k'>{}</a>"
    html = (card.format("<strong class='x job-card-list__title'><strong>Any</strong> element</strong>" + link.format("no"))
            + card.format(link.format(" ") + "<span aria-hidden='true'>outside</span>")
            + card.format(link.format("<span>Lead</span><span aria-hidden='true'>no</span>")))
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r.title for r in extract_postings(df, LAYOUT_B).orderBy("pos").collect()] == ["Any element", "", "Lead no"]


def test_extract_layout_b(spark):
    html = ("<div class=\"x job-card-container y\"><a class='job-card-list__title' href='https://h/j?a=1'> </a>"
            "<a class='job-card-container__link' href='https://h/k?a=1'><span>Data</span> <span>Lead</span></a></div>"
            "<div class='job-card-container--no'>z</div>")
    df = spark.createDataFrame([(7, html)], "page_id long, html string")
    out = [tuple(r) for r in extract_postings(df, LAYOUT_B).collect()]
    assert out == [(7, 0, "Data Lead", "https://h/j", None)]


def test_capture(spark):
    html = ("<div class='SerpJob'><a class='jobTitle' href='/job/1'>Data Analyst</a>"
            "<span data-testid='companyName'>Acme</span></div>")
    pages = spark.createDataFrame([(3, html, "data", 1)], "page_id long, html string, keyword string, page_num int")
    details = spark.createDataFrame(
        [(3 << 20, "", "acme", "text", None, "pays $5/hour", ["SQL", " "])],
        "card_id long, title string, company string, description string, compensation string, body string, "
        "qualifications array<string>")
    row = collect.capture(pages, details, LAYOUT_A).first()
    assert (row.title, row.url, row.company, row.salary, row.qualifications, row.session, row.page_num) == (
        "Data Analyst", LAYOUT_A.base_url + "/job/1", "Acme", "$5/hour", "SQL", 3, 1)


def test_both_layouts_with_equal_page_ids(spark):
    """Layout A comes first, no card gets the arrival of another, and a rejected one stays out."""
    page = "page_id long, html string"
    a = spark.createDataFrame([(3, "<div class='SerpJob'><a class='jobTitle' href='/job/1'>Data Analyst</a>"
                                   "<span data-testid='companyName'>Acme</span></div>")], page)
    b = spark.createDataFrame([(3, "<div class='job-card-container'><a class='job-card-list__title' href='https://h/j'>Nurse</a></div>")], page)
    detail = "card_id long, title string, company string, description string, compensation string, body string, qualifications array<string>"
    one = collect.capture(a, spark.createDataFrame([(3 << 20, "Data Analyst", "Acme", "sql", None, None, None)], detail), LAYOUT_A)
    two = collect.capture(b, spark.createDataFrame([(3 << 20, "Nurse", "Care", "sql", None, None, None)], detail), LAYOUT_B)
    both = one.unionByName(two).withColumn("scraped_at", F.lit("x"))
    cfg = Config(bad=("nurse",), strong=("data",), ambiguous=(), tech=("sql",))
    none = spark.createDataFrame([], "title string, url string, company string")
    got = {r.title: (r.arrival, r.reason) for r in collect.decide(both, none, cfg).collect()}
    assert got["Data Analyst"] == (3 << 20, "kept") and got["Nurse"] == ((1 << 62) + (3 << 20), "bad_keyword")
    assert [r.title for r in collect.accepted(both, none, cfg).collect()] == ["Data Analyst"]


def test_rows_of_other_layouts_are_judged_too(spark):
    rows = [(1, "A", 0), (2, "C", 0), (3, None, 0), (4, "C", 0)]
    df = spark.createDataFrame([(a, x, s, "strong", f"u{a % 3}", "c", "sql") for a, x, s in rows],
                               "arrival long, layout string, session int, title string, url string, company string, description string")
    none = spark.createDataFrame([], "title string, url string, company string")
    got = {r.arrival: r.reason for r in collect.decide(df, none, CFG).collect()}
    assert got == {1: "kept", 2: "duplicate_signature", 3: "duplicate_signature", 4: "duplicate_url"}


@pytest.mark.parametrize("page", [1 << 42, -1])
def test_card_numbers_do_not_wrap(spark, page):
    df = spark.createDataFrame([(page, 0)], "page_id long, pos int")
    with pytest.raises(Exception, match="no card number"):
        df.select(collect.card_number()).collect()


CFG = Config(bad=("bad",), strong=("strong",), ambiguous=("maybe",), tech=("sql",), max_rows=None)


def decide_model(rows, stored_urls, stored_sigs, cfg):
    """Row by row, as a run would see them."""
    urls, sigs, out, saved = set(stored_urls), set(stored_sigs), {}, 0
    gone = lambda x: (x or "").strip().lower() in ("", "n/a")
    for a, layout, t, u, c, d in sorted(rows):
        if cfg.max_rows is not None and saved >= cfg.max_rows:
            out[a] = "not_reached"
            continue
        sig, dup_url = (t.lower().strip(), (c or "").lower().strip()), u in urls and not gone(u)
        bad, skip = "bad" in t.lower(), not any(w in t.lower() for w in ("strong", "maybe"))
        checks = [("missing_title", gone(t)), ("duplicate_url", dup_url)]
        b = layout == "B"
        words = [("bad_keyword", bad), ("irrelevant_title", skip)]
        if not b:
            checks = checks[::-1] + words + [("missing_url", layout == "A" and gone(u)), ("missing_company", gone(c)),
                                             ("duplicate_signature", sig in sigs)]
        else:
            checks += [("missing_company", gone(c)), ("duplicate_signature", sig in sigs)] + words
        checks.append(("no_tech_keyword", "strong" not in t.lower() and "sql" not in (d or "").lower()))
        out[a] = next((name for name, hit in checks if hit), "kept")
        if out[a] == "kept":
            saved += 1
            sigs.add(sig)
            if not gone(u):
                urls.add(u)
    return out


@pytest.mark.parametrize("cap", [None, 12])
def test_decisions_match_a_sequential_run(spark, cap):
    cfg = Config(**{**CFG.__dict__, "max_rows": cap})
    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "B", "C", None]), rng.choice(["bad", "Strong ", "maybe", "other", "", "n/a"]) + rng.choice("abcd ") * 2,
             rng.choice([None, "N/A", *[f"u{k}" for k in range(30)]]), rng.choice(["c", "C ", None, "d", "e"]),
             rng.choice([None, "uses SQL", "none"])) for i in range(250)]
    stored = spark.createDataFrame([("strongaa", "u1", "c"), ("x", "u2", "d"), (None, None, "e")],
                                   "title string, url string, company string")
    df = spark.createDataFrame(rows, "arrival long, layout string, title string, url string, company string, description string") \
        .withColumn("salary", F.lit(None).cast("string"))
    want = decide_model(rows, {"u1", "u2"}, {("strongaa", "c"), ("x", "d")}, cfg)
    got = collect.decide(df, stored, cfg)
    assert {r.arrival: r.reason for r in got.collect()} == want
    assert sorted(r.arrival for r in collect.accepted(df, stored, cfg).collect()) == [
        a for a, reason in sorted(want.items()) if reason == "kept"]
    counts = {r.reason: r.n for r in gates.funnel(got).collect()}
    assert sum(counts.values()) == len(rows)


def test_page_limit_cap_and_log(spark):
    df = spark.createDataFrame([(i, i, "B" if i < 3 else "A") for i in range(30)], "arrival long, page_num int, layout string")
    assert gates.page_limit(df, Config(max_pages=18)).count() == 19
    assert gates.page_limit(df, Config()).count() == 30 and Config().max_rows is None
    assert [r.arrival for r in gates.cap(df, 4, "layout", "arrival").collect()] == [3, 4, 5, 6]
    wide = spark.createDataFrame([(1, "r", "t" * 99, "c" * 99, "s" * 99, " " + "u" * 99)],
                                 "arrival long, reason string, title string, company string, salary string, url string")
    row = gates.decision_log(wide).first()
    assert [len(row[c]) for c in ("title", "company", "salary", "url")] == [80, 60, 40, 90]
