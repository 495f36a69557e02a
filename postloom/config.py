"""Settings: keyword lists, title rules, page layouts, thresholds.

Everything is a parameter; the defaults are the fixed values below.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. They decide results, so they are stated literally.
# ---------------------------------------------------------------------------

BAD_KEYWORDS = (
    "intern", "co-op", "coop", "student", "summer", "placement",
    "manager", "director", "head of", "vp", "president", "chief", "principal", "lead",
    "sales", "customer service", "technician", "support", "clerk", "admin",
    "marketing", "account executive", "driver", "warehouse", "nurse", "bilingual",
    "business analyst", "business systems analyst", "business system analyst", "financial analyst",
)

STRONG_KEYWORDS = (
    "data scientist", "data engineer", "machine learning", "ai engineer", "analytics",
    "computer vision", "nlp", "business intelligence", "deep learning",
    "data analyst", "quantitative researcher", "statistical modeling", "statistician",
)

AMBIGUOUS_KEYWORDS = (
    "analyst", "insights", "consultant", "scientist", "researcher",
    "strategist", "specialist", "associate",
)

TECH_KEYWORDS = (
    "sql", "python", " r ", "r-programming", "tableau", "power bi", "powerbi",
    "aws", "azure", "gcp", "snowflake", "etl", "pipeline", "modeling", "models",
    "machine learning", "statistical", "looker", "bigquery", "spark", "hadoop",
)

#: Phrases deleted from titles by the batch clean, in this order.
TITLE_NOISE = ("with verification", " - Job", "(f/m/d)", "(m/f/d)")

#: Page text that says a posting is closed.
DEAD_PHRASES = (
    "this job posting is temporarily unavailable",
    "job no longer available",
    "this job has expired",
    "no longer accepting applications",
    "job is no longer available",
)

#: Title normalisation: each pattern is replaced by one space, in this order.
TITLE_NORM_PATTERNS = (
    r"\(.*?\)",
    r"\[.*?\]",
    r"\b[a-z]*\d{3,}\b",
    r"[/|,;:\-–—]+",
    r"\b(i|ii|iii|iv|v)\b",
)

#: Canonical roles: the first pattern found in a normalised title names it.
ROLE_RULES = (
    ("Data Scientist", r"\bdata scientist\b"),
    ("ML Scientist/Research",
     r"\bmachine learning scientist\b|\bml scientist\b|\bresearch scientist\b|\bmachine learning researcher\b|"
     r"\bresearch engineer\b|\bscientist\b|\bmachine learning specialist\b|\bresearcher\b"),
    ("Machine Learning Engineer",
     r"\bmachine learning engineer\b|\bml engineer\b|\bai engineer\b"),
    ("Data Engineer",
     r"\bdata engineer\b|\bdata engineering\b|"
     r"\bdata\s*(?:&|and)\s*analytics\b.*\banalytics\b.*\bengineer\b|"
     r"\bdata\s*(?:&|and)\s*model\s*ops\b.*\bengineer\b"),
    ("Analytics Engineer",
     r"\banalytics(?:\s+\w+){0,3}\s+engineer\b|\bsenior analytics engineer\b|"
     r"\bintermediate analytics engineer\b|\bai analytics\b|\banalytics engineering\b"),
    ("Business Intelligence", r"\bbusiness intelligence\b|\bpower bi\b|\binsights\b"),
    ("Data Analyst", r"\bdata analyst\b|\bdata analytics\b"),
    ("Analyst", r"\banalyst\b|\brisk analytics\b|\brisk modelling\b"),
)

#: One pay amount, and the pattern of a pay statement built from it.
PAY_AMOUNT = r"\s*[\d]{1,3}(?:[,\s]\d{3})*(?:\.\d+)?\s*[kK]?"
PAY_PATTERN = (
    r"(?:CA?\$|C\$|\$)" + PAY_AMOUNT
    + r"(?:\s*(?:-|–|—|to)\s*(?:CA?\$|C\$|\$)?" + PAY_AMOUNT + r")?"
    + r"(?:\s*(?:/|per\s*)?(?:hour|hr|year|yr|month|mo|week|wk|day|annum))?"
)

CHUNK_PROMPT = (
    "Summarize technical skills and duties in this job text, "
    "obtain salary / salary range, if available:\n\n"
)
FINAL_PROMPT = (
    "Write a professional paragraph job summary listing tech stack and responsibilities, "
    "obtain salary / salary range, if available:\n\n"
)

SITE_A_BASE = "https://www.simplyhired.ca"
SITE_A_MARK = "simplyhired"

#: Text that the CSV reader takes for "no value" (the pandas default list).
CSV_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Element:
    """An HTML element to find: tag name, optionally an attribute test.

    ``match`` is ``"contains"`` (substring of the attribute), ``"word"`` (one
    of its blank-separated words) or ``"equals"``. With ``within``, it is looked for inside the first
    such element, for cards among its own items only (an ``li`` inside another is none).
    """

    tag: str
    attr: str | None = None
    value: str | None = None
    match: str = "contains"
    within: Element | None = None


ANY = "[a-z][a-z0-9]*"


@dataclass(frozen=True)
class Layout:
    """How one posting site lays out its result cards.

    Candidates are tried in order. The first one present wins; for titles with
    ``title_by_text`` the first one that yields text, its parts joined by spaces. With ``title_first_line``
    a card without any of them has the first line of its text for a title.
    """

    name: str
    cards: tuple[Element, ...]
    titles: tuple[Element, ...]
    links: tuple[Element, ...]
    companies: tuple[Element, ...] = ()
    base_url: str = ""
    title_by_text: bool = False
    title_first_line: bool = False


LAYOUT_A = Layout(
    name="A",
    cards=(Element("div", "class", "SerpJob"), Element("li", within=Element(ANY, "id", "job-list", "equals"))),
    titles=(Element("a", "class", "jobTitle"),),
    links=(Element("a", "class", "jobTitle"), Element("a")),
    companies=(Element("span", "data-testid", "companyName", "equals"),),
    base_url=SITE_A_BASE,
    title_first_line=True,
)

LAYOUT_B = Layout(
    name="B",
    cards=(
        Element(ANY, "class", "job-card-container", "word"),
        Element("li", "class", "jobs-search-results__list-item", "word"),
    ),
    titles=(
        Element(ANY, "class", "job-card-list__title", "word"),
        Element("a", "class", "job-card-container__link", "word"),
        Element("span", "aria-hidden", "true", "equals", within=Element("a", "class", "job-card-container__link", "word")),
    ),
    links=(
        Element("a", "class", "job-card-list__title", "word"),
        Element("a", "class", "job-card-container__link", "word"),
    ),
    title_by_text=True,
)


@dataclass(frozen=True)
class Config:
    """Parameters of one collection run; a run has no limit of rows or result pages unless one is given."""

    bad: tuple[str, ...] = BAD_KEYWORDS
    strong: tuple[str, ...] = STRONG_KEYWORDS
    ambiguous: tuple[str, ...] = AMBIGUOUS_KEYWORDS
    tech: tuple[str, ...] = TECH_KEYWORDS
    require_company: bool = True
    require_salary: bool = False
    max_rows: int | None = None
    max_pages: int | None = None
    dead_phrases: tuple[str, ...] = DEAD_PHRASES
    redirect_marks: tuple[str, str] = (SITE_A_MARK, "/job/")
    redirect_target: str = "/search"
    layouts: dict[str, Layout] = field(default_factory=lambda: {"A": LAYOUT_A, "B": LAYOUT_B})
