"""Column functions: input and output pairs."""

import math

import pytest
from pyspark.sql import functions as F

from postloom.config import ROLE_RULES
from postloom.functions import fields, grams, text, titles


def apply(spark, fn, values, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def check(spark, fn, pairs, type_="string"):
    assert apply(spark, fn, [a for a, _ in pairs], type_) == [b for _, b in pairs]


def test_spaces_are_those_of_unicode():
    assert set(text.SPACES) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_and_collapse(spark):
    check(spark, text.strip, [("\u00a0 a b\u2003\x1c", "a b"), ("\t\n", ""), (None, None)])
    check(spark, text.collapse, [(" a\u3000\n b ", "a b"), ("", "")])


def test_is_missing(spark):
    check(spark, text.is_missing, [
        (None, True), ("", True), (" \u00a0", True), ("N/A", True), (" na ", True), ("None", True),
        ("NULL", True), ("nan", False), ("x", False)])


def test_first_non_blank(spark):
    df = spark.createDataFrame([(" ", None, " b "), (None, "", ""), ("a", "b", "c")], "p string, q string, r string")
    got = df.select(text.first_non_blank(F.col("p"), F.col("q"), F.col("r")).alias("y")).collect()
    assert [r.y for r in got] == ["b", "", "a"]


def test_fix_doubled(spark):
    check(spark, titles.fix_doubled, [
        ("Data Scientist Data Scientist", "Data Scientist"), ("Data ScientistData Scientist", "Data Scientist"),
        ("data scientist Data Scientist", "data scientist Data Scientist"), ("a b a b", "a b"),
        ("A A A A", "A A"), ("abab", "abab"), ("abcabc", "abc"), ("  Data   Analyst ", "Data Analyst"),
        ("Data Analyst with verification", "Data Analyst with verification"),
        ("a a", "a"), ("aa", "aa"), ("x", "x"), ("", ""), (None, ""), ("é\u00a0é", "é"), ("aXa", "aXa")])


def test_sanitize_title(spark):
    check(spark, titles.sanitize_title, [
        ("Data Scientist Data Scientist", "Data Scientist"), ("Data ScientistData Scientist", "Data Scientist"),
        ("data scientist Data Scientist", "data scientist"), ("A A A A", "A A"), ("abab", "abab"),
        ("abcabc", "abcabc"), ("abcdABCD", "abcd"), ("Data Analyst WITH Verification", "Data Analyst"),
        ("Data Analyst - Jobs", "Data Analysts"), ("Data Engineer (M/F/D)", "Data Engineer"),
        ("(f/m/d)", ""), (None, ""), ("One", "One")])


def test_pay_statement(spark):
    check(spark, fields.pay_statement, [
        ("$80,000 - $100,000 a year", "$80,000 - $100,000"), ("$85000 per year", "$850"),
        ("$45 an hour", "$45"), ("$20/hour", "$20/hour"), ("$20 / hour", "$20"), ("$30 monthly", "$30 month"),
        ("$20 100 hours", "$20 100 hour"), ("CA$45.50 per hour", "CA$45.50 per hour"),
        ("C$90K – C$110K/yr", "C$90K – C$110K/yr"), ("$60,000 to 70,000 per year", "$60,000 to 70,000 per year"),
        ("USD 100", "N/A"), (None, "N/A"), ("", "N/A"), ("pay:\n$5\u00a0 PER\tHour", "$5 PER Hour")])


def test_salary_source_and_fill(spark):
    df = spark.createDataFrame([("no pay", "$5"), (None, "$5"), ("", "$5")], "box string, body string")
    got = df.select(fields.extract_salary(F.col("box"), F.col("body")).alias("y")).collect()
    assert [r.y for r in got] == ["N/A", "$5", "N/A"]
    check(spark, fields.fill_salary, [(None, "N/A"), ("  ", "N/A"), ("$5", "$5")])


def test_join_quals(spark):
    check(spark, fields.join_quals, [
        ([" SQL ", "", "  ", "R"], "SQL; R"), ([], "N/A"), (None, "N/A"), ([None, "x"], "x")], "array<string>")


def test_canonical_url(spark):
    a = lambda c: fields.canonical_url(c, "https://b", "A")
    b = lambda c: fields.canonical_url(c, "https://b", "B")
    check(spark, a, [("/job/1?x=2", "https://b/job/1"), ("https://h/job/1?x=2", "https://h/job/1?x=2"),
                     ("", ""), (None, ""), ("/job#f?x", "https://b/job#f")])
    check(spark, b, [("https://h/job/1?x=2", "https://h/job/1"), ("", ""), (None, "")])


def test_normalize_and_role(spark):
    check(spark, titles.normalize_title, [
        ("Senior Data Scientist II (Toronto) - B3617", "senior data scientist"),
        ("Data Analyst/BI Developer [Contract]", "data analyst bi developer"), ("Model Ops v2", "model ops v2"),
        ("R&D Engineer, Level IV", "r&d engineer level"), ("((nested) x) Analyst", "x) analyst"),
        ("Analyst 2024—Remote", "analyst remote"), (None, ""), ("éi i éi", "éi éi"), ("a\r(b\rc)d", "a d"),
        ("é123 123é x1234", "é123 123é")])
    check(spark, titles.canonical_title, [
        ("senior data scientist", "Data Scientist"), ("data scientist machine learning engineer", "Data Scientist"),
        ("applied scientist", "ML Scientist/Research"), ("ml engineer", "Machine Learning Engineer"),
        ("data & analytics analytics engineer", "Data Engineer"), ("data analytics engineer", "Analytics Engineer"),
        ("ai analytics lead", "Analytics Engineer"), ("customer insights analyst", "Business Intelligence"),
        ("business analyst", "Analyst"), ("senior statistician", "senior statistician"),
        ("analytics a b c engineer", "Analytics Engineer"), ("analytics a b c d engineer", "analytics a b c d engineer"),
        ("analysté", "analysté"), ("", "")])


def test_role_patterns_mean_the_same_as_in_python(spark):
    import re

    words = ["data", "analyst", "scientist", "é", "engineer", "analytics", "&", "and", "ops", "model", "ai", "ml", "²"]
    samples = [" ".join(words[(i * k) % len(words)] for k in (1, 3, 5, 7)) for i in range(1, 60)]
    samples += [s.replace(" ", sep) for s in samples[:20] for sep in ("-", "é", "_")]
    want = [next((label for label, p in ROLE_RULES if re.search(p, s)), s) for s in samples]
    assert apply(spark, titles.canonical_title, samples) == want


def test_signatures(spark):
    df = spark.createDataFrame([(" Data É", "Intact."), ("日本", None)], "t string, c string")
    got = df.select(fields.batch_sig(F.col("t"), F.col("c")).alias("b"),
                    fields.ingest_sig(F.col("t"), F.col("c")).alias("i")).collect()
    assert [r.b for r in got] == ["intact_data", "_"]
    assert [tuple(r.i) for r in got] == [("data é", "intact."), ("日本", "")]


def test_stamp(spark):
    import re
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", spark.range(1).select(fields.stamp().alias("s")).first().s)


@pytest.mark.parametrize("value", ["ai", "a data-eng été", "", "x", "C++ & r", "😀😀 a𝒜b ok", "one two three four"])
def test_grams(spark, value):
    import re

    tokens = re.findall(r"\w\w+", value.lower())
    words = [" ".join(tokens[i:i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)]
    chars = []
    for w in value.lower().split():
        w = f" {w} "
        chars += [w[i:i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    assert apply(spark, grams.word_grams, [value]) == [words]
    assert sorted(apply(spark, grams.char_grams, [value])[0]) == sorted(chars)


def test_idf(spark):
    from postloom.operators.features import idf
    got = spark.range(1).select(idf(F.lit(2), F.lit(4)).alias("y")).first().y
    assert math.isclose(got, 1.5108256237659907)
