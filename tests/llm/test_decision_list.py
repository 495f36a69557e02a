import re
from collections import Counter

from pyspark.sql import functions as F

from postloom.llm import decision_list as d
from postloom.scratch import Scratch

from .data import documents, prose, texts


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    seen = Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i: i + 8])] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_statistics_against_brute_force(spark):
    one = prose(8, 1)
    all_texts = [*texts(), f"{one} x {one} y {prose(9, 2)} {one}", "a\nb\na\n \n\na", "# * $ % & | < >", prose(30, 3) + " " + prose(30, 3),
                 "\x0b\x0c a\rb \xa0c", "ab " * 50]
    rows = d.judge(d.text_stats(documents(spark, all_texts)), d.DecisionList()).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in (*d.COUNTS, "base_failed")) for r in rows] == [brute(t) for t in all_texts]
    assert all(r.kept == (not r.base_failed) for r in rows)


def test_rules_are_found_and_pruned(spark):
    df = spark.range(3000).select(
        (F.rand(1)).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"), (F.col("id") % 3).cast("int").alias("part"))
    df = Scratch(spark, "t").save(df.withColumn("reject", ((F.col("a") > 0.8) & (F.col("b") > 0.5)) | (F.col("c") < 0.1)), "rows")
    rules = d.learn(df, ("a", "b", "c"))
    assert rules.rules and all(len(r) <= 3 for r in rules.rules)
    wrong = df.where(rules.rule().isNotNull() != F.col("reject")).count()
    assert wrong < 250
    assert d.learn(df.where("reject"), ("a", "b", "c")).rules == []
    assert d.learn(df.limit(0), ("a", "b", "c")).rules == []
    assert d.learn(df.withColumn("a", F.lit(None).cast("double")), ("a",)).rules == []


def test_documents_are_kept_as_they_are(spark):
    good = [prose(40, 100 + k) for k in range(60)]
    bad = [" ".join(f"{w}###" for w in prose(40, 200 + k).split()) for k in range(60)]
    docs = documents(spark, [*good, *bad, None])
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)] + [(3, 1), (None, 0), (5, None)], "doc_id long, quality int")
    left = d.good_documents(docs, labels, Scratch(spark, "t"))
    assert left.columns == docs.columns
    assert sorted(left.select("doc_id", "text", "kept", "n_words").collect()) == [(k, good[k], True, -1) for k in range(60)]
    none = d.good_documents(docs, labels.limit(0), Scratch(spark, "t"))
    assert none.count() == 120


def test_no_python_in_the_plan(spark):
    plan = d.judge(d.text_stats(documents(spark, ["a"])), d.DecisionList([(d.Condition("mean_length", True, 3.0),)]))
    assert "Python" not in plan._jdf.queryExecution().toString().replace("PythonRDD", "").replace("EvaluatePython", "")
