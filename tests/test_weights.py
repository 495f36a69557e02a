"""What the features of titles cost: rows as they are, digits in binary."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from postloom.operators import features

TITLES = ["senior data engineer", "data engineer data", "engineer of data", "x", "", "data", "ab cd ab cd"]


def rows(spark):
    return spark.createDataFrame([(t, k, 1 + k % 2) for k, t in enumerate(TITLES)], "title string, title_id long, n long")


def test_the_length_of_a_title_is_not_computed_again_for_each_feature(spark):
    united = features.union_features(features.vectors(rows(spark)))
    plan = united._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "Generate" not in plan
    lengths = united.groupBy("title_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert len(lengths) >= 4 and all(abs(r.s - 1) < 1e-12 for r in lengths)


def test_six_digits_as_spark_rounds_them(spark):
    rng = random.Random(3)
    values = [rng.random() ** k for k in (1, 2, 5) for _ in range(3000)] + [0.0, 1.0, 0.5, 0.1234565, 1e-7, 6e-7]
    got = entry._rounded(spark.createDataFrame([(v, v) for v in values], "weight double, given double"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan
    ours = got.select("weight", F.round("given", 6).alias("theirs")).collect()
    assert sum(r.weight != r.theirs for r in ours) == 0
