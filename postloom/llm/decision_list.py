"""Quality rules learned as a decision list.

``text_stats`` describes a text by numbers, ``learn`` turns labelled numbers
into an ordered list of rules for *rejecting*, and ``DecisionList`` states the list
as one Spark conditional expression: the first rule that holds decides, no
rule keeps.

Learning is sequential covering. A rule grows by the threshold condition of
the highest information gain on the growing part of the labelled rows, until it
covers no accepted row or gains nothing; it loses its last conditions again if
that serves the pruning part better; it is taken if it is precise there, and
the rows it covers leave; if not, its first feature is not used any more. Each step is one aggregate: rows per feature and step
between candidate thresholds, a table of fixed size, of which the driver makes
running sums. All labelled rows count, whatever their number.

Everything is DataFrame functions.

Input rules: null text has no words; rows without a label or with a null
statistic are never learned from, and no condition holds for a null statistic,
so such rows are kept unless the base rule fails; several labels of a document
count as the lowest one; without labels the list is empty and rejects nothing; columns
of the input that carry the name of a statistic are replaced.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rule.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_length", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share",
            "distinct_share", "next_share")
#: Candidate thresholds of a feature lie halfway between neighbours among these quantiles of both classes.
QUANTILES = tuple(k / 16 for k in range(17))


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` (long) and ``FEATURES`` (double) of each whole text."""
    keep = [c for c in docs.columns if c not in (*COUNTS, *FEATURES)]
    text = F.coalesce(F.col(text_col), F.lit("")) if text_col in keep else F.lit("")
    # every select is a stage of its own: what it computes is used several times after it
    a = docs.select(
        *keep, F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "").alias("__w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("__symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}")).alias("__upper"),
        F.regexp_count(text, F.lit("[!?]")).alias("__marks"))
    b = a.select(
        "*", F.size("__w").alias("__n"), F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"))
    last = F.col("__n") - WINDOW
    windows = F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.col("__h")[i + k] for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    c = b.select("*", windows.alias("__win"))
    twice = F.size(F.array_distinct("__win")) < F.size("__win")
    d = c.select("*", F.when(twice, F.sort_array(F.transform(
        "__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__sorted"))
    s = F.col("__sorted")
    again = F.transform(s, lambda e, p: F.when(
        ((p > 0) & (s[F.greatest(p - 1, F.lit(0))]["h"] == e["h"]))
        | ((p < F.size(s) - 1) & (s[F.least(p + 1, F.size(s) - 1)]["h"] == e["h"])), e["i"]))
    e = d.select("*", F.sort_array(F.filter(again, lambda i: i.isNotNull())).alias("__at"))
    at = F.col("__at")
    covered = F.aggregate(
        F.transform(at, lambda i, p: F.when(p == 0, WINDOW).otherwise(
            F.least(F.lit(WINDOW), i - at[F.greatest(p - 1, F.lit(0))]))), F.lit(0), lambda x, y: x + y)
    near = F.size(F.filter(
        F.transform("__h", lambda h, i: (i > 0) & (h == F.col("__h")[F.greatest(i - 1, F.lit(0))])), lambda x: x))
    f = e.select(
        *keep, F.col("__n").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.col("__symbols").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "__upper", "__marks", F.size("__lines").alias("__n_lines"),
        F.size(F.array_distinct("__h")).alias("__distinct"), near.alias("__near"))
    share = lambda x, of: (F.col(x) / F.when(F.col(of) > 0, F.col(of))).cast("double")
    return f.select(
        *keep, *COUNTS, share("word_chars", "n_words").alias("mean_length"),
        share("n_symbols", "word_chars").alias("symbol_share"), share("__upper", "word_chars").alias("upper_share"),
        share("__marks", "word_chars").alias("mark_share"), share("n_dup_lines", "__n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("__distinct", "n_words").alias("distinct_share"),
        share("__near", "n_words").alias("next_share"))


def base_failed() -> Column:
    """The rule that needs no learning: few words, or mostly repeated ones."""
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return F.coalesce(x > self.threshold if self.above else x <= self.threshold, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rule(self) -> Column:
        """The number of the first rule that holds, from 1, or null."""
        out = F.lit(None).cast("int")
        for number, conditions in reversed(list(enumerate(self.rules, 1))):
            out = F.when(_all(conditions), number).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{n}. reject if {' and '.join(map(str, r))}" for n, r in enumerate(self.rules, 1))


def _all(conditions: tuple[Condition, ...] | list[Condition]) -> Column:
    test = F.lit(True)
    for c in conditions:
        test = test & c.column()
    return test


def _thresholds(rows: DataFrame, features: tuple[str, ...]) -> dict[str, list[tuple[float, float]]]:
    """Candidate thresholds of each feature, with the width of the gap they lie in as a share of its range."""
    per_class = rows.groupBy("reject").agg(*[
        F.percentile_approx(f, F.array(*map(F.lit, QUANTILES)), 2000).alias(f) for f in features]).collect()
    values = {f: sorted({x for r in per_class for x in r[f] or [] if x is not None}) for f in features}
    return {f: [((a + b) / 2, (b - a) / (v[-1] - v[0])) for a, b in itertools.pairwise(v)] for f, v in values.items()}


def _gain(p: int, n: int, before: float) -> float:
    return p * (math.log2(p / (p + n)) - before) if p else -math.inf


def _step(feature: str, thresholds: list[float]) -> Column:
    """How many thresholds lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda x: x < F.col(feature)))


def _grow(rows: DataFrame, steps: dict[str, list[tuple[float, float]]], most: int) -> list[Condition]:
    """The conditions of one rule, in the order they were found; of equal gains the widest gap wins."""
    conditions: list[Condition] = []
    bins = F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"),
        _step(f, [x for x, _ in t]).alias("step")) for f, t in steps.items() if t]))
    while len(conditions) < most:
        here = rows.where(_all(conditions))
        table: dict[str, dict[int, tuple[int, int]]] = {}
        for r in here.select("reject", bins.alias("b")).groupBy("b.feature", "b.step").agg(
                F.count_if("reject").alias("p"), F.count_if(~F.col("reject")).alias("n")).collect():
            table.setdefault(r.feature, {})[r.step] = (r.p, r.n)
        total = [sum(x[k] for x in next(iter(table.values()), {}).values()) for k in (0, 1)]
        if not total[0] or not total[1]:
            break
        before, found = math.log2(total[0] / sum(total)), None
        for f in sorted(table):
            low = [0, 0]
            for k, (threshold, gap) in enumerate(steps[f]):
                got = table[f].get(k, (0, 0))
                low = [low[0] + got[0], low[1] + got[1]]
                for above, (p, n) in ((False, low), (True, (total[0] - low[0], total[1] - low[1]))):
                    gain = _gain(p, n, before)
                    if gain > 1e-9 and (found is None or (round(gain, 6), gap) > found[0]):
                        found = ((round(gain, 6), gap), Condition(f, above, float(threshold)))
        if found is None:
            break
        conditions.append(found[1])
    return conditions


def learn(labelled: DataFrame, features: tuple[str, ...] = FEATURES, max_rules: int = 10, max_conditions: int = 3,
          min_precision: float = 0.97, min_rows: int = 5) -> DecisionList:
    """Learn from ``labelled``: the features, ``reject`` (boolean) and ``part``, an integer of 0, 1 or 2.

    Rules grow on parts 0 and 1 and are pruned on part 2. The table is read once a
    step, so it should be a written one.
    """
    rows = labelled.where(F.col("reject").isNotNull() & _no_null(features))
    steps, learned = _thresholds(rows, features), DecisionList()
    for _ in range(max_rules):
        if not any(steps.values()):
            break
        left = rows.where(learned.rule().isNull())
        conditions = _grow(left.where("part < 2"), steps, max_conditions)
        if not conditions:
            break
        heads = [tuple(conditions[: k + 1]) for k in range(len(conditions))]
        counts = left.where("part = 2").agg(*[
            F.count_if(_all(h) & (F.col("reject") if hit else ~F.col("reject"))).alias(f"c{k}{hit:d}")
            for k, h in enumerate(heads) for hit in (True, False)]).first()
        value = lambda k: (counts[f"c{k}1"] - counts[f"c{k}0"]) / max(1, counts[f"c{k}1"] + counts[f"c{k}0"])
        k = max(range(len(heads)), key=lambda i: (round(value(i), 9), -i))
        p, n = counts[f"c{k}1"], counts[f"c{k}0"]
        if p < min_rows or p / (p + n) < min_precision:
            steps = {f: t for f, t in steps.items() if f != conditions[0].feature}  # it leads to no good rule
        else:
            learned.rules.append(heads[k])
    return learned


def _no_null(features: tuple[str, ...]) -> Column:
    test = F.lit(True)
    for f in features:
        test = test & F.col(f).isNotNull()
    return test


def labelled_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """The features of labelled documents that pass the base rule, with ``reject`` and ``part``."""
    one = labels.groupBy(id_col).agg(F.min(label).alias("__label")).where(
        F.col(id_col).isNotNull() & F.col("__label").isNotNull())
    return stats.where(~base_failed()).select(id_col, *FEATURES).join(one, id_col).select(
        *FEATURES, (F.col("__label") == 0).alias("reject"), F.pmod(F.xxhash64(id_col), F.lit(3)).cast("int").alias("part"))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds ``base_failed``, ``rule`` (the number of the rejecting rule, else null) and ``kept``."""
    keep = [c for c in stats.columns if c not in ("base_failed", "rule", "kept")]
    return stats.select(*keep, base_failed().alias("base_failed"), rules.rule().alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())


def good_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that the base rule and a list learned from the labelled ones keep, as they are."""
    taken = {*COUNTS, *FEATURES, "base_failed", "rule", "kept"}
    names = {c: f"__in_{c}" if c in taken else c for c in docs.columns}
    stats = scratch.save(text_stats(docs.select(*[F.col(c).alias(n) for c, n in names.items()])), "stats")
    rules = learn(scratch.save(labelled_rows(stats, labels), "labelled"))
    return judge(stats, rules).where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])
