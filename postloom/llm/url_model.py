"""URL filtering by host rules and a ratio of character language models.

Two Markov models of variable order, one of accepted and one of rejected URLs,
are learned from labelled URLs. A model's chance of a symbol mixes contexts of
``ORDER`` symbols down to none by Witten-Bell smoothing: the more different symbols
a context was followed by, the more weight the shorter context gets. A URL scores the
mean difference of log-likelihood per symbol, so long and short ones compare, and is
accepted from a threshold calibrated on labelled URLs that were held out: the
middle of the range with the best mean of both classes' hit rates.

Counting is a Spark aggregate. Symbols fall into ``SYMBOLS`` classes, so a model
has at most ``SYMBOLS ** (ORDER + 1)`` = 2,560,000 counts whatever the corpus, and
what scoring needs is one table of that many 32-bit floats (10 MB), shared with the tasks.

Input rules: a null or empty URL scores 0; without labels of both classes all scores
are 0 and the threshold is 0, so the model allows; repeated URLs count repeatedly; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER, SYMBOLS = 3, 40
#: Every fifth labelled URL by hash calibrates the threshold, in steps of 1/100 between -5 and 5.
HELD_OUT, STEP, REACH = 5, 0.01, 5.0
_CODES = SYMBOLS ** (ORDER + 1)
_KNOWN = "abcdefghijklmnopqrstuvwxyz./-_?=&:#%~+"  # 38 symbols; digits share the next, all else and the ends the last
_DIGIT, _OTHER = 38, 39


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.int64)
    for i, c in enumerate(_KNOWN):
        out[ord(c)] = out[ord(c.upper())] = i
    out[ord("0"): ord("9") + 1] = _DIGIT
    return out


_CLASS = _classes()


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_column: Column, path_column: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule, else null; rules are (verdict, host and path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host_column == name) | host_column.endswith(f".{name}")) & path_column.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def codes(url: str) -> np.ndarray:
    """For each symbol of a URL, and its end, the number of it with its context."""
    raw = np.frombuffer(url.encode().partition(b"://")[2] or url.encode(), np.uint8)
    s = np.concatenate((np.full(ORDER, _OTHER), _CLASS[raw], [_OTHER]))
    out = np.zeros(len(raw) + 1, np.int64)
    for k in range(ORDER + 1):
        out = out * SYMBOLS + s[k: k + len(out)]
    return out


@dataclass
class UrlModel:
    #: Difference of log-likelihood of each symbol in its context; None if a class is missing.
    table: np.ndarray | None
    threshold: float = 0.0

    def score(self, urls: list[str | None]) -> list[float]:
        if self.table is None:
            return [0.0] * len(urls)
        return [round(float(self.table[codes(u)].mean(dtype=np.float64)), 9) if u else 0.0 for u in urls]


def log_likelihood(counts: np.ndarray) -> np.ndarray:
    """Log of the smoothed chance of every symbol in every context, from counts of full contexts."""
    chance = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, SYMBOLS ** (order + 1)).sum(axis=0).reshape(-1, SYMBOLS)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(chance.reshape(-1, SYMBOLS), (len(n) // max(1, len(chance) // SYMBOLS), 1))
        mixed = (n + kinds * shorter) / np.maximum(total + kinds, 1)
        chance = np.where(total + kinds > 0, mixed, shorter).reshape(-1)
    return np.log(chance)


def count(urls: DataFrame) -> DataFrame:
    """``(accepted, code, n)`` of labelled URLs ``(url, accepted)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), bool)
            found = [codes(u) for u in batch.column(0).to_pylist()]
            for value in (False, True):
                own = [c for c, x in zip(found, label, strict=True) if x == value]
                if own:
                    code, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([value] * len(code)), pa.array(code), pa.array(n)], ["accepted", "code", "n"])

    return urls.mapInArrow(run, "accepted boolean, code long, n long").groupBy("accepted", "code").agg(F.sum("n").alias("n"))


def score(urls: DataFrame, model: UrlModel, url_col: str = "url") -> DataFrame:
    """``urls`` with ``score``; a column of that name is replaced."""
    rows = urls.drop("score") if url_col != "score" else urls
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(url_col)
        for batch in batches:
            got = pa.array(model.score(batch.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*names, "score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, score double")


def learn(labelled: DataFrame, url_col: str = "url", label_col: str = "accepted") -> UrlModel:
    """Learn and calibrate from labelled URLs; rows without a URL or a label are left out."""
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).alias("accepted")).where(
        "url IS NOT NULL AND accepted IS NOT NULL")
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    counts = {True: np.zeros(_CODES), False: np.zeros(_CODES)}
    # at most two rows per code: bounded by the alphabet
    got = count(rows.where(~held)).toPandas()
    for value, own in got.groupby("accepted"):
        counts[bool(value)][own["code"].to_numpy()] = own["n"].to_numpy()
    if not counts[True].any() or not counts[False].any():
        return UrlModel(None)
    model = UrlModel((log_likelihood(counts[True]) - log_likelihood(counts[False])).astype(np.float32))
    steps = int(REACH / STEP)
    placed = score(rows.where(held), model).groupBy("accepted", F.greatest(F.lit(-steps), F.least(
        F.lit(steps), F.floor(F.col("score") / STEP))).cast("int").alias("step")).count().collect()
    by = {True: np.zeros(2 * steps + 1), False: np.zeros(2 * steps + 1)}
    for r in placed:
        by[r.accepted][r.step + steps] = r["count"]
    if by[True].any() and by[False].any():
        kept = by[True][::-1].cumsum()[::-1] / by[True].sum()
        dropped = np.concatenate(([0], by[False].cumsum()[:-1])) / by[False].sum()
        best = np.flatnonzero(np.isclose(kept + dropped, (kept + dropped).max()))
        model.threshold = round(float((best[0] + best[-1]) / 2 - steps) * STEP, 6)
    return model
