"""Periodic runs of words: a dictionary of basic factors proposes periods.

A *run* is a stretch of words with smallest period q, of at least ``TIMES``
periods and ``LEAST`` words, that cannot be made longer. Basic factors are
the stretches of 1, 2, 4, ... words; each gets a name, equal for equal
stretches of a document, from the names of its two halves. In a run of
period q, with L the smallest power of two that is at least q, the factor of L words at a
place occurs next exactly q words later: earlier would contradict the smallest
period. So for every L, places whose next occurrence lies d words ahead, L / 2 < d <= L, and thus both
inside the twice as long stretch that begins there, are chained to
arithmetic progressions of difference d. Each proposes period d. Of the up
to d progressions of a run only the first is kept, if it may be long enough; it is
extended on both sides as far as words d apart agree, and equal results are
folded.

Names that occur once are dropped, and what begins with one has none on
the next level: after a few levels only repeated places are left. Documents
are worked on together, about ``SLICE_BYTES`` of text at a time, with words
named per document so that nothing matches across. The memory of a task is
some 20 numbers per word of a slice, or of one longer document.

Input rules: words are what lies between blanks (space and \\t to \\r); a null text
has none, and neither has an empty one; a repeated row gives a repeated
result; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, slices, text_bytes

#: Fewest words, and fewest periods, of a run.
LEAST, TIMES = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"


def _names(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names by place (-1: occurs once), then places that have one, and the place of the next occurrence of each (or -1)."""
    names = np.full(n, -1, np.int64)
    if not len(keys):
        return names, at, at
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    again = keys[1:] == keys[:-1]
    named = np.concatenate(([False], again)) | np.concatenate((again, [False]))
    names[at] = np.where(named, np.concatenate(([0], np.cumsum(~again))), -1)
    following = np.concatenate((np.where(again, at[1:], -1), [-1]))
    return names, at[named], following[named]


def _proposals(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(first, end, d)``: words of progressions, words d apart agree from ``first`` up to ``end``."""
    n, size = len(words), 1
    names, places, following = _names(words, np.arange(n), n)
    while len(places):
        gap = following - places
        near = np.zeros(n + 1, np.int64)  # the last entry answers for place -1
        fits = (following >= 0) & (2 * gap > size) & (gap <= size)
        near[places[fits]] = gap[fits]
        own = near[:n]
        held = np.flatnonzero(own)
        d = own[held]
        # a progression begins where no equal step ends, and the run's first one where no neighbour proposes the same
        before = np.where(held >= d, held - d, n)
        begins = (near[before] != d) & (near[held - 1] != d)
        # the neighbours that propose the same step go on up to the run's last factor
        breaks = np.flatnonzero(np.concatenate((np.diff(held) != 1, [True])) | np.concatenate((np.diff(d) != 0, [True])))
        last = held[breaks[np.searchsorted(breaks, np.arange(len(held)))]]
        end = last + size + d
        for k in np.flatnonzero(begins & (end - held + 2 * d >= np.maximum(LEAST, TIMES * d))).tolist():
            yield int(held[k]), int(end[k]), int(d[k])
        # names of the stretches twice as long, where both halves have one
        places = np.sort(places)
        places = places[places + size < n]
        right = names[places + size]
        places, right = places[right >= 0], right[right >= 0]
        names, places, following = _names(names[places] * n + right, places, n)
        size *= 2


def _extended(words: np.ndarray, first: int, end: int, d: int) -> tuple[int, int]:
    """The whole stretch around ``[first, end)`` in which words d apart agree."""
    while end < len(words) and (new := min(len(words), end + d)):
        other = np.flatnonzero(words[end:new] != words[end - d: new - d])
        if len(other):
            end += int(other[0])
            break
        end = new
    while first > 0:
        new = max(0, first - d)
        other = np.flatnonzero(words[new:first] != words[new + d: first + d])
        if len(other):
            first = new + int(other[-1]) + 1
            break
        first = new
    return first, end


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence of word numbers, in order."""
    found = set()
    for first, end, d in _proposals(words):
        first, end = _extended(words, first, end, d)
        if end - first >= max(LEAST, TIMES * d):
            found.add((first, end - first, d))
    return sorted(found)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, of every run only the first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, runs, collapsed)``: the runs by start and period, and the text without their later periods.

    A word is dropped if a run holds it after that run's first period; the words that stay are joined by one space.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for i, j in slices(at):
                texts = [data[at[k]: at[k + 1]].tobytes().split() for k in range(i, j)]
                numbers, starts, used = [], [0], 0
                for words in texts:
                    own: dict[bytes, int] = {}
                    numbers.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words)) + used)
                    used += len(own)
                    starts.append(starts[-1] + len(words))
                runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                found = find_runs(np.concatenate(numbers))
                homes = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
                for (start, length, period), home in zip(found, homes.tolist(), strict=True):
                    runs[home].append((start - starts[home], length, period))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(w) for w in texts], pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], kind),
                     pa.array(map(_collapsed, texts, runs), pa.binary()).view(pa.string())],
                    [id_col, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with most periods; of equals, that of smallest start, then period. Null if there is none."""
    none = F.lit(None).cast(RUNS[6:-1])
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame, share: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with a periodic tail written into every ``share``-th text, chosen by the crc32 of the id.

    With g = crc32 DIV 10, words from a = g % n on repeat the p = 1 + (n - a) DIV (3 + g % 8) words that begin there.
    Texts without words, and the other rows, stay as they are; a null id counts as the empty string.
    """
    bounded_batches(docs.sparkSession)
    drawn = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))

    @F.pandas_udf("string")
    def repeated(texts: pd.Series, draws: pd.Series) -> pd.Series:
        out = []
        for text, h in zip(texts, draws, strict=True):
            words = text.encode().split() if text is not None else []
            if words:
                n, g = len(words), int(h) // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words[a:] = [words[a + k % p] for k in range(n - a)]
            out.append(b" ".join(words).decode() if words else text)
        return pd.Series(out, dtype=object)

    text = F.col(text_col)
    return docs.withColumn(text_col, F.when(drawn % share == 0, repeated(F.when(drawn % share == 0, text), drawn)).otherwise(text))
