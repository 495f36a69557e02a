"""Fill-in-middle: documents cut in three and reordered, cuts found by Fenwick trees over text blocks.

A text is a sequence of units, its code points unless a pattern is given. Its
UTF-8 bytes lie in blocks of ``BLOCK_BYTES``; two Fenwick trees over the blocks
hold how many units and how many code points begin in each. A cut after k units
is found by binary-lifting descent: from the highest power of two down, the
position advances by a power while the units passed stay at most k. That names
the block, and both counts before it, in a logarithm of the number of blocks;
the boundary is then looked up among the bytes of that block alone.

``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>``
prefix ``<M>`` middle. Draws come from the SHA-256 of seed and id, so a lost task
draws the same again. A text that holds a marker stays plain, hence each marker
occurs once in what is not plain, and ``restored`` finds the parts again.

Units by a pattern are its matches from left to right; what lies between two
matches goes with the one before, what lies before the first with the first.

Input rules: a null text is the empty text, which stays plain; a null id draws
as the empty string; a repeated row gives a repeated result; other columns are
left out unless named in ``keep``, and must not clash with the columns added; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, slices, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of documents that are cut, and percent of those that put the suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20
BLOCK_BYTES = 512


def _fenwick(counts: np.ndarray) -> np.ndarray:
    """The tree over counts; entry i sums the ``i & -i`` counts that end with the i-th."""
    at = np.arange(len(counts) + 1)
    before = np.concatenate(([0], np.cumsum(counts)))
    return before - before[at - (at & -at)]


class Blocks:
    """The units and code points of one text, counted by blocks of its bytes."""

    def __init__(self, data: np.ndarray, pattern: regex.Pattern | None = None) -> None:
        self.size = len(data)
        self.points = (data & 0xC0) != 0x80  # bytes that begin a code point
        self.units = self.points if pattern is None else self._matches(data, pattern)
        edges = np.arange(0, max(1, self.size), BLOCK_BYTES)
        count = lambda marks: np.add.reduceat(marks, edges, dtype=np.int64) if self.size else np.zeros(1, np.int64)
        n_units, n_points = count(self.units), count(self.points)
        self.n, self.n_points = int(n_units.sum()), int(n_points.sum())
        self.unit_tree, self.point_tree = _fenwick(n_units).tolist(), _fenwick(n_points).tolist()

    def _matches(self, data: np.ndarray, pattern: regex.Pattern) -> np.ndarray:
        begins = np.flatnonzero(self.points)
        marks = np.zeros(self.size, bool)
        marks[begins[[m.start() for m in pattern.finditer(data.tobytes().decode()) if m.end() > m.start()]]] = True
        return marks

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the boundary that follows k units."""
        if k <= 0:
            return 0, 0
        if k >= self.n:
            return self.size, self.n_points
        block, left, points, last = 0, k, 0, len(self.unit_tree) - 1
        step = 1 << last.bit_length()
        while step := step >> 1:
            there = block + step
            if there <= last and self.unit_tree[there] <= left:
                block, left, points = there, left - self.unit_tree[there], points + self.point_tree[there]
        start = block * BLOCK_BYTES
        at = int(np.flatnonzero(self.units[start: start + BLOCK_BYTES])[left])
        return start + at, points + int(self.points[start: start + at].sum())


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _put_together(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == PSM else (s, suffix, p, prefix, m, middle))


def transform(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
              unit: str | None = None, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``(id_col, *keep, n, form, prefix_chars, middle_chars, output)`` of every row.

    ``n`` counts units; the lengths are code points, null in a plain row.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    first, second, cut, order = draws(F.col(id_col), seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (cut % 100 >= cut_percent), PLAIN).when(
        order % 100 < spm_percent, SPM).otherwise(PSM)
    rows = docs.select(id_col, *keep, first.alias("__first"), second.alias("__second"), form.alias("form"), text.alias("__text"))
    kept = [id_col, *keep]
    pattern = regex.compile(unit) if unit else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column("__text"))
            draw = [batch.column(c).to_pylist() for c in ("__first", "__second", "form")]
            for i, j in slices(at):
                sizes, lengths, outputs = [], [], []
                for k in range(i, j):
                    own = data[at[k]: at[k + 1]]
                    blocks = Blocks(own, pattern)
                    sizes.append(blocks.n)
                    if draw[2][k] == PLAIN:
                        lengths.append((None, None))
                        outputs.append(own.tobytes())
                        continue
                    ends = sorted(draw[c][k] % (blocks.n + 1) for c in (0, 1))
                    (a, points_a), (b, points_b) = (blocks.cut(e) for e in ends)
                    lengths.append((points_a, points_b - points_a))
                    outputs.append(_put_together(draw[2][k], own[:a].tobytes(), own[a:b].tobytes(), own[b:].tobytes()))
                some = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in kept), pa.array(sizes, pa.int64()), some.column("form"),
                     *(pa.array([x[c] for x in lengths], pa.int64()) for c in (0, 1)),
                     pa.array(outputs, pa.binary()).view(pa.string())],
                    [*kept, "n", "form", "prefix_chars", "middle_chars", "output"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # the first part is empty, the last one the middle
    one, two, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == PSM, F.concat(one, middle, two)).when(form == SPM, F.concat(two, middle, one)).otherwise(output)
