"""SimHash groups: fingerprints joined with themselves by walking pairs of nodes of a binary trie.

A text's fingerprint has a bit set where more than half of its shingle hashes
have it set. Fingerprints link if they differ in at most ``BUDGET`` bits. They
are folded first, so that copies cost one number.

A node of the trie is a prefix and stands for the fingerprints that begin with
it. Two nodes of one depth are walked together; their children pair up, and a
pair of children that differ in their last bit has one error more than its parents.
A pair of nodes with more errors than the budget is not entered. Sorted
fingerprints are the trie: a node is a range, and its children are where the
next bit changes. Pairs of small nodes are compared by counting differing bits.

Two nodes whose fingerprints are all in one group already are not entered either,
as their links would change no group. Neighbours in sorted order are tried first, and
so a crowd of near copies is walked in about its own size, not its square.

How tasks get their parts. ``BUDGET`` errors leave one of ``BUDGET + 1`` blocks of the
64 bits without an error. So fingerprints are rotated to each block in turn, and
the walk starts at the node pairs of equal blocks, without an error: five rows a
fingerprint. A *cell* is such a pair of nodes and what is below them.
Cells above ``CELL`` members go ``STEP`` bits down the trie on Spark, by the same rule, until none is left:
their members are dealt to the pairs of nodes below that the budget allows and that have
members on both sides. Hence no task holds a whole hot block. A cell returns links that
join groups, fewer than it has members; the groups come from them as connected components.

Input rules: A-Z are lower-cased; words are what lies between blanks; fewer
words than a shingle are one shingle; no words (null and empty texts included) have fingerprint
zero, which links like any other. Rows are linked by their fingerprints alone, so
rows of one id are separate and may be in several groups. A null id names no
group: it gets the smallest id of its group, null if there is none. Other columns are left out;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, shuffles, slices, text_bytes
from postloom.operators.components import components
from postloom.scratch import Scratch

#: Words of a shingle, seed of their hashes, and the most bits in which linked fingerprints differ.
SHINGLE, SEED, BUDGET = 4, 42, 4
#: Members of a cell that one task may hold, and bits by which a larger one goes down.
CELL, STEP = 4096, 4
#: Members walked together in a task, node pairs walked at a time, pairs of fingerprints compared at a time.
TOGETHER, WALKED, COMPARED = 1 << 16, 1 << 17, 1 << 20
#: Node pairs that stand for up to this many pairs of fingerprints are compared.
SMALL = 16
_PLACE = ["rot", "depth", "pa", "pb", "errors"]


def _majority(hashes: list[int]) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[k: k + (1 << 16)], "<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    one = xxhash.xxh64_intdigest
    return _majority([one(flat[a:b], seed) for a, b in zip(starts, ends)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` holds the 64 bits as a signed number."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for i, j in slices(at):
                found = np.array([fingerprint(data[at[k]: at[k + 1]].tobytes()) for k in range(i, j)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, "id long, fp long")


def _widths(budget: int) -> list[int]:
    """Sizes of the blocks into which the 64 bits are cut."""
    return [64 // (budget + 1) + (k < 64 % (budget + 1)) for k in range(budget + 1)]


def _started(fps: DataFrame, budget: int) -> DataFrame:
    """Every fingerprint once a rotation, at the node of its leading block."""
    widths = _widths(budget)
    turned = []
    for k, width in enumerate(widths):
        by = sum(widths[:k])
        r = F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", 64 - by)) if by else F.col("fp")
        turned.append(F.struct(F.lit(by).alias("rot"), F.lit(width).alias("depth"), r.alias("r")))
    node = F.expr("shiftrightunsigned(x.r, 64 - x.depth)")
    return fps.select(F.explode(F.array(*turned)).alias("x")).select(
        "x.rot", "x.depth", node.alias("pa"), node.alias("pb"), F.lit(0).alias("errors"), F.lit(0).alias("side"), "x.r")


def _below(members: DataFrame, budget: int) -> DataFrame:
    """Members of large cells dealt to the cells ``STEP`` bits below that are within the budget."""
    fan = 1 << STEP
    near = [[[y, (x ^ y).bit_count()] for y in range(fan) if (x ^ y).bit_count() <= budget] for x in range(fan)]
    kind = F.array(*[F.array(*[F.struct(F.lit(y).cast("long").alias("y"), F.lit(e).alias("e")) for y, e in row]) for row in near])
    own = F.expr(f"shiftrightunsigned(r, 64 - {STEP} - depth)").bitwiseAND(F.lit(fan - 1).cast("long"))
    dealt = members.withColumn("x", own).withColumn("o", F.explode(F.get(kind, F.col("x").cast("int"))))
    dealt = dealt.where(F.col("errors") + F.col("o.e") <= budget)
    self_pair, first = F.col("pa") == F.col("pb"), F.col("side") == 0
    down = lambda p, bits: F.shiftleft(p, STEP).bitwiseOR(bits)
    x, y = F.col("x"), F.col("o.y")
    left = F.when(self_pair, F.least(x, y)).when(first, x).otherwise(y)
    right = F.when(self_pair, F.greatest(x, y)).when(first, y).otherwise(x)
    side = F.when(self_pair, (x > y).cast("int")).otherwise(F.col("side"))
    return dealt.select(
        "rot", (F.col("depth") + STEP).alias("depth"), down("pa", left).alias("pa"), down("pb", right).alias("pb"),
        (F.col("errors") + F.col("o.e")).alias("errors"), side.alias("side"), "r")


class _Groups:
    """Groups of the members in a task, and the links that made them."""

    def __init__(self, n: int) -> None:
        self.label, self.parent, self.links = np.arange(n), np.arange(n), []
        self._count()

    def _count(self) -> None:
        self.change = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.label[i] != self.label[j]
        if not apart.any():
            return
        i, j, parent = i[apart], j[apart], self.parent
        for a, b, x, y in zip(i.tolist(), j.tolist(), self.label[i].tolist(), self.label[j].tolist()):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.links.append((a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        self.parent, self.label = parent, parent[self.label]
        self._count()

    def one(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Whether two nodes each lie in one group, the same."""
        return ((self.change[a1 - 1] == self.change[a0]) & (self.change[b1 - 1] == self.change[b0])
                & (self.label[a0] == self.label[b0]))


def _compare(r: np.ndarray, pairs: np.ndarray, groups: _Groups, budget: int) -> None:
    """All fingerprints of one node with all of the other."""
    sizes = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
    total = np.cumsum(sizes)
    cuts = [0, *np.searchsorted(total, np.arange(COMPARED, total[-1], COMPARED)).tolist(), len(sizes)]
    for lo, hi in zip(cuts, cuts[1:]):
        a0, _, b0, b1 = (x[lo:hi] for x in pairs[:4])
        n = sizes[lo:hi]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(b1 - b0, n)
        i, j = np.repeat(a0, n) + at // wide, np.repeat(b0, n) + at % wide
        near = (np.bitwise_count(r[i] ^ r[j]) <= budget) & (i < j)
        groups.unite(i[near], j[near])


def walk(r: np.ndarray, starts: np.ndarray, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Links that join groups, among members ``r`` sorted within their nodes.

    ``starts`` has a column per node pair: the two ranges ``a0, a1, b0, b1``, the errors so far and the depth.
    """
    groups = _Groups(len(r))
    edges = np.arange(len(r) - 1)
    inside = np.zeros(len(r), np.int64)
    inside[starts[0]] = inside[starts[2]] = 1
    inside = np.cumsum(inside)
    edges = edges[(inside[1:] == inside[:-1]) & (np.bitwise_count(r[1:] ^ r[:-1]) <= budget)]
    groups.unite(edges, edges + 1)
    ones: dict[int, np.ndarray] = {}

    def step(depth: int, pairs: np.ndarray) -> np.ndarray:
        if depth not in ones:
            bits = (r >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bits.astype(np.int32))))
        a0, a1, b0, b1, errors = pairs
        a, b = a1 - (ones[depth][a1] - ones[depth][a0]), b1 - (ones[depth][b1] - ones[depth][b0])
        other = a0 != b0
        made = [(a0, a, b0, b, errors), (a, a1, b, b1, errors), (a0, a, b, b1, errors + 1),
                tuple(x[other] for x in (a, a1, b0, b, errors + 1))]
        return np.concatenate([np.stack(m) for m in made], axis=1)

    stack = [(int(d), starts[:5, starts[5] == d]) for d in np.unique(starts[5])]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > WALKED:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, half:]), (depth, pairs[:, :half])]
            continue
        a0, a1, b0, b1, errors = pairs
        live = (a1 > a0) & (b1 > b0) & (errors <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        pairs = pairs[:, live]
        pairs = pairs[:, ~groups.one(*pairs[:4])]
        if not pairs.shape[1]:
            continue
        few = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= SMALL
        if depth >= 64:
            few[:] = True
        if few.any():
            _compare(r, pairs[:, few], groups, budget)
        if not few.all():
            stack.append((depth + 1, step(depth, pairs[:, ~few])))
    return groups.links


def _walk_cells(table: pa.Table, budget: int) -> pa.RecordBatch:
    """Links of whole cells, whose rows are sorted by cell, side and fingerprint."""
    columns = {c: table.column(c).to_numpy() for c in (*_PLACE, "side", "r")}
    r, n = np.ascontiguousarray(columns["r"]).view(np.uint64), len(columns["r"])
    differs = np.zeros(n - 1, bool)
    for c in _PLACE:
        differs |= columns[c][1:] != columns[c][:-1]
    lo = np.concatenate(([0], np.flatnonzero(differs) + 1))
    hi = np.concatenate((lo[1:], [n]))
    second = np.add.reduceat(columns["side"], lo)
    alone = columns["pa"][lo] == columns["pb"][lo]
    starts = np.stack([lo, np.where(alone, hi, hi - second), np.where(alone, lo, hi - second), hi,
                       columns["errors"][lo], columns["depth"][lo]]).astype(np.int64)
    links = np.array(walk(r, starts, budget), np.int64).reshape(-1, 2)
    by = columns["rot"][links[:, 0]].astype(np.uint64)
    back = lambda x: np.where(by == 0, x, (x >> by) | (x << (np.uint64(64) - by) % np.uint64(64))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(back(r[links[:, k]])) for k in (0, 1)], ["a", "b"])


def links(fps: DataFrame, scratch: Scratch, budget: int = BUDGET) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints ``(fp)``, enough to join all groups that are linked; a written table."""
    members, done, n = scratch.save(_started(fps, budget), "cells-0"), None, 0
    while True:
        sizes = members.groupBy(*_PLACE).agg(
            F.count(F.lit(1)).alias("size"), F.min("side").alias("low"), F.max("side").alias("high"))
        live = scratch.save(sizes.where(
            ((F.col("pa") == F.col("pb")) & (F.col("size") > 1)) | (F.col("low") < F.col("high"))).select(*_PLACE, "size"), f"sizes-{n}")
        placed = scratch.save(members.join(live, _PLACE), f"placed-{n}")
        large = (F.col("size") > CELL) & (F.col("depth") + STEP <= 64)  # a deeper cell holds a few numbers only
        ready = placed.where(~large).drop("size")
        done = ready if done is None else done.unionByName(ready)
        large = placed.where(large).drop("size")
        if large.isEmpty():
            break
        n += 1
        members = scratch.save(_below(large, budget), f"cells-{n}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                whole = pa.Table.from_batches(held)
                last = np.zeros(whole.num_rows - 1, bool)
                for c in _PLACE:
                    values = whole.column(c).to_numpy()
                    last |= values[1:] != values[:-1]
                cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if cut:
                    yield _walk_cells(whole.slice(0, cut), budget)
                held = whole.slice(cut).to_batches()
        if held:
            yield _walk_cells(pa.Table.from_batches(held), budget)

    order = [*_PLACE, "side", "r"]
    cells = done.select(*order).repartition(shuffles(fps.sparkSession), *_PLACE).sortWithinPartitions(*order)
    return scratch.save(cells.mapInArrow(run, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text",
                    budget: int = BUDGET) -> DataFrame:
    """``(id, fp, component)`` of every row; a component's name is its smallest id."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    joined = components(links(distinct.select("fp"), scratch, budget), Scratch(docs.sparkSession, "groups"))
    named = scratch.save(distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")), "named")
    least = scratch.save(named.groupBy("component").agg(F.min("first").alias("least")), "least")
    of = scratch.save(named.join(least, "component").select("fp", F.col("least").alias("component")), "of")
    return rows.join(of, "fp").select("id", "fp", "component")


def as_hex(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
