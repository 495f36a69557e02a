"""Connected components by contraction: hook, compress, relabel, repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.scratch import Scratch

#: Edges that a task holds at a time, about.
EDGES = 1_000_000


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest node of each component to its other nodes, or to itself if there are none."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), code[:len(a)], code[len(a):]
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    kept = (root != np.arange(len(nodes))) | (np.bincount(root, minlength=len(nodes)) == 1)
    return nodes[root[kept]], nodes[kept]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges with the same nodes and components: those of a task are put together before anything is written."""
    held, size = [], 0
    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        size += batch.num_rows
        if size >= EDGES:
            held = [_stars(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            size = len(held[0][0])
            if 2 * size >= EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["a", "b"])
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in _stars(*(np.concatenate(c) for c in zip(*held, strict=True)))], ["a", "b"])


def compress(parents: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Point every node of a forest ``(node, parent)`` at its root.

    Pointer jumping: each pass jumps twice, so the passes grow with the
    logarithm of the depth. Roots are not listed as nodes.
    """
    step = 0
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        once = parents.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))
        twice = once.join(up, "parent", "left").select(
            "node", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved"),
        )
        twice = scratch.save(twice, f"{name}-jump-{step}")
        parents, step = twice.select("node", "parent"), step + 1
        if twice.where("moved").isEmpty():
            return parents


def components(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``pairs(a, b)``.

    A component's name is its smallest node. Each round points every node at
    its smallest neighbour if that is smaller, and contracts the edges to the
    roots reached, so the edge table shrinks until nothing is left. The
    pairs themselves are not written: a task first joins those it has.
    """
    scratch = scratch or Scratch(pairs.sparkSession, "components")
    first = scratch.save(pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_joined, "a long, b long"), "edges-0")
    edges, n = first, 0
    hooks = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.save(
            ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
            .where(F.col("parent") < F.col("node")),
            f"hooks-{n}",
        )
        roots = compress(hooks, scratch, f"round-{n}")
        edges = edges.select("a", "b")
        for end in ("a", "b"):
            to = roots.select(F.col("node").alias(end), F.col("parent").alias("root"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = scratch.save(
            edges.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            f"edges-{n + 1}",
        )
        n += 1
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if hooks is None:
        return nodes.withColumn("component", F.col("node"))
    # a node is hooked once, in the round it stops being a root
    roots = compress(scratch.load("hooks-*", hooks), scratch, "all")
    return nodes.join(roots, "node", "left").select(
        "node", F.coalesce("parent", "node").alias("component")
    )
