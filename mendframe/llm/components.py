"""Connected components of a distributed edge table.

Alternating large-star and small-star rounds: every node is linked to the least
node it sees until only stars remain.  Minima are aggregated before any
shuffle, so a hub costs one row per task; the joins are plain sort-merge joins
whose hot side adaptive execution may split.  Each round is written to the
shared folder, and the driver sees one count and one checksum a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import cut, forget


def _forest(batches):
    """The edges of one task as stars around the least node of each local tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:
            yield _stars(parent, root)
            parent.clear()
    if parent:
        yield _stars(parent, root)


def _stars(parent: dict[int, int], root) -> pa.RecordBatch:
    nodes = [x for x in list(parent) if root(x) != x]
    return pa.record_batch([pa.array(np.array(nodes, dtype=np.int64)), pa.array(np.array([root(x) for x in nodes], dtype=np.int64))], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    if large:
        near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        least = cut(least, "least")  # a plain side, so that a hub's edges can be split over tasks
        return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u long, v long) edges -> (node, root): each linked node with the least
    node of its component.  Nodes without an edge don't appear; self-loops and
    repeated edges are harmless; an empty table gives an empty table."""
    edges = cut(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_forest, "u long, v long"), "edges")
    before = None
    while True:
        after = cut(_star(_star(edges, large=True), large=False), "stars")
        mark = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        forget(edges)
        edges = after
        if mark == before or not mark["n"]:
            break
        before = mark
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def across(placed: DataFrame) -> DataFrame:
    """(u, v): the pairs of nodes of one bucket that lie in different parts, of the
    rows (key, part, node) of ``placed``.  The parts meet first, so that a bucket
    all of which is one part costs its rows, not its pairs."""
    parts = placed.select("key", "part").distinct()
    meets = parts.withColumnRenamed("part", "one").join(parts.withColumnRenamed("part", "two"), "key").where("one < two")
    left, right = (placed.select("key", F.col("part").alias(p), F.col("node").alias(k)) for p, k in (("one", "a"), ("two", "b")))
    return meets.join(left, ["key", "one"]).join(right, ["key", "two"]).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
