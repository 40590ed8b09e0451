"""Connected components of links between ids, by contraction of a shrinking graph.

Each partition first replaces its links by a spanning forest. While more than ``LOCAL`` links are left, every node points
to the neighbour (or itself) of least hashed priority, and the graph is contracted along these pointers; the priorities
are new in each round, so a path shrinks by a constant factor, whatever its order. What is left is joined by one task,
whose memory that bound limits. All tables live in the shared folder between rounds; the driver only learns counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import Scratch


class Forest:
    """Union-find over ids with their least member as root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches):
    held = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.union(a, b)
    nodes = [x for x in held.parent if held.find(x) != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([held.find(x) for x in part], pa.int64())], names=["a", "b"])


#: Links that one task joins by itself: a bound on its memory, beyond which the graph is contracted first.
LOCAL = 200_000


def _joined(edges: DataFrame) -> DataFrame:
    """(a, b) of few links to (a, b): every node and the least node that it reaches, by one task."""

    def solve(batches):
        held = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.union(a, b)
        nodes = list(held.parent)
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([held.find(x) for x in part], pa.int64())], names=["a", "b"])

    return edges.select("a", "b").repartition(1).mapInArrow(solve, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links(a, b) of longs to (node, component): the least id that a node reaches; nodes without links are left out."""
    edges = scratch.write(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long"), "edges")
    if edges.count() <= LOCAL:
        out = scratch.write(_joined(edges).select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
        scratch.drop(edges)
        return out
    nodes = scratch.write(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    labels = scratch.write(nodes.select("node", F.col("node").alias("at")), "labels")
    step, last = 0, False
    while not last:
        def rank(c, k=step):
            return F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("id"))

        last = edges.count() <= LOCAL
        if last:
            points = _joined(edges).select(F.col("a").alias("n"), F.col("b").alias("to"))
        else:
            both = edges.select(F.col("a").alias("n"), rank("b").alias("r")).union(edges.select(F.col("b").alias("n"), rank("a").alias("r")))
            points = both.groupBy("n").agg(F.min("r").alias("r")).select("n", F.least("r", rank("n")).getField("id").alias("to"))
        points = scratch.write(points, "pointers")
        relabelled = scratch.write(labels.join(points, labels["at"] == points.n, "left").select("node", F.coalesce("to", "at").alias("at")), "labels")
        if not last:
            moved = edges.join(points, edges.a == points.n).select(F.col("to").alias("a"), "b")
            moved = moved.join(points, moved.b == points.n).select("a", F.col("to").alias("b")).where("a <> b")
            fewer = scratch.write(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
            scratch.drop(edges)
            edges = fewer
        scratch.drop(points, labels)
        labels, step = relabelled, step + 1
    least = labels.groupBy("at").agg(F.min("node").alias("component"))
    out = scratch.write(labels.join(least, "at").select("node", "component"), "components")
    scratch.drop(edges, nodes, labels)
    return out
