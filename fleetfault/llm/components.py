"""Connected components of an undirected graph: forests inside tasks, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.llm.words import resting
from fleetfault.session import written

CHUNK = 1 << 20  # edges that a task holds


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, ascending, and the lowest node that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        least = np.minimum(low[x], low[y])
        for side in (x, y):
            np.minimum.at(low, side, least)
            np.minimum.at(low, before[side], least)
        low = low[low]
        if (low == before).all():
            return nodes, nodes[low]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the lowest node of each component of every ``CHUNK`` edges of a task to its others."""

    def flush(parts: list) -> pa.RecordBatch:
        nodes, low = _labels(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        n += batch.num_rows
        if n >= CHUNK:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its lowest neighbour to its larger (or its other smaller) neighbours."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(lowest, "a")
    if large:
        return met.where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    other = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return other.unionByName(lowest.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; a component is its lowest node.

    Edges in either direction, repeated or from a node to itself are all right.  Tasks first reduce
    their edges to a forest, ``CHUNK`` edges at a time.  What is left is often few: up to ``CHUNK`` edges one more forest is the
    answer.  Otherwise stars take over; their rounds grow with the logarithm of the longest shortest
    path, and each leaves edges that point downwards, at most one more than there were.  A node with
    very many neighbours is summed before the shuffle and its join is split.
    """
    schema = "a long, b long"

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return resting(_forest(batches))

    # Loops stay in: they name the nodes without other edges.
    current = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(forest, schema))
    left = current.count()
    while left > CHUNK:
        tasks = -(-left // CHUNK)
        merged = written(current.repartition(tasks, F.greatest("a", "b")).mapInArrow(forest, schema))
        before, left = left, merged.count()
        current = merged
        if left > 0.7 * before:
            break
    if left <= CHUNK:
        return written(current.coalesce(1).mapInArrow(forest, schema)).select(F.col("a").alias("node"), F.col("b").alias("component"))

    nodes = written(current.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    current = written(
        current.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        current = written(_star(_star(current, True), False))
        now = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        if now == state:
            break
        state = now
    return nodes.join(current.select(F.col("a").alias("node"), "b"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )
