"""Chains and cycles in wait-for graphs where each node waits for at most one other.

A graph of up to ``LIMIT`` waits is walked by the task that holds it (``ordered_cycles``, ``walks``): one
shuffle by graph, nothing written.  Larger graphs are cut up by pointer doubling: after ``r`` rounds a node knows who stands ``2**r`` steps
ahead, so a chain of ``n`` nodes needs ``log2(n)`` joins and no task ever holds
a whole graph.  Every third round is written, or the plan would double with it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.session import materialize


LIMIT = 1 << 16  # waits of a graph that one task may hold


def _split(edges: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """The graphs above the limit, or None."""
    large = materialize(edges.groupBy(*keys).count().where(F.col("count") > limit).select(*keys))
    return None if large.isEmpty() else large


def _walk_each(rows: DataFrame, keys: Sequence[str], out: Sequence[str], walk: Callable) -> DataFrame:
    """``keys`` and the long columns ``out`` of what ``walk`` makes of the rows of each graph."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in keys}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = walk(*[table.column(c).to_pylist() for c in table.column_names if c not in keys])
        columns = [pa.repeat(k, len(found)) for k in key] + [pa.array([f[i] for f in found], pa.int64()) for i in range(len(out))]
        return pa.Table.from_arrays(columns, names=[*keys, *out])

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{c} long" for c in out])
    return rows.groupBy(*keys).applyInArrow(run, schema)


def _cycles_of(nodes: list, tos: list, ranks: list) -> list[tuple]:
    """``(node, cycle_id, cycle_size, cycle_pos, cycle_rank)``: walks begin in order of rank, and a walk that meets
    itself has found the cycle at the place where it enters it."""
    to, seen, found = dict(zip(nodes, tos)), {}, []
    for rank, start in sorted(zip(ranks, nodes)):
        path, at = [], start
        while at in to and at not in seen:
            seen[at] = rank
            path.append(at)
            at = to[at]
        if seen.get(at) == rank:
            ring = path[path.index(at) :]
            found += [(node, min(ring), len(ring), pos, rank) for pos, node in enumerate(ring)]
    return found


def ordered_cycles(edges: DataFrame, node_order: DataFrame, keys: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """``keys, node, cycle_id, cycle_size, cycle_pos, cycle_rank`` of the nodes on cycles of two or more.

    ``edges (keys, node, to)`` has one row per node, ``node_order (keys, node, rank)`` a rank of its own for each.
    """
    out = ["node", "cycle_id", "cycle_size", "cycle_pos", "cycle_rank"]
    edges = edges.where("node <> to")
    large = _split(edges, keys, limit)
    small = edges if large is None else edges.join(large, list(keys), "left_anti")
    ranked = small.join(node_order.select(*keys, "node", "rank"), [*keys, "node"])
    found = _walk_each(
        ranked.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("node", "to", "rank")]), keys, out, _cycles_of
    )
    if large is None:
        return found
    rest = materialize(edges.join(large, list(keys), "left_semi"))
    return found.unionByName(cycle_order(rest, cycle_nodes(rest, keys), node_order, keys).select(*keys, *out))


def _walks_of(nodes: list, tos: list, starts: list) -> list[tuple]:
    """``(start, hop, node)`` up to the end of a chain or the first node met twice."""
    to, found = {n: t for n, t, s in zip(nodes, tos, starts) if not s}, []
    for start in {n for n, s in zip(nodes, starts) if s}:
        met, at, hop = {start}, start, 0
        while at in to:
            at, hop = to[at], hop + 1
            found.append((start, hop, at))
            if at in met:
                break
            met.add(at)
    return found


def walks(edges: DataFrame, starts: DataFrame, keys: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """``keys, start, hop, node``: who each node of ``starts`` waits for, hop by hop, as ``chains`` has it."""
    large = _split(edges, keys, limit)
    rows = edges.select(*keys, "node", "to", F.lit(0).alias("is_start")).unionByName(
        starts.select(*keys, "node", F.lit(None).cast("long").alias("to"), F.lit(1).alias("is_start")).distinct()
    )
    rows = rows.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("node", "to", "is_start")])
    small = rows if large is None else rows.join(large, list(keys), "left_anti")
    found = _walk_each(small, keys, ["start", "hop", "node"], _walks_of)
    if large is None:
        return found
    rest = materialize(edges.join(large, list(keys), "left_semi"))
    begun = starts.join(large, list(keys), "left_semi")
    return found.unionByName(chains(rest, begun, cycle_nodes(rest, keys), keys))


def _rounds(edges: DataFrame, keys: Sequence[str]) -> int:
    most = edges.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return max(int(most), 1).bit_length()


def _ahead(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair each row with the row of the node it points at."""
    other = right.select(*keys, F.col("node").alias("to"), *[F.col(c).alias(f"_{c}") for c in right.columns
                                                            if c not in (*keys, "node")])
    return left.join(other, [*keys, "to"])


def cycle_nodes(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, node, cycle_id, cycle_size`` for nodes on a cycle of two or more.

    ``edges`` holds ``keys, node, to`` with one row per node.  ``cycle_id`` is
    the smallest node on the cycle.
    """
    hops = materialize(edges.where("node <> to").select(*keys, "node", "to", F.col("node").alias("low")))

    def twice(h: DataFrame) -> DataFrame:
        return _ahead(h, h, keys).select(*keys, "node", F.col("_to").alias("to"), F.least("low", "_low").alias("low"))

    for _ in range(0, _rounds(hops, keys), 3):
        hops = materialize(twice(twice(twice(hops))))
        if hops.isEmpty():  # every chain has ended: no cycle anywhere
            break
    ends = hops.select(*keys, F.col("to").alias("node")).distinct()
    found = hops.join(ends, [*keys, "node"], "left_semi").select(*keys, "node", F.col("low").alias("cycle_id"))
    sizes = found.groupBy(*keys, "cycle_id").agg(F.count(F.lit(1)).alias("cycle_size"))
    return found.join(sizes, [*keys, "cycle_id"]).select(*keys, "node", "cycle_id", "cycle_size")


def steps_to(edges: DataFrame, stops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, node, stop, steps``: the first stop each node reaches, stops included."""
    at_rest = stops.select(*keys, "node", F.col("node").alias("to"), F.lit(0).cast("long").alias("steps"))
    moving = edges.join(stops, [*keys, "node"], "left_anti").select(
        *keys, "node", "to", F.lit(1).cast("long").alias("steps")
    )
    state = materialize(at_rest.unionByName(moving))

    def twice(s: DataFrame) -> DataFrame:
        return _ahead(s, s, keys).select(
            *keys, "node", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps")
        )

    for _ in range(0, _rounds(state, keys), 3):
        state = materialize(twice(twice(twice(state))))
    reached = stops.select(*keys, F.col("node").alias("to"))
    return state.join(reached, [*keys, "to"], "left_semi").select(*keys, "node", F.col("to").alias("stop"), "steps")


def cycle_order(edges: DataFrame, cycles: DataFrame, node_order: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cycles`` plus ``cycle_pos``: walking order from the node where the first
    node (by ``node_order.rank``) that leads into the cycle enters it."""
    entry = steps_to(edges, cycles.select(*keys, "node"), keys).join(
        cycles.select(*keys, F.col("node").alias("stop"), "cycle_id"), [*keys, "stop"]
    )
    first = (
        entry.join(node_order, [*keys, "node"])
        .groupBy(*keys, "cycle_id")
        .agg(F.min_by("stop", "rank").alias("node"), F.min("rank").alias("cycle_rank"))
    )
    inside = edges.join(cycles.select(*keys, "node"), [*keys, "node"], "left_semi")
    back = steps_to(inside, first.select(*keys, "node"), keys).select(*keys, "node", "steps")
    return (
        cycles.join(back, [*keys, "node"])
        .join(first.select(*keys, "cycle_id", "cycle_rank"), [*keys, "cycle_id"])
        .withColumn("cycle_pos", (F.col("cycle_size") - F.col("steps")) % F.col("cycle_size"))
        .drop("steps")
    )


def chains(edges: DataFrame, starts: DataFrame, cycles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, start, hop, node``: who each start waits for, hop by hop.

    A chain ends where nobody is waited for, or with the first node met twice
    (that node is listed).
    """
    jumps = [materialize(edges.select(*keys, "node", "to"))]
    for _ in range(_rounds(jumps[0], keys) - 1):
        step = materialize(_ahead(jumps[-1], jumps[-1], keys).select(*keys, "node", F.col("_to").alias("to")))
        if step.isEmpty():
            break
        jumps.append(step)

    loops = edges.where("node = to").select(*keys, "node", F.lit(1).cast("long").alias("cycle_size"))
    rings = cycles.select(*keys, "node", "cycle_size").unionByName(loops)
    limit = steps_to(edges, rings.select(*keys, "node"), keys).join(
        rings.withColumnRenamed("node", "stop"), [*keys, "stop"]
    ).select(*keys, F.col("node").alias("start"), (F.col("steps") + F.col("cycle_size")).alias("_limit"))

    rows = (
        starts.select(*keys, F.col("node").alias("start"), F.lit(0).cast("long").alias("hop"), F.col("node").alias("to"))
        .distinct()
        .join(limit, [*keys, "start"], "left")
    )
    for power in reversed(range(len(jumps))):
        moved = _ahead(rows, jumps[power], keys).select(
            *keys, "start", (F.col("hop") + 2**power).alias("hop"), F.col("_to").alias("to"), "_limit"
        )
        moved = moved.where(F.col("_limit").isNull() | (F.col("hop") <= F.col("_limit")))
        rows = materialize(rows.unionByName(moved))
    return rows.where("hop > 0").select(*keys, "start", "hop", F.col("to").alias("node"))
