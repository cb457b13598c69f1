"""Anchored de-duplication of neighbouring rows.

A row merges into the last *kept* row when both agree on ``same`` and lie
within ``window_ms`` of each other; otherwise it is kept and becomes the new
anchor.  The anchor does not move with merged rows, so this is neither a
session window nor a gap rule, and each decision depends on the one before.

Rows are range-placed by ``(keys, order)``, which splits a hot key over tasks.
Each task tells in one row of bounded size how it maps an incoming anchor to an outgoing one
(needed only when a single run fills the task); the driver walks these rows,
one per task; a second sweep decides each row knowing its incoming anchor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.session import materialize

_SUMMARY = (
    "part int, first_sig string, last_sig string, one_run boolean, out_ms long, out_id long, "
    "lows array<long>, highs array<long>, step_ms array<long>, step_id array<long>"
)
_NONE = np.iinfo(np.int64).min  # stands for a missing time inside tasks


def _greedy_end(ms: np.ndarray, start: int, window: int, known: dict[int, int]) -> int:
    """Last anchor reached inside ``ms`` when row ``start`` is kept."""
    path, at = [], start
    while at not in known:
        path.append(at)
        step = 256
        nxt, low = len(ms), at + 1
        while low < len(ms):
            part = ms[low : low + step]
            far = (part == _NONE) | (np.abs(part - ms[at]) > window) if ms[at] != _NONE else np.ones(len(part), bool)
            if far.any():
                nxt = low + int(far.argmax())
                break
            low += step
            step *= 2
        if nxt == len(ms):
            known[at] = at
            break
        at = nxt
    end = known[at]
    for p in path:
        known[p] = end
    return end


def _steps(ms: np.ndarray, ids: np.ndarray, window: int):
    """Which incoming anchor times survive to which row, and where each exit leads.

    No anchor outlives the first row at which the rows so far lie more than two windows
    apart.  Times are whole milliseconds, so at most ``4 * window + 3`` steps come before it.
    """
    seen_none = np.flatnonzero(ms == _NONE)
    stop = int(seen_none[0]) if len(seen_none) else len(ms)
    low = np.maximum.accumulate(ms[:stop]) - window
    high = np.minimum.accumulate(ms[:stop]) + window
    none_left = np.flatnonzero(low > high)
    if len(none_left):
        stop = int(none_left[0]) + 1
        low, high = low[:stop], high[:stop]
    change = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if stop else np.array([], int)
    lows, highs = list(low[change]), list(high[change])
    rows = [int(c) for c in change]
    if stop < len(ms) and not len(none_left):  # a row without time keeps itself whatever comes in
        lows.append(1), highs.append(0), rows.append(stop)
    known: dict[int, int] = {}
    ends = [_greedy_end(ms, r, window, known) for r in reversed(rows)][::-1]
    return [int(x) for x in lows], [int(x) for x in highs], [int(ms[e]) for e in ends], [int(ids[e]) for e in ends]


def _sweep(sigs: np.ndarray, ms: np.ndarray, ids: np.ndarray, state: tuple | None, window: int):
    """The anchor of each row, and the last ``(sig, ms, id)``; ``state`` is the one before.

    Runs of one row anchor themselves; in longer ones the sweep leaps from anchor to anchor.
    """
    anchor, n = ids.copy(), len(ids)
    starts = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
    ends = np.r_[starts[1:], n]
    last = (sigs[-1], int(ms[-1]), int(ids[-1]))
    long = np.flatnonzero(ends - starts > 1)
    joins = state is not None and state[0] == sigs[0]
    if joins and (not len(long) or long[0] != 0):
        long = np.r_[0, long]
    for k in long.tolist():
        at, end = int(starts[k]), int(ends[k])
        if k == 0 and joins:
            held_ms, held_id = state[1], state[2]
        else:
            held_ms, held_id, at = int(ms[at]), int(ids[at]), at + 1
        while at < end:
            nxt, step = _first_far(ms, at, end, held_ms, window), at
            anchor[step:nxt] = held_id
            if nxt == end:
                break
            held_ms, held_id, at = int(ms[nxt]), int(ids[nxt]), nxt + 1
        if end == n:
            last = (sigs[-1], held_ms, held_id)
    return anchor, last


def _first_far(ms: np.ndarray, at: int, end: int, held: int, window: int) -> int:
    """The first row from ``at`` on that the anchor time ``held`` does not reach, else ``end``."""
    if held == _NONE:
        return at
    step = 64
    while at < end:
        part = ms[at : min(at + step, end)]
        far = (part == _NONE) | (np.abs(part - held) > window)
        if far.any():
            return at + int(far.argmax())
        at += len(part)
        step *= 2
    return end


def anchored_groups(
    df: DataFrame, keys: Sequence[str], order: str, same: Sequence[str], millis: str, window_ms: int, out: str = "anchor"
) -> DataFrame:
    """``keys, order, out`` where ``out`` is the order value of the kept row."""
    spark = df.sparkSession
    wanted = [*keys, order]
    narrow = df.select(
        *keys,
        F.col(order).cast("long").alias(order),
        F.to_json(F.struct(*keys, *same), {"ignoreNullFields": "false"}).alias("_sig"),
        F.coalesce(F.col(millis).cast("long"), F.lit(int(_NONE))).alias("_ms"),
    )
    placed = materialize(
        narrow.repartitionByRange(*wanted).sortWithinPartitions(*wanted).withColumn("_part", F.spark_partition_id())
    )

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = part = state = None
        lead_ms: list[np.ndarray] = []
        lead_id: list[np.ndarray] = []
        one_run = True
        for pdf in batches:
            sigs, ms, ids = pdf["_sig"].to_numpy(), pdf["_ms"].to_numpy(), pdf[order].to_numpy()
            if not len(sigs):
                continue
            if first is None:
                first, part = sigs[0], int(pdf["_part"].iloc[0])
            if one_run:
                other = np.flatnonzero(sigs != first)
                cut = int(other[0]) if len(other) else len(sigs)
                lead_ms.append(ms[:cut])
                lead_id.append(ids[:cut])
                if cut < len(sigs):
                    one_run, lead_ms, lead_id = False, [], []
            state = _sweep(sigs, ms, ids, state, window_ms)[1]
        if first is None:
            return
        sig, anchor_ms, anchor_id = state
        lows, highs, step_ms, step_id = (
            _steps(np.concatenate(lead_ms), np.concatenate(lead_id), window_ms) if one_run else ([], [], [], [])
        )
        yield pd.DataFrame(
            {
                "part": [part], "first_sig": [first], "last_sig": [sig], "one_run": [one_run],
                "out_ms": [anchor_ms], "out_id": [anchor_id],
                "lows": [lows], "highs": [highs], "step_ms": [step_ms], "step_id": [step_id],
            }
        )

    # One row per task, which `_steps` keeps to a few thousand numbers whatever the data.
    incoming: dict[int, tuple[str, int, int]] = {}
    state: tuple[str, int, int] | None = None
    for row in sorted(placed.mapInPandas(summarise, _SUMMARY).collect(), key=lambda r: r.part):
        if state is not None:
            incoming[row.part] = state
        nxt = (row.last_sig, row.out_ms, row.out_id)
        if row.one_run and state is not None and state[0] == row.first_sig and state[1] != _NONE:
            nxt = state
            for low, high, ms, ident in zip(row.lows, row.highs, row.step_ms, row.step_id):
                if not low <= state[1] <= high:
                    nxt = (row.last_sig, ms, ident)
                    break
        state = nxt
    handed = spark.sparkContext.broadcast(incoming)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, begun = None, False
        for pdf in batches:
            if not len(pdf):
                continue
            if not begun:
                begun = True
                state = handed.value.get(int(pdf["_part"].iloc[0]))
            result, state = _sweep(pdf["_sig"].to_numpy(), pdf["_ms"].to_numpy(), pdf[order].to_numpy(), state, window_ms)
            yield pdf[[*keys, order]].assign(**{out: result})

    types = dict(placed.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, order]) + f", `{out}` bigint"
    return placed.mapInPandas(decide, schema)
