"""Tables of counters or bits of a fixed size, filled by all tasks and merged by Spark.

Each task sends its table in pieces, pieces are merged apart from each other, and the
driver receives one merged table, whose size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetfault.llm.words import resting, scatter

PIECES = 64
SCHEMA = "piece int, counts binary"
BLOOM_BITS = 1 << 25
BLOOM_PROBES = 4


def pieces(table: np.ndarray) -> pa.RecordBatch:
    """A task's table as rows; empty pieces are left out."""
    rows = table.reshape(PIECES, -1)
    used = np.flatnonzero(rows.any(1))
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([rows[k].tobytes() for k in used], pa.binary())], names=["piece", "counts"]
    )


def merged(parts: DataFrame, size: int, kind: type, merge: np.ufunc) -> np.ndarray:
    """All tasks' tables of ``size`` numbers as one."""

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for table in tables:
            for piece, raw in zip(table.column(0).to_pylist(), table.column(1)):
                counts = np.frombuffer(raw.as_buffer(), kind)
                total[piece] = merge(counts, total[piece]) if piece in total else counts
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                names=["piece", "counts"],
            )

    out = np.zeros(size, kind).reshape(PIECES, -1)
    for row in parts.repartition(PIECES, "piece").mapInArrow(lambda tables: resting(add(tables)), SCHEMA).collect():
        out[row["piece"]] = np.frombuffer(row["counts"], kind)
    return out.ravel()


def _probes(keys: np.ndarray) -> Iterator[np.ndarray]:
    one = scatter(keys.astype(np.int64, copy=False).view(np.uint64) if keys.dtype != np.uint64 else keys)
    two = scatter(one) | np.uint64(1)
    for _ in range(BLOOM_PROBES):
        yield (one % np.uint64(BLOOM_BITS)).astype(np.int64)
        one = one + two


def bloom(keys: DataFrame) -> np.ndarray:
    """Bloom filter of all values of the long columns of ``keys``, as packed bits (4 MB)."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BLOOM_BITS, np.uint8)
        for batch in batches:
            for column in batch.columns:
                for at in _probes(np.asarray(column)):
                    seen[at] = 1
        yield pieces(np.packbits(seen))

    return merged(keys.mapInArrow(lambda batches: resting(marked(batches)), SCHEMA), BLOOM_BITS // 8, np.uint8, np.bitwise_or)


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key is surely not in the filter; ``bits`` packed."""
    found = np.ones(len(keys), bool)
    for at in _probes(keys):
        found &= bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
    return found
