"""Words of many texts at once: numpy work inside a task, on the bytes of an Arrow batch.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  A word, or any other
span, is named by a 64-bit hash of its bytes; two spans are taken as equal when their
hashes are.  With V different spans the chance of any mistake is V*V / 2**65, which is
1e-7 for the two million words of a half-gigabyte table.

Nulls count as empty texts.  A text of any length is handled: working memory beyond the
text itself is bounded by ``SLICE`` bytes (or the longest single word).
"""

from __future__ import annotations

import ctypes
import sys
import threading
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_RADIX_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(271828).integers(1, 1 << 64, 256, dtype=np.uint64)
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that tasks can share what they learnt."""
    holder = sys.modules.setdefault("_fleetfault_worker", types.ModuleType("_fleetfault_worker"))
    return holder.__dict__.setdefault(name, {})


def release_stores() -> None:
    """Forget what earlier stages left in this worker, for a stage that needs its memory; it is learnt again when wanted."""
    holder = sys.modules.get("_fleetfault_worker")
    for name, store in vars(holder).items() if holder else ():
        if isinstance(store, dict) and not name.startswith("__") and name != "powers":
            store.clear()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc do so by themselves
    if trim is not None:
        trim(0)


def resting(batches: Iterator[pa.RecordBatch], wait: float = 0.5) -> Iterator[pa.RecordBatch]:
    """What a task makes.  If no other task of this kind comes to its Python worker within ``wait`` seconds, the
    worker gives freed memory back to the system, which the stages that follow can use; nothing learnt is forgotten."""
    store = worker_store("rest")
    if "timer" in store:
        store.pop("timer").cancel()
    try:
        yield from batches
    finally:
        store["timer"] = threading.Timer(wait, _give_back)
        store["timer"].daemon = True
        store["timer"].start()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and the border of each text (length rows + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    borders = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[borders[0] : borders[-1]], borders - borders[0]


def slices(borders: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    rows, start = len(borders) - 1, 0
    while start < rows:
        stop = int(np.searchsorted(borders, borders[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def word_spans(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each word; a word never crosses the border of a text."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = borders[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(borders, starts, "right") - 1
    return rows, starts, ends


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    store = worker_store("powers")
    if len(store.get("up", ())) < length:
        size = max(length, SLICE + 4096)
        for name, radix in (("up", _RADIX), ("down", _RADIX_INVERSE)):
            steps = np.full(size, radix, np.uint64)
            steps[0] = 1
            store[name] = np.multiply.accumulate(steps)
    return store["up"], store["down"]


def scatter(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """A hash for each span of ``data``; spans are in order and do not overlap.
    ``fold_case`` reads A-Z as a-z."""
    table = _BYTES[_FOLD] if fold_case else _BYTES
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(int(np.searchsorted(ends, base + SLICE, "right")), at + 1)
        piece = data[base : int(ends[stop - 1])]
        up, down = _powers(len(piece) + 1)
        running = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(table[piece] * up[: len(piece)], out=running[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = scatter((running[e] - running[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def window_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row within one text, and the index of the first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    total, factor = np.zeros(len(at), np.uint64), 1
    for k in range(size):  # the words' hashes are well spread already
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += words[at + k] * np.uint64(factor)
    return scatter(total), at
