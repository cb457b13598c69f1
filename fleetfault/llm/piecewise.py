"""Context-triggered piecewise hashes of texts, and how alike two of them are.

* A hash rolls over the last seven bytes of a text (fewer at its start).  Where its lowest k
  bits are zero, a piece of block size 2**k ends; so a cut of one size is a cut of all finer
  ones, and an edit moves only the cuts near it.
* A signature holds twelve bits of the hash of each piece, as two digits.  More than three
  equal pieces in a row count as three.  The finest block size with less than 64 cuts is
  taken; while that leaves under 32 pieces (repetitive texts) and the next finer size has at
  most 64, the finer one.  No size is below four bytes.
* A fingerprint is the block size and the signatures at that size, twice and four times it,
  so two are compatible if their sizes differ by a factor of at most four.
* Likeness is ``1 - distance / pieces of both`` with the edit distance that inserts and deletes
  pieces, at the finest size both have; 0 for incompatible sizes, 1 for two empty texts.
  Sixty-four rows of the distance are the bits of one word, and all pairs of a batch step together.

Equal texts have equal fingerprints.  A null text is empty.  Texts of any length are hashed
whole; working memory beyond the text is bounded by ``words.SLICE`` and its pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.llm.words import SLICE, slices, span_hashes, text_bytes
from fleetfault.session import scratch_folder

WINDOW = 7
PIECES = 64
RUN = 3
FINEST = 2
SIZES = 3
DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LEVELS = 66  # trailing zeros of 64 bits, and a level that no cut reaches


class Prints(NamedTuple):
    level: np.ndarray  # (texts): binary logarithm of the block size
    pieces: np.ndarray  # (texts, SIZES, PIECES)
    counts: np.ndarray  # (texts, SIZES)

    def at(self, rows) -> Prints:
        return Prints(*[part[rows] for part in self])


def joined(prints: list[Prints]) -> Prints:
    return Prints(*[np.concatenate(parts) for parts in zip(*prints)])


def _cuts(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the finest pieces and the level of each: up to which size it is a cut."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for low in range(0, len(data), SLICE):
        high = min(low + SLICE, len(data))
        a, b = np.searchsorted(borders, low, "right") - 1, np.searchsorted(borders, high, "left")
        inside = np.minimum(borders[a + 1 : b + 1], high) - np.maximum(borders[a:b], low)
        ends = np.arange(low + 1, high + 1)
        rolled = span_hashes(data, np.maximum(ends - WINDOW, np.repeat(borders[a:b], inside)), ends)
        at = np.flatnonzero(rolled & np.uint64((1 << FINEST) - 1) == 0)
        rolled = rolled[at]
        found.append((ends[at], np.bitwise_count((rolled & (~rolled + np.uint64(1))) - np.uint64(1)).astype(np.int64)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def prints(data: np.ndarray, borders: np.ndarray) -> Prints:
    """The fingerprints of all texts between ``borders``."""
    n = len(borders) - 1
    cuts, levels = _cuts(data, borders)
    rows = np.searchsorted(borders, cuts, "left") - 1
    table = np.bincount(rows * _LEVELS + levels, minlength=n * _LEVELS).reshape(n, _LEVELS)
    upwards = table[:, ::-1].cumsum(axis=1)[:, ::-1]
    level = (upwards[:, FINEST:] < PIECES).argmax(axis=1) + FINEST
    filled = borders[1:] > borders[:-1]

    def signed(wanted: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, hash) of the pieces of ``some`` texts at a level each, and the number of pieces."""
        ends = np.unique(np.concatenate([cuts[some[rows] & (levels >= wanted[rows])], borders[1:][filled & some]]))
        owner = np.searchsorted(borders, ends, "left") - 1
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        starts = np.maximum(starts, borders[owner])
        hashes = span_hashes(data, starts, ends)
        index = np.arange(len(ends))
        fresh = np.ones(len(ends), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        kept = index - np.maximum.accumulate(np.where(fresh, index, 0)) < RUN
        owner, hashes = owner[kept], hashes[kept]
        counts = np.bincount(owner, minlength=n)
        return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner], hashes, counts

    counts = signed(level, np.ones(n, bool))[3]
    thin = (counts < PIECES // 2) & (level > FINEST)
    while thin.any():
        finer = signed(level - 1, thin)[3]
        better = thin & (finer <= PIECES)
        level[better] -= 1
        counts[better] = finer[better]
        thin = better & (counts < PIECES // 2) & (level > FINEST)
    sums, sizes = np.zeros((n, SIZES, PIECES), np.uint64), np.zeros((n, SIZES), np.int64)
    for k in range(SIZES):
        owner, place, hashes, counts = signed(level + k, np.ones(n, bool))
        np.add.at(sums, (owner, k, np.minimum(place, PIECES - 1)), hashes)  # were there more, the last piece would hold the rest
        sizes[:, k] = np.minimum(counts, PIECES)
    return Prints(level, (sums >> np.uint64(52)).astype(np.uint16), sizes)


def written(found: Prints) -> list[str]:
    """``block size:signature:signature:signature`` of each text."""
    digits = np.frombuffer(DIGITS, np.uint8)
    codes = np.stack([digits[found.pieces >> 6], digits[found.pieces & 63]], axis=-1).reshape(len(found.level), SIZES, 2 * PIECES)
    raw, out = codes.tobytes().decode("ascii"), []
    for i, (level, counts) in enumerate(zip(found.level.tolist(), found.counts.tolist())):
        starts = [(i * SIZES + k) * 2 * PIECES for k in range(SIZES)]
        out.append(":".join([str(1 << level), *[raw[s : s + 2 * c] for s, c in zip(starts, counts)]]))
    return out


def read_back(fingerprints: list[str]) -> Prints:
    value = np.zeros(256, np.uint16)
    value[np.frombuffer(DIGITS, np.uint8)] = np.arange(64)
    n = len(fingerprints)
    out = Prints(np.zeros(n, np.int64), np.zeros((n, SIZES, PIECES), np.uint16), np.zeros((n, SIZES), np.int64))
    for i, text in enumerate(fingerprints):
        size, *signatures = text.split(":")
        out.level[i] = int(size).bit_length() - 1
        for k, signature in enumerate(signatures):
            pair = value[np.frombuffer(signature.encode("ascii"), np.uint8)].reshape(-1, 2)
            out.pieces[i, k, : len(pair)] = pair[:, 0] * 64 + pair[:, 1]
            out.counts[i, k] = len(pair)
    return out


def alike(a: Prints, b: Prints) -> np.ndarray:
    """Likeness of the fingerprints of two lists, pair by pair."""
    every, common = np.arange(len(a.level)), np.maximum(a.level, b.level)
    at_a, at_b = common - a.level, common - b.level
    compatible = (at_a < SIZES) & (at_b < SIZES)
    at_a, at_b = np.minimum(at_a, SIZES - 1), np.minimum(at_b, SIZES - 1)
    left, right, m, n = a.pieces[every, at_a], b.pieces[every, at_b], a.counts[every, at_a], b.counts[every, at_b]
    bits = (np.arange(PIECES) < m[:, None]) if len(every) else np.zeros((0, PIECES), bool)
    row = np.full(len(every), 0xFFFFFFFFFFFFFFFF, np.uint64)  # a zero bit: the common part grows by this piece
    for j in range(int(n.max(initial=0))):
        same = np.packbits((left == right[:, j : j + 1]) & bits, axis=1, bitorder="little").view("<u8").ravel()
        step = row & same
        row = np.where(j < n, (row + step) | (row - step), row)
    mask = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    shared = np.bitwise_count(~row & mask).astype(np.int64)
    return np.where(compatible, np.where(m + n == 0, 1.0, 2 * shared / np.maximum(m + n, 1)), 0.0)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""

    def of(texts: pd.Series) -> pd.Series:
        data, borders = text_bytes(pa.array(texts, pa.string(), from_pandas=True))
        found = [p for a, b in slices(borders) for p in written(prints(data[borders[a] : borders[b]], borders[a : b + 1] - borders[a]))]
        return pd.Series(found, index=texts.index, dtype=object)

    return F.pandas_udf(of, "string")(text)


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprint columns, 0 to 1."""

    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(alike(read_back(x.tolist()), read_back(y.tolist())), index=x.index)

    return F.pandas_udf(of, "double")(a, b)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], own: Prints, following: list[str], theirs: Prints) -> list[pa.Array]:
    """The columns of ``RESULT``: each text beside its edit by, and its likeness to, the text that follows."""
    edited = []
    for text, after in zip(texts, following):
        half = len(text) // 2
        edited.append((text[: len(text) - half] + after[:half]).encode("utf-8"))
    parts = []
    borders = np.concatenate([[0], np.cumsum([len(e) for e in edited])]).astype(np.int64)
    for a, b in slices(borders):
        parts.append(prints(np.frombuffer(b"".join(edited[a:b]), np.uint8), borders[a : b + 1] - borders[a]))
    changed = joined(parts)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array(written(own), pa.string()),
        pa.array(written(changed), pa.string()), pa.array(alike(own, changed)), pa.array(alike(own, theirs)),
    ]


def compare_with_next(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``RESULT`` for every row: its fingerprint, that of its edited text (the second half replaced by the
    start of the next text), and its likeness to that and to the next text.

    The next row is the one with the next lower id; after the last comes the first.  Null ids come
    last, rows with the same id go by a hash of their text (equal ones are alike anyway), and a lone
    row is next to itself.  One range shuffle puts the rows in order.  Each task compares the rows it
    has; its last one waits for the first of the next task, and these pairs, one a task, are joined
    afterwards.  Only the numbers of the tasks reach the driver.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("h"))
    order = [F.col("id").desc_nulls_last(), F.col("h")]
    names = ["kind", "part", "text", *[part.split()[0] for part in RESULT.split(", ")]]

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def waiting(kind: str, key, text: str) -> pa.RecordBatch:
            known = {"kind": [kind], "part": [part], "text": [text], "doc_id": [key]}
            types = {"part": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
            return pa.RecordBatch.from_arrays([pa.array(known.get(n, [None]), types.get(n, pa.string())) for n in names], names=names)

        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, borders = text_bytes(batch.column(1))
            for a, b in slices(borders):
                piece, inner = data[borders[a] : borders[b]], borders[a : b + 1] - borders[a]
                raw = piece.tobytes()
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(inner[:-1].tolist(), inner[1:].tolist())]
                if not held[0]:
                    yield waiting("first", keys[a], texts[0])
                ids, texts, found = held[0] + keys[a:b], held[1] + texts, joined([*held[2], prints(piece, inner)])
                if len(ids) > 1:
                    done = _compared(ids[:-1], texts[:-1], found.at(slice(None, -1)), texts[1:], found.at(slice(1, None)))
                    head = [pa.array(["done"] * (len(ids) - 1)), pa.array([part] * (len(ids) - 1), pa.int32()), pa.nulls(len(ids) - 1, pa.string())]
                    yield pa.RecordBatch.from_arrays(head + done, names=names)
                held = (ids[-1:], texts[-1:], [found.at(slice(-1, None))])
        if held[0]:
            yield waiting("last", held[0][0], held[1][0])

    path = f"{scratch_folder(spark)}/compared"
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    placed.mapInArrow(swept, f"kind string, part int, text string, {RESULT}").write.parquet(path)
    compared = spark.read.schema(f"kind string, part int, text string, {RESULT}").parquet(path)

    parts = sorted(r.part for r in compared.where("kind = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next int")
    firsts = compared.where("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = compared.where("kind = 'last'").select("part", F.col("doc_id").alias("id"), "text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # one row for each task that had any
                texts = [row["text"], row["following"]]
                raw = [t.encode("utf-8") for t in texts]
                found = prints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
                done = _compared([row["id"]], texts[:1], found.at(slice(0, 1)), texts[1:], found.at(slice(1, 2)))
                yield pa.RecordBatch.from_arrays(done, names=names[3:])

    met = lasts.join(after, "part").join(firsts, "next").select("id", "text", "following").mapInArrow(finish, RESULT)
    return compared.where("kind = 'done'").select(*names[3:]).unionByName(met)
