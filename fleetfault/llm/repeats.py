"""Exact repeats of ``LENGTH`` bytes anywhere in the texts, by sparse induced suffix sorting.

Only sampled suffixes are sorted, and the order of those before them is induced.  The
sample is local, as the S* suffixes of induced sorting are: of every window of ``LENGTH``
bytes, the ``KMER`` bytes with the lowest hash are its anchor.  Equal windows have their
anchors at the same place, so a repeat is found by comparing suffixes of equal anchors.

1. Windows with one anchor form a run; runs are counted by a hash of their whole span.
   All windows of a span that occurs twice repeat.
2. Where an anchor has different spans, single windows may still repeat.  One of each such
   span is sorted by the bytes from its anchor on (Spark's sort, which spills to disk),
   with the common prefix of neighbours.  Then step by step the order of the suffixes one
   byte further left is induced: a stable pass over (byte, rank), and a common prefix one
   longer than the least between the two.  A window repeats where its suffix shares
   ``LENGTH`` bytes with a neighbour.
3. An anchor with more than ``MAX_SPANS`` different spans is not gathered in one task: its
   windows are counted by their hash, as rows.

Texts are read three times and shuffled once; spans travel, single positions do not.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.llm.sketch import bloom, maybe_in
from fleetfault.llm.words import _BYTES, _powers, scatter, slices, text_bytes
from fleetfault.session import scratch_folder

LENGTH = 200
KMER = 32
PIECE = 1 << 21  # windows of a text taken at once
MAX_SPANS = 50_000
SENT = 200_000  # spans a task remembers to have given; beyond that some are given twice
_AT = np.uint64((1 << 24) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    full = -(-len(values) // width) * width
    padded = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Runs:
    """Runs of the windows of some texts: ``row``, first and last window, anchor and hashes of each."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, length: int, kmer: int):
        up, down = _powers(len(data) + 1)
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=running[1:])
        self.data, self.running, self.down = data, running, down
        empty = np.zeros(0, np.int64)
        self.row = self.first = self.last = self.anchor = empty
        self.group = self.span = np.zeros(0, np.uint64)
        if len(data) < length:
            return
        n = len(data) - kmer + 1
        grams = scatter((running[kmer:] - running[:n]) * down[:n])
        lowest = (_least((grams & ~_AT) | np.arange(n, dtype=np.uint64), length - kmer + 1) & _AT).astype(np.int64)
        # Windows that lie inside one text.
        sizes = np.diff(borders)
        held = np.flatnonzero(sizes >= length)
        count = sizes[held] - length + 1
        row = np.repeat(held, count)
        at = np.repeat(borders[held] - (np.cumsum(count) - count), count) + np.arange(len(row))
        anchor = lowest[at]
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        self.row, self.first, self.last, self.anchor = row[begin], at[begin], at[end], anchor[begin]
        self.group = grams[self.anchor]
        whole = self.hashes(self.first, self.last + length)
        offset = (self.anchor - self.first).astype(np.uint64) << np.uint64(32)
        self.span = scatter(whole ^ scatter(offset + (self.last - self.first).astype(np.uint64)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.running[ends] - self.running[starts]) * self.down[starts]


def _parts(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, borders, first row, byte of the text at which the first row begins) of what is taken at once.

    A longer text comes in pieces that overlap, so that no window is lost; runs may be cut.
    """
    data, borders = text_bytes(column)
    for low, high in slices(borders, PIECE):
        part, edges = data[borders[low] : borders[high]], borders[low : high + 1] - borders[low]
        if high - low == 1 and len(part) > 2 * PIECE:
            for begin in range(0, max(1, len(part) - length + 1), PIECE):
                piece = part[begin : begin + PIECE + length - 1]
                yield piece, np.array([0, len(piece)]), low, begin
        else:
            yield part, edges, low, 0


def induced(groups: np.ndarray, spans: list[bytes], anchors: np.ndarray, length: int) -> list[np.ndarray]:
    """The windows of each span (by place in the span) that also occur in another span.

    ``spans`` are different where their group is equal, and sorted by group; ``anchors`` is
    the place of the anchor in each.
    """
    n = len(spans)
    sizes = np.array([len(x) for x in spans])
    right = sizes - anchors
    width = int(right.max(initial=0))
    tail = np.full((n, width), -1, np.int16)  # bytes from the anchor on; -1: the span has ended
    whole = np.frombuffer(b"".join(spans), np.uint8)
    begin = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(n), right)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(right) - right, right)
    tail[own, inner] = whole[np.repeat(begin + anchors, right) + inner]
    # Keys compare as big-endian bytes: group number, then the tail.
    number = np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
    keys = np.concatenate([number.astype(">u4").view(np.uint8).reshape(n, 4), (tail + 1).astype(">u2").view(np.uint8).reshape(n, -1)], axis=1)
    order = _sorted_rows(keys)
    above, below = order[:-1], order[1:]
    same = (tail[above] == tail[below]) & (tail[above] >= 0)
    common = np.where(same.all(1), width, np.argmin(same, axis=1)) if n > 1 else np.zeros(0, np.int64)
    common = np.concatenate([[0], np.where(number[above] == number[below], common, -1)])
    common[0] = -1
    found: list[list[int]] = [[] for _ in range(n)]
    step, reach = 0, int(anchors.max(initial=0))
    while len(order) > 1:
        # `common[i]`: bytes that suffix i shares with the one above; -1 across groups.
        full = common >= length
        hit = full.copy()
        hit[:-1] |= full[1:]
        for k in order[hit].tolist():
            if step <= anchors[k] and anchors[k] - step + length <= sizes[k]:
                found[k].append(int(anchors[k]) - step)
        step += 1
        if step > reach:
            break
        # Suffixes one byte further left: a stable pass by (group, byte) over the present order.
        alive = anchors[order] >= step
        rank = np.flatnonzero(alive)
        who = order[alive]
        byte = whole[begin[who] + anchors[who] - step]
        turn = np.argsort(number[who] * 256 + byte, kind="stable")
        old = rank[turn]
        new = who[turn]
        joined = np.concatenate([[False], (number[new[1:]] == number[new[:-1]]) & (byte[turn][1:] == byte[turn][:-1])])
        least = np.full(len(new), -2)
        pairs = np.flatnonzero(joined)
        if len(pairs):
            least[pairs] = _range_min(common, old[pairs - 1] + 1, old[pairs])
        differ = np.concatenate([[True], number[new[1:]] != number[new[:-1]]]) if len(new) else np.zeros(0, bool)
        common, order = np.where(joined, least + 1, np.where(differ, -1, 0)), new
    return [np.array(sorted(x), np.int64) for x in found]


def _sorted_rows(keys: np.ndarray) -> np.ndarray:
    """Order of rows of bytes, eight bytes at a time."""
    padded = np.zeros((len(keys), -(-keys.shape[1] // 8) * 8), np.uint8)
    padded[:, : keys.shape[1]] = keys
    return np.lexsort(padded.view(">u8").T[::-1]) if len(keys) else np.zeros(0, np.int64)


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``values[low : high + 1].min()`` for each pair, from minima over powers of two."""
    span = high - low + 1
    power = np.frexp(span)[1] - 1
    out = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(power.max()) + 1):
        here = power == k
        out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


STRETCHES = "span long, from long, to long"


def _stretches(spans: pa.Array, places: list[np.ndarray]) -> pa.RecordBatch:
    """Neighbouring places of each span as one row."""
    flat = np.concatenate(places) if places else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(places)), [len(x) for x in places])
    new = np.concatenate([[True], (flat[1:] != flat[:-1] + 1) | (owner[1:] != owner[:-1])]) if len(flat) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(flat)) - 1 if len(flat) else begin
    return pa.RecordBatch.from_arrays(
        [spans.take(pa.array(owner[begin], pa.int64())), pa.array(flat[begin]), pa.array(flat[end])], names=["span", "from", "to"]
    )


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Stretches of the spans of each group, from sorted rows; about 20,000 spans, or a group, are held."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        # A group may go on in the next batch.
        if batch is not None:
            held.append(batch)
            if sum(x.num_rows for x in held) < 20_000:
                continue
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        g, span = np.asarray(table["g"]), np.asarray(table["span"])
        table = table.filter(pa.array(np.concatenate([[True], (g[1:] != g[:-1]) | (span[1:] != span[:-1])])))  # other tasks gave it too
        g = np.asarray(table["g"])
        stop = len(g) if batch is None else int(np.searchsorted(g, g[-1]))
        ready, held = table.slice(0, stop), table.slice(stop).to_batches()
        if ready.num_rows:
            found = induced(
                np.asarray(ready["g"]), ready["content"].to_pylist(), np.asarray(ready["anchor"]), length
            )
            some = [k for k, x in enumerate(found) if len(x)]
            yield _stretches(ready["span"].combine_chunks().take(pa.array(some, pa.int64())), [found[k] for k in some])


def _repeated(docs: DataFrame, length: int, kmer: int, max_spans: int) -> DataFrame:
    """``(doc_id, text_hash, first, last)``: windows, by place in the text, that occur elsewhere."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, borders, _, _ in _parts(batch.column(0), length):
                runs = Runs(data, borders, length, kmer)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.group.view(np.int64)), pa.array(runs.span.view(np.int64))], names=["g", "span"]
                )

    path = scratch_folder(spark)
    counted = docs.select("text").mapInArrow(named, "g long, span long").groupBy("g", "span").agg(F.count(F.lit(1)).alias("n"))
    counted.write.parquet(path)
    counted = spark.read.parquet(path)
    path = scratch_folder(spark)
    counted.where("n > 1").select("span").write.parquet(path)
    twice = spark.read.parquet(path)
    path = scratch_folder(spark)
    counted.groupBy("g").agg(F.count(F.lit(1)).alias("spans")).where("spans > 1").write.parquet(path)
    mixed = spark.read.parquet(path)
    in_twice = spark.sparkContext.broadcast(bloom(twice))
    in_mixed = spark.sparkContext.broadcast(bloom(mixed.select("g")))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # spans whose bytes this task has given already
        for batch in batches:
            for data, borders, row, shift in _parts(batch.column(2), length):
                runs = Runs(data, borders, length, kmer)
                again, odd = maybe_in(in_twice.value, runs.span), maybe_in(in_mixed.value, runs.group)
                keep = np.flatnonzero(again | odd)
                if not len(keep):
                    continue
                content = []
                for a, b, o, name in zip(runs.first[keep].tolist(), (runs.last[keep] + length).tolist(), odd[keep].tolist(), runs.span[keep].tolist()):
                    content.append(data[a:b].tobytes() if o and name not in sent else None)
                    if o and len(sent) < SENT:
                        sent.add(name)
                own = runs.row[keep]
                who = pa.array(own + row)
                begin = runs.first[keep] - borders[own] + shift
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(who), batch.column(1).take(who), pa.array(begin),
                     pa.array(begin + runs.last[keep] - runs.first[keep]), pa.array(runs.anchor[keep] - runs.first[keep]), pa.array(odd[keep]),
                     pa.array(runs.group[keep].view(np.int64)), pa.array(runs.span[keep].view(np.int64)), pa.array(content, pa.binary())],
                    names=["doc_id", "text_hash", "first", "last", "anchor", "odd", "g", "span", "content"])

    path = scratch_folder(spark)
    docs.select("doc_id", "text_hash", "text").mapInArrow(
        marked, f"doc_id {kind}, text_hash long, first long, last long, anchor long, odd boolean, g long, span long, content binary"
    ).write.option("compression", "zstd").parquet(path)
    runs = spark.read.parquet(path)

    whole = runs.select("doc_id", "text_hash", "first", "last", "span").join(twice, "span", "left_semi")
    one = runs.where("content is not null").select("g", "span", "anchor", "content")
    large = mixed.where(f"spans > {max_spans}").select("g")
    some_large = not large.isEmpty()

    few = (
        (one.join(large, "g", "left_anti") if some_large else one)
        .select("g", "span", "anchor", "content")
        .repartition("g").sortWithinPartitions("g", "span").mapInArrow(lambda batches: _sorted_groups(batches, length), STRETCHES)
    )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, span, anchor, content in zip(*(batch.column(k) for k in range(4))):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                own = Runs(data, np.array([0, 0]), length, kmer)
                at = np.arange(len(data) - length + 1)
                name = scatter(own.hashes(at, at + length) ^ scatter((anchor.as_py() - at).astype(np.uint64)) ^ np.uint64(g.as_py() & (1 << 63) - 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(np.full(len(at), span.as_py(), np.int64)), pa.array(at)],
                    names=["name", "span", "place"],
                )

    if some_large:
        rows = one.join(large, "g").select("g", "span", "anchor", "content").dropDuplicates(["g", "span"])
        rows = rows.mapInArrow(windows, "name long, span long, place long")
        shared = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
        many = rows.join(shared, "name", "left_semi").groupBy("span").agg(F.sort_array(F.collect_set("place")).alias("places"))
        few = few.unionByName(many.mapInArrow(lambda ps: (_stretches(p.column(0), [np.asarray(x.values) for x in p.column(1)]) for p in ps), STRETCHES))
    single = (
        runs.where("odd").select("doc_id", "text_hash", "first", "span")
        .join(few, "span")
        .select("doc_id", "text_hash", (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.col("to")).alias("last"))
    )
    return whole.select("doc_id", "text_hash", "first", "last").unionByName(single)


def without_repeats(
    docs: DataFrame, length: int = LENGTH, kmer: int = KMER, max_spans: int = MAX_SPANS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for each row of ``docs``.

    Removed is every byte covered by a string of ``length`` bytes that starts at a second
    place in any text, its own included; strings are judged on the input.  ``kept`` is what
    is left, as bytes.  Null texts are empty.  Repeated rows are texts like others, so all of
    their bytes go, if there are enough; null ids are kept; other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_hash"))
    marks = _repeated(source, length, kmer, max_spans).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    marks = marks.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "marks")
    joined = source.join(marks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders = text_bytes(batch.column(1))
            rows = [[], [], [], []]
            for k, found in enumerate(batch.column(2)):
                own = data[borders[k] : borders[k + 1]]
                edge = np.zeros(len(own) + 1, np.int32)
                if found.is_valid and len(found):
                    first = np.asarray(found.values.field(0))
                    last = np.asarray(found.values.field(1))
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                starts = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                for column, value in zip(rows, (len(own), int(gone.sum()), starts, own[~gone].tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in rows[:3]], pa.array(rows[3], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.select("doc_id", "text", "marks").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
