"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of words (A-Z as a-z).  Seeds are runs of ``SEED``
words; a text and an item that share enough of them are tiled: the longest common run of
words not yet marked is marked in both, again and again, found by running Karp-Rabin hashes
of seed length and extended from there.  Tiles may lie in any order, so a passage whose
sentences were moved is covered all the same.  A text is contaminated by an item when
tiles cover ``COVERAGE_PERCENT`` of the item's words.

Texts are read once against a Bloom filter of all seeds (fixed size); texts that may hold a
seed, and their seeds, are joined with the seed table.  No item list is broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.llm.sketch import bloom, maybe_in
from fleetfault.llm.words import resting, slices, span_hashes, text_bytes, window_hashes, word_spans
from fleetfault.session import scratch_folder

SEED = 5
COVERAGE_PERCENT = 50


def word_names(column: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the words of each text in order."""
    data, borders = text_bytes(column)
    for low, high in slices(borders):
        part, edges = data[borders[low] : borders[high]], borders[low : high + 1] - borders[low]
        rows, starts, ends = word_spans(part, edges)
        words = span_hashes(part, starts, ends, True)
        at = np.searchsorted(rows, np.arange(high - low + 1))
        for k in range(high - low):
            yield words[at[k] : at[k + 1]]


def _seeds(words: np.ndarray, size: int) -> np.ndarray:
    return window_hashes(words, np.zeros(len(words), np.int8), size)[0] + np.uint64(size)


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: ``(start in text, start in item, length)``, longest
    first, the earliest in the text (then in the item) on ties; no shorter than ``least``."""
    places: dict[int, list[int]] = {}
    seeds, windows = _seeds(item, least), _seeds(text, least)
    for j, seed in enumerate(seeds.tolist()):
        places.setdefault(seed, []).append(j)
    heap = []
    for i in np.flatnonzero(np.isin(windows, seeds)).tolist():
        for j in places[int(windows[i])]:
            if i and j and windows[i - 1] == seeds[j - 1]:
                continue  # inside a run that began earlier
            length = least
            while i + length < len(text) and j + length < len(item) and text[i + length] == item[j + length]:
                length += 1
            heap.append((-length, i, j))
    heapq.heapify(heap)
    in_text, in_item, found = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        taken = in_text[i : i + length] | in_item[j : j + length]
        if not taken.any():
            in_text[i : i + length] = in_item[j : j + length] = True
            found.append((i, j, length))
            if in_item.all():
                break
            continue
        free = np.concatenate([[False], ~taken, [False]])
        edges = np.flatnonzero(free[1:] != free[:-1]).reshape(-1, 2)
        for a, b in edges.tolist():
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = COVERAGE_PERCENT,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``(doc_id, text_hash, item_id, n_words, n_covered, coverage, tiles)`` of each contaminated text.

    Items with fewer than ``seed`` words must occur whole; items without words (null, empty)
    match nothing.  Items with equal ids are taken apart by their text.  Null and empty texts
    are clean.  A text is known by its id and hash, so repeated rows and null ids get a
    result each (equal rows one).  Other columns are not read.
    """
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = list(word_names(batch.column(2)))
            sizes = [min(seed, len(x)) for x in words]
            grams = [_seeds(x, n).view(np.int64) if n else np.zeros(0, np.int64) for x, n in zip(words, sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(map(len, words)), pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array([x.tobytes() for x in words], pa.binary()), pa.array(grams, pa.list_(pa.int64()))],
                names=["item_id", "item_hash", "n_words", "least", "item", "grams"])

    kind = benchmark.schema[item_column].dataType.simpleString()
    path = scratch_folder(spark)
    source = benchmark.select(F.col(item_column).alias("item_id"), F.xxhash64(item_text).alias("item_hash"), F.col(item_text).alias("text"))
    source.mapInArrow(
        lambda batches: resting(split(batches)), f"item_id {kind}, item_hash long, n_words long, least int, item binary, grams array<long>"
    ).where("n_words > 0").write.parquet(path)
    items = spark.read.parquet(path).dropDuplicates(["item_id", "item_hash"])
    seeds = items.select("item_id", "item_hash", "n_words", F.explode("grams").alias("gram"))
    lengths = sorted(r["least"] for r in items.select("least").distinct().collect())  # at most `seed` of them
    wanted = spark.sparkContext.broadcast(bloom(seeds.select("gram")))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, grams, texts = [], [], []
            data, borders = text_bytes(batch.column(2))
            for low, high in slices(borders):
                part, edges = data[borders[low] : borders[high]], borders[low : high + 1] - borders[low]
                rows, starts, ends = word_spans(part, edges)
                words = span_hashes(part, starts, ends, True)
                hits: dict[int, list[np.ndarray]] = {}
                for size in lengths:
                    windows, at = window_hashes(words, rows, size)
                    windows = windows + np.uint64(size)
                    found = np.flatnonzero(maybe_in(wanted.value, windows))
                    owner = rows[at[found]]
                    cut = np.flatnonzero(np.diff(owner)) + 1
                    for own, values in zip(np.split(owner, cut), np.split(windows[found], cut)):
                        if len(own):
                            hits.setdefault(int(own[0]), []).append(values)
                edge = np.searchsorted(rows, np.arange(high - low + 1))
                for row, values in sorted(hits.items()):
                    kept.append(low + row)
                    grams.append(np.unique(np.concatenate(values)).view(np.int64))
                    texts.append(words[edge[row] : edge[row + 1]].tobytes())
            if kept:
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(texts, pa.binary()), pa.array(grams, pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "words", "grams"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    path = scratch_folder(spark)
    plain = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    plain.mapInArrow(lambda batches: resting(touched(batches)), f"doc_id {kind}, text_hash long, words binary, grams array<long>").write.parquet(path)
    # A row for each different text, whatever its ids: copies are tiled once.
    hit = spark.read.parquet(path)
    once = hit.select("text_hash", "words", "grams").dropDuplicates(["text_hash"])

    # A tile of L words has L - seed + 1 seeds, so seeds in the item are at least a fifth of what is covered.
    pairs = (
        once.select("text_hash", F.explode("grams").alias("gram"))
        .join(seeds, "gram")
        .groupBy("text_hash", "item_id", "item_hash", "n_words")
        .agg(F.count(F.lit(1)).alias("c"))
        .where(f"100 * {seed} * c >= {percent} * n_words")
        .select("text_hash", "item_id", "item_hash")
    )
    item_side = items.select(F.col("item_id").alias("of_item"), F.col("item_hash").alias("of_hash"), "n_words", "least", "item")
    both = pairs.join(once.select("text_hash", "words"), "text_hash").join(
        item_side, F.col("item_id").eqNullSafe(F.col("of_item")) & (F.col("item_hash") == F.col("of_hash")))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, covered, spans = [], [], []
            for k, (words, item, least) in enumerate(zip(batch.column(3), batch.column(4), batch.column(5).to_pylist())):
                item = np.frombuffer(item.as_buffer(), np.uint64)
                found = tiles(np.frombuffer(words.as_buffer(), np.uint64), item, least)
                total = sum(n for _, _, n in found)
                if 100 * total >= percent * len(item):
                    keep.append(k)
                    covered.append(total)
                    spans.append([{"at": i, "item_at": j, "length": n} for i, j, n in found])
            part = batch.take(pa.array(keep, pa.int64()))
            shape = pa.list_(pa.struct([("at", pa.int64()), ("item_at", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(covered, pa.int64()), pa.array(spans, shape)],
                names=["text_hash", "item_id", "n_words", "n_covered", "tiles"],
            )

    kind = benchmark.schema[item_column].dataType.simpleString()
    found = both.select("text_hash", "item_id", "n_words", "words", "item", "least").mapInArrow(
        lambda batches: resting(tiled(batches)),
        f"text_hash long, item_id {kind}, n_words long, n_covered long, tiles array<struct<at: long, item_at: long, length: long>>",
    )
    named = hit.select("doc_id", "text_hash").distinct()
    return named.join(found, "text_hash").select(
        "doc_id", "text_hash", "item_id", "n_words", "n_covered", (F.col("n_covered") / F.col("n_words")).alias("coverage"), "tiles"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; all columns, null ids and repeated rows kept."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("doc.text") == F.col("bad_hash"))
    return rows.join(bad, same, "left_anti").select("doc.*")
