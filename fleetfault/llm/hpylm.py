"""Scores of texts by a hierarchical Pitman-Yor model of word pairs.

Every word is a customer of the restaurant of its context, the word before it; restaurants
of all contexts share one parent, the restaurant of words, whose parent is the even spread
over the vocabulary and one unknown word.  Every word, however rare, is a context of its own.
A table in a context restaurant is a customer of the parent.

Seating is sampled by Gibbs: all tables of one dish in one restaurant are drawn anew, given
the other tables and the parent, by the Chinese-restaurant process.  The work is dealt by
word, so a dish is whole in one task.  Words of at least one in ``FREQUENT`` of the training
words are dealt by their context, or by word and context where both are that frequent.  What
restaurants share is summed over all tasks between the two rounds: the parent's seating of
frequent words, and the customers and tables of every context.  Each bucket asks for the
contexts it holds, in slices by hash; a slice adds up what the buckets bring and answers each
in the same order, so no table of contexts is broadcast and a hot one is a value a bucket.
The first round burns in (a bucket then takes its own tables of a rare context for all of
them) and gives those sums and the discounts; in the second, ``SAMPLES`` seatings are drawn
and the predictive probability of each token is their mean.

Tokens travel as arrays, one row for each batch of texts and bucket of words, and are summed
inside a batch first.  The model is made of all training texts; nothing is sampled or cut
but the seatings.  Only the table of frequent words (at most ``FREQUENT`` rows) is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.llm.words import scatter, slices, span_hashes, text_bytes, word_spans
from fleetfault.session import scratch_folder

FREQUENT = 1 << 15
SWEEPS = 3  # of burn-in, in each round
SAMPLES = 4
STRENGTH = 1.0  # of all restaurants
FIRST_DISCOUNTS = (0.8, 0.5)  # of contexts and words, until they are estimated
BUCKET_TOKENS = 2_000_000
ROWS = 50_000  # texts in a batch
END = np.uint64(0x5EED5EED5EED5EED)


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each token, token) of slices of a column: the words of each text and its end."""
    data, borders = text_bytes(column)
    for low, high in slices(borders):
        part, edges = data[borders[low] : borders[high]], borders[low : high + 1] - borders[low]
        rows, starts, ends = word_spans(part, edges)
        n = high - low
        words = np.full(len(rows) + n, END, np.uint64)
        words[np.arange(len(rows)) + rows] = span_hashes(part, starts, ends, True)
        yield low, np.repeat(np.arange(n), np.bincount(rows, minlength=n) + 1), words


def _word_counts(training: DataFrame) -> DataFrame:
    """``(w, n)``: occurrences of each token in the training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(words, return_counts=True) for _, _, words in _tokens(batch.column(0))]
            if held:
                words, back = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in held]))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

    return training.select("text").mapInArrow(counted, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Lexicon:
    """What every task needs: sizes of the training texts, and the frequent words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, kinds: int, buckets: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.total, self.kinds, self.buckets = total, kinds, buckets
        self.slices = max(8, math.ceil(buckets / 4))  # of contexts
        self.base_unknown = 1.0 / (kinds + 1)

    def plain(self) -> tuple:
        """What it is made of: workers that lack this package rebuild it."""
        return self.words, self.counts, self.total, self.kinds, self.buckets

    def number(self, words: np.ndarray) -> np.ndarray:
        """1 + place among the frequent words, 0 for all others."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + 1, 0)


    def coded(self, words: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
        """Words as the numbers of the frequent ones, and the hashes of the others."""
        return [numbers.astype(np.uint16), words[numbers == 0]]

    def decoded(self, numbers: np.ndarray, others: np.ndarray) -> np.ndarray:
        words = np.empty(len(numbers), np.uint64)
        words[numbers == 0] = others
        words[numbers > 0] = self.words[numbers[numbers > 0].astype(np.int64) - 1]
        return words


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the least number of bytes that holds them."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: their lengths and types, then their bytes."""
    head = ";".join(f"{x.dtype.str},{len(x)}" for x in arrays).encode()
    whole = len(head).to_bytes(4, "little") + head + b"".join(x.tobytes() for x in arrays)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _unpacked(packed: memoryview) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for part in raw[4:at].decode().split(";"):
        kind, length = part.split(",")
        out.append(np.frombuffer(raw, kind, int(length), at))
        at += out[-1].nbytes
    return out


def _dealt(docs: DataFrame, lexicon: Lexicon, texts: bool) -> DataFrame:
    """``(bucket, batch, tokens)``: of each batch of texts, the pairs of each bucket.

    Arrays: words, pairs of each word, then context and training tokens of each pair.  With
    ``texts`` also tokens of each pair and the text of each token, and the number of texts of the
    batch; in bucket 0 then also their training flags, ids and which are null.
    """
    model = docs.sparkSession.sparkContext.broadcast(lexicon.plain())
    buckets = lexicon.buckets

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*model.value)
        name = TaskContext.get().partitionId() << 32
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                held = list(_tokens(batch.column(2)))
                words = np.concatenate([w for _, _, w in held])
                rows = np.concatenate([r + first for first, r, _ in held])
                context = np.empty_like(words)
                context[1:] = words[:-1]
                context[np.concatenate([[True], rows[1:] != rows[:-1]])] = END
                number = own.number(words)
                before = np.empty_like(number)
                before[1:] = number[:-1]
                starts = context == END
                before[starts] = own.number(context[starts])
                both = np.where(before > 0, scatter(words + before.astype(np.uint64)), context)
                bucket = np.where(number > 0, both, words) % np.uint64(buckets)
                # Equal pairs side by side; one that is torn apart by a chance tie is two.
                bits = max(1, (buckets - 1).bit_length())
                key = bucket << np.uint64(64 - bits) | words >> np.uint64(bits + 20) << np.uint64(20) | context >> np.uint64(44)
                order = np.argsort(key)
                words, context, number, before = words[order], context[order], number[order], before[order]
                bucket, rows = bucket[order].astype(np.int64), rows[order]
                training = np.asarray(batch.column(1)).astype(np.uint8)
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                other = np.concatenate([[True], (words[1:] != words[:-1]) | (bucket[1:] != bucket[:-1])])
                pair = np.flatnonzero(other | np.concatenate([[True], context[1:] != context[:-1]]))
                first = np.flatnonzero(other[pair])
                size = np.diff(np.append(pair, len(words)))
                trained = np.add.reduceat(training[rows].astype(np.int64), pair)
                pairs = np.diff(np.append(first, len(pair)))
                pair_edge = np.searchsorted(pair, edge)
                word_edge = np.searchsorted(first, pair_edge)
                absent = np.asarray(batch.column(0).is_null()).astype(np.uint8)
                ids = np.asarray(batch.column(0).fill_null(0))
                blobs, to = [], []
                for b in range(buckets):
                    if b and edge[b] == edge[b + 1]:
                        continue  # bucket 0 gets the texts' ids in any case
                    to.append(b)
                    w = pair[first[word_edge[b] : word_edge[b + 1]]]
                    part = slice(pair_edge[b], pair_edge[b + 1])
                    arrays = [*own.coded(words[w], number[w]), _small(pairs[word_edge[b] : word_edge[b + 1]]),
                              *own.coded(context[pair[part]], before[pair[part]]), _small(trained[part])]
                    if texts:
                        arrays += [_small(size[part]), rows[edge[b] : edge[b + 1]].astype(np.uint16), np.array([len(training)])]
                        arrays += [] if b else [training, ids, absent]
                    blobs.append(_packed(*arrays))
                name += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array(np.full(len(to), name)), pa.array(blobs, pa.binary())],
                    names=["bucket", "batch", "tokens"],
                )

    return docs.select("doc_id", "training", "text").mapInArrow(deal, "bucket int, batch long, tokens binary")


def _placed(dealt: DataFrame, buckets: int) -> DataFrame:
    # More partitions than buckets, so that few buckets share one.
    return dealt.repartition(4 * buckets, "bucket").sortWithinPartitions("bucket")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    held, at = [], None
    for batch in batches:
        for bucket, name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if held and bucket != at:
                yield at, held
                held = []
            at = bucket
            held.append([*_unpacked(memoryview(raw.as_buffer())), name])
    if held:
        yield at, held


class Bucket:
    """The pairs of one bucket: words, contexts, and training counts of the pairs."""

    def __init__(self, own: Lexicon, parts: list[list]):
        joined = lambda k: np.concatenate([p[k] for p in parts]).astype(np.int64)
        self.words, place = np.unique(np.concatenate([own.decoded(p[0], p[1]) for p in parts]), return_inverse=True)
        self.contexts, room = np.unique(np.concatenate([own.decoded(p[3], p[4]) for p in parts]), return_inverse=True)
        key, self.at = np.unique(np.repeat(place, joined(2)) << 32 | room, return_inverse=True)
        self.word, self.room = key >> 32, key & 0xFFFFFFFF
        trained = np.bincount(self.at, joined(5), len(key)).astype(np.int64)
        self.pairs = np.flatnonzero(trained)
        self.customers = trained[self.pairs]
        self.dish, self.context = self.word[self.pairs], self.room[self.pairs]
        self.count = np.bincount(self.dish, self.customers, len(self.words)).astype(np.int64)
        self.slice = (scatter(self.contexts) % np.uint64(own.slices)).astype(np.int64)


def seat(rng: np.random.Generator, customers: np.ndarray, new: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each dish after its customers have come one after another: the next sits at a
    new table with weight ``new``, at an old one with ``customers so far - discount * tables``.

    Beyond 32 customers they come in groups of a tenth of those seated, all under the weights
    at the middle of the group.
    """
    tables = (customers > 0).astype(np.float64)
    order = np.argsort(-customers, kind="stable")
    sorted_customers = customers[order]
    done = 1
    most = int(sorted_customers[0]) if len(order) else 0
    while done < most:
        group = 1 if done < 32 else done // 10
        who = order[: np.searchsorted(-sorted_customers, -done, "left")]
        coming = np.minimum(group, customers[who] - done)
        old = done + (coming - 1) / 2 - discount * tables[who]
        tables[who] += rng.binomial(coming, new[who] / (new[who] + old))
        done += group
    return tables


def _parent(rng, below: np.ndarray, discount: float, tables_in_all: float, customers_in_all: float, unknown: float):
    """Probability of each word in the parent restaurant, from its customers ``below``; and its tables."""
    fresh = (STRENGTH + discount * tables_in_all) * unknown
    tables = seat(rng, below.astype(np.int64), np.full(len(below), fresh), discount)
    return (below - discount * tables + fresh) / (STRENGTH + customers_in_all), tables


def _first_round(dealt: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(slice, bucket, sums)``: what each bucket brings to each slice.

    Arrays: contexts with their customers and tables; frequent words with their customers in the
    parent; and, in one slice, (customers, tables in the parent of rare words, pairs seen once and
    twice, rare parent customers seen once and twice).
    """
    model = dealt.sparkSession.sparkContext.broadcast(lexicon.plain())

    def burn_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*model.value)
        d1, d0 = FIRST_DISCOUNTS
        for number, parts in _by_bucket(batches):
            b, rng = Bucket(own, parts), np.random.default_rng((1, number))
            contexts = len(b.contexts)
            frequent = own.number(b.words)
            # Frequent words and contexts are spread over all buckets, and so is what they bring to the parent.
            share = np.where(frequent > 0, own.buckets, 1)
            spread = np.where(own.number(b.contexts) > 0, own.buckets, 1)
            tables = np.ones(len(b.pairs))
            top = np.zeros(len(b.words))
            for _ in range(SWEEPS):
                below = np.bincount(b.dish, tables, len(b.words))
                chance, top = _parent(rng, below * share, d0, max(1.0, top.sum() * own.buckets), below.sum() * own.buckets, own.base_unknown)
                rooms = np.bincount(b.context, tables, contexts) * spread
                tables = seat(rng, b.customers, (STRENGTH + d1 * rooms[b.context]) * chance[b.dish], d1)
            below = np.bincount(b.dish, tables, len(b.words))
            rare = frequent == 0
            often = np.flatnonzero(~rare & (below > 0))
            ones = lambda x, k: int((x == k).sum())
            totals = [below.sum(), top[rare].sum(), ones(b.customers, 1), ones(b.customers, 2), ones(below[rare], 1), ones(below[rare], 2)]
            seats, tables = np.bincount(b.context, b.customers, contexts), np.bincount(b.context, tables, contexts)
            for k in range(own.slices):
                here, word = np.flatnonzero(b.slice == k), often[frequent[often] % own.slices == k]
                sums = [b.contexts[here], _small(seats[here]), _small(tables[here]), frequent[word].astype(np.uint16), _small(below[word])]
                sums.append(np.array(totals, np.float64) if number % own.slices == k else np.zeros(6))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([number], pa.int64()), pa.array([_packed(*sums)], pa.binary())], names=["slice", "bucket", "sums"]
                )

    return dealt.mapInArrow(burn_in, "slice int, bucket long, sums binary")


def _exchanged(first: DataFrame, slices: int) -> DataFrame:
    """``(bucket, batch, tokens)``: the sums over all buckets of the contexts that a bucket brought
    to a slice, in their order, with batch ``-1 - slice``; in bucket -1 the other sums of the slice."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in _by_bucket(batches):
            _, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            seats, tables = (np.bincount(place, np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (1, 2))
            words, at = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
            below = np.bincount(at, np.concatenate([p[4] for p in parts]), len(words)).astype(np.float64)
            begin, to, blobs = 0, [-1], [_packed(words, below, sum(p[5] for p in parts))]
            for p in parts:
                own = place[begin : begin + len(p[0])]
                begin += len(p[0])
                to.append(p[-1])
                blobs.append(_packed(_small(seats[own]), _small(tables[own])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array(np.full(len(to), -1 - number)), pa.array(blobs, pa.binary())], names=["bucket", "batch", "tokens"]
            )

    return first.repartition(4 * slices, "slice").sortWithinPartitions("slice").mapInArrow(added, "bucket int, batch long, tokens binary")


class Shared:
    """What the parts of the parent restaurant in all tasks add up to."""

    def __init__(self, lexicon: Lexicon, sums: list[bytes]):
        self.below = np.zeros(len(lexicon.words) + 1)
        self.parent_customers = self.parent_tables = 1.0
        self.discounts = list(FIRST_DISCOUNTS)
        totals = np.zeros(6)
        for words, below, part in (_unpacked(memoryview(raw)) for raw in sums):
            self.below[words] = below
            totals = totals + part
        for k in (0, 1):
            once, twice = totals[2 + 2 * k : 4 + 2 * k]
            if once + twice > 0:  # the usual estimate from things seen once and twice
                self.discounts[k] = float(min(0.95, max(0.05, once / (once + 2 * twice))))
        if totals[0] > 0:
            self.parent_customers, rare_tables = totals[:2]
            self.chance, tables = _parent(
                np.random.default_rng(2), self.below, self.discounts[1], max(1.0, rare_tables), self.parent_customers, lexicon.base_unknown
            )
            self.parent_tables = rare_tables + tables.sum()


def _second_round(dealt: DataFrame, lexicon: Lexicon, shared: Shared) -> DataFrame:
    """``(doc_id, training, n_tokens, n_known, base, score)`` of each text: each bucket gives its
    part of all texts of a batch as one row, and the parts of a batch meet to be summed."""
    model = dealt.sparkSession.sparkContext.broadcast((lexicon.plain(), vars(shared)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, all_tasks = Lexicon(*model.value[0]), SimpleNamespace(**model.value[1])
        d1, d0 = all_tasks.discounts
        for number, parts in _by_bucket(batches):
            answers = {-1 - p[-1]: p for p in parts if p[-1] < 0}
            parts = [p for p in parts if p[-1] >= 0]
            b, rng = Bucket(own, parts), np.random.default_rng((2, number))
            seats, rooms = np.zeros(len(b.contexts)), np.zeros(len(b.contexts))
            for k in range(own.slices):
                seats[b.slice == k], rooms[b.slice == k] = answers[k][:2]
            frequent = own.number(b.words)
            often = frequent > 0
            counts = np.where(often, own.counts[np.maximum(frequent, 1) - 1] if len(own.counts) else 0, b.count)
            new = STRENGTH + d1 * rooms
            tables, mean = np.ones(len(b.pairs)), np.zeros(len(b.word))
            for sweep in range(SWEEPS + SAMPLES):
                below = np.bincount(b.dish, tables, len(b.words))
                chance, _ = _parent(rng, below, d0, all_tasks.parent_tables, all_tasks.parent_customers, own.base_unknown)
                if all_tasks.below.any():
                    chance = np.where(often, all_tasks.chance[frequent], chance)
                tables = seat(rng, b.customers, new[b.context] * chance[b.dish], d1)
                if sweep >= SWEEPS:
                    kept = new[b.room] * chance[b.word]
                    kept[b.pairs] += b.customers - d1 * tables
                    mean += kept / (STRENGTH + seats[b.room])
            score = np.log10(mean / SAMPLES)
            base = np.log10((counts + 0.5) / (own.total + 0.5 * (own.kinds + 1)))
            begin = 0
            for p in parts:
                pair = b.at[begin : begin + len(p[5])]
                begin += len(p[5])
                pair = np.repeat(pair, p[6])
                word, (rows, row) = b.word[pair], np.unique(p[7], return_inverse=True)
                sums = [np.bincount(row, x, len(rows)) for x in (None, (counts > 0)[word], base[word], score[pair])]
                # Of the texts that have tokens here; parts of scores are rounded to seven digits.
                sums = [rows, _small(sums[0].astype(np.int64)), _small(sums[1].astype(np.int64)), sums[2], sums[3].astype(np.float32)]
                side = p[9:-1] if number == 0 else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[-1]], pa.int64()), pa.array([_packed(*sums, *side)], pa.binary())], names=["batch", "sums"]
                )

    def summed(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        training, ids, absent = next(p[5:] for p in parts if len(p) > 5)
        total = np.zeros((4, len(ids)))
        for rows, *sums in (p[:5] for p in parts):
            for line, x in zip(total, sums):
                line[rows] += x
        counts = total[:2].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=absent.astype(bool)), pa.array(training.astype(bool)), pa.array(counts[0]), pa.array(counts[1]),
             pa.array(total[2]), pa.array(total[3])],
            names=["doc_id", "training", "n_tokens", "n_known", "base", "score"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and name != at:
                    yield summed(held)
                    held = []
                at = name
                held.append(_unpacked(memoryview(raw.as_buffer())))
        if held:
            yield summed(held)

    parts = dealt.mapInArrow(scored, "batch long, sums binary").repartition("batch").sortWithinPartitions("batch")
    return parts.mapInArrow(added, "doc_id long, training boolean, n_tokens long, n_known long, base double, score double")


def held_out(id_column: Column) -> Column:
    """Rows that never train: a fifth of all, by the checksum of the id (a null id reads as empty)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def score(docs: DataFrame, held: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    Learns from the rows that ``held`` (default: ``held_out`` of the id) leaves in.  A null or
    empty text is its end only.  Words in lower case (A-Z only).  Repeated rows are texts like
    others; null ids are kept; other columns are not read.
    Without training rows every token is unknown.
    """
    spark = docs.sparkSession
    held = held_out(F.col(id_column)) if held is None else held
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (~held).alias("training"), F.col(text_column).alias("text"))
    path = scratch_folder(spark)
    _word_counts(rows.where("training")).write.parquet(path)
    counts = spark.read.parquet(path)
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = counts.where(F.col("n") * FREQUENT >= total).collect()  # at most FREQUENT words can be so frequent
    lexicon = Lexicon(
        np.array([r["w"] for r in often], np.int64).view(np.uint64), np.array([r["n"] for r in often], np.int64),
        total, kinds, max(8, math.ceil(total / BUCKET_TOKENS)),
    )
    path = scratch_folder(spark)
    first = _first_round(_placed(_dealt(rows, lexicon, False), lexicon.buckets), lexicon)
    _exchanged(first, lexicon.slices).write.parquet(path)
    sums = spark.read.schema("bucket int, batch long, tokens binary").parquet(path)
    shared = Shared(lexicon, [bytes(r["tokens"]) for r in sums.where("bucket < 0").select("tokens").collect()])  # a row per slice
    dealt = _placed(_dealt(rows, lexicon, True).unionByName(sums.where("bucket >= 0")), lexicon.buckets)
    return _second_round(dealt, lexicon, shared).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
