"""Similarity join on word n-grams by adaptive multi-match prefixes, and its groups.

Two texts link when ``100 * |x & y| >= percent * |x | y|`` for their sets of n-grams.

* Texts with equal sets are one class; only one representative of it goes on.
* Every n-gram has a place in one order: rare first.  How rare, a table of ``COUNTERS``
  counters tells (one pass, summed over the tasks; only speed depends on it), and a hash
  decides among equals.  A text of n n-grams that must share a with its partner looks only
  at its prefix of ``n - a + l``: partners share at least l n-grams of their prefixes.
* l adapts: texts whose prefix promises many candidates get a longer one.  A pair is
  verified only when it shares as many prefix n-grams as its two prefixes demand, which for
  partners of like size is a good part of the prefix.
* Near copies of one text would be candidates all with all.  So pairs with a few pivots of
  each prefix n-gram are verified first; they link most of a group, and pairs that share half
  of their n-grams make a neighbourhood.  Inside a neighbourhood, texts outside its largest
  group are compared with all others in blocks, where pairs are numbers of a matrix, not
  rows.  Candidate pairs from prefixes are only made between neighbourhoods.
  None of this is capped, so no link between groups is lost.

N-grams are 58-bit hashes under six bits of rarity; two differ in a pair of texts of a
thousand n-grams each with a chance of error of 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfault.llm.components import components
from fleetfault.llm.sketch import SCHEMA, bloom, maybe_in, merged, pieces
from fleetfault.llm.words import release_stores, resting, scatter, slices, span_hashes, text_bytes, window_hashes, word_spans
from fleetfault.operators.ordering import top_rows
from fleetfault.session import written

SHINGLE = 5
PERCENT = 80
COUNTERS = 1 << 22
LONG_COST = 64  # expected partners from which a prefix is lengthened
PIVOTS = 2  # per prefix n-gram
TRIES = 2  # pivots verified per text
BATCH_BYTES = 4 << 20  # handed to a Python worker at once
BLOCK = 256  # texts on either side of a block
_LOW = np.uint64((1 << 58) - 1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Distinct n-gram hashes of each text, ascending; words in lower case (A-Z only).

    Fewer words than ``size``: one n-gram of all words.  No words: an empty set.
    """
    data, borders = text_bytes(column)
    for low, high in slices(borders):
        part, edges = data[borders[low] : borders[high]], borders[low : high + 1] - borders[low]
        rows, starts, ends = word_spans(part, edges)
        words = span_hashes(part, starts, ends, True)
        grams, at = window_hashes(words, rows, size)
        first = np.searchsorted(rows[at] if len(at) else at, np.arange(high - low + 1))
        word_edge = np.searchsorted(rows, np.arange(high - low + 1))
        for k in range(high - low):
            n = word_edge[k + 1] - word_edge[k]
            if n >= size:
                yield np.unique(grams[first[k] : first[k + 1]])
            elif n:
                own = words[word_edge[k] : word_edge[k + 1]]
                yield window_hashes(own, np.zeros(n, np.int64), int(n))[0] ^ np.uint64(n)
            else:
                yield np.zeros(0, np.uint64)


def _rarity(docs: DataFrame, size: int) -> np.ndarray:
    """Six-bit class of each counter: 0 up to twice the mean, then one more for each doubling."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_stores()  # in a pipeline, a tokenizer's may be there
        counts = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for grams in shingle_sets(batch.column(0), size):
                np.add.at(counts, (grams & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        yield pieces(counts)

    counts = merged(docs.select("text").mapInArrow(lambda batches: resting(counted(batches)), SCHEMA), COUNTERS, np.int32, np.add)
    return np.clip(np.log2(np.maximum(counts, 1) / max(2 * counts.mean(), 4)) + 1, 0, 63).astype(np.uint8)


def _profiles(docs: DataFrame, size: int, percent: int, rarity: np.ndarray) -> DataFrame:
    """``(id, doc_id, n, s1, s2, p, prefix)``: set size, identity of the set, and prefix of each text."""
    table = docs.sparkSession.sparkContext.broadcast(rarity)

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = table.value
        weight = np.exp2(np.arange(64)) * 2
        for batch in batches:
            n, s1, s2, prefixes = [], [], [], []
            for grams in shingle_sets(batch.column(1), size):
                tokens = _ordered(grams, classes)
                count = len(tokens)
                p = count - -(-count * percent // 100) + 1 if count else 0
                hot = tokens[:p] >> np.uint64(58)
                cost = weight[hot[hot > 0].astype(np.int64)].sum()
                if cost > LONG_COST:  # demand l shared n-grams, more where more partners are expected
                    p = min(count, p + int(p * min(1.0, np.log2(cost / LONG_COST) / 4)))
                n.append(count)
                s1.append(int(grams.sum(dtype=np.uint64)) - (1 << 63))
                s2.append(int(scatter(grams).sum(dtype=np.uint64)) - (1 << 63))
                prefixes.append(tokens[:p].view(np.int64))
            sizes = np.array([len(x) for x in prefixes], np.int64)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sizes), lists],
                names=["id", "doc_id", "n", "s1", "s2", "p", "prefix"],
            )

    return docs.mapInArrow(lambda batches: resting(profiled(batches)), "id long, doc_id long, n long, s1 long, s2 long, p long, prefix array<long>")


def _ordered(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The n-grams as tokens in the order of the join."""
    rare = classes[(grams & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
    # The hash is spread anew: its low bits chose the counter.
    return np.unique(rare << np.uint64(58) | scatter(grams) & _LOW)


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``(id, grams)`` of the texts in ``ids``, made anew from the texts and written once."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bloom(ids.select("id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe_in(wanted.value, np.asarray(batch.column(0)))))
            found = list(shingle_sets(batch.column(1), size))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "grams"]
                )

    # Equal keys have equal sets.
    made = docs.select("id", "text").mapInArrow(lambda batches: resting(sets(batches)), "id long, grams binary")
    return written(made.join(ids, "id", "left_semi").dropDuplicates(["id"]))


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """``(a, b, link)`` for the pairs that share at least half of all their n-grams."""
    kept = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), size)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, link = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                union = len(x) + len(y) - both
                near.append(2 * both >= union)
                link.append(100 * both >= percent * union)
            whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link, pa.bool_())], names=["a", "b", "link"])
            yield whole.filter(pa.array([n or k for n, k in zip(near, link)], pa.bool_()))

    with_b = pairs.select("a", "b").join(kept.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    both = with_b.join(kept.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(lambda batches: resting(compared(batches)), "a long, b long, link boolean")


def block_links(ids: np.ndarray, labels: np.ndarray, outside: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between texts of different labels, one of them ``outside``: a spanning forest of them.

    All intersections at once, as a product of the incidence matrices over the n-grams that
    more than one of the texts has.
    """
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    grams, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = times[place] > 1
    owner, column = np.repeat(np.arange(len(sets)), size)[shared], column[place[shared]]
    rows, others = np.flatnonzero(outside), np.arange(len(sets))
    both = np.zeros((len(rows), len(sets)), np.float32)
    for low in range(0, int((times > 1).sum()), 2048):
        here = (column >= low) & (column < low + 2048)
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[here], column[here] - low] = 1
        both += part[rows] @ part.T
    union = size[rows][:, None] + size[None, :] - both
    linked = (100 * both >= percent * union) & (labels[rows][:, None] != labels[None, :])
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = find(int(labels[rows[i]])), find(int(labels[others[j]]))
        if x != y:
            root[x] = y
            found.append((int(ids[rows[i]]), int(ids[others[j]])))
    return found


def _within(docs: DataFrame, near: DataFrame, labels: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between groups of one neighbourhood, ``near (id, k)``, in blocks of about ``BLOCK``
    texts: those outside the largest group against all, block by block."""
    members = near.join(labels, "id", "left").select("id", "k", F.coalesce("g", "id").alias("g"))
    parts = members.groupBy("k", "g").agg(F.count(F.lit(1)).alias("c"))
    sizes = parts.groupBy("k").agg(
        F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("g", F.struct("c", "g")).alias("top"), F.count(F.lit(1)).alias("groups")
    ).where("groups > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    rows = members.join(sizes, "k").select(
        "id", "k", "g", (F.col("g") != F.col("top")).alias("outside"), blocks(F.col("m")).alias("all"), blocks(F.col("m") - F.col("most")).alias("few")
    )
    rows = written(rows)
    sets = _sets(docs, rows.select("id"), size)
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    every = rows.select("*", own(F.col("all")).alias("i"), F.explode(F.expr("sequence(0, few - 1)")).alias("j")).withColumn("outside", F.lit(False))
    some = rows.where("outside").select("*", F.explode(F.expr("sequence(0, all - 1)")).alias("i"), own(F.col("few")).alias("j")).select(every.columns)
    dealt = every.unionByName(some).select("id", "k", "g", "outside", "i", "j").join(sets, "id")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            once = {}
            for _, ident, g, outside, grams in held:  # a text may be on both sides
                once[ident] = (g, outside or once.get(ident, (0, False))[1], grams)
            ids = np.array(list(once), np.int64)
            found = block_links(
                ids, np.array([x[0] for x in once.values()]), np.array([x[1] for x in once.values()]),
                [np.frombuffer(x[2], np.uint64) for x in once.values()], percent,
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            for k, i, j, ident, g, outside, grams in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != (k, i, j):
                    yield flush()
                    held = []
                held.append(((k, i, j), ident, g, outside, grams))
        if held:
            yield flush()

    ordered = dealt.select("k", "i", "j", "id", "g", "outside", "grams").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return ordered.mapInArrow(lambda batches: resting(linked(batches)), "a long, b long")


def _demand(percent: int) -> str:
    """Prefix n-grams that the pair (n, p), (n2, p2) must share: its least overlap, less what
    may lie behind the prefix that ends first."""
    return f"greatest(1, cast(ceil({percent} * (n + n2) / {100 + percent}D - 1e-9) as bigint) - greatest(n - p, n2 - p2))"


def _links(docs: DataFrame, tokens: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that connect the representatives as all their links would."""
    fits = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"

    # One shuffle by n-gram serves both the sums and the join.
    tokens = tokens.repartition("token")
    pivot = [F.struct(F.xxhash64(F.lit(k), "id").alias("h"), "id", "n", "p") for k in range(PIVOTS)]
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), *[F.min(x).alias(f"pivot{k}") for k, x in enumerate(pivot)])
    buckets = written(tokens.join(shared.where("df > 1"), "token"))

    tried = buckets.select("id", "n", "p", F.explode(F.array(*[f"pivot{k}" for k in range(PIVOTS)])).alias("v")).select(
        "id", "n", "p", F.col("v.id").alias("id2"), F.col("v.n").alias("n2"), F.col("v.p").alias("p2"))
    tried = tried.where(f"id != id2 and {fits}").groupBy("id", "n", "p", "id2", "n2", "p2").agg(F.count(F.lit(1)).alias("c"))
    # Shared n-grams of other pivots are not in c, so a part of the demand is enough to try.
    tried = top_rows(tried.where(f"{2 * PIVOTS} * c >= {_demand(percent)}"), ["id"], [F.col("c").desc(), F.col("id2")], TRIES)
    pairs = written(tried.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())
    tried = written(_verified(docs, pairs, size, percent))
    first = tried.where("link").select("a", "b")
    labels = components(first).select(F.col("node").alias("id"), F.col("component").alias("g"))
    near = components(tried.select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("k"))
    inside = _within(docs, near, labels, size, percent)

    grouped = buckets.select("token", "id", "n", "p").join(near.withColumnRenamed("k", "component"), "id", "left")
    grouped = written(grouped.select("token", "id", "n", "p", F.coalesce("component", "id").alias("g")))
    largest = (
        grouped.groupBy("token", "g").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("token").agg(F.max_by("g", F.struct("c", "g")).alias("top"), F.count(F.lit(1)).alias("groups"))
        .where("groups > 1").select("token", "top")
    )
    mixed = grouped.join(largest, "token")
    outside = mixed.where("g != top").select(
        "token", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("p").alias("p2"), F.col("g").alias("g2"))
    # Both outside the largest group: from one side only.
    apart = mixed.join(outside, "token").where(f"g != g2 and (g = top or id < id2) and {fits}")
    enough = (
        apart.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
        .agg(F.count(F.lit(1)).alias("c"), F.first(F.expr(_demand(percent))).alias("demand"))
        .where("c >= demand")
    )
    rest = written(enough.select("a", "b").join(pairs, ["a", "b"], "left_anti"))
    return first.unionByName(inside).unionByName(_verified(docs, rest, size, percent).where("link").select("a", "b"))


def _grouped(docs: DataFrame, size: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """``(key, doc_id, n, class_id, component_id, stays)`` for each row; ``stays`` is the key of the row
    with the lowest id of its group, null without words or without any id.

    Inside, a row is its key, a hash of id and text: rows that share an id and not the text are two.
    """
    # Sets of long texts are large: batches of few bytes.  All of this runs before the function returns.
    spark, limit = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(BATCH_BYTES))
    try:
        profile, known = _known(docs, size, percent, id_column, text_column)
    finally:
        spark.conf.set(limit, before)
    alone = F.col("has_words").isNull()
    return profile.select("id", "doc_id", "n", "s1", "s2").join(known, ["n", "s1", "s2"], "left").select(
        F.col("id").alias("key"), "doc_id", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("id")).otherwise(F.col("stays")).alias("stays"),
    )


def _known(docs: DataFrame, size: int, percent: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """The written profiles of the rows, and of each set of n-grams its lowest ids."""
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    source = plain.select(row_key(F.col("doc_id"), "text").alias("id"), "text", "doc_id")
    rarity = _rarity(source, size)
    profile = written(_profiles(source, size, percent, rarity))

    lowest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "id"))).alias("low")
    classes = written(profile.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("node"), lowest))
    chosen = profile.join(classes.select(F.col("node").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    tokens = chosen.select("id", "n", "p", F.explode("prefix").alias("token"))
    linked = components(_links(source, tokens, size, percent))

    known = classes.join(linked, "node", "left").select("n", "s1", "s2", "low", F.coalesce("component", "node").alias("component"))
    known = written(known)
    lows = known.groupBy("component").agg(F.min("low").alias("first"))
    return profile, known.join(lows, "component").select(
        "n", "s1", "s2", F.lit(True).alias("has_words"), F.col("low.doc_id").alias("class_id"),
        F.col("first.doc_id").alias("component_id"), F.col("first.id").alias("stays"),
    )


def row_key(ident: Column, text_column: str) -> Column:
    """A 64-bit name of an id and its text."""
    return F.xxhash64(ident.isNull(), ident, text_column)


def groups(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id)`` for each row of ``docs``.

    ``class_id``: lowest id with an equal set; ``component_id``: lowest id that links reach.
    Texts without words (null, empty, blank) have no n-grams and link with nothing.  Rows that
    share an id are rows of their own: each has its links by its text.  A null id counts behind all
    others and is null in the result where a group has no other.  Other columns are not read.
    """
    found = _grouped(docs, size, percent, id_column, text_column)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` less the near copies: of each group the row with the lowest ``doc_id`` stays.

    Rows without words link with nothing and stay; rows with a null id all stay.  Of
    repeated rows (equal ids and texts) one stays; other rows that share an id are judged by their text.
    """
    found = _grouped(docs, size, percent, "doc_id", "text")
    stays = found.where("doc_id is not null and key = stays").select(F.col("key").alias("stays")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(F.col("doc_id").cast("long"), "text").alias("key"))
    named = rows.where("doc.doc_id is not null")
    # The join leaves rows in order of the key, which the window needs.
    first = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    once = named.join(stays, F.col("key") == F.col("stays"), "left_semi").withColumn("nth", first).where("nth = 1")
    return once.select("doc.*").unionByName(rows.where("doc.doc_id is null").select("doc.*"))
