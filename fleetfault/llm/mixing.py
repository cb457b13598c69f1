"""Mixing sources to target weights, in DataFrame functions only.

Targets: each source gets its weight's part of all words, at most ``MAX_EPOCHS`` times its
own size; what is above that is shared again by weight until nothing is above.  That is
the water level L with ``target = least(3 * size, L * weight)`` and all words handed out,
found from running sums over the sources, one row for each.

Draw: the texts of a source stand in the order of a seeded hash, and again in that order
for each further epoch.  Its target cuts a line of words off that row, and the line is
cut into blocks of ``BLOCK_WORDS``.  The blocks of all sources are dealt to output shards
by a splitting tree: a node holds an exact number of blocks of each source and passes half
of all its blocks to its left child, each source's part drawn from the multivariate
hypergeometric law (one hypergeometric draw after another, by inversion).  A shard then
takes the next blocks of each source, so blocks are disjoint, and its texts are shuffled
inside it.  All draws are hashes of the seed, so reruns agree.

No source is gathered in one task: texts are summed in buckets of about ``BUCKET_ROWS``
rows over all sources, and only bucket sums are scanned for each source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetfault.session import materialize, scratch_folder

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 8192
SHARD_BLOCKS = 64
BUCKET_ROWS = 1 << 11
LEVELS_PER_CUT = 6


def _size(text_column: str):
    return F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``(doc_id, source, size)`` of each row; a null text has size 0."""
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        _size(text_column).alias("size"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_no, source_size, target)`` for each source, from ``(source, size)`` rows.

    Sources by code point, null last, take the weights in turn.  Without words all targets are 0.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    # A source is full once the level reaches size * epochs / weight: the fullest first.
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.array(*map(F.lit, weights))[F.col("source_no") % len(weights)].cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
    )
    rest = sources.select(
        "*",
        F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
        F.sum("source_size").over(everything).alias("words"),
    ).withColumn("level", (F.col("words") - F.col("full")) / F.col("open_weight"))
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    return rest.select(
        "source", "source_no", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target")
    )


def _draw(m: str, k: str, n: str, u: str) -> str:
    """One hypergeometric draw: of ``n`` blocks out of ``m``, how many are of the source that has ``k``.

    Inversion of the uniform number ``u``: probabilities are summed from the mode outwards,
    relative to the mode's, for 12 standard deviations, beyond which doubles are 0.
    """
    low, high = f"greatest(0L, {n} - ({m} - {k}))", f"least({n}, {k})"
    mode = f"least({high}, greatest({low}, ({n} + 1) * ({k} + 1) div ({m} + 2)))"
    reach = f"(cast(12 * sqrt({n} * ({k} / {m}) * (1 - {k} / {m}) * (({m} - {n}) / greatest({m} - 1, 1L))) as bigint) + 12)"
    up = f"(({k} - x) * ({n} - x) / ((x + 1) * ({m} - {k} - {n} + x + 1)))"  # weight of x + 1 over that of x
    down = f"(x * ({m} - {k} - {n} + x) / (({k} - x + 1) * ({n} - x + 1)))"  # weight of x - 1 over that of x
    rising = "filter(sequence(b.mode, b.mode + b.reach), x -> x < b.high)"
    falling = "filter(sequence(b.mode, b.mode - b.reach, -1L), x -> x > b.low)"
    total = lambda values, ratio: (
        f"aggregate({values}, struct(1D as w, 0D as t), (a, x) -> struct(a.w * {ratio} as w, a.t + a.w * {ratio} as t), a -> a.t)"
    )
    find = lambda values, ratio, step, begun: (
        f"aggregate({values}, struct(1D as w, {begun} as t, b.mode as at), (a, x) -> if(a.t > b.goal, a, "
        f"struct(a.w * {ratio} as w, a.t + a.w * {ratio} as t, x {step} as at)))"
    )
    one = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    bounds = f"struct({low} as low, {high} as high, {mode} as mode, {reach} as reach)"
    sums = f"struct(b.*, 1D + {total(rising, up)} as above, {total(falling, down)} as below)"
    sums = sums.replace("b.*", "b.low as low, b.high as high, b.mode as mode, b.reach as reach")
    goal = "struct(b.low as low, b.high as high, b.mode as mode, b.reach as reach, b.above as above, {u} * (b.above + b.below) as goal)"
    picked = f"if(b.goal < b.above, {find(rising, up, '+ 1', '1D')}.at, {find(falling, down, '- 1', 'b.above')}.at)"
    return one(bounds, "b", one(sums, "b", one(goal.format(u=u), "b", picked)))


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """``(shard, source_no, n)``: the exact ``(source_no, n)`` blocks dealt to ``2 ** levels`` shards.

    The sources of a node meet in one row, so a row is as long as there are sources.
    """
    uniform = "(shiftrightunsigned(xxhash64(node, s.source_no, {}L), 11) / 9007199254740992D)"
    tree = quotas.where("n > 0").select(F.lit(0).cast("long").alias("node"), "source_no", F.col("n").cast("long").alias("n"))
    for level in range(levels):
        # rest: blocks of this and later sources; want: how many of them still go left
        step = f"""aggregate(sources,
            struct(total as rest, total div 2 as want, cast(array() as array<struct<source_no: int, n: bigint, left_n: bigint>>) as out),
            (acc, s) -> element_at(transform(array({_draw('acc.rest', 's.n', 'acc.want', uniform.format(seed * 100 + level))}),
                d -> struct(acc.rest - s.n as rest, acc.want - d as want,
                            array_append(acc.out, struct(s.source_no as source_no, s.n as n, d as left_n)) as out)), 1),
            acc -> acc.out)"""
        halves = F.expr("inline(array(struct(node * 2 as node, d.source_no as source_no, d.left_n as n),"
                        " struct(node * 2 + 1 as node, d.source_no as source_no, d.n - d.left_n as n)))")  # fmt: skip
        tree = (
            tree.groupBy("node")
            .agg(F.array_sort(F.collect_list(F.struct("source_no", "n"))).alias("sources"), F.sum("n").alias("total"))
            .select("node", F.explode(F.expr(step)).alias("d"))
            .select(halves)
            .where("n > 0")
        )
        if level % LEVELS_PER_CUT == LEVELS_PER_CUT - 1:
            tree = materialize(tree)
    return tree.withColumnRenamed("node", "shard")


def draw(
    sizes: DataFrame, seed: int = 1, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
) -> DataFrame:
    """The mix: ``(doc_id, source, size, source_size, target, copies)`` for each row of ``sized``.

    ``copies`` lists ``(epoch, words, shard)`` for each time the mix takes the row; only the
    last copy that a source gives may be cut, at the word that fills its target.  Rows
    without words and sources without words have no copies.  Null ids and repeated rows are
    rows like others: equal rows are interchangeable.
    """
    spark = sizes.sparkSession
    path = scratch_folder(spark)
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    sizes.select("doc_id", "source", "size", key.alias("h")).write.parquet(path)
    rows = spark.read.parquet(path)
    n_rows = rows.count()
    buckets = max(1, math.ceil(n_rows / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.expr(f"shiftrightunsigned(h, 33) * {buckets}L div 2147483648L"))

    sources = materialize(targets(rows, weights, max_epochs)).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    blocks = sources.select("source_no", F.ceil(F.col("quota") / block_words).cast("long").alias("n"))
    n_blocks = blocks.agg(F.sum("n")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, n_blocks) / shard_blocks)))
    run = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = (
        split_tree(blocks, levels, seed)
        .withColumn("first", F.coalesce(F.sum("n").over(run), F.lit(0)))
        .select("source_no", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("block"))
    )

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn(
        "begun", F.coalesce(F.sum("words").over(before), F.lit(0)))
    s = sums.join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).select(
        F.col("source").alias("of"), F.col("bucket").alias("in_bucket"), "begun", "source_no", "source_size", "target", "quota")
    inside = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(s, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket"))).withColumn(
        "at", F.col("begun") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    copies = F.expr(
        f"filter(transform(sequence(0, {max_epochs - 1}), e -> struct(e as epoch, e * source_size + at as begins, "
        "greatest(0L, least(size, quota - (e * source_size + at))) as words)), c -> c.words > 0)"
    )
    # One row per row and copy, so that each copy finds its block; they meet again by row.
    placed = placed.withColumn("c", F.explode_outer(copies)).withColumn("block", F.expr(f"c.begins div {block_words}"))
    found = placed.join(dealt, ["source_no", "block"], "left")
    keys = ["doc_id", "source", "size", "source_size", "target", "h", "at"]
    taken = F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c.epoch", "c.words", "shard"))))
    # Rows equal in all keys have no words, for `at` tells others apart: count them.
    once = found.groupBy(*keys).agg(taken.alias("copies"), F.count(F.when(F.col("c").isNull(), 1)).alias("_n"))
    return once.select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        F.explode(F.expr("sequence(1, greatest(1, cast(_n as int)))")).alias("_k"),
    ).drop("_k")


def placements(drawn: DataFrame, seed: int = 1) -> DataFrame:
    """``(shard, place, doc_id, epoch, words)``: texts in the shuffled order of each output shard."""
    return drawn.select("doc_id", F.inline("copies")).select(
        "shard", F.xxhash64(F.lit(seed), "shard", "doc_id", "epoch").alias("place"), "doc_id", "epoch", "words"
    )


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``docs`` as mixed: every row as often as the mix takes it, with all its columns.

    Whole texts only: the one text of a source that the draw cuts is rounded to the nearest
    whole copy.  Rows that share id, source and size share the mean of their copies, rounded
    to the nearest; rows that share the id alone have nothing to do with each other.
    """
    drawn = draw(sized(docs), seed).where("size > 0")
    taken = F.expr("floor(aggregate(copies, 0L, (a, c) -> a + c.words) / size + 0.5)")
    counts = (
        drawn.groupBy(F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source"), F.col("size").alias("mixed_size"))
        .agg(F.floor(F.avg(taken) + 0.5).cast("int").alias("n"))
        .where("n > 0")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _size("text").alias("own_size"))
    joined = rows.join(
        counts,
        F.col("doc.doc_id").eqNullSafe(F.col("mixed_id")) & F.col("doc.source").eqNullSafe(F.col("mixed_source"))
        & (F.col("own_size") == F.col("mixed_size")),
    )
    return joined.select("doc", F.explode(F.expr("sequence(1, n)"))).select("doc.*")
