"""Ordered scans that hold when one key owns a third of all rows.

A plain ``Window.partitionBy(report)`` sends a whole report to one task.  Here
the rows of a key are cut into chunks of consecutive order values.  A window
works inside each chunk, one summary row per chunk is scanned per key, and the
result is joined back on ``(keys, chunk)``.  A task holds at most
``chunk_rows`` rows, because the order column is an integer that is unique
inside the keys; the per-key scan sees one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfault.session import materialize

CHUNK_ROWS = 1 << 17


def chunk_of(order: str, chunk_rows: int) -> Column:
    return F.expr(f"`{order}` div {int(chunk_rows)}")


def _inside(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys, "_chunk").orderBy(order)


def _upto_row(keys: Sequence[str], order: str):
    return _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier_chunks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Running values up to and including each row.

    ``last``: the latest non-null value; ``total``: the running sum (as long).
    """
    last, total = last or {}, total or {}
    staged = df.withColumn("_chunk", chunk_of(order, chunk_rows))
    for name, value in {**last, **total}.items():
        staged = staged.withColumn(f"_v_{name}", value)

    ends = [
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_c_{n}") for n in last
    ] + [F.sum(F.coalesce(F.col(f"_v_{n}"), F.lit(0)).cast("long")).alias(f"_c_{n}") for n in total]
    before = _earlier_chunks(keys)
    carried = (
        staged.groupBy(*keys, "_chunk")
        .agg(*ends)
        .select(
            *keys,
            "_chunk",
            *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last],
            *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in total],
        )
        # Most keys have one chunk and their first chunk has nothing before it.
        .where(reduce(or_, [F.col(f"_c_{n}").isNotNull() for n in [*last, *total]]))
    )
    upto = _upto_row(keys, order)
    inside = staged.select(
        *staged.columns,
        *[F.last(f"_v_{n}", ignorenulls=True).over(upto).alias(f"_w_{n}") for n in last],
        *[F.sum(F.coalesce(F.col(f"_v_{n}"), F.lit(0)).cast("long")).over(upto).alias(f"_w_{n}") for n in total],
    )
    joined = inside.join(carried, [*keys, "_chunk"], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_w_{n}", f"_c_{n}").alias(n) for n in last],
        *[(F.col(f"_w_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in total],
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``value`` of the row before, across chunk borders; null on a key's first row."""
    staged = df.withColumn("_chunk", chunk_of(order, chunk_rows)).withColumn("_v", F.struct(value.alias("v")))
    carried = (
        staged.groupBy(*keys, "_chunk")
        .agg(F.max_by("_v", order).alias("_end"))
        .select(*keys, "_chunk", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_c"))
        .where(F.col("_c").isNotNull())
    )
    inside = staged.withColumn("_w", F.lag("_v").over(_inside(keys, order)))
    return inside.join(carried, [*keys, "_chunk"], "left").select(
        *df.columns, F.coalesce("_w", "_c")["v"].alias(out)
    )


def mark_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    same: Sequence[str],
    out: str = "run_start",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Label maximal runs of neighbouring rows that agree on ``same``.

    The label is the order value of the run's first row.  One pass: chunks
    label the runs that start inside them, and the chunk summaries tell which
    chunk continues the run of the chunk before.
    """
    staged = df.withColumn("_chunk", chunk_of(order, chunk_rows)).withColumn("_v", F.struct(*same))
    staged = staged.withColumn("_p", F.lag("_v").over(_inside(keys, order)))
    staged = staged.withColumn("_s", F.when(F.col("_p").isNotNull() & ~F.col("_v").eqNullSafe(F.col("_p")), F.col(order)))
    staged = staged.withColumn("_w", F.max("_s").over(_upto_row(keys, order)))

    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    carried = (
        staged.groupBy(*keys, "_chunk")
        .agg(
            F.min_by("_v", order).alias("_first"),
            F.max_by("_v", order).alias("_last"),
            F.min(order).alias("_from"),
            F.max("_s").alias("_inner"),
        )
        .withColumn("_prior", F.lag("_last").over(chunks))
        .withColumn(
            "_opens", F.when(F.col("_prior").isNull() | ~F.col("_first").eqNullSafe(F.col("_prior")), F.col("_from"))
        )
        .withColumn("_open_end", F.coalesce("_inner", "_opens"))
        .select(
            *keys,
            "_chunk",
            F.coalesce(
                "_opens", F.last("_open_end", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1))
            ).alias("_c"),
        )
    )
    return staged.join(carried, [*keys, "_chunk"]).select(*df.columns, F.coalesce("_w", "_c").alias(out))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "pos") -> DataFrame:
    """Dense 0-based position per key under any total order.

    A range shuffle on ``(keys, order)`` spreads a hot key over many tasks.
    The placement is fixed by a checkpoint, then one row per (key, task) gives
    the offset.  ``order`` must not tie.
    """
    wanted = [*[F.col(k) for k in keys], *order]
    placed = materialize(
        df.repartitionByRange(*wanted).sortWithinPartitions(*wanted).withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_row", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_part")
        .agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    )
    return placed.join(offsets, [*keys, "_part"]).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(out))


def ordered_text(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    out: str,
    sep: str = "\n",
    chunk_rows: int = 4096,
) -> DataFrame:
    """Join the texts of a key in order.  Pieces are joined per chunk before the
    key's pieces meet, so the sort never sees more than ``chunk_rows`` texts."""

    def joined(frame: DataFrame, by: Sequence[str], rank: str, value: str, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("k"), F.col(value).alias("v"))))
        return frame.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: p["v"]), sep).alias(name))

    pieces = joined(
        df.withColumn("_chunk", chunk_of(order, chunk_rows)).where(F.col(text).isNotNull()),
        [*keys, "_chunk"], order, text, "_piece",
    )
    return joined(pieces, keys, "_chunk", "_piece", out)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Spark cuts each map task to ``k`` rows per key
    before the shuffle, so a hot key costs at most ``k`` rows per task."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= k)
