"""First rows within a distance, without meeting all pairs.

A bucketed range join still pairs every point with every value of a busy
bucket.  Since at most ``k`` values per point are wanted, values are cut to
``k`` per cell on a ladder of cell sizes (1, base, base**2, ...).  A point's
interval splits into a bounded number of whole cells, so a point meets at most
``cells * k`` values however many share its moment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.operators.ordering import top_rows


def _span(low: Column, high: Column, level: int) -> Column:
    cells = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(cells, lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))


def interval_cells(low: Column, high: Column, levels: int, base: int) -> Column:
    """Cells that tile ``[low, high]`` exactly, coarse in the middle."""
    parts: list[Column] = []
    b = F.lit(base).cast("long")
    for level in range(levels):
        up = F.ceil(low / b).cast("long") * b
        down = F.floor((high + 1) / b).cast("long") * b
        parts.append(_span(low, F.least(up - 1, high), level))
        parts.append(_span(F.greatest(down, up), high, level))
        low, high = F.ceil(low / b).cast("long"), F.floor((high + 1) / b).cast("long") - 1
    parts.append(_span(low, high, levels))
    return F.flatten(F.array(*parts))


def first_within(
    points: DataFrame,
    values: DataFrame,
    keys: Sequence[str],
    *,
    at: str,
    when: str,
    order: str,
    radius: int,
    k: int,
    base: int = 64,
) -> DataFrame:
    """For each distinct ``(keys, at)`` the first ``k`` values, by ``order``, whose
    ``when`` lies within ``radius``.  ``at`` and ``when`` are whole numbers in one unit."""
    levels = 0
    while base ** (levels + 1) <= radius:
        levels += 1
    top = base**levels

    centre = points.select(*keys, F.col(at).cast("long").alias(at)).distinct()
    probes = centre.withColumn(
        "_c", F.explode(interval_cells(F.col(at) - radius, F.col(at) + radius, levels, base))
    ).select(*keys, at, "_c.level", "_c.cell")

    touched = (
        centre.select(
            *keys,
            F.explode(
                F.sequence(F.floor((F.col(at) - radius) / top), F.floor((F.col(at) + radius) / top))
            ).alias("_zone"),
        )
    ).distinct()
    moment = F.col(when).cast("long")
    near = values.withColumn("_zone", F.floor(moment / top)).join(touched, [*keys, "_zone"], "left_semi").drop("_zone")
    ladder = F.array(
        *[F.struct(F.lit(n).alias("level"), F.floor(moment / base**n).alias("cell")) for n in range(levels + 1)]
    )
    cells = near.withColumn("_c", F.explode(ladder)).select("*", "_c.level", "_c.cell").drop("_c")
    kept = top_rows(cells, [*keys, "level", "cell"], [F.col(order)], k, "_r").drop("_r")
    met = probes.join(kept, [*keys, "level", "cell"]).drop("level", "cell")
    return top_rows(met, [*keys, at], [F.col(order)], k, "rank")
