"""Health score of each report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.functions.penalties import PENALTIES, clamp, damped, overall

KEYS = ("report_id",)


def event_counts(
    anomalies: DataFrame, events: DataFrame, blocks: DataFrame, crashes: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``keys, type, n``.  Of a trace only the main thread counts."""
    main = blocks.where("role = 'main'").select(
        *keys,
        F.when(F.col("reason") == "idle_main_thread", "trace_idle")
        .when(F.col("reason") == "deadlock", "trace_deadlock")
        .otherwise("trace_other")
        .alias("type"),
    )
    every = [
        anomalies.select(*keys, "type"), events.select(*keys, "type"), main,
        crashes.select(*keys, F.lit("crash_dump").alias("type")),
    ]
    union = every[0]
    for part in every[1:]:
        union = union.unionByName(part)
    return union.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))


def deductions(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Points lost per report, sub-score and type."""
    rows = [(d, t, base, cap) for d, types in PENALTIES.items() for t, (base, cap) in types.items()]
    table = counts.sparkSession.createDataFrame(rows, "dimension string, type string, base int, cap int")
    # The penalty table is a fixed list of some thirty rows.
    return counts.join(F.broadcast(table), "type").select(
        *keys, "dimension", "type", "n", damped(F.col("n"), F.col("base"), F.col("cap")).alias("points")
    )


def health_scores(
    reports: DataFrame, counts: DataFrame, memory: DataFrame | None = None, cpu: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Sub-scores 0-100 and their weighted mean, for every report in ``reports``."""
    lost = deductions(counts, keys).groupBy(*keys).agg(
        *[F.sum(F.when(F.col("dimension") == d, F.col("points"))).alias(f"_{d}") for d in PENALTIES]
    )
    rows = reports.select(*keys).distinct().join(lost, list(keys), "left")
    score = {d: clamp(100 - F.coalesce(f"_{d}", F.lit(0))) for d in PENALTIES}
    if memory is not None:
        rows = rows.join(memory.select(*keys, "total_kb", "free_kb"), list(keys), "left")
        share = F.when(F.col("total_kb") > 0, F.col("free_kb") / F.col("total_kb"))
        score["memory"] = clamp(score["memory"] - F.when(share < 0.05, 20).when(share < 0.1, 10).otherwise(0))
    if cpu is not None:
        rows = rows.join(cpu.select(*keys, "total_percent", "iowait_percent"), list(keys), "left")
        busy, wait = F.col("total_percent"), F.col("iowait_percent")
        score["responsiveness"] = clamp(
            score["responsiveness"]
            - F.when(busy > 90, 15).when(busy > 80, 8).otherwise(0)
            - F.when(wait > 30, 10).when(wait > 20, 5).otherwise(0)
        )
    scored = rows.select(*keys, *[F.round(s, 0).cast("int").alias(d) for d, s in score.items()])
    return scored.select(*keys, overall({d: F.col(d) for d in PENALTIES}).alias("overall"), *PENALTIES)
