"""One timeline per report from four sources, equal neighbours merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.functions.reasons import label
from fleetfault.functions.text import boot_text, display_time, wall_text
from fleetfault.operators.ordering import mark_runs, with_position

KEYS = ("report_id",)


def epoch_table(meta: DataFrame, boot: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Boot moment of each report in milliseconds (UTC); null without report time or uptime."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return meta.select(*keys, "report_ts").join(boot.select(*keys, "uptime_s"), list(keys), "left").select(
        *keys,
        (F.timestamp_diff("MILLISECOND", start, F.col("report_ts")).cast("decimal(20,3)") - F.col("uptime_s") * 1000)
        .alias("boot_ms"),
    )


def kernel_time(boot_ms: Column, boot_s: Column) -> Column:
    """Wall-clock text where the boot moment is known, else seconds since boot."""
    wall = F.floor(boot_ms + boot_s * 1000).cast("long")
    return F.coalesce(wall_text(wall), boot_text(boot_s))


def timeline_rows(
    anomalies: DataFrame, events: DataFrame, heads: DataFrame, blocks: DataFrame, crashes: DataFrame,
    epochs: DataFrame, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Unordered rows with ``source_rank, seq`` = order among equal times.

    ``heads`` needs ``trace_idx`` and ``crashes`` needs ``file_idx``.
    """
    none = F.lit(None).cast("string")
    logs = anomalies.select(
        *keys, F.lit(0).alias("source_rank"), F.col("entry_idx").cast("long").alias("seq"), "ts_text",
        F.lit("logcat").alias("source"), "severity", F.col("summary").alias("label"),
        F.col("process_name").alias("details"),
    )
    kernel = events.join(epochs, list(keys), "left").select(
        *keys, F.lit(1).alias("source_rank"), F.col("entry_idx").cast("long").alias("seq"),
        kernel_time(F.col("boot_ms"), F.col("boot_s")).alias("ts_text"), F.lit("kernel").alias("source"), "severity",
        F.col("summary").alias("label"), none.alias("details"),
    )
    main = blocks.where("role = 'main'").join(
        heads.select(*keys, "trace_id", "trace_idx", "process_name", "ts_text"), [*keys, "trace_id"]
    )
    traces = main.select(
        *keys, F.lit(2).alias("source_rank"), F.col("trace_idx").cast("long").alias("seq"),
        display_time(F.coalesce("ts_text", F.lit("unknown"))).alias("ts_text"), F.lit("anr").alias("source"),
        F.when(F.col("reason") == "idle_main_thread", "info").otherwise("critical").alias("severity"),
        F.concat(F.lit("ANR: "), label(F.col("reason")), F.lit(" in "), "process_name").alias("label"),
        F.concat(F.lit("Confidence: "), "confidence").alias("details"),
    )
    dumps = crashes.select(
        *keys, F.lit(3).alias("source_rank"), F.col("file_idx").cast("long").alias("seq"),
        display_time(F.coalesce("ts_text", F.lit("unknown"))).alias("ts_text"), F.lit("tombstone").alias("source"),
        F.lit("critical").alias("severity"), F.col("summary").alias("label"),
        F.col("crashed_in_binary").alias("details"),
    )
    return logs.unionByName(kernel).unionByName(traces).unionByName(dumps)


def sort_key(ts: Column) -> Column:
    return F.when(ts.startswith("boot+"), F.concat(F.lit("Z_"), ts)).when(ts == "unknown", "ZZ_unknown").otherwise(display_time(ts))


def order_timeline(rows: DataFrame, keys: Sequence[str] = KEYS, numeric_boot_sort: bool = False) -> DataFrame:
    """Adds the position in time order.

    Times compare as text under the Unicode collation, so ``boot+1000`` comes
    before ``boot+200``; ``numeric_boot_sort`` orders those by their seconds.
    """
    ts = F.col("ts_text")
    order = [F.collate(sort_key(ts), "UNICODE")]
    if numeric_boot_sort:
        seconds = F.regexp_extract(ts, r"^boot\+([\d.]+)s", 1).try_cast("decimal(18,3)")
        order = [F.when(ts.startswith("boot+"), 1).when(ts == "unknown", 2).otherwise(0), seconds, *order]
    return with_position(rows, keys, [*order, F.col("source_rank"), F.col("seq")])


def merge_runs(ordered: DataFrame, keys: Sequence[str] = KEYS, order: str = "pos") -> DataFrame:
    """Neighbours with equal label, source and severity become their first row with
    ``count`` and ``time_range``; single rows carry neither."""
    marked = mark_runs(ordered, keys, order, ["label", "source", "severity"])
    merged = marked.groupBy(*keys, "run_start").agg(
        F.min_by(F.struct("ts_text", "source", "severity", "label", "details"), order).alias("f"),
        F.count(F.lit(1)).alias("_n"),
        F.max_by("ts_text", order).alias("_to"),
    )
    many = F.col("_n") > 1
    return merged.select(
        *keys, F.col("run_start").alias("seq"), "f.*",
        F.when(many, F.col("_n")).alias("count"),
        F.when(many, F.concat("f.ts_text", F.lit(" ~ "), "_to")).alias("time_range"),
    )


def build_timeline(rows: DataFrame, keys: Sequence[str] = KEYS, numeric_boot_sort: bool = False) -> DataFrame:
    return merge_runs(order_timeline(rows, keys, numeric_boot_sort), keys)
