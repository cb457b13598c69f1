"""Application-log operators: lines to entries, anomalies, context and tag statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfault.functions.log_rules import log_anomaly, tag_class, worth_checking
from fleetfault.functions.text import capture, computed_rows, log_time_ms, trimmed, whole, with_fields
from fleetfault.operators.dedup import anchored_groups
from fleetfault.operators.ordering import ordered_text, scan, top_rows

KEYS = ("report_id",)

# Fixed value: date, time, [uid], pid, tid, level, tag, message.  The group for the
# uid is optional, so the form with four numbers is tried before the one with three.
LINE = (
    r"^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+(?:\d+\s+)?(\d+)\s+(\d+)\s+([VDIWEF])\s+(.+?):\s+(.*)[\s\S]*\z"
)


def with_entry(lines: DataFrame, text: str = "raw", out: str = "e") -> DataFrame:
    """Adds ``struct(ts_text, ms, pid, tid, level, tag, message)`` or null; row-local."""
    p = F.col("_f")
    entry = F.struct(
        p[0].alias("ts_text"),
        log_time_ms(p[0]).alias("ms"),
        whole(p[1]).alias("pid"),
        whole(p[2]).alias("tid"),
        p[3].alias("level"),
        trimmed(p[4]).alias("tag"),
        p[5].alias("message"),
    )
    found = with_fields(lines, text, LINE, [1, 2, 3, 4, 5, 6], "_f")
    return found.withColumn(out, F.when(p.isNotNull(), entry)).drop("_f")


def _continues(text: Column) -> Column:
    return text.rlike(r"\S") & (text.startswith("\t") | text.startswith("  "))


def parse_log(
    lines: DataFrame, keys: Sequence[str] = KEYS, order: str = "line_no", text: str = "raw", stitch: bool = True
) -> DataFrame:
    """Entries with a dense 1-based ``entry_idx`` per report; indented lines that
    match no entry are appended to the entry before them."""
    raw = F.col(text)
    marked = with_entry(lines.select(*keys, F.col(order).cast("long").alias("line_no"), raw.alias("raw")))
    head = F.col("e").isNotNull()
    used = marked.where(head | _continues(F.col("raw"))) if stitch else marked.where(head)
    counted = scan(used, keys, "line_no", total={"entry_idx": head.cast("long")})
    entries = counted.where("e is not null").select(
        *keys, "entry_idx", "line_no", "e.*", "raw"
    )
    if stitch:
        # Stitched entries are few: only the continuation lines are grouped.
        tails = ordered_text(
            counted.where("e is null and entry_idx > 0"), [*keys, "entry_idx"], "line_no", "raw", "tail"
        )
        entries = entries.join(tails, [*keys, "entry_idx"], "left")
        for name in ("message", "raw"):
            entries = entries.withColumn(
                name, F.when(F.col("tail").isNull(), F.col(name)).otherwise(F.concat(name, F.lit("\n"), "tail"))
            )
        entries = entries.drop("tail")
    return entries.withColumn(
        "ts", F.timestamp_add("MILLISECOND", F.col("ms"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    )


def log_stats(
    lines: DataFrame, keys: Sequence[str] = KEYS, order: str = "line_no", text: str = "raw"
) -> DataFrame:
    """Lines, entries and lines that are neither, per report."""
    raw = F.col(text)
    shape = lines.select(
        *keys,
        F.col(order).alias("line_no"),
        F.when(raw.rlike(LINE), "entry").when(_continues(raw), "tail").when(raw.rlike(r"\S"), "other").otherwise("blank").alias("shape"),
    )
    first = shape.groupBy(*keys).agg(F.min(F.when(F.col("shape") == "entry", F.col("line_no"))).alias("first"))
    stray = (F.col("shape") == "other") | (
        (F.col("shape") == "tail") & (F.col("first").isNull() | (F.col("line_no") < F.col("first")))
    )
    return (
        shape.join(first, list(keys))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_lines"),
            F.count_if(F.col("shape") == "entry").alias("parsed_lines"),
            F.count_if(stray).alias("parse_errors"),
        )
    )


def process_name(message: Column) -> Column:
    return F.coalesce(capture(message, r"ANR in (\S+)"), capture(message, r"Process:\s*(\S+)"))


def detect_anomalies(entries: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """At most one anomaly per entry: the first rule that holds.  Row-local."""
    found = entries.where(worth_checking(F.col("tag"), F.col("message"))).select(
        "*", computed_rows(log_anomaly(F.col("tag"), F.col("message"))).alias("a")
    )
    return found.select(
        *keys, "entry_idx", "a.type", "a.severity", "ts_text", "ms", "pid",
        process_name(F.col("message")).alias("process_name"), "a.summary",
    )


def merge_anomalies(anomalies: DataFrame, keys: Sequence[str] = KEYS, window_ms: int = 1000) -> DataFrame:
    """Adds ``anchor``: the entry of the anomaly each one merges into (itself when kept)."""
    anchors = anchored_groups(anomalies, keys, "entry_idx", ["type", "pid"], "ms", window_ms)
    return anomalies.join(anchors, [*keys, "entry_idx"])


def kept_anomalies(merged: DataFrame) -> DataFrame:
    return merged.where("anchor = entry_idx").drop("anchor")


def anomaly_context(
    entries: DataFrame, merged: DataFrame, keys: Sequence[str] = KEYS, reach: int = 5, limit: int | None = None
) -> DataFrame:
    """Entries of the same process within ``reach`` positions of each anomaly.

    ``anomaly`` is the kept anomaly; a merged one brings its own context after
    it (``source`` then ``entry_idx`` is the order).  Joined on the exact
    position, so no report and no window becomes a single task.
    """
    wanted = merged.select(
        *keys, F.col("anchor").alias("anomaly"), F.col("entry_idx").alias("source"), F.col("pid").alias("_pid"),
        F.explode(F.sequence(F.col("entry_idx") - reach, F.col("entry_idx") + reach)).alias("entry_idx"),
    )
    if limit:  # an anomaly's first rows: nearly always decided before the join
        wanted = wanted.where("entry_idx > 0")
    near = wanted.join(entries.select(*keys, "entry_idx", "pid", "raw"), [*keys, "entry_idx"])
    near = near.where((F.col("pid") == F.col("_pid")) | (F.col("entry_idx") == F.col("source"))).drop("pid", "_pid")
    if limit is None:
        return near
    return top_rows(near, [*keys, "anomaly"], [F.col("source"), F.col("entry_idx")], limit, "ord")


def tag_stats(entries: DataFrame, keys: Sequence[str] = KEYS, k: int = 20) -> DataFrame:
    """Most frequent tags among error and fatal entries; ties keep first appearance."""
    counts = (
        entries.where(F.col("level").isin("E", "F"))
        .groupBy(*keys, "tag")
        .agg(F.count(F.lit(1)).alias("count"), F.min("entry_idx").alias("_first"))
    )
    return (
        top_rows(counts, keys, [F.col("count").desc(), F.col("_first")], k)
        .drop("_first")
        .withColumn("classification", tag_class(F.col("tag")))
    )


def tag_share(stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of each class among the ranked tags only (at most twenty rows a report)."""
    every = Window.partitionBy(*keys)
    return (
        stats.groupBy(*keys, "classification")
        .agg(F.sum("count").alias("count"))
        .withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(every))
    )


def tag_bars(stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ranked tags with the width of their bar against the first one."""
    return stats.withColumn("bar", F.col("count") * 100.0 / F.max("count").over(Window.partitionBy(*keys)))
