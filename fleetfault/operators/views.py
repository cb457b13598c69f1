"""Result views: filters, counts, boards and fleet bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.functions.text import fixed
from fleetfault.operators.ordering import top_rows

KEYS = ("report_id",)
SEVERITIES = ("critical", "warning", "info")
SOURCES = ("logcat", "anr", "kernel", "tombstone")


def filter_timeline(
    timeline: DataFrame, severities: Sequence[str] = ("critical", "warning"), sources: Sequence[str] = SOURCES
) -> DataFrame:
    return timeline.where(F.col("severity").isin(list(severities)) & F.col("source").isin(list(sources)))


def timeline_counts(
    timeline: DataFrame, keys: Sequence[str] = KEYS, severities: Sequence[str] = ("critical", "warning"),
    sources: Sequence[str] = SOURCES,
) -> DataFrame:
    """Rows shown by the filter and rows in all."""
    shown = F.col("severity").isin(list(severities)) & F.col("source").isin(list(sources))
    return timeline.groupBy(*keys).agg(F.count_if(shown).alias("shown"), F.count(F.lit(1)).alias("total"))


def severity_counts(insights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return insights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def hal_board(families: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Family counts by maker and state."""
    vendor, oem, status = F.col("is_vendor"), F.col("is_oem"), F.col("highest_status")
    return families.groupBy(*keys).agg(
        F.count_if(status == "alive").alias("alive"), F.count(F.lit(1)).alias("families"),
        *[F.count_if(vendor & (oem if maker == "oem" else ~oem) & (status == s)).alias(f"{maker}_{n}")
          for maker in ("oem", "chip") for s, n in (("non-responsive", "non_responsive"), ("declared", "declared"))],
    )


def hal_lists(families: DataFrame, keys: Sequence[str] = KEYS, k: int = 10) -> DataFrame:
    """Families in trouble in file order: every OEM one, the first ``k`` of chip vendors, with how many remain."""
    bad = families.where("is_vendor and highest_status in ('non-responsive', 'declared')")
    group = [*keys, "is_oem", "highest_status"]
    sizes = bad.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    name = F.concat("short_name", F.lit("@"), "highest_version").alias("name")
    listed = bad.where("is_oem").select(*group, "first_seen", name).unionByName(
        top_rows(bad.where("not is_oem"), group, [F.col("first_seen")], k).select(*group, "first_seen", name)
    )
    more = F.when(F.col("is_oem"), 0).otherwise(F.greatest(F.col("_n") - k, F.lit(0)))
    return listed.join(sizes, group).withColumn("more", more).drop("_n")


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor")


def fleet_bands(health: DataFrame) -> DataFrame:
    """How many reports fall in each band of the overall score."""
    return health.groupBy(score_band(F.col("overall")).alias("band")).agg(F.count(F.lit(1)).alias("reports"))


def gigabytes(kb: Column) -> Column:
    return fixed(kb / 1048576, 1)


def uptime_text(seconds: Column) -> Column:
    hours, minutes = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    plain = F.concat(minutes.cast("long").cast("string"), F.lit("m"))
    return F.when(hours > 0, F.concat(hours.cast("long").cast("string"), F.lit("h "), plain)).otherwise(plain)


def short_fingerprint(fingerprint: Column) -> Column:
    parts = F.split(fingerprint, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(fingerprint)


def latest_results(
    results: DataFrame, keys: Sequence[str], ts: str, as_of: Column, ttl: Column, tie: str | None = None
) -> DataFrame:
    """Last result of each key, unless older than ``ttl`` at ``as_of``.  One aggregation, no window."""
    rest = [c for c in results.columns if c not in keys]
    order = F.struct(ts, tie) if tie else F.col(ts)
    last = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    return last.where(as_of - F.col(ts) <= ttl)
