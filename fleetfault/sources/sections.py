"""The main report text: sections, metadata, and which section feeds which table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.functions.text import capture
from fleetfault.operators.ordering import scan

KEYS = ("report_id",)

# Fixed values.
HEADER = r"^------\s+(.+?)\s+\((.+?)\)\s+------\z"
PROPERTY = r"\[{}\]:\s*\[({})\]"
LOG_SECTIONS = r"SYSTEM LOG|EVENT LOG|MAIN LOG|CRASH LOG|RADIO LOG|LOGCAT"
META = {
    "android_version": ("ro.build.version.release", ".+?"),
    "sdk_level": ("ro.build.version.sdk", r"\d+"),
    "build_fingerprint": ("ro.build.fingerprint", ".+?"),
    "device_model": ("ro.product.model", ".+?"),
    "manufacturer": ("ro.product.manufacturer", ".+?"),
    "build_date": ("ro.build.date", ".+?"),
}


def mark_sections(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every line with its section (``section_idx`` from 0, -1 before the first header)."""
    raw = F.col("raw")
    head = raw.startswith("------") & raw.rlike(HEADER)
    told = F.when(
        F.col("is_header"),
        F.struct(
            F.regexp_extract(raw, HEADER, 1).alias("name"),
            F.regexp_extract(raw, HEADER, 2).alias("command"),
            F.col("line_no").alias("start_line"),
        ),
    )
    marked = scan(
        lines.select(*keys, "line_no", "raw").withColumn("is_header", head),
        keys, "line_no", last={"_s": told}, total={"_n": F.col("is_header").cast("long")},
    )
    return marked.select(*keys, "line_no", "raw", "is_header", (F.col("_n") - 1).alias("section_idx"), "_s.*")


def sections(marked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per section, empty ones included, with what its text holds."""
    body = F.when(~F.col("is_header"), F.col("raw"))
    return (
        marked.where("section_idx >= 0")
        .groupBy(*keys, "section_idx")
        .agg(
            F.max("name").alias("name"),
            F.max("command").alias("command"),
            F.max("start_line").alias("start_line"),
            F.max("line_no").alias("end_line"),
            F.coalesce(F.bool_or(body.rlike(r"(?i)Total RAM:")), F.lit(False)).alias("shows_memory"),
            F.coalesce(F.bool_or(body.rlike(r"(?i)TOTAL:.*user.*kernel")), F.lit(False)).alias("shows_cpu"),
        )
    )


def routes(found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per report the section read for each purpose; a dedicated command comes first."""
    name, command, idx = F.col("name"), F.col("command"), F.col("section_idx")

    def first(when):
        return F.min(F.when(when, idx))

    dump = name.rlike(r"(?i)^DUMPSYS")
    return found.groupBy(*keys).agg(
        first((name == "SYSTEM PROPERTIES") | command.contains("getprop")).alias("properties"),
        first((name == "KERNEL LOG") | command.contains("dmesg")).alias("kernel"),
        F.coalesce(first(command.contains("dumpsys meminfo")), first(dump & F.col("shows_memory"))).alias("memory"),
        F.coalesce(first(command.contains("dumpsys cpuinfo")), first(dump & F.col("shows_cpu"))).alias("cpu"),
        first((name == "HARDWARE HALS") | command.contains("lshal")).alias("hals"),
    )


def routed_lines(marked: DataFrame, routed: DataFrame, target: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Body lines of the section chosen for ``target``."""
    chosen = routed.select(*keys, F.col(target).alias("section_idx")).where("section_idx is not null")
    return marked.where("not is_header").join(chosen, [*keys, "section_idx"], "left_semi").select(*keys, "line_no", "raw")


def log_lines(marked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lines of all log sections in section order, numbered from 1 as one text.

    An empty log section counts as one blank line, as joining its text would give.
    """
    is_log = F.upper("name").rlike(LOG_SECTIONS) | F.col("command").contains("logcat")
    mine = marked.where(is_log)
    empty = (
        mine.groupBy(*keys, "section_idx")
        .agg(F.min("line_no").alias("line_no"), F.max("line_no").alias("_end"))
        .where("line_no = _end")
        .select(*keys, "line_no", F.lit("").alias("raw"))
    )
    rows = mine.where("not is_header").select(*keys, "line_no", "raw").unionByName(empty)
    return scan(rows, keys, "line_no", total={"_n": F.lit(1)}).select(*keys, F.col("_n").alias("line_no"), "raw")


def report_meta(marked: DataFrame, routed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Device and build facts; a report without a time line gets null, never the current time."""
    raw = F.col("raw")
    reports = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"))
    told = marked.where(raw.contains("[ro.") | raw.contains("Linux version") | raw.rlike(r"^==\s+dumpstate:"))
    placed = told.join(routed.select(*keys, "properties", "kernel"), list(keys), "left")

    def first(pattern: str, section: str | None):
        value = capture(raw, pattern)
        inside = F.lit(True)
        if section:
            inside = F.col(section).isNull() | (~F.col("is_header") & (F.col("section_idx") == F.col(section)))
        return F.min_by(value, F.when(inside & value.isNotNull(), F.col("line_no")))

    patterns = {n: PROPERTY.format(key.replace(".", r"\."), form) for n, (key, form) in META.items()}
    facts = placed.groupBy(*keys).agg(
        *[first(p, "properties").alias(n) for n, p in patterns.items()],
        first(r"Linux version\s+(\S+)", "kernel").alias("kernel_version"),
        first(r"^==\s+dumpstate:\s+(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", None).alias("_ts"),
    )
    unknown = [n for n in [*META, "kernel_version"] if n != "sdk_level"]
    return reports.select(*keys).join(facts, list(keys), "left").select(
        *keys,
        *[F.coalesce(n, F.lit("unknown")).alias(n) for n in unknown],
        F.coalesce(F.col("sdk_level").try_cast("int"), F.lit(0)).alias("sdk_level"),
        F.regexp_replace("_ts", r"\s+", " ").try_cast("timestamp_ntz").alias("report_ts"),
    )
