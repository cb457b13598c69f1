"""Resource snapshots: memory, CPU, HAL services and boot state, from section lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.functions.text import capture, trimmed, whole
from fleetfault.operators.ordering import top_rows

KEYS = ("report_id",)

# Line formats.
PSS_LINE = r"^\s*([\d,]+)K:\s*(.+?)\s*\(pid\s+(\d+)"
CPU_TOTAL = (
    r"(?i)([\d.]+)%\s+TOTAL:\s*([\d.]+)%\s+user\s*\+\s*([\d.]+)%\s+kernel(?:\s*\+\s*([\d.]+)%\s+iowait)?"
)
CPU_LINE = r"^\s*([\d.]+)%\s+(\d+)\/([^:]+):\s*([\d.]+)%\s+user\s*\+\s*([\d.]+)%\s+kernel"
SPACED_HAL = r"^(\S+@\S+::\S+)\s+(\w+)\s*(.*)"
CHIP_VENDORS = ["qti", "qualcomm", "qcom", "display", "mediatek", "mtk", "sprd", "samsung", "google", "nxp"]


def _kb(text: Column) -> Column:
    return F.coalesce(whole(F.regexp_replace(text, ",", "")), F.lit(0))


def mem_summary(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    raw = F.col("raw")

    def first(name: str) -> Column:
        value = capture(raw, rf"(?i){name}\s+RAM:\s*([\d,]+)K")
        return F.coalesce(_kb(F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))), F.lit(0))

    return lines.groupBy(*keys).agg(
        first("Total").alias("total_kb"), first("Free").alias("free_kb"), first("Used").alias("used_kb")
    )


def mem_processes(lines: DataFrame, keys: Sequence[str] = KEYS, k: int = 10) -> DataFrame:
    """First ``k`` processes of the PSS block in file order.

    The block runs from its title to a blank line or the next PSS title and
    counts only when that end is there.
    """
    raw, line = F.col("raw"), F.col("line_no")
    blank = ~raw.rlike(r"\S")
    start = lines.groupBy(*keys).agg(
        F.min(F.when(raw.rlike(r"(?i)Total PSS by process:\s*\z"), line)).alias("_title"), F.max(line).alias("_last")
    ).where("_title is not null")
    inside = lines.join(start, list(keys)).where("line_no > _title")
    begun = inside.where(~blank).groupBy(*keys).agg(F.min("line_no").alias("_first"))
    inside = inside.join(begun, list(keys))
    ends = (blank & (line < F.col("_last"))) | raw.rlike(r"(?i)^Total PSS by (?:OOM|category)")
    stop = inside.where(ends & (line > F.col("_first"))).groupBy(*keys).agg(F.min("line_no").alias("_stop"))
    rows = inside.join(stop, list(keys)).where("line_no < _stop").where(raw.rlike(PSS_LINE))
    return top_rows(rows, keys, [line], k).select(
        *keys, "rank", _kb(capture(raw, PSS_LINE, 1)).alias("pss_kb"),
        trimmed(capture(raw, PSS_LINE, 2)).alias("process_name"), whole(capture(raw, PSS_LINE, 3)).alias("pid"),
    )


def cpu_summary(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    raw = F.col("raw")
    found = F.struct(*[capture(raw, CPU_TOTAL, i).try_cast("double").alias(f"g{i}") for i in range(1, 5)])
    first = lines.groupBy(*keys).agg(F.min_by(found, F.when(raw.rlike(CPU_TOTAL), F.col("line_no"))).alias("t"))
    names = ["total_percent", "user_percent", "kernel_percent", "iowait_percent"]
    return first.select(*keys, *[F.coalesce(f"t.g{i + 1}", F.lit(0.0)).alias(n) for i, n in enumerate(names)])


def cpu_processes(lines: DataFrame, keys: Sequence[str] = KEYS, k: int = 10) -> DataFrame:
    """Busiest ``k`` processes; ties keep file order."""
    raw = F.col("raw")
    rows = lines.where(raw.rlike(CPU_LINE)).select(
        *keys, "line_no", capture(raw, CPU_LINE, 1).try_cast("double").alias("cpu_percent"),
        whole(capture(raw, CPU_LINE, 2)).alias("pid"), trimmed(capture(raw, CPU_LINE, 3)).alias("process_name"),
    )
    return top_rows(rows, keys, [F.col("cpu_percent").desc(), F.col("line_no")], k).drop("line_no")


# HAL services ------------------------------------------------------------------


def hal_status(text: Column) -> Column:
    """Explicit words first (non-responsive, declared, alive), then ``N/A``."""
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\bnon-responsive\b"), "non-responsive")
        .when(low.rlike(r"\bdeclared\b"), "declared")
        .when(low.rlike(r"\balive\b"), "alive")
        .when(text.rlike(r"\|\s*N/A\s*\||\bN/A\b"), "declared")
        .otherwise("alive")
    )


def hal_services(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Service rows of both layouts, named by ``line_no``.  Row-local."""
    text = F.col("_t")
    rows = lines.select(*keys, "line_no", trimmed("raw").alias("_t")).where(
        (text != "") & ~text.startswith("VINTF") & ~text.startswith("Interface")
    )
    cells = F.transform(F.split(text, r"\|"), trimmed)
    place = F.array_position(F.transform(cells, lambda c: c.contains("::") | c.contains("@")), True)
    piped = text.contains("|")
    name = F.when(piped & (F.size(cells) >= 3) & (place > 0), F.try_element_at(cells, place.cast("int"))).when(
        ~piped, capture(text, SPACED_HAL, 1)
    )
    carrier = F.when(piped, F.lower(F.try_element_at(cells, place.cast("int") + 1))).otherwise(
        F.lower(capture(text, SPACED_HAL, 2))
    )
    said = F.when(piped, text).otherwise(F.coalesce(capture(text, SPACED_HAL, 3), text))
    return rows.withColumn("interface", F.when(piped & (place == 0), None).otherwise(name)).where("interface is not null").select(
        *keys, "line_no", "interface",
        F.coalesce(F.nullif(carrier, F.lit("")), F.lit("unknown")).alias("transport"),
        hal_status(said).alias("status"),
        F.col("interface").startswith("vendor.").alias("is_vendor"),
    )


def hal_summary(lines: DataFrame, services: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts per status and whether the listing was cut off."""
    cut = lines.groupBy(*keys).agg(
        F.bool_or(F.col("raw").rlike(r"(?i)failed:\s*exit code|was the duration of")).alias("truncated")
    )
    counts = services.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in
          (("alive", "alive"), ("non-responsive", "non_responsive"), ("declared", "declared"))],
    )
    return cut.join(counts, list(keys), "left").fillna(0, ["total", "alive", "non_responsive", "declared"])


def version_key(version: Column) -> Column:
    """Comparable number list; trailing zeros dropped, so ``1`` equals ``1.0``."""
    numbers = F.transform(F.split(version, r"\."), lambda p: F.coalesce(whole(p), F.lit(0)))
    used = F.aggregate(
        F.transform(numbers, lambda n, i: F.when(n != 0, i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x)
    )
    return F.slice(numbers, 1, used)


def newest_per_family(
    df: DataFrame, keys: Sequence[str], family: str, version: str, status: str, order: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Highest version of each family and the best status seen at that version.

    Statuses rank alive, non-responsive, declared; ties keep the first row.  Two
    aggregations with map-side combine, no sort of a family.
    """
    rank = F.when(F.col(status) == "alive", 2).when(F.col(status) == "non-responsive", 1).otherwise(0)
    carried = F.struct(F.col(status).alias("status"), *keep)
    versions = df.groupBy(*keys, family, version).agg(
        F.max_by(carried, F.struct(rank, -F.col(order))).alias("_s"), F.min(order).alias("_seen")
    )
    return (
        versions.groupBy(*keys, family)
        .agg(
            F.max_by(
                F.struct(F.col(version).alias("highest_version"), "_s"),
                F.struct(version_key(F.col(version)), -F.col("_seen")),
            ).alias("_b"),
            F.count(F.lit(1)).alias("version_count"),
            F.min("_seen").alias("first_seen"),
        )
        .select(
            *keys, family, "_b.highest_version", F.col("_b._s.status").alias("highest_status"),
            *[F.col(f"_b._s.{c}").alias(c) for c in keep], "version_count", "first_seen",
        )
    )


def is_oem(family: Column, is_vendor: Column, manufacturer: Column) -> Column:
    """A vendor family that carries the manufacturer's name, or no chip vendor's."""
    space = F.lower(F.element_at(F.split(F.regexp_replace(family, r"^vendor\.", ""), "::"), 1))
    parts = F.split(space, r"\.")
    maker = F.lower(F.nullif(manufacturer, F.lit("")))
    named = F.coalesce(F.exists(parts, lambda p: p.contains(maker) | maker.contains(p)), F.lit(False))
    chips = F.array(*[F.lit(c) for c in CHIP_VENDORS])
    chip = F.exists(parts, lambda p: F.exists(chips, lambda c: p.contains(c)))
    return is_vendor & (named | ~chip)


def hal_families(services: DataFrame, meta: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per interface family, ``first_seen`` giving file order.

    ``meta`` holds ``keys, manufacturer``.
    """
    base = F.element_at(F.split("interface", "/"), 1)
    named = services.select(
        *keys, "line_no", "status", "is_vendor",
        F.regexp_replace(base, r"^(.*?)@[\d.]+", "$1").alias("family"),
        F.coalesce(capture(base, r"@([\d.]+)"), F.lit("0")).alias("version"),
    )
    rows = newest_per_family(named, keys, "family", "version", "status", "line_no", ["is_vendor"])
    space = F.element_at(F.split("family", "::"), 1)
    short = F.coalesce(F.nullif(F.regexp_extract(space, r"([^.]*)\z", 1), F.lit("")), space)
    return (
        rows.join(meta.select(*keys, "manufacturer"), list(keys), "left")
        .withColumn("short_name", short)
        .withColumn("is_oem", is_oem(F.col("family"), F.col("is_vendor"), F.col("manufacturer")))
        .drop("manufacturer")
    )


def vendor_issues(families: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return families.groupBy(*keys).agg(
        F.count_if(F.col("is_vendor") & F.col("highest_status").isin("non-responsive", "declared")).alias("vendor_issues")
    )


# Boot state ----------------------------------------------------------------------

BOOT_PROPERTY = r"\[(?:sys\.boot\.reason\.last|sys\.boot\.reason|ro\.boot\.bootreason)\]:\s*\[([^\]]+)\]"
KERNEL_REASON = r"(?i)(?:Boot reason|androidboot\.bootreason)[=:\s]+(\S+)"


def boot_status(
    entries: DataFrame, kernel: DataFrame, properties: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Completed or not, reason, server restarts and uptime from three sources."""
    raw, message, tag = F.col("raw"), F.col("message"), F.col("tag")
    reason = capture(raw, BOOT_PROPERTY)
    from_properties = properties.groupBy(*keys).agg(
        F.bool_or(raw.rlike(r"\[sys\.boot_completed\]:\s*\[1\]")).alias("_p_done"),
        F.min_by(reason, F.when(reason.isNotNull(), F.col("line_no"))).alias("_p_reason"),
    )
    done = (
        message.contains("sys.boot_completed=1")
        | ((tag == "BootReceiver") & message.rlike(r"(?i)boot.*completed"))
        | ((tag == "ActivityManager") & message.contains("Boot completed"))
    )
    from_log = entries.groupBy(*keys).agg(
        F.bool_or(done).alias("_l_done"),
        F.count_if((tag == "Zygote") & message.contains("System server process")).alias("_starts"),
    )
    told = capture(message, KERNEL_REASON)
    from_kernel = kernel.groupBy(*keys).agg(
        F.bool_or(message.contains("sys.boot_completed=1")).alias("_k_done"),
        F.min_by(told, F.when(told.isNotNull(), F.col("entry_idx"))).alias("_k_reason"),
        F.max_by("boot_s", "entry_idx").alias("uptime_s"),
    )
    every = from_properties.join(from_log, list(keys), "full").join(from_kernel, list(keys), "full")
    no = F.lit(False)
    return every.select(
        *keys,
        (F.coalesce("_p_done", no) | F.coalesce("_l_done", no) | F.coalesce("_k_done", no)).alias("boot_completed"),
        F.coalesce("_p_reason", "_k_reason").alias("boot_reason"),
        F.greatest(F.coalesce("_starts", F.lit(0)) - 1, F.lit(0)).alias("restarts"),
        "uptime_s",
    )
