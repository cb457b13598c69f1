"""Findings ("insights") from every source, merged, ranked and numbered.

Rows carry ``rank, o1, o2, o3``: the order in which the sources list them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.functions import wording
from fleetfault.functions.kernel_rules import allow_rule
from fleetfault.functions.reasons import label, trace_severity
from fleetfault.functions.text import computed, display_time, fixed
from fleetfault.operators.ordering import ordered_text, top_rows, with_position
from fleetfault.operators.timeline import kernel_time

KEYS = ("report_id",)
ORDER = ("rank", "o1", "o2", "o3")
FIELDS = (
    "severity", "category", "title", "description", "snippet", "stack", "ts_text", "source", "allow_rule",
    "debug_commands",
)


def _rows(df: DataFrame, keys: Sequence[str], rank: int, order: Sequence[Column], **values: Column | str) -> DataFrame:
    empty = {"debug_commands": F.lit(None).cast("array<string>")}
    spots = [*order, F.lit(0), F.lit(0), F.lit(0)][:3]
    return df.select(
        *keys, F.lit(rank).alias("rank"), *[c.cast("long").alias(f"o{i + 1}") for i, c in enumerate(spots)],
        *[
            (F.lit(v) if isinstance(v, str) else v).alias(f)
            for f in FIELDS
            for v in [values.get(f, empty.get(f, F.lit(None).cast("string")))]
        ],
    )


def _commands(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _command_map(table: dict[str, list[str]], kind: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), _commands(v))]
    return F.try_element_at(F.create_map(*pairs), kind)


def _texts(kind: Column, table: dict[str, tuple[str, str]], values: dict[str, Column]) -> Column:
    """Description by type with the named parts filled in."""
    import re

    chain = None
    for name, (_, text) in table.items():
        pieces = [values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", text) if p]
        filled = F.concat(*pieces)
        chain = F.when(kind == name, filled) if chain is None else chain.when(kind == name, filled)
    return chain


def _category(kind: Column, table: dict[str, tuple[str, str]]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, (c, _) in table.items() for x in (k, c)]), kind)


def _plain(number: Column) -> Column:
    """A number as it is usually written: no trailing ``.0``."""
    return F.regexp_replace(number.cast("string"), r"\.0\z", "")


def log_findings(anomalies: DataFrame, context: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``context``: numbered rows of ``anomaly_context``; the first ten make the snippet."""
    first = context.where("ord <= 10").groupBy(*keys, F.col("anomaly").alias("entry_idx")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "raw"))), lambda r: r["raw"]), "\n"
        ).alias("_snippet")
    )
    process = F.coalesce(F.concat(F.lit(" in process "), "process_name"), F.lit(""))
    pid = F.when(F.col("pid") != 0, F.concat(F.lit(" (PID "), F.col("pid").cast("string"), F.lit(")"))).otherwise("")
    return _rows(
        anomalies.join(first, [*keys, "entry_idx"], "left"), keys, 0, [F.col("entry_idx")],
        severity=F.col("severity"), category=_category(F.col("type"), wording.LOG_FINDINGS), title=F.col("summary"),
        description=_texts(F.col("type"), wording.LOG_FINDINGS, {"process": process, "pid": pid}),
        snippet=F.coalesce("_snippet", F.lit("")), ts_text=F.col("ts_text"), source="logcat",
        debug_commands=_command_map(wording.LOG_COMMANDS, F.col("type")),
    )


def kernel_findings(events: DataFrame, epochs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    d = F.col("details")
    heat = F.when(
        F.coalesce(d["temperature"], F.lit("0")) != "0", F.concat(F.lit(" Temperature: "), d["temperature"], F.lit("°C."))
    ).otherwise("")
    values = {
        "name": F.coalesce(d["processName"], F.lit("unknown")), "pid": F.coalesce(d["pid"], F.lit("0")),
        "message": F.substring("message", 1, 200), "heat": heat,
        "source": F.coalesce(d["scontext"], F.lit("unknown")), "target": F.coalesce(d["tcontext"], F.lit("unknown")),
    }
    rule = F.when(F.col("type") == "selinux_denial", allow_rule(d))
    told = _texts(F.col("type"), wording.KERNEL_FINDINGS, values)
    rows = events.join(epochs, list(keys), "left").select("*", computed(F.struct(told.alias("told"), rule.alias("rule"))).alias("c"))
    told, rule = F.col("c.told"), F.col("c.rule")
    return _rows(
        rows, keys, 2, [F.lit(0), F.col("entry_idx")],
        severity=F.col("severity"), category=_category(F.col("type"), wording.KERNEL_FINDINGS), title=F.col("summary"),
        description=F.concat(told, F.coalesce(F.concat(F.lit("\nSuggested allow rule: "), rule), F.lit(""))),
        snippet=F.col("raw"), ts_text=kernel_time(F.col("boot_ms"), F.col("boot_s")), source="kernel",
        allow_rule=rule, debug_commands=_command_map(wording.KERNEL_COMMANDS, F.col("type")),
    )


def merge_counted(rows: DataFrame, by: Sequence[str], keep: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group plus ``occurrences``; partial aggregation absorbs hot groups."""
    spot = F.struct(*order)
    return rows.groupBy(*by).agg(
        F.min_by(F.struct(*keep), spot).alias("_f"), F.min(spot).alias("_o"), F.count(F.lit(1)).alias("occurrences")
    ).select(*[c for c in by if c not in (*keep, *order)], "_o.*", "_f.*", "occurrences")


def _with_count(rows: DataFrame) -> DataFrame:
    many = F.col("occurrences") > 1
    n = F.col("occurrences").cast("string")
    return rows.withColumn(
        "description",
        F.when(many, F.concat("description", F.lit("\nOccurred "), n, F.lit(" times."))).otherwise(F.col("description")),
    ).withColumn("title", F.when(many, F.concat("title", F.lit(" (×"), n, F.lit(")"))).otherwise(F.col("title")))


def merge_denials(kernel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Denials with equal title become one row each, listed after the other events."""
    denial = F.col("title").startswith("SELinux denial:")
    merged = _with_count(merge_counted(kernel.where(denial), [*keys, "title"], FIELDS, ORDER)).drop("occurrences")
    return kernel.where(~denial).unionByName(merged.withColumn("o1", F.lit(1).cast("long")))


def trace_findings(
    heads: DataFrame, blocks: DataFrame, targets: DataFrame, suspects: DataFrame, chains: DataFrame,
    cycles: DataFrame, pool: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per trace with a primary thread, one per deadlock, one for a used-up pool."""
    trace = [*keys, "trace_id"]
    kept = ["role", "thread_no", "tid", "reason", "confidence", "has_suspects"]
    # "blocked" sorts before "main", and is preferred.
    primary = blocks.groupBy(*trace).agg(F.min_by(F.struct(*kept), "role").alias("p")).select(*trace, "p.*")
    mine = suspects.join(primary.select(*trace, "role"), [*trace, "role"], "left_semi")
    told = F.concat(
        F.lit("Suspected HAL: "), "interface_name", F.lit("."), "method", F.lit('() on thread "'), "thread_name",
        F.lit('" ('), "package_name", F.lit(")"),
    )
    listed = ordered_text(mine.withColumn("_t", told), trace, "thread_no", "_t", "_suspects")
    top = mine.groupBy(*trace).agg(F.min_by("interface_name", "thread_no").alias("_top"))
    own = chains.join(primary.select(*trace, F.col("tid").alias("start_tid")), [*trace, "start_tid"], "left_semi")
    quoted = own.withColumn("_q", F.concat(F.lit('"'), "name", F.lit('"')))
    chain = ordered_text(quoted, trace, "hop", "_q", "_chain", " → ")
    stack = ordered_text(
        top_rows(frames.join(primary.select(*trace, "thread_no"), [*trace, "thread_no"], "left_semi"), trace,
                 [F.col("frame_no")], 15, "_r"),
        trace, "frame_no", "raw", "_stack",
    )
    locks = cycles.groupBy(*trace, "cycle_rank", "cycle_id").agg(F.max("cycle_size").alias("cycle_size"))
    first_lock = locks.groupBy(*trace).agg(F.min_by("cycle_size", "cycle_rank").alias("_ring"))

    rows = heads.join(primary, trace)
    for extra in (targets, listed, top, chain, stack, first_lock, pool.select(*trace, "total", "exhausted")):
        on = [*trace, "thread_no"] if extra is targets else trace
        rows = rows.join(extra, on, "left")
    name = label(F.col("reason"))
    place = F.when(
        F.col("blocked_thread_name") != "main", F.concat(F.lit(' on thread "'), "blocked_thread_name", F.lit('"'))
    ).otherwise("")
    place = F.coalesce(place, F.lit(""))
    hit = (F.col("interface_name") != "Unknown") & (F.col("reason") == "slow_binder_call")
    used_up = F.coalesce("exhausted", F.lit(False))
    title = (
        F.when(hit, F.concat(F.lit("ANR: "), name, F.lit(" to "), "interface_name", place, F.lit(" in "), "process_name"))
        .when(F.col("_top").isNotNull(), F.concat(F.lit("ANR: "), name, F.lit(" in "), "process_name", F.lit(" (suspected: "), "_top", F.lit(" HAL)")))
        .otherwise(F.concat(F.lit("ANR: "), name, place, F.lit(" in "), "process_name"))
    )
    call = F.when(F.col("method") != "", F.concat(F.lit(" → "), "interface_name", F.lit("."), "method", F.lit("()"))).otherwise("")
    caller = F.when(F.col("caller_class") != "", F.concat(F.lit(" called from "), "caller_class", F.lit("."), "caller_method", F.lit("()"))).otherwise("")
    start = F.coalesce("blocked_thread_name", F.lit("main"))
    description = F.concat_ws(
        "\n",
        F.concat(F.lit("Subject: "), F.nullif("subject", F.lit(""))),
        F.concat(F.lit("ANR in "), "process_name", F.lit(": "), name, F.lit(" (confidence: "), "confidence", F.lit(")")),
        F.when(hit, F.concat(F.lit("Target HAL: "), "interface_name", F.lit(" ("), "package_name", F.lit(")"), call, caller)),
        F.col("_suspects"),
        F.concat(F.lit("Blocking chain: "), start, F.lit(" → "), "_chain"),
        F.when(F.col("reason") == "deadlock", F.concat(F.lit("Deadlock detected involving "), F.coalesce("_ring", F.lit(0)).cast("string"), F.lit(" threads"))),
        F.when(used_up, F.concat(F.lit("Binder pool exhausted: all "), F.col("total").cast("string"), F.lit(" threads busy"))),
    )
    when = display_time("ts_text")
    main = _rows(
        rows, keys, 1, [F.col("trace_idx")],
        severity=trace_severity(F.col("reason"), F.col("confidence"), F.col("has_suspects")), category="anr",
        title=title, description=description, stack=F.nullif("_stack", F.lit("")), ts_text=when, source="anr",
    )
    member = F.concat(F.lit('"'), "name", F.lit('" (tid='), F.col("tid").cast("string"), F.lit(")"))
    names = ordered_text(cycles.withColumn("_m", member), [*trace, "cycle_id"], "cycle_pos", "_m", "_names", ", ")
    rings = rows.select(*trace, "trace_idx", "ts_text").join(locks, trace).join(names, [*trace, "cycle_id"])
    deadlock = _rows(
        rings, keys, 1, [F.col("trace_idx"), F.lit(1), F.col("cycle_rank")], severity="critical", category="anr",
        title=F.concat(F.lit("Deadlock: "), F.col("cycle_size").cast("string"), F.lit(" threads in circular wait")),
        description=F.concat(F.lit("Deadlock cycle involving: "), "_names", F.lit(". Each thread holds a lock needed by another thread in the cycle.")),
        ts_text=when, source="anr",
    )
    spent = _rows(
        rows.where(used_up & (F.col("reason") != "binder_pool_exhaustion")), keys, 1, [F.col("trace_idx"), F.lit(2)],
        severity="warning", category="performance",
        title=F.concat(F.lit("Binder Pool Exhausted in "), "process_name"),
        description=F.concat(F.lit("All "), F.col("total").cast("string"), F.lit(" binder threads are busy (0 idle). IPC calls may be queuing or timing out.")),
        ts_text=when, source="anr",
    )
    return main.unionByName(deadlock).unionByName(spent)


def _top_three(rows: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    few = rows.where("rank <= 3").withColumn("_x", text)
    return ordered_text(few, keys, "rank", "_x", "_names", ", ")


def resource_findings(
    memory: DataFrame, mem_top: DataFrame, cpu: DataFrame, cpu_top: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    consumers = F.coalesce("_names", F.lit("N/A"))
    size = fixed(F.col("pss_kb") / 1024, 0)
    mem_names = _top_three(mem_top, keys, F.concat("process_name", F.lit(" ("), size, F.lit(" MB)")))
    share = F.col("free_kb") / F.nullif(F.col("total_kb"), F.lit(0))
    low = memory.where(share < 0.1).join(mem_names, list(keys), "left")
    gb = 1048576
    mem = _rows(
        low, keys, 3, [F.lit(0)], severity="warning", category="memory", title="Low available memory",
        description=F.concat(
            F.lit("Only "), fixed(share * 100, 1), F.lit("% of RAM is free ("), fixed(F.col("used_kb") / gb, 1),
            F.lit(" GB used / "), fixed(F.col("total_kb") / gb, 1), F.lit(" GB total). Top consumers: "), consumers, F.lit(".")),
        source="cross", debug_commands=_commands(wording.MEMORY_COMMANDS),
    )
    cpu_names = _top_three(cpu_top, keys, F.concat("process_name", F.lit(" ("), _plain(F.col("cpu_percent")), F.lit("%)")))
    busy = _rows(
        cpu.where("total_percent > 80").join(cpu_names, list(keys), "left"), keys, 3, [F.lit(1)],
        severity="warning", category="performance", title="High CPU usage",
        description=F.concat(
            F.lit("Total CPU usage is "), _plain(F.col("total_percent")), F.lit("% ("), _plain(F.col("user_percent")),
            F.lit("% user + "), _plain(F.col("kernel_percent")), F.lit("% kernel). Top consumers: "), consumers, F.lit(".")),
        source="cross", debug_commands=_commands(wording.CPU_COMMANDS),
    )
    wait = _rows(
        cpu.where("iowait_percent > 20"), keys, 3, [F.lit(2)], severity="warning", category="performance",
        title="High I/O wait",
        description=F.concat(F.lit("I/O wait is "), _plain(F.col("iowait_percent")), F.lit("%, indicating the CPU is frequently waiting for disk or storage operations.")),
        source="cross", debug_commands=_commands(wording.IOWAIT_COMMANDS),
    )
    return mem.unionByName(busy).unionByName(wait)


def boot_findings(boot: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    n = F.col("restarts").cast("string")
    base = dict(category="stability", source="cross")
    undone = _rows(
        boot.where("not boot_completed and uptime_s is not null"), keys, 4, [F.lit(0)], severity="warning",
        title="Boot not completed",
        description="sys.boot_completed was not set. The device may not have finished booting successfully.",
        debug_commands=_commands(wording.BOOT_COMMANDS), **base,
    )
    again = _rows(
        boot.where("restarts > 0"), keys, 4, [F.lit(1)],
        severity=F.when(F.col("restarts") >= 3, "critical").otherwise("warning"),
        title=F.concat(F.lit("System server restarted "), n, F.lit(" time(s)")),
        description=F.concat(F.lit("system_server was restarted "), n, F.lit(" time(s) since boot. Frequent restarts indicate serious system instability.")),
        debug_commands=_commands(wording.RESTART_COMMANDS), **base,
    )
    odd = _rows(
        boot.where(F.col("boot_reason").isNotNull() & ~F.col("boot_reason").rlike(r"(?i)reboot|normal")), keys, 4,
        [F.lit(2)], severity="warning", title=F.concat(F.lit("Abnormal boot reason: "), "boot_reason"),
        description=F.concat(F.lit('The device booted with reason "'), "boot_reason", F.lit('", which may indicate a crash, watchdog reset, or power issue.')),
        debug_commands=_commands(wording.BOOT_COMMANDS), **base,
    )
    return undone.unionByName(again).unionByName(odd)


def hal_findings(summary: DataFrame, families: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cut-off note, then vendor families in trouble by maker; chip vendors only when not cut off."""
    seen = summary.where("total > 0")
    rows = _rows(
        seen.where("truncated"), keys, 5, [F.lit(0)], severity="info", category="stability",
        title=wording.HAL_CUT[0], description=wording.HAL_CUT[1], source="cross",
    )
    bad = families.where("is_vendor and highest_status in ('non-responsive', 'declared')").withColumn(
        "_name", F.concat("short_name", F.lit("@"), "highest_version")
    )
    groups = [*keys, "is_oem", "highest_status"]
    counted = (
        bad.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
        .join(ordered_text(bad, groups, "first_seen", "_name", "_names", ", "), groups)
        .join(seen.select(*keys, "truncated"), list(keys))
        .where("is_oem or not truncated")
    )
    spot = reduce(
        lambda c, i: c.when(
            (F.col("is_oem") == wording.HAL_FINDINGS[i][0]) & (F.col("highest_status") == wording.HAL_FINDINGS[i][1]), i + 1
        ),
        range(len(wording.HAL_FINDINGS)), F,
    )
    table = F.array(
        *[F.struct(*[F.lit(x).alias(f"f{j}") for j, x in enumerate(row)]) for row in wording.HAL_FINDINGS]
    )
    told = counted.withColumn("_spot", spot).withColumn("w", F.element_at(table, F.col("_spot")))
    return rows.unionByName(
        _rows(
            told, keys, 5, [F.col("_spot")], severity=F.col("w.f2"), category="stability",
            title=F.concat_ws(" ", "w.f3", F.col("_n").cast("string"), "w.f4"),
            description=F.concat("w.f5", "_names", "w.f6"), source="cross",
        )
    )


def crash_findings(crashes: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``crashes`` needs ``file_idx``."""
    stack = ordered_text(
        top_rows(frames, [*keys, "file"], [F.col("line_no")], 20, "_r"), [*keys, "file"], "line_no", "raw", "_stack"
    )
    tag = F.when(F.col("is_vendor_crash"), " [Vendor]").otherwise("")
    description = F.concat_ws(
        "\n", "summary",
        F.concat(F.lit("Crashed in: "), "crashed_in_binary"), F.concat(F.lit("Fault address: "), "fault_addr"),
        F.concat(F.lit("ABI: "), "abi"), F.concat(F.lit("Abort message: "), "abort_message"),
    )
    return _rows(
        crashes.join(stack, [*keys, "file"], "left"), keys, 6, [F.col("file_idx")], severity="critical",
        category="crash", title=F.concat(F.lit("Native Crash: "), "signal_name", tag, F.lit(" in "), "process_name"),
        description=description, stack=F.col("_stack"), ts_text=display_time("ts_text"), source="tombstone",
        debug_commands=_commands(wording.CRASH_COMMANDS),
    )


def tag_findings(stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per report on who writes the errors."""
    line = F.concat(F.lit("  ["), "classification", F.lit("] "), "tag", F.lit(": "), F.col("count").cast("string"), F.lit(" errors"))
    listed = ordered_text(stats.where("rank <= 15").withColumn("_l", line), keys, "rank", "_l", "_lines")
    sums = stats.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("classification") == c, F.col("count"))), F.lit(0)).cast("string").alias(f"_{c}")
          for c in ("vendor", "framework", "app")]
    )
    return _rows(
        sums.join(listed, list(keys)), keys, 7, [], severity="info", category="stability",
        title="Top Error Tags (E/F level)",
        description=F.concat(F.lit("Error/Fatal log distribution: vendor="), "_vendor", F.lit(", framework="), "_framework",
                             F.lit(", app="), "_app", F.lit("\n\n"), "_lines"),
        source="logcat",
    )


def drop_explained(log: DataFrame, trace: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Where a report has trace findings, its log findings on the same matter go."""
    about = F.col("category") == "anr"
    spared = log.where(about).join(trace.select(*keys).distinct(), list(keys), "left_anti")
    return log.where(~about).unionByName(spared)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def merge_duplicates(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Findings equal in severity, category, source and title become one with a count."""
    return _with_count(merge_counted(rows, [*keys, "severity", "category", "source", "title"], FIELDS, ORDER))


def number_findings(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Most severe first, else as listed; ``insight_no`` from 1 and its id."""
    order = [severity_rank(F.col("severity")), *[F.col(c) for c in ORDER]]
    return (
        with_position(rows, keys, order)
        .withColumn("insight_no", F.col("pos") + 1)
        .withColumn("insight_id", F.concat(F.lit("insight-"), (F.col("pos") + 1).cast("string")))
        .drop("pos", *ORDER)
    )


def all_findings(
    log: DataFrame, trace: DataFrame, kernel: DataFrame, others: Sequence[DataFrame], keys: Sequence[str] = KEYS
) -> DataFrame:
    rows = drop_explained(log, trace, keys).unionByName(trace).unionByName(merge_denials(kernel, keys))
    for part in others:
        rows = rows.unionByName(part)
    return number_findings(merge_duplicates(rows, keys), keys)
