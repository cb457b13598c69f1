"""Every operator as a query over the check tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfault.functions.kernel_rules import KERNEL_RULES, allow_rule
from fleetfault.functions.log_rules import LOG_RULES, tag_class
from fleetfault.operators import (
    answers, context, crashes, findings, health, kernel, logs, ordering, snapshots, timeline, traces,
    views,
)
from fleetfault.plans import bindings as b
from fleetfault.session import materialize, prepare, scratch_folder, written
from fleetfault.sources import archives, members, sections, sinks
from fleetfault.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GAP_MS = 900_000  # merge window on the sparse check data
NEAR_MS = 43_200_000
NEAR_S = 30
BUDGET = 60_000
LOG_TYPES = [r[0] for r in LOG_RULES]
KERNEL_TYPES = [r[0] for r in KERNEL_RULES]


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(prepare(spark), folder)

    QUERIES[build.__name__] = run
    return build


# Application log ---------------------------------------------------------------------


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return logs.parse_log(b.log_lines(spark, folder))


def _merged(entries: DataFrame) -> DataFrame:
    return logs.merge_anomalies(logs.detect_anomalies(entries), window_ms=GAP_MS)


@query
def log_entries(spark, folder):
    return _entries(spark, folder).select(
        "report_id", "entry_idx", "line_no", "ts_text", "ms", "pid", "tid", "level", "tag", "message"
    )


@query
def log_stitched(spark, folder):
    return _entries(spark, folder).select("report_id", "entry_idx", "message", "raw")


@query
def log_stats(spark, folder):
    return logs.log_stats(b.log_lines(spark, folder))


@query
def log_anomalies(spark, folder):
    return logs.detect_anomalies(_entries(spark, folder)).select(
        "report_id", "entry_idx", "type", "severity", "summary", "process_name"
    )


@query
def log_dedup(spark, folder):
    return _merged(_entries(spark, folder)).select("report_id", "entry_idx", "anchor")


@query
def log_context(spark, folder):
    entries = _entries(spark, folder)
    return logs.anomaly_context(entries, _merged(entries)).select(
        "report_id", "anomaly", "source", "entry_idx", "raw"
    )


@query
def tag_classes(spark, folder):
    tags = b.load(spark, folder, "part").withColumn(
        "tag",
        F.expr(b.cases("(p_partkey % 5)", ("0", "'ActivityManager'"), ("1", "'hal_' || p_name"), ("2", "p_brand"),
                       ("3", "p_name || '_QCOM'"), other="'View'")),
    )
    return tags.groupBy(tag_class(F.col("tag")).alias("class"), "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query
def tag_top(spark, folder):
    stats = logs.tag_stats(_entries(spark, folder), k=6)
    return logs.tag_bars(stats).select("report_id", "rank", "tag", "count", "classification", "bar")


@query
def tag_share(spark, folder):
    return logs.tag_share(logs.tag_stats(_entries(spark, folder)))


# Kernel log ---------------------------------------------------------------------------


def _kernel(spark: SparkSession, folder: str) -> DataFrame:
    return kernel.parse_kernel(b.kernel_lines(spark, folder))


@query
def kernel_entries(spark, folder):
    return _kernel(spark, folder).select(
        "report_id", "entry_idx", F.col("boot_s").cast("double").alias("boot_s"), "level", "message"
    )


@query
def kernel_events(spark, folder):
    d = F.col("details")
    return kernel.detect_events(_kernel(spark, folder)).select(
        "report_id", "entry_idx", "type", "severity", "summary",
        d["pid"].alias("victim_pid"), d["processName"].alias("victim"), d["temperature"].alias("temperature"),
        d["permission"].alias("permission"), d["message"].alias("message"),
    )


@query
def allow_rules(spark, folder):
    events = kernel.detect_events(_kernel(spark, folder)).where("type = 'selinux_denial'")
    return events.groupBy("report_id", "summary", allow_rule(F.col("details")).alias("rule")).agg(
        F.count(F.lit(1)).alias("n")
    )


# Thread dumps ---------------------------------------------------------------------------

TRACE = ["report_id", "trace_id"]


def _dumps(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    lines = b.trace_lines(spark, folder)
    owned = traces.thread_lines(lines)
    t = {"lines": lines, "owned": owned, "heads": traces.trace_heads(lines)}
    t["threads"], t["frames"] = traces.threads(owned), traces.frames(owned)
    return t


def _reasoned(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    # Many readers: the lines are made and split into threads once.
    t["heads"], t["owned"] = written(t["heads"]), written(t["owned"])
    t["threads"], t["frames"] = materialize(traces.threads(t["owned"])), materialize(traces.frames(t["owned"]))
    t["cycles"] = materialize(traces.deadlocks(t["threads"]))
    t["pool"] = traces.binder_pool(t["threads"], t["frames"])
    t["evidence"] = materialize(traces.stack_evidence(t["frames"]))
    t["primary"] = materialize(traces.primary_threads(t["heads"], t["threads"]))
    t["reasoned"] = materialize(traces.block_reasons(t["primary"], t["evidence"], t["cycles"], t["pool"]))
    t["suspects"] = materialize(traces.suspected_targets(t["reasoned"], t["threads"], t["frames"], t["evidence"]))
    t["blocks"] = materialize(traces.thread_blocks(t["reasoned"], t["suspects"]))
    t["targets"] = traces.binder_targets(t["reasoned"].where("reason = 'slow_binder_call'"), t["frames"])
    return t


@query
def trace_heads(spark, folder):
    return traces.trace_heads(b.trace_lines(spark, folder))


@query
def trace_threads(spark, folder):
    return _dumps(spark, folder)["threads"].drop("thread_no")


@query
def trace_frames(spark, folder):
    return _dumps(spark, folder)["frames"].drop("thread_no", "frame_no")


@query
def trace_locks(spark, folder):
    return traces.held_locks(_dumps(spark, folder)["owned"]).drop("thread_no", "lock_no")


@query
def thread_texts(spark, folder):
    texts = traces.thread_text(_dumps(spark, folder)["owned"])
    return texts.groupBy(*TRACE).agg(F.sum(F.length("raw")).alias("chars"), F.count(F.lit(1)).alias("threads"))


@query
def lock_waits(spark, folder):
    return traces.named_edges(_dumps(spark, folder)["threads"]).drop("thread_no")


@query
def lock_cycles(spark, folder):
    th = materialize(_dumps(spark, folder)["threads"])
    return traces.deadlocks(th).select(*TRACE, "cycle_id", "cycle_size", "cycle_pos", "tid", "name", "wait_addr")


@query
def lock_chains(spark, folder):
    t = _dumps(spark, folder)
    th = materialize(t["threads"])
    return traces.blocking_chains(th, traces.primary_threads(t["heads"], th)).select(
        *TRACE, "start_tid", "hop", "tid", "name"
    )


@query
def binder_pool(spark, folder):
    t = _dumps(spark, folder)
    return traces.binder_pool(t["threads"], t["frames"])


@query
def block_reasons(spark, folder):
    t = _reasoned(_dumps(spark, folder))
    return t["blocks"].select(*TRACE, "role", "tid", "reason", "frames", "confidence", "has_suspects")


@query
def suspected_targets(spark, folder):
    t = _reasoned(_dumps(spark, folder))
    return t["suspects"].select(
        *TRACE, "role", "interface_name", "package_name", "method", "thread_name", "caller_class", "caller_method"
    )


@query
def binder_targets(spark, folder):
    t = _reasoned(_dumps(spark, folder))
    named = t["threads"].select(*TRACE, "thread_no", "tid")
    return t["targets"].join(named, [*TRACE, "thread_no"]).drop("thread_no")


@query
def stack_targets(spark, folder):
    """What each thread of each dump would call, by all strategies, whatever the thread is blocked by."""
    t = _dumps(spark, folder)
    frames = materialize(t["frames"])
    named = materialize(t["threads"].select(*TRACE, "thread_no", "tid"))
    return traces.binder_targets(named, frames).join(named, [*TRACE, "thread_no"]).drop("thread_no")


@query
def all_suspects(spark, folder):
    """Threads stuck in binder calls beside every primary thread, as if none of these could explain itself."""
    t = _dumps(spark, folder)
    threads, frames = materialize(t["threads"]), materialize(t["frames"])
    asking = traces.primary_threads(t["heads"], threads).withColumn("reason", F.lit("unknown"))
    found = traces.suspected_targets(asking, threads, frames, materialize(traces.stack_evidence(frames)))
    return found.select(*TRACE, "role", "interface_name", "package_name", "method", "thread_name", "caller_class", "caller_method")


@query
def hot_frames(spark, folder):
    return traces.hot_frames(traces.frame_view(_dumps(spark, folder)["frames"]))


@query
def frame_kinds(spark, folder):
    view = traces.frame_view(_dumps(spark, folder)["frames"])
    return view.groupBy("report_id", "kind", "is_hal", "is_framework").agg(F.count(F.lit(1)).alias("n"))


# Native-crash dumps ------------------------------------------------------------------------


def _crash_lines(spark: SparkSession, folder: str) -> DataFrame:
    return crashes.usable_dumps(b.crash_lines(spark, folder))


@query
def crash_dumps(spark, folder):
    return crashes.crash_dumps(_crash_lines(spark, folder))


@query
def crash_frames(spark, folder):
    return crashes.crash_frames(_crash_lines(spark, folder)).drop("line_no")


@query
def crash_registers(spark, folder):
    return crashes.registers(_crash_lines(spark, folder))


@query
def crash_files(spark, folder):
    every = b.crash_lines(spark, folder)
    return crashes.dump_counts(every, crashes.crash_dumps(crashes.usable_dumps(every)))


# Snapshots -----------------------------------------------------------------------------------


@query
def mem_summary(spark, folder):
    return snapshots.mem_summary(b.snapshot_lines(spark, folder, b.MEM_LINES))


@query
def mem_processes(spark, folder):
    return snapshots.mem_processes(b.snapshot_lines(spark, folder, b.MEM_LINES))


@query
def cpu_summary(spark, folder):
    return snapshots.cpu_summary(b.snapshot_lines(spark, folder, b.CPU_LINES))


@query
def cpu_processes(spark, folder):
    return snapshots.cpu_processes(b.snapshot_lines(spark, folder, b.CPU_LINES))


@query
def hal_services(spark, folder):
    return snapshots.hal_services(b.hal_lines(spark, folder))


def _families(spark: SparkSession, folder: str) -> DataFrame:
    services = snapshots.hal_services(b.hal_lines(spark, folder))
    return snapshots.hal_families(services, b.hal_makers(spark, folder))


@query
def hal_summary(spark, folder):
    lines = b.hal_lines(spark, folder)
    return snapshots.hal_summary(lines, snapshots.hal_services(lines))


@query
def hal_families(spark, folder):
    return _families(spark, folder)


@query
def hal_board(spark, folder):
    families = _families(spark, folder)
    return views.hal_board(families).join(snapshots.vendor_issues(families), "report_id")


@query
def hal_lists(spark, folder):
    return views.hal_lists(_families(spark, folder), k=2)


def _boot(spark: SparkSession, folder: str, entries: DataFrame, kernel_rows: DataFrame) -> DataFrame:
    props = b.load(spark, folder, "nation").select(
        F.expr("'r' || CAST(n_nationkey % 3 AS STRING)").alias("report_id"),
        F.col("n_nationkey").cast("long").alias("line_no"),
        F.expr("CASE n_nationkey WHEN 4 THEN '[sys.boot_completed]: [1]' WHEN 6 THEN '[sys.boot.reason]: [cold,powerkey]' "
               "ELSE '[ro.x]: [' || n_name || ']' END").alias("raw"),
    )
    return snapshots.boot_status(entries, kernel_rows, props)


@query
def boot_status(spark, folder):
    rows = _boot(spark, folder, _entries(spark, folder), _kernel(spark, folder))
    return rows.withColumn("uptime_s", F.col("uptime_s").cast("double"))


# Archives and sections ------------------------------------------------------------------------


@query
def archive_members(spark, folder):
    blocks = archives.expand_archives(b.document_archives(spark, folder), block_bytes=2048)
    return archives.members(blocks).select("report_id", "member", "length", "is_main", "is_trace", "is_crash")


@query
def archive_rejects(spark, folder):
    blocks = archives.expand_archives(b.document_archives(spark, folder))
    return archives.rejects(blocks).select("report_id")


@query
def archive_lines(spark, folder):
    blocks = archives.expand_archives(b.document_archives(spark, folder), block_bytes=2048)
    return archives.main_lines(blocks).select("report_id", "line_no", F.length("raw").cast("long").alias("chars"))


def _landed(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_folder(spark)
    b.landed_archives(spark, folder, place)
    return written(members.read_reports(spark, place, max_bytes=b.LANDED_LIMIT, block_bytes=1024))


@query
def landed_members(spark, folder):
    """Members of archive files opened by their directories, each put together again from its blocks."""
    keys = ["report_id", "member_idx", "member", "length", "is_main", "is_trace"]
    blocks = _landed(spark, folder).where("error is null")
    whole = ordering.ordered_text(blocks, keys, "block_no", "text", "whole")
    return whole.select(*keys, F.md5("whole").alias("digest"))


@query
def landed_rejects(spark, folder):
    """Files that are no archive, archives above the size limit, which are not opened, and those without a report."""
    found = archives.rejects(_landed(spark, folder))
    kind = F.when(F.col("error").startswith("larger than"), "oversize").when(F.col("error").startswith("no main"), "no report")
    return found.select("report_id", kind.otherwise("broken").alias("kind"))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    return sections.mark_sections(archives.text_lines(b.documents(spark, folder), ["report_id"], "content"))


@query
def report_sections(spark, folder):
    return sections.sections(_marked(spark, folder))


@query
def section_routes(spark, folder):
    return sections.routes(sections.sections(_marked(spark, folder)))


@query
def section_log_lines(spark, folder):
    return sections.log_lines(_marked(spark, folder)).select(
        "report_id", "line_no", F.length("raw").cast("long").alias("chars"), F.md5("raw").alias("digest")
    )


@query
def report_meta(spark, folder):
    marked = _marked(spark, folder)
    meta = sections.report_meta(marked, sections.routes(sections.sections(marked)))
    return meta.select(
        "report_id", "device_model", "sdk_level", "kernel_version", "manufacturer", "android_version", "build_fingerprint",
        F.col("build_date").cast("string").alias("build_date"),
        F.date_format("report_ts", "yyyy-MM-dd HH:mm:ss").alias("report_time"),
    )


# Findings ------------------------------------------------------------------------------------


def _log_findings(spark: SparkSession, folder: str) -> DataFrame:
    entries = materialize(_entries(spark, folder))
    merged = materialize(_merged(entries))
    rows = logs.anomaly_context(entries, merged, limit=15)
    return findings.log_findings(logs.kept_anomalies(merged), rows)


@query
def log_findings(spark, folder):
    return _log_findings(spark, folder).select(
        "report_id", F.col("o1").alias("entry_idx"), "severity", "category", "title", "description", "snippet",
        F.array_join("debug_commands", "|").alias("commands"),
    )


def _epochs(spark: SparkSession, folder: str, boot: DataFrame) -> DataFrame:
    meta = b.load(spark, folder, "region").select(
        F.expr("'r' || CAST(r_regionkey AS STRING)").alias("report_id"),
        F.expr("CASE WHEN r_regionkey < 3 THEN timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(r_regionkey) END").alias("report_ts"),
    )
    return timeline.epoch_table(meta, boot)


def _kernel_findings(spark: SparkSession, folder: str) -> DataFrame:
    rows = _kernel(spark, folder)
    uptime = rows.groupBy("report_id").agg(F.max_by("boot_s", "entry_idx").alias("uptime_s"))
    return findings.kernel_findings(kernel.detect_events(rows), _epochs(spark, folder, uptime))


@query
def kernel_findings(spark, folder):
    return _kernel_findings(spark, folder).select(
        "report_id", F.col("o2").alias("entry_idx"), "severity", "category", "title", "description", "ts_text", "allow_rule",
        F.array_join("debug_commands", "|").alias("commands"),
    )


@query
def denial_merge(spark, folder):
    return findings.merge_denials(_kernel_findings(spark, folder)).select("report_id", "o1", "o2", "title", "description")


@query
def finding_order(spark, folder):
    rows = findings.merge_denials(_kernel_findings(spark, folder)).unionByName(_log_findings(spark, folder))
    numbered = findings.number_findings(findings.merge_duplicates(rows))
    return numbered.select("report_id", "insight_no", "insight_id", "severity", "source", "title", "occurrences")


@query
def explained_logs(spark, folder):
    entries = _entries(spark, folder)
    found = findings._rows(
        logs.detect_anomalies(entries), ["report_id"], 0, [F.col("entry_idx")], severity=F.col("severity"),
        category=F.when(F.col("type").isin("anr", "input_dispatching_timeout"), "anr").otherwise("other"),
        title=F.col("summary"), source="logcat",
    )
    # Reports with a trace: those named after a region.
    about = b.load(spark, folder, "nation").select(F.expr("'r' || CAST(2 * n_regionkey AS STRING)").alias("report_id")).distinct()
    return findings.drop_explained(found, about).groupBy("report_id", "title").agg(F.count(F.lit(1)).alias("n"))


@query
def resource_findings(spark, folder):
    mem, cpu = (b.snapshot_lines(spark, folder, x) for x in (b.MEM_LINES, b.CPU_LINES))
    rows = findings.resource_findings(
        snapshots.mem_summary(mem), snapshots.mem_processes(mem), snapshots.cpu_summary(cpu), snapshots.cpu_processes(cpu)
    )
    return rows.select("report_id", "severity", "category", "title", "description")


@query
def boot_findings(spark, folder):
    boot = _boot(spark, folder, _entries(spark, folder), _kernel(spark, folder))
    return findings.boot_findings(boot).select("report_id", "severity", "title", "description")


@query
def hal_findings(spark, folder):
    lines = b.hal_lines(spark, folder)
    services = materialize(snapshots.hal_services(lines))
    families = materialize(snapshots.hal_families(services, b.hal_makers(spark, folder)))
    return findings.hal_findings(snapshots.hal_summary(lines, services), families).select(
        "report_id", "severity", "title", "description"
    )


def _crashes(spark: SparkSession, folder: str) -> DataFrame:
    return crashes.crash_dumps(_crash_lines(spark, folder)).withColumn(
        "file_idx", F.regexp_extract("file", r"(\d+)", 1).cast("long")
    )


@query
def crash_findings(spark, folder):
    rows = findings.crash_findings(_crashes(spark, folder), crashes.crash_frames(_crash_lines(spark, folder)))
    return rows.select("report_id", F.col("o1").alias("file_idx"), "title", "description", "stack", "ts_text")


@query
def tag_findings(spark, folder):
    return findings.tag_findings(logs.tag_stats(_entries(spark, folder))).select("report_id", "title", "description")


def _traced(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    t = _reasoned(_dumps(spark, folder))
    t["heads"] = t["heads"].withColumn("trace_idx", F.substring("trace_id", 2, 20).cast("long"))
    t["chains"] = materialize(traces.blocking_chains(t["threads"], t["primary"]))
    t["targets"] = materialize(t["targets"])
    return t


@query
def trace_findings(spark, folder):
    t = _traced(spark, folder)
    rows = findings.trace_findings(
        t["heads"], t["blocks"], t["targets"], t["suspects"], t["chains"], t["cycles"], t["pool"], t["frames"]
    )
    return rows.select("report_id", F.col("o1").alias("trace_idx"), F.col("o2").alias("part"), "severity", "category", "title", "ts_text")


# Timeline and health ------------------------------------------------------------------------


@query
def timeline_merged(spark, folder):
    entries, kernel_rows = _entries(spark, folder), _kernel(spark, folder)
    uptime = kernel_rows.groupBy("report_id").agg(F.max_by("boot_s", "entry_idx").alias("uptime_s"))
    t = _reasoned(_dumps(spark, folder))
    t["heads"] = t["heads"].withColumn("trace_idx", F.substring("trace_id", 2, 20).cast("long"))
    rows = timeline.timeline_rows(
        logs.detect_anomalies(entries), kernel.detect_events(kernel_rows), t["heads"], t["blocks"], _crashes(spark, folder),
        _epochs(spark, folder, uptime),
    )
    return timeline.build_timeline(rows)


def _event_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Events in their own order as timeline rows."""
    columns = {
        "report_id": "'r' || CAST(user_id % 4 AS STRING)",
        "severity": b.cases("event_type", ("'error'", "'critical'"), ("'purchase'", "'warning'"), other="'info'"),
        "source": b.cases("(user_id % 3)", ("0", "'logcat'"), ("1", "'kernel'"), other="'anr'"),
    }
    rows = b.with_columns(b.load(spark, folder, "events"), columns)
    return rows.select(
        "report_id", F.col("event_id").alias("pos"), F.date_format("ts", "MM-dd HH:mm:ss.SSS").alias("ts_text"), "source",
        "severity", F.lit("l").alias("label"), F.col("event_type").alias("details"),
    )


@query
def timeline_runs(spark, folder):
    return timeline.merge_runs(_event_timeline(spark, folder).withColumn("label", F.col("details")))


@query
def timeline_counts(spark, folder):
    return views.timeline_counts(_event_timeline(spark, folder), sources=("logcat", "anr"))


@query
def timeline_filter(spark, folder):
    shown = views.filter_timeline(_event_timeline(spark, folder), ("critical",), ("kernel",))
    return shown.select("report_id", "pos", "ts_text", "severity", "source")


@query
def severity_counts(spark, folder):
    return views.severity_counts(_event_timeline(spark, folder))


def _user_health(spark: SparkSession, folder: str) -> DataFrame:
    """Each user as a report; events stand for counted types, orders for resources."""
    kinds = LOG_TYPES + KERNEL_TYPES + ["crash_dump", "trace_idle", "trace_deadlock", "trace_other"]
    named = F.array(*map(F.lit, kinds))
    events = b.load(spark, folder, "events").select(
        F.col("user_id").alias("report_id"),
        F.element_at(named, (F.col("event_id") % (F.col("user_id") % len(kinds) + 1) + 1).cast("int")).alias("type"),
    )
    counts = events.groupBy("report_id", "type").agg(F.count(F.lit(1)).alias("n"))
    cust = b.load(spark, folder, "customer")
    res = cust.select(
        F.col("c_custkey").alias("report_id"), F.lit(10000).alias("total_kb"), ((F.col("c_custkey") * 37) % 1500).alias("free_kb"),
        (F.col("c_custkey") % 100).cast("double").alias("total_percent"), (F.col("c_custkey") % 41).cast("double").alias("iowait_percent"),
    )
    return health.health_scores(res, counts, res, res)


@query
def health_scores(spark, folder):
    return _user_health(spark, folder)


@query
def health_deductions(spark, folder):
    events = b.load(spark, folder, "events").select(
        F.col("user_id").alias("report_id"),
        F.element_at(F.array(*map(F.lit, LOG_TYPES)), (F.col("event_id") % 11 + 1).cast("int")).alias("type"),
    )
    rows = health.deductions(events.groupBy("report_id", "type").agg(F.count(F.lit(1)).alias("n")))
    return rows.withColumn("points", F.col("points").cast("double"))


@query
def fleet_bands(spark, folder):
    return views.fleet_bands(_user_health(spark, folder))


@query
def overview_texts(spark, folder):
    rows = b.load(spark, folder, "orders")
    price = F.col("o_orderkey") * 977
    return rows.select(
        "o_orderkey", views.gigabytes(price).alias("gb"), views.uptime_text(F.col("o_orderkey") * 13).alias("uptime"),
        views.short_fingerprint(F.concat_ws("/", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))).alias("build"),
    )


@query
def latest_results(spark, folder):
    events = b.load(spark, folder, "events").select("user_id", "event_id", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("at"), "event_type")
    last = views.latest_results(events, ["user_id"], "at", F.lit(1706572800000000), F.lit(86_400_000_000), "event_id")
    return last.select("user_id", "event_id", "event_type")


# Correlation and text ------------------------------------------------------------------------

TITLES = b.cases(
    "(p_partkey % 7)",
    ("0", "'ANR: Lock Contention in com.app.u' || CAST(p_size % 12 AS STRING)"),
    ("1", "'Slow operation: delivery (×' || CAST(p_size AS STRING) || ')'"),
    ("2", "'Input dispatching timeout: com.app/.U' || CAST(p_size % 9 AS STRING)"),
    ("3", "'Kernel panic: not syncing: fatal ' || CAST(p_size % 9 AS STRING)"),
    ("4", "'Low available memory'"),
    ("5", "'Fatal Exception: main Process: com.app.u' || CAST(p_size % 9 AS STRING) || ' pid 700' || CAST(p_size % 10 AS STRING)"),
    other="'Nothing known ' || CAST(p_size AS STRING)",
)


def _insights(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as findings, spread over four reports."""
    rows = b.load(spark, folder, "part").select(
        F.expr("'r' || CAST(p_partkey % 4 AS STRING)").alias("report_id"), F.col("p_partkey").alias("insight_no"),
        F.expr(TITLES).alias("title"),
        F.expr(b.cases("(p_partkey % 3)", ("0", "'critical'"), ("1", "'warning'"), other="'info'")).alias("severity"),
        F.expr(b.cases("(p_partkey % 5)", ("0", "'anr'"), ("1", "'crash'"), ("2", "'memory'"), ("3", "'performance'"), other="'kernel'")).alias("category"),
    )
    return context.target_findings(rows)


@query
def matching_anomalies(spark, folder):
    anomalies = materialize(logs.detect_anomalies(_entries(spark, folder)))
    return context.matching_anomalies(
        _insights(spark, folder), anomalies, LOG_TYPES, match_missing_process=False
    ).select("report_id", "insight_no", "entry_idx", "rank")


@query
def matching_anomalies_any_process(spark, folder):
    anomalies = materialize(logs.detect_anomalies(_entries(spark, folder)))
    return context.matching_anomalies(_insights(spark, folder), anomalies, LOG_TYPES).select(
        "report_id", "insight_no", "entry_idx", "rank"
    )


@query
def kernel_context(spark, folder):
    entries = materialize(_kernel(spark, folder))
    rows = context.kernel_context(
        _insights(spark, folder), materialize(kernel.detect_events(entries)), entries, KERNEL_TYPES, radius_s=NEAR_S
    )
    return context.distinct_lines(rows).groupBy("report_id", "insight_no", "text").agg(F.count(F.lit(1)).alias("n"))


@query
def temporal_context(spark, folder):
    entries = _entries(spark, folder)
    moments = b.load(spark, folder, "orders").select(
        F.expr("'r' || CAST(o_custkey % 4 AS STRING)").alias("report_id"), F.col("o_orderkey").alias("insight_no"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'critical' ELSE 'warning' END").alias("severity"),
        F.expr("CASE WHEN o_orderkey % 30 = 9 THEN 'boot+1.000s' ELSE '2024-01-' || lpad(CAST(1 + o_custkey % 30 AS STRING), 2, '0') || "
               "' 0' || CAST(o_orderkey % 10 AS STRING) || ':00:00.000' END").alias("ts_text"),
    )
    return context.temporal_context(moments, entries, radius_ms=NEAR_MS, k=20).select(
        "report_id", "insight_no", "ord", "text"
    )


@query
def trace_choice(spark, folder):
    heads = traces.trace_heads(b.trace_lines(spark, folder)).withColumn(
        "trace_idx", F.substring("trace_id", 2, 20).cast("long")
    )
    titled = _insights(spark, folder).withColumn("_title", F.replace("_title", F.lit(".u"), F.lit(".p")))
    return context.choose_trace(titled, materialize(heads))


def _digested(rows: DataFrame) -> DataFrame:
    """Lines, characters and a digest of the texts in order, for each kind of context of a finding."""
    keys = ["report_id", "insight_no", "kind"]
    rows = materialize(rows.select(*keys, "ord", "text"))
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    whole = ordering.ordered_text(rows, keys, "ord", "text", "whole").select(*keys, F.md5("whole").alias("digest"))
    return sums.join(whole, keys)


@query
def trace_context(spark, folder):
    t = _traced(spark, folder)
    primary = t["blocks"].groupBy(*TRACE).agg(F.min_by(F.struct("thread_no", "tid"), "role").alias("p")).select(*TRACE, "p.*")
    chosen = t["heads"].select("report_id", F.col("trace_idx").alias("insight_no"), "trace_id")
    rows = context.trace_context(chosen, primary, t["threads"], t["frames"], traces.held_locks(t["owned"]), t["chains"])
    return _digested(rows)


def _context_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines as context rows: documents are findings, sources are reports."""
    lines = archives.text_lines(b.load(spark, folder, "documents"), ["source", "doc_id"], "text")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("temporal", "thread", "log", "chain")]), (F.col("line_no") % 4 + 1).cast("int"))
    return lines.select(
        F.col("source").alias("report_id"), F.col("doc_id").alias("insight_no"), kinds.alias("kind"),
        F.expr("line_no DIV 4 + 1").alias("ord"), F.col("raw").alias("text"),
    )


@query
def budget_cut(spark, folder):
    kept = context.within_budget(
        materialize(_context_parts(spark, folder)), budget=BUDGET,
        cuts=[("temporal", 3), ("thread", 2), ("log", 1), ("chain", 1)],
    )
    return _digested(kept)


@query
def family_match(spark, folder):
    targets = b.load(spark, folder, "supplier").select(
        F.expr("'h' || CAST(s_suppkey % 20 AS STRING)").alias("report_id"),
        F.expr(b.cases("(s_nationkey % 4)", ("0", "'Vendor.Acme.Pad@1.0'"), ("1", "'vendor.qti.color@1.2::x'"), ("2", "'android.hardware.gnss'"),
                       other="'com.none@2.' || CAST(s_suppkey AS STRING)")).alias("package_name"),
        F.concat(F.lit("I"), F.col("s_suppkey").cast("string")).alias("interface_name"),
    )
    return context.match_families(targets, _families(spark, folder)).select("report_id", "interface_name", "text")


@query
def hal_cross_reference(spark, folder):
    t = _traced(spark, folder)
    kept = t["blocks"].groupBy(*TRACE).agg(F.min_by(F.struct("role", "thread_no"), "role").alias("p")).select(*TRACE, "p.*")
    families = _families(spark, folder).withColumn("report_id", F.replace("report_id", F.lit("h"), F.lit("r")))
    return context.hal_cross_reference(t["heads"], kept, t["targets"], t["suspects"], families).select("report_id", "text")


@query
def trace_summaries(spark, folder):
    t = _traced(spark, folder)
    kept = ["role", "thread_no", "tid", "reason", "confidence"]
    primary = t["blocks"].groupBy(*TRACE).agg(F.min_by(F.struct(*kept), "role").alias("p")).select(*TRACE, "p.*")
    return context.trace_summaries(t["heads"], primary, t["targets"], t["suspects"], t["chains"], t["cycles"], t["pool"])


@query
def chat_prompts(spark, folder):
    return answers.flatten_conversation(b.load(spark, folder, "conversations"), ["conv_id"], "turn")


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers built around each event's ``props``: fenced, bare, listed, broken."""
    k = "get_json_object(props, '$.k')"
    item = f"'{{\"insightId\":\"insight-' || CAST(event_id % 3 AS STRING) || '\",\"rootCause\":\"cause ' || {k} || '\",\"evidence\":[\"a\",\"b\"]}}'"
    full = f"'{{\"executiveSummary\":\"sum ' || {k} || '\",\"insights\":[' || {item} || ']}}'"
    text = b.cases(
        "(event_id % 6)",
        ("0", f"'Here:' || chr(10) || '```json' || chr(10) || {full} || chr(10) || '```'"),
        ("1", f"'So ' || {full} || ' done'"), ("2", f"'List [' || {item} || ',' || {item} || ']'"),
        ("3", "'no answer ' || props"), ("4", "'{\"insights\": [broken'"),
        other=f"'```' || chr(10) || '{{\"other\":1}}' || chr(10) || '```' || chr(10) || '[' || {item} || ']'",
    )
    rows = b.load(spark, folder, "events").select(F.col("event_id").alias("report_id"), F.expr(text).alias("content"))
    return answers.parse_answers(rows, ["report_id"])


@query
def answer_parse(spark, folder):
    a = F.col("answer")
    return _answers(spark, folder).select(
        "report_id", a.isNotNull().alias("read"), a["executiveSummary"].alias("summary"),
        F.size(a["insights"]).alias("items"), a["insights"][0]["rootCause"].alias("cause"),
    )


@query
def answer_merge(spark, folder):
    ids = b.load(spark, folder, "events").select(
        F.col("event_id").alias("report_id"), F.expr("'insight-' || CAST(event_id % 2 AS STRING)").alias("insight_id")
    )
    d = F.col("deep")
    return answers.deep_insights(ids, _answers(spark, folder)).select(
        "report_id", "insight_id", d["root_cause"].alias("cause"), F.array_join(d["evidence"], ",").alias("evidence"),
        d["category"].alias("category"),
    )


@query
def answer_overview(spark, folder):
    return answers.deep_overview(_answers(spark, folder)).select("report_id", "executive_summary", "system_diagnosis")


# Generic ordered helpers over wide tables -------------------------------------------------------


@query
def newest_versions(spark, folder):
    parts = b.load(spark, folder, "part").select(
        "p_brand", "p_type", F.expr("CAST(p_size DIV 10 AS STRING) || '.' || CAST(p_size % 10 AS STRING)").alias("version"),
        F.expr(b.cases("(p_partkey % 3)", ("0", "'alive'"), ("1", "'non-responsive'"), other="'declared'")).alias("status"), "p_partkey",
    )
    return snapshots.newest_per_family(parts, ["p_brand"], "p_type", "version", "status", "p_partkey")


@query
def ordered_position(spark, folder):
    rows = b.load(spark, folder, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    order = [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    placed = ordering.with_position(rows, ["l_returnflag"], order)
    return placed.groupBy("l_returnflag", F.expr("pos DIV 100").alias("page")).agg(
        F.sum("l_orderkey").alias("orders"), F.min("l_shipdate").cast("string").alias("first_day")
    )


@query
def running_text_groups(spark, folder):
    lines = archives.text_lines(b.load(spark, folder, "documents"), ["doc_id"], "text")
    head = (F.col("line_no") == 0) | F.col("raw").rlike("[0-9]")
    owned = ordering.scan(lines, ["doc_id"], "line_no", last={"head": F.when(head, F.col("line_no"))})
    return owned.groupBy("doc_id", "head").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("raw")).alias("chars")
    )


# Streams -------------------------------------------------------------------------------------------


@query
def streamed_anomalies(spark, folder):
    """The events table read as a stream, rendered to lines, classified and appended."""
    schema = b.load(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{{events.parquet}}")  # a file or a folder of files
    lines = b.as_log_lines(stream)
    place = scratch_folder(spark)
    arrivals.append_anomalies(lines, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("report_id", "line_no", "type", "summary", "tag", "classification")


@query
def streamed_latest(spark, folder):
    """The newest event of each user, kept by a stream with a day to live."""
    schema = b.load(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{{events.parquet}}")  # a file or a folder of files
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    rows = stream.select(
        F.col("user_id").cast("string").alias("id"), F.timestamp_diff("MILLISECOND", epoch, F.col("ts")).alias("at"),
        F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("payload"),
    )
    place = scratch_folder(spark)
    arrivals.keep_latest(rows, f"{place}/out", f"{place}/state", ttl_ms=86_400_000).awaitTermination()
    return arrivals.newest(spark, f"{place}/out", ttl_ms=86_400_000)


def _pages(spark: SparkSession, folder: str, page_rows: int, only: str = "true") -> DataFrame:
    events = _event_timeline(spark, folder).where(only)
    return sinks.result_pages(
        _user_health(spark, folder).withColumn("report_id", F.col("report_id").cast("string")).where(only),
        events.select("report_id", (F.col("pos") + 1).alias("insight_no"), "severity", "source", "details"),
        timeline.merge_runs(events), page_rows=page_rows,
    )


def _page_facts(pages: DataFrame, *more: str) -> DataFrame:
    return pages.select(
        "report_id", "part", "page", F.json_array_length("result").alias("rows"),
        F.get_json_object("result", "$[0].severity").alias("first_severity"),
        F.get_json_object("result", "$.overall").cast("int").alias("overall"), *more,
    )


@query
def result_pages(spark, folder):
    return _page_facts(_pages(spark, folder, 100))


@query
def written_results(spark, folder):
    """Results written by date and read again, after one day's reports were analysed anew with smaller pages."""
    day = "ascii(right(report_id, 1)) % 5"
    place = f"{scratch_folder(spark)}/results"
    for page_rows, only, mode in ((100, "true", "append"), (40, f"{day} = 2", "replace")):
        pages = _pages(spark, folder, page_rows, only)
        dates = pages.select("report_id").distinct().withColumn("report_date", F.expr(f"date_add(DATE '2024-01-01', CAST({day} AS INT))"))
        sinks.write_tables({"results": pages}, place, dates, mode)
    return _page_facts(spark.read.parquet(f"{place}/results"), F.col("report_date").cast("string").alias("report_date"))
