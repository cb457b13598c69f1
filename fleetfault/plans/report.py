"""From archives to tables: the whole rule-based analysis of a fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.functions.kernel_rules import KERNEL_RULES
from fleetfault.functions.log_rules import LOG_RULES
from fleetfault.operators import context as ctx
from fleetfault.operators import crashes, findings, health, kernel, logs, snapshots, timeline, traces
from fleetfault.session import materialize, prepare, written
from fleetfault.sources import archives, sections

LOG_TYPES = [r[0] for r in LOG_RULES]
KERNEL_TYPES = [r[0] for r in KERNEL_RULES]


def typed_tables(blocks: DataFrame) -> dict[str, DataFrame]:
    """Extraction: one DataFrame per record type.

    ``blocks`` is what ``members.read_reports`` or ``archives.expand_archives`` gives.  It is written
    first, so that archives are opened once, whatever reads their lines later.  Tables that later
    steps read several times are written once here.
    """
    prepare(blocks.sparkSession)
    blocks = written(blocks)
    t: dict[str, DataFrame] = {
        "members": materialize(archives.members(blocks)), "rejects": materialize(archives.rejects(blocks))
    }
    usable = blocks.join(t["rejects"].select("report_id"), "report_id", "left_anti")
    marked = materialize(sections.mark_sections(archives.main_lines(usable)))
    t["section_lines"] = marked
    t["sections"] = materialize(sections.sections(marked))
    routed = materialize(sections.routes(t["sections"]))
    t["report_meta"] = materialize(sections.report_meta(marked, routed))
    section = {n: materialize(sections.routed_lines(marked, routed, n)) for n in ("properties", "kernel", "memory", "cpu", "hals")}

    log = sections.log_lines(marked)
    t["log_stats"] = logs.log_stats(log)
    t["log_entries"] = materialize(logs.parse_log(log))
    t["log_merges"] = materialize(logs.merge_anomalies(logs.detect_anomalies(t["log_entries"])))
    t["log_anomalies"] = logs.kept_anomalies(t["log_merges"])
    t["log_anomaly_entries"] = materialize(logs.anomaly_context(t["log_entries"], t["log_merges"], limit=15))
    t["tag_stats"] = materialize(logs.tag_stats(t["log_entries"]))
    t["kernel_entries"] = materialize(kernel.parse_kernel(section["kernel"]))
    t["kernel_events"] = materialize(kernel.detect_events(t["kernel_entries"]))

    order = t["members"].select("report_id", "member", "member_idx")
    owned = materialize(traces.thread_lines(archives.dump_lines(usable, "is_trace", "trace_id")))
    t["traces"] = materialize(traces.trace_heads(archives.dump_lines(usable, "is_trace", "trace_id")).join(
        order.select("report_id", F.col("member").alias("trace_id"), F.col("member_idx").alias("trace_idx")),
        ["report_id", "trace_id"],
    ))
    t["threads"], t["frames"] = materialize(traces.threads(owned)), materialize(traces.frames(owned))
    t["held_locks"] = traces.held_locks(owned)
    t["lock_edges"], t["lock_nodes"] = traces.lock_edges(t["threads"]), traces.lock_nodes(t["threads"])
    t["deadlocks"] = materialize(traces.deadlocks(t["threads"]))
    t["binder_pool"] = materialize(traces.binder_pool(t["threads"], t["frames"]))
    evidence = materialize(traces.stack_evidence(t["frames"]))
    starts = materialize(traces.primary_threads(t["traces"], t["threads"]))
    reasoned = materialize(traces.block_reasons(starts, evidence, t["deadlocks"], t["binder_pool"]))
    t["suspected_targets"] = materialize(traces.suspected_targets(reasoned, t["threads"], t["frames"], evidence))
    t["thread_block"] = materialize(traces.thread_blocks(reasoned, t["suspected_targets"]))
    t["binder_targets"] = materialize(traces.binder_targets(reasoned.where("reason = 'slow_binder_call'"), t["frames"]))
    t["blocking_chains"] = materialize(traces.blocking_chains(t["threads"], starts))

    every = archives.dump_lines(usable, "is_crash", "file")
    dumps = crashes.usable_dumps(every)
    t["tombstones"] = materialize(crashes.crash_dumps(dumps).join(
        order.select("report_id", F.col("member").alias("file"), F.col("member_idx").alias("file_idx")), ["report_id", "file"]
    ))
    t["crash_frames"], t["registers"] = crashes.crash_frames(dumps), crashes.registers(dumps)
    t["unreadable_dumps"] = crashes.unreadable_dumps(every, t["tombstones"])

    t["mem_summary"], t["mem_process"] = snapshots.mem_summary(section["memory"]), snapshots.mem_processes(section["memory"])
    t["cpu_summary"], t["cpu_process"] = snapshots.cpu_summary(section["cpu"]), snapshots.cpu_processes(section["cpu"])
    t["hal_services"] = materialize(snapshots.hal_services(section["hals"]))
    t["hal_summary"] = materialize(snapshots.hal_summary(section["hals"], t["hal_services"]))
    t["hal_families"] = materialize(snapshots.hal_families(t["hal_services"], t["report_meta"]))
    t["boot_status"] = materialize(snapshots.boot_status(t["log_entries"], t["kernel_entries"], section["properties"]))
    return t


def analyse(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds ``insights``, ``timeline`` and ``health`` to the typed tables."""
    epochs = timeline.epoch_table(t["report_meta"], t["boot_status"])
    trace = findings.trace_findings(
        t["traces"], t["thread_block"], t["binder_targets"], t["suspected_targets"], t["blocking_chains"],
        t["deadlocks"], t["binder_pool"], t["frames"],
    )
    others = [
        findings.resource_findings(t["mem_summary"], t["mem_process"], t["cpu_summary"], t["cpu_process"]),
        findings.boot_findings(t["boot_status"]),
        findings.hal_findings(t["hal_summary"], t["hal_families"]),
        findings.crash_findings(t["tombstones"], t["crash_frames"]),
        findings.tag_findings(t["tag_stats"]),
    ]
    t = dict(t)
    t["insights"] = materialize(findings.all_findings(
        findings.log_findings(t["log_anomalies"], t["log_anomaly_entries"]), trace,
        findings.kernel_findings(t["kernel_events"], epochs), others,
    ))
    t["timeline"] = materialize(timeline.build_timeline(
        timeline.timeline_rows(
            t["log_anomalies"], t["kernel_events"], t["traces"], t["thread_block"], t["tombstones"], epochs
        )
    ))
    counts = health.event_counts(t["log_anomalies"], t["kernel_events"], t["thread_block"], t["tombstones"])
    t["health"] = materialize(health.health_scores(t["report_meta"], counts, t["mem_summary"], t["cpu_summary"]))
    return t


def review(t: dict[str, DataFrame], budget: int = ctx.MAX_CHARS) -> dict[str, DataFrame]:
    """Adds ``contexts`` (within the budget) and ``review_parts``."""
    found = materialize(ctx.target_findings(t["insights"]))
    trace = ["report_id", "trace_id"]
    kept = ["role", "thread_no", "tid", "reason", "confidence"]
    primary = t["thread_block"].groupBy(*trace).agg(F.min_by(F.struct(*kept), "role").alias("p")).select(*trace, "p.*")
    with_logs = found.where("source in ('logcat', 'anr', 'cross')")
    with_kernel = found.where("source in ('kernel', 'cross')")
    log = ctx.log_context(
        ctx.matching_anomalies(with_logs, t["log_anomalies"], LOG_TYPES), t["log_anomaly_entries"]
    )
    kern = ctx.kernel_context(with_kernel, t["kernel_events"], t["kernel_entries"], KERNEL_TYPES)
    # Findings that read the kernel log list each line once; pure log findings keep repeats.
    mixed = log.join(with_kernel.select("report_id", "insight_no"), ["report_id", "insight_no"], "left_semi")
    plain = log.join(with_kernel.select("report_id", "insight_no"), ["report_id", "insight_no"], "left_anti")
    lines = plain.unionByName(ctx.distinct_lines(mixed.unionByName(kern)))
    chosen = ctx.choose_trace(found.where("source = 'anr'"), t["traces"])
    stacks = ctx.trace_context(
        chosen, primary, t["threads"], t["frames"], t["held_locks"], t["blocking_chains"]
    )
    parts = lines.unionByName(stacks).unionByName(ctx.temporal_context(found, t["log_entries"]))
    t = dict(t)
    t["contexts"] = ctx.within_budget(materialize(parts), budget=budget)
    cross = ctx.hal_cross_reference(
        t["traces"], primary, t["binder_targets"], t["suspected_targets"], t["hal_families"]
    )
    t["hal_cross_reference"] = cross
    t["review_parts"] = ctx.review_parts(
        t["report_meta"], t["health"], t["insights"], t["timeline"],
        ctx.trace_summaries(t["traces"], primary, t["binder_targets"], t["suspected_targets"], t["blocking_chains"],
                            t["deadlocks"], t["binder_pool"]),
        t["hal_summary"], t["hal_families"], cross, t["contexts"],
    )
    return t
