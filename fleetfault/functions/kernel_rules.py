"""Fixed values for kernel logs: event rules in order, details, policy rule text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetfault.functions.rules import Rule, first_match, summarise
from fleetfault.functions.text import capture, fill, trimmed, whole

# Fixed values.  (type, severity, clauses, summary forms, summary fallback, kind of details).
# A clause is a list of patterns that must all be found; any clause is enough.
KERNEL_RULES = [
    ("kernel_panic", "critical",
     [[r"(?i)Kernel panic"]],
     [(r"Kernel panic - (.+)", "Kernel panic: {}")], "Kernel panic", "message"),
    ("oom_kill", "critical",
     [[r"(?i)Out of memory: Kill(ed)? process"], [r"(?i)oom-kill"]],
     [], "OOM kill event", "victim"),
    ("lowmemory_killer", "warning",
     [[r"(?i)lowmemorykiller|lmkd"]],
     [(r"kill.*?'(.+?)'", "LMK killed: {}")], "Low memory killer event", "message"),
    ("kswapd_active", "warning",
     [[r"kswapd\d*", r"(?i)running|active|wake"]],
     [], "kswapd active (memory pressure)", "none"),
    ("driver_error", "warning",
     [[r"(?i)\berror\b", r"(?i)driver|firmware|hardware"]],
     [], "Driver error: ", "message"),
    ("gpu_error", "warning",
     [[r"(?i)gpu", r"(?i)fault|error|hang|timeout"]],
     [], "GPU error: ", "message"),
    ("thermal_shutdown", "critical",
     [[r"(?i)thermal", r"(?i)shutdown|critical|emergency"]],
     [], "Thermal shutdown triggered", "temperature"),
    ("watchdog_reset", "critical",
     [[r"(?i)watchdog", r"(?i)reset|bark|bite|triggered|expired"]],
     [], "Watchdog reset triggered", "message"),
    ("thermal_throttling", "warning",
     [[r"(?i)thermal", r"(?i)throttl"]],
     [(r"(?i)zone\s+(\S+)", "Thermal throttling: {}")], "Thermal throttling detected", "temperature"),
    ("storage_io_error", "warning",
     [[r"(?i)mmc\d*.*error"], [r"(?i)EXT4-fs error"], [r"(?i)I\/O error.*dev\s+(sd|mmc|nvme)"],
      [r"(?i)Buffer I\/O error"]],
     [], "Storage I/O error: ", "message"),
    ("suspend_resume_error", "warning",
     [[r"(?i)suspend.*abort"], [r"(?i)resume.*fail"], [r"(?i)PM:.*suspend.*error"], [r"(?i)suspend entry.*error"]],
     [(r"(?i)abort", "Suspend aborted"), (r"(?i)resume.*fail", "Resume failed")], "Suspend/resume error", "message"),
    ("selinux_denial", "info",
     [[r"(?i)avc:\s+denied|selinux"]],
     [], "SELinux denial", "access"),
]

# Rules whose summary shows the first hundred characters of the message.
_QUOTING = {"driver_error", "gpu_error", "storage_io_error"}


def _details(kind: str, message: Column) -> Column:
    if kind == "message":
        parts = {"message": message}
    elif kind == "victim":
        parts = {
            "pid": F.coalesce(whole(capture(message, r"process (\d+)")), F.lit(0)).cast("string"),
            "processName": F.coalesce(capture(message, r"\((.+?)\)"), F.lit("unknown")),
        }
    elif kind == "temperature":
        parts = {"temperature": whole(capture(message, r"(?i)(\d+)\s*(?:°?C|celsius|mC)")).cast("string")}
    elif kind == "access":
        parts = {
            "scontext": capture(message, r"scontext=(\S+)"),
            "tcontext": capture(message, r"tcontext=(\S+)"),
            "tclass": capture(message, r"tclass=(\S+)"),
            "permission": trimmed(capture(message, r"\{\s*([^}]+?)\s*\}")),
        }
    else:
        return F.create_map().cast("map<string,string>")
    pairs = [x for name, value in parts.items() for x in (F.lit(name), value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _summary(kind: str, message: Column, forms, fallback: str) -> Column:
    if kind == "oom_kill":
        victim = r"Kill(?:ed)? process (\d+) \((.+?)\)"
        named = fill("OOM killed: {} (pid={})", capture(message, victim, 2), capture(message, victim, 1))
        return F.coalesce(named, F.lit(fallback))
    if kind == "selinux_denial":
        pair = fill("SELinux denial: {} → {}", capture(message, r"scontext=(\S+)"), capture(message, r"tcontext=(\S+)"))
        return F.coalesce(pair, F.lit(fallback))
    if kind in _QUOTING:
        return F.concat(F.lit(fallback), F.substring(message, 1, 100))
    return summarise(message, forms, fallback)


def kernel_event(message: Column) -> Column:
    """``struct(type, severity, summary, details)`` of the first rule that holds, else null."""
    rules = []
    for kind, severity, clauses, forms, fallback, details in KERNEL_RULES:
        when = F.lit(False)
        for patterns in clauses:
            all_found = message.rlike(patterns[0])
            for pattern in patterns[1:]:
                all_found = all_found & message.rlike(pattern)
            when = when | all_found
        rules.append(
            Rule(
                when,
                F.struct(
                    F.lit(kind).alias("type"),
                    F.lit(severity).alias("severity"),
                    _summary(kind, message, forms, fallback).alias("summary"),
                    _details(details, message).alias("details"),
                ),
            )
        )
    return first_match(rules)


def worth_checking(message: Column) -> Column:
    """One pattern that every rule implies."""
    return message.rlike(
        r"(?i)panic|out of memory|oom-kill|lowmemorykiller|lmkd|kswapd|error|gpu|thermal|watchdog|suspend|resume|avc:|selinux"
    )


def allow_rule(details: Column) -> Column:
    """Policy text that would permit a denied access; null when a part is missing or odd."""
    domain = capture(details["scontext"], r"^u:r:([^:]+):")
    target = capture(details["tcontext"], r"^u:[^:]+:([^:]+):")
    return F.concat(
        F.lit("allow "), domain, F.lit(" "), target, F.lit(":"), details["tclass"],
        F.lit(" { "), details["permission"], F.lit(" };"),
    )
