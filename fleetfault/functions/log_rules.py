"""Fixed values for application logs: anomaly rules in order, tag lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetfault.functions.rules import Rule, first_match, summarise

# Fixed values.  (type, severity, clauses, summary forms, summary fallback).
# A clause is (exact tags or a tag pattern or None, message pattern); any clause is enough.
LOG_RULES = [
    ("anr", "critical",
     [(["ActivityManager"], r"ANR in|not responding")],
     [(r"ANR in (.+?)(?:\s+\(|\z)", "ANR in {}")], "ANR detected"),
    ("fatal_exception", "critical",
     [(["AndroidRuntime"], r"FATAL EXCEPTION")],
     [(r"FATAL EXCEPTION:\s*(.+)", "Fatal Exception: {}")], "Fatal Exception"),
    ("native_crash", "critical",
     [(["DEBUG"], r"\*\*\* \*\*\*|signal")],
     [], "Native crash detected"),
    ("system_server_crash", "critical",  # never reached: fatal_exception takes the same lines first
     [(["AndroidRuntime"], r"FATAL EXCEPTION[\s\S]*system_server|system_server[\s\S]*FATAL EXCEPTION")],
     [], "System server crash"),
    ("oom", "critical",
     [(["ActivityManager"], r"Out of memory|Low on memory"), (["lowmemorykiller"], r"kill")],
     [(r"kill.*?(\S+).*?adj\s*(\d+)", "OOM kill: {} (adj={})")], "Out of memory event"),
    ("watchdog", "critical",
     [(["Watchdog"], r"WATCHDOG KILLING SYSTEM PROCESS|Blocked in")],
     [(r"Blocked in (.+)", "Watchdog: blocked in {}")], "Watchdog triggered"),
    ("binder_timeout", "warning",
     [(["JavaBinder"], r"Binder transaction timeout"), (["binder"], r"timeout"), (r"Binder", r"(?i)\btimeout\b")],
     [], "Binder transaction timeout"),
    ("slow_operation", "warning",
     [(["Looper", "ActivityThread", "ContentResolver"], r"Slow")],
     [(r"Slow (\w+)", "Slow operation: {}")], "Slow operation detected"),
    ("strict_mode", "info",
     [(["StrictMode"], r"violation|penalty")],
     [(r"policy=(\d+)\s+violation=(\d+)", "StrictMode violation (policy={}, violation={})")], "StrictMode violation"),
    ("input_dispatching_timeout", "critical",
     [(None, r"(?i)Input dispatching timed out"), (["InputDispatcher"], r"(?i)timeout")],
     [(r"timed out.*?(\S+\/\S+)", "Input dispatching timeout: {}")], "Input dispatching timeout"),
    ("hal_service_death", "warning",
     [(r"(?i)hwservicemanager", r"(?i)died|restart"), (["ServiceManager", "servicemanager"], r"(?i)service.*died")],
     [(r"(?i)(?:service\s+)?['\"]?(\S+?)['\"]?\s+(?:has\s+)?died", "HAL service died: {}")], "HAL service died"),
]

# Tags of the platform itself.
FRAMEWORK_TAGS = [
    "ActivityManager", "WindowManager", "PackageManager", "SystemServer",
    "InputDispatcher", "SurfaceFlinger", "AudioFlinger", "PowerManagerService",
    "ConnectivityService", "NetworkController", "WifiService", "BluetoothAdapter",
    "LocationManagerService", "TelephonyManager", "StatusBarManagerService",
    "NotificationManagerService", "AlarmManagerService", "JobScheduler",
    "ContentResolver", "AccountManagerService", "DevicePolicyManager",
    "DisplayManagerService", "InputMethodManagerService", "AccessibilityManagerService",
    "AppOps", "BatteryService", "StorageManagerService", "UsageStatsService",
    "Watchdog", "Zygote", "art", "dalvikvm", "AndroidRuntime",
    "ServiceManager", "SystemUI", "Binder", "JavaBinder", "BinderProxy",
    "InputReader", "InputTransport", "Looper", "ActivityThread",
    "ActivityTaskManager", "WindowManagerService", "View", "ViewRootImpl",
    "Choreographer", "RenderThread", "hwui", "GC", "StrictMode",
]

# Tag prefixes and chip-maker names.
VENDOR_TAG = (
    r"(?i)^(vendor|hal_|hw_|sensor|gnss|nfc|bluetooth|thermal|power|display|camera|audio_hw|gps|modem|ril|radio|wifi_hal)"
    r"|qti|qcom|mtk|mediatek|sprd|samsung|nxp|exynos|hisilicon|kirin|unisoc"
)


def _clause(tag: Column, message: Column, tags, pattern: str) -> Column:
    if tags is None:
        return message.rlike(pattern)
    named = tag.isin(tags) if isinstance(tags, list) else tag.rlike(tags)
    return named & message.rlike(pattern)


def log_anomaly(tag: Column, message: Column) -> Column:
    """``struct(type, severity, summary)`` of the first rule that holds, else null."""
    rules = []
    for kind, severity, clauses, forms, fallback in LOG_RULES:
        when = F.lit(False)
        for tags, pattern in clauses:
            when = when | _clause(tag, message, tags, pattern)
        summary = summarise(message, forms, fallback)
        rules.append(
            Rule(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), summary.alias("summary")))
        )
    return first_match(rules)


def worth_checking(tag: Column, message: Column) -> Column:
    """Cheap test that every rule implies; drops nearly all lines before the rules run."""
    exact = sorted({t for _, _, clauses, _, _ in LOG_RULES for tags, _ in clauses if isinstance(tags, list) for t in tags})
    return tag.isin(exact) | tag.rlike(r"Binder|(?i:hwservicemanager)") | message.rlike(r"(?i)Input dispatching timed out")


def tag_class(tag: Column) -> Column:
    return F.when(tag.isin(FRAMEWORK_TAGS), "framework").when(tag.rlike(VENDOR_TAG), "vendor").otherwise("app")
