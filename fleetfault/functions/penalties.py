"""Fixed values and arithmetic of the health score; exact decimals throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sub-score -> counted type -> (points for the first one, most points in total).
PENALTIES = {
    "stability": {
        "system_server_crash": (30, 60), "fatal_exception": (10, 30), "native_crash": (15, 40), "watchdog": (25, 50),
        "hal_service_death": (10, 30), "kernel_panic": (40, 60), "watchdog_reset": (30, 50), "crash_dump": (15, 40),
    },
    "memory": {"oom": (20, 40), "oom_kill": (25, 50), "lowmemory_killer": (10, 30), "kswapd_active": (5, 20)},
    "responsiveness": {
        "anr": (20, 50), "input_dispatching_timeout": (20, 50), "binder_timeout": (10, 30), "slow_operation": (5, 20),
        "trace_idle": (2, 10), "trace_deadlock": (25, 50), "trace_other": (15, 40),
    },
    "kernel": {
        "kernel_panic": (40, 60), "thermal_shutdown": (30, 50), "watchdog_reset": (30, 50), "gpu_error": (15, 35),
        "driver_error": (10, 30), "thermal_throttling": (8, 25), "storage_io_error": (10, 30),
        "suspend_resume_error": (5, 20), "selinux_denial": (2, 15),
    },
}
WEIGHTS = {"stability": "0.30", "memory": "0.25", "responsiveness": "0.25", "kernel": "0.20"}


def damped(n: Column, base: Column, cap: Column) -> Column:
    """Points for ``n`` events: full, half, a quarter, then a tenth each, up to ``cap``."""
    tenths = F.when(n <= 0, 0).when(n == 1, 100).when(n == 2, 150).when(n == 3, 175).otherwise(175 + (n - 3) * 10)
    return F.least(cap.cast("decimal(20,2)"), (tenths * base).cast("decimal(20,2)") / 100).cast("decimal(20,2)")


def clamp(score: Column) -> Column:
    low, high = F.lit(0).cast("decimal(20,2)"), F.lit(100).cast("decimal(20,2)")
    return F.greatest(low, F.least(high, score.cast("decimal(20,2)")))


def overall(scores: dict[str, Column]) -> Column:
    total = None
    for name, weight in WEIGHTS.items():
        part = scores[name].cast("decimal(10,0)") * F.lit(weight).cast("decimal(4,2)")
        total = part if total is None else total + part
    return F.round(total, 0).cast("int")
