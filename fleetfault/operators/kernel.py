"""Kernel-log operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.functions.kernel_rules import kernel_event, worth_checking
from fleetfault.functions.text import computed_rows, with_fields

KEYS = ("report_id",)

# Fixed value: [<level>] [ seconds][optional T/C pid] message
LINE = r"^(?:<(\d+)>)?\s*\[\s*(\d+\.\d+)\](?:\[[\s\w]+\])?\s+(.*)[\s\S]*\z"


def parse_kernel(
    lines: DataFrame, keys: Sequence[str] = KEYS, order: str = "line_no", text: str = "raw"
) -> DataFrame:
    """Entries in line order (``entry_idx`` is the line number); other lines are dropped.  Row-local."""
    rows = lines.select(*keys, F.col(order).cast("long").alias("entry_idx"), F.col(text).alias("raw"))
    parsed = with_fields(rows, "raw", LINE, [1, 2, 3], "p").where("p is not null")
    level = F.col("p")[0]
    return parsed.select(
        *keys, "entry_idx",
        F.col("p")[1].cast("decimal(18,6)").alias("boot_s"),
        F.when(level == "", "").otherwise(F.concat(F.lit("<"), level, F.lit(">"))).alias("level"),
        F.col("p")[2].alias("message"), "raw",
    )


def detect_events(entries: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """At most one event per entry: the first rule that holds.  Row-local."""
    found = entries.where(worth_checking(F.col("message"))).select(
        "*", computed_rows(kernel_event(F.col("message"))).alias("k")
    )
    return found.select(*keys, "entry_idx", "k.*", "boot_s", "message", "raw")
