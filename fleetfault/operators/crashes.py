"""Native-crash dump operators: ``report_id, file, line_no, raw`` lines in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.functions.text import capture, trimmed, whole
from fleetfault.operators.ordering import scan

KEYS = ("report_id", "file")

# Line formats and signal names.
FINGERPRINT = r"^Build fingerprint:\s*'(.+)'"
ABI = r"^ABI:\s*'(\w+)'"
TIMESTAMP = r"^Timestamp:\s*(.+)"
PROCESS = r"^pid:\s*(\d+),\s*tid:\s*(\d+),\s*name:\s*(\S+)\s*>>>\s*(.+?)\s*<<<"
SIGNAL = (
    r"^signal\s+(\d+)\s*\((\w+)\),\s*code\s+[-\d]+\s*\(([^)]*)\)"
    r"(?:,\s*fault addr\s+(0x[0-9a-fA-F]+|0x0+))?"
)
ABORT = r"^Abort message:\s*'(.+)'"
FRAME = (
    r"^\s*#(\d+)\s+pc\s+([0-9a-fA-F]+)\s+(\S+)(?:\s+\(([^)]+)\))?(?:\s+\(BuildId:\s*([0-9a-fA-F]+)\))?"
)
REGISTER_LINE = r"^\s+((?:[xr]\d+|[a-z]{2,3})\s+[0-9a-fA-F]+(?:\s+(?:[xr]\d+|[a-z]{2,3})\s+[0-9a-fA-F]+)*)\s*\z"
REGISTER_PAIR = r"([xr]\d+|[a-z]{2,3})\s+([0-9a-fA-F]+)"
REGISTER_QUICK = r"^\s+(?:[xr]\d+|lr|sp|pc|pst)\s+[0-9a-fA-F]{8,}"
SIGNALS = {4: "SIGILL", 5: "SIGTRAP", 6: "SIGABRT", 7: "SIGBUS", 8: "SIGFPE", 11: "SIGSEGV"}


def usable_dumps(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lines of text dumps; protobuf files are left out."""
    return lines.where(~F.col(keys[-1]).endswith(".pb"))


def crash_frames(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Backtrace rows, accepted anywhere in the file.  Row-local."""
    raw = F.col("raw")
    func = capture(raw, FRAME, 4)
    split = r"^(.+)\+(\d+)\z"
    return lines.where(raw.rlike(FRAME)).select(
        *keys, "line_no",
        whole(capture(raw, FRAME, 1)).alias("frame_number"),
        capture(raw, FRAME, 2).alias("pc"),
        capture(raw, FRAME, 3).alias("binary"),
        F.coalesce(capture(func, split), func).alias("function"),
        whole(capture(func, split, 2)).alias("offset"),
        capture(raw, FRAME, 5).alias("build_id"),
        trimmed(raw).alias("raw"),
    )


def registers(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``register, value`` rows; the last value of a register wins.

    A register line counts inside a register section, or anywhere outside a
    backtrace when it looks plain enough.  Sections end at a blank or title line
    once they hold something.  What a line needs to know is the last place of
    each kind of border before it, carried in one scan.
    """
    raw, line = F.col("raw"), F.col("line_no")
    text = trimmed(raw)
    trace_at, regs_at = text == "backtrace:", text.rlike(r"(?i)^registers?:")
    border = ((text == "") | (text.endswith(":") & ~text.startswith("#"))) & ~trace_at & ~regs_at
    kind = (
        F.when(trace_at, "trace").when(regs_at, "regs").when(raw.rlike(FRAME), "frame").when(border, "border")
        .when(raw.rlike(REGISTER_LINE), "values")
    )
    marked = lines.select(*keys, "line_no", "raw").withColumn("kind", kind).where("kind is not null")
    last = {f"l_{k}": F.when(F.col("kind") == k, line) for k in ("trace", "regs", "frame", "border")}
    seen = scan(marked, keys, "line_no", last=last).where("kind = 'values'").fillna(-1, list(last))
    first_frame = marked.where("kind = 'frame'").groupBy(*keys).agg(F.min("line_no").alias("first_frame"))
    seen = seen.join(first_frame, list(keys), "left")

    opened = F.greatest("l_trace", "l_frame")
    ended = F.col("first_frame").isNotNull() & (F.col("l_border") > F.greatest(opened, F.col("first_frame")))
    in_trace = (opened >= 0) & (F.col("l_regs") < opened) & ~ended
    plain = ~in_trace & raw.rlike(REGISTER_QUICK)
    asked = F.col("l_regs") > F.col("l_trace")
    seen = seen.withColumn("_plain", plain).withColumn("_asked", asked)
    # Borders end a register section only after the first register was read.
    first_value = seen.where("_plain or _asked").groupBy(*keys).agg(F.min("line_no").alias("first_value"))
    inside = F.col("_asked") & ~(F.col("l_border") > F.greatest("l_regs", "first_value"))
    taken = seen.join(first_value, list(keys)).where(F.col("_plain") | inside)

    body = F.regexp_extract(raw, REGISTER_LINE, 1)
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(REGISTER_PAIR), F.lit(1)).alias("register"),
        F.regexp_extract_all(body, F.lit(REGISTER_PAIR), F.lit(2)).alias("value"),
    )
    return (
        taken.select(*keys, "line_no", F.posexplode(pairs))
        .groupBy(*keys, F.col("col.register").alias("register"))
        .agg(F.max_by("col.value", F.struct("line_no", "pos")).alias("value"))
    )


def _summary(process: Column, name: Column, code: Column, binary: Column, abort: Column) -> Column:
    short = F.when(F.length(abort) > 80, F.concat(F.substring(abort, 1, 80), F.lit("..."))).otherwise(abort)
    base = F.coalesce(F.regexp_extract(binary, r"([^/]*)\z", 1), F.lit("unknown"))
    cause = F.coalesce(F.concat(F.lit(" ("), code, F.lit(")")), F.lit(""))
    return F.when(
        (name == "SIGABRT") & abort.isNotNull(), F.concat(F.lit("Native crash (SIGABRT) in "), process, F.lit(": "), short)
    ).otherwise(F.concat(F.lit("Native crash ("), name, cause, F.lit(") in "), process, F.lit(" at "), base))


def crash_dumps(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per dump that shows a signal or a frame."""
    raw = F.col("raw")

    def first(pattern: str, value: Column) -> Column:
        return F.min_by(value, F.when(raw.rlike(pattern), F.col("line_no")))

    facts = lines.groupBy(*keys).agg(
        first(FINGERPRINT, capture(raw, FINGERPRINT)).alias("build_fingerprint"),
        first(ABI, capture(raw, ABI)).alias("abi"),
        first(TIMESTAMP, trimmed(capture(raw, TIMESTAMP))).alias("ts_text"),
        first(PROCESS, F.struct(*[capture(raw, PROCESS, i).alias(f"g{i}") for i in range(1, 5)])).alias("p"),
        first(SIGNAL, F.struct(*[capture(raw, SIGNAL, i).alias(f"g{i}") for i in range(1, 5)])).alias("s"),
        first(ABORT, capture(raw, ABORT)).alias("abort_message"),
        first(FRAME, capture(raw, FRAME, 3)).alias("crashed_in_binary"),
    )
    number = F.coalesce(whole(F.col("s.g1")), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in SIGNALS.items() for x in pair])
    name = F.when(F.col("s.g2").isin(list(SIGNALS.values())), F.col("s.g2")).otherwise(
        F.coalesce(F.try_element_at(known, number.cast("int")), F.lit("UNKNOWN"))
    )
    rows = facts.select(
        *keys,
        F.coalesce(whole(F.col("p.g1")), F.lit(0)).alias("pid"),
        F.coalesce(whole(F.col("p.g2")), F.lit(0)).alias("tid"),
        F.coalesce("p.g4", F.lit("unknown")).alias("process_name"),
        F.col("p.g3").alias("thread_name"),
        number.alias("signal"), name.alias("signal_name"), F.col("s.g3").alias("signal_code"),
        F.col("s.g4").alias("fault_addr"), "abi", "build_fingerprint", "ts_text", "abort_message",
        "crashed_in_binary",
        F.coalesce(F.col("crashed_in_binary").rlike(r"^/(vendor|odm)/"), F.lit(False)).alias("is_vendor_crash"),
    ).where("signal > 0 or crashed_in_binary is not null")
    return rows.withColumn(
        "summary",
        _summary(*[F.col(c) for c in ("process_name", "signal_name", "signal_code", "crashed_in_binary", "abort_message")]),
    )


def dump_counts(lines: DataFrame, crashes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per report: files met and files that could be read."""
    files = lines.select(*keys).distinct().groupBy(*keys[:-1]).agg(F.count(F.lit(1)).alias("total_files"))
    read = crashes.groupBy(*keys[:-1]).agg(F.count(F.lit(1)).alias("parsed_files"))
    return files.join(read, list(keys[:-1]), "left").fillna(0, ["parsed_files"])


def unreadable_dumps(lines: DataFrame, crashes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return lines.select(*keys).distinct().join(crashes.select(*keys), list(keys), "left_anti")
