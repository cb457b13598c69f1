"""Small text and time expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def capture(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A regex group, null when the pattern or the group does not take part."""
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def computed(value: Column) -> Column:
    """Evaluate ``value`` once per row.  Without this the optimizer copies a long CASE
    into every place that reads one of its fields; a generator is never copied."""
    return F.explode(F.array(value))


def computed_rows(value: Column) -> Column:
    """As ``computed``, and rows where ``value`` is null vanish."""
    return F.explode(F.array_compact(F.array(value)))


def with_fields(df: DataFrame, text: Column | str, pattern: str, groups: list[int], out: str) -> DataFrame:
    """Adds several groups of one pattern as an array, matching each text only once.

    ``pattern`` must cover the whole text.  Null when it does not match.  The groups are
    parted by a control character; a text that holds it takes one match per group instead.
    """
    text, mark = col(text), "\u0001"
    reply = mark + mark + mark.join(f"${g}" for g in groups)
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(reply)), mark, -1)
    marked = F.when(text.rlike(pattern), F.array(F.lit(""), F.lit(""), *[F.regexp_extract(text, pattern, g) for g in groups]))
    split = df.select("*", computed(F.when(text.contains(mark), marked).otherwise(parts)).alias("_parts"))
    p = F.col("_parts")
    return split.withColumn(out, F.when(F.size(p) == len(groups) + 2, F.slice(p, 3, len(groups)))).drop("_parts")


def trimmed(text: Column | str) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.regexp_replace(col(text), r"^\s+|\s+\z", "")


def whole(text: Column) -> Column:
    return text.try_cast("bigint")


def fill(template: str, *values: Column) -> Column:
    """``"a {} b {}"`` with columns; null when a value is null."""
    pieces: list[Column] = []
    for i, part in enumerate(template.split("{}")):
        if i:
            pieces.append(values[i - 1].cast("string"))
        if part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def yearless_ms(month: Column, day: Column, hour: Column, minute: Column, second: Column, milli: Column) -> Column:
    """Milliseconds of a date without year, set in 2000; overflowing parts roll over."""
    days = F.unix_date(F.add_months(F.lit("2000-01-01").cast("date"), month.cast("int") - 1)) + day.cast("int") - 1
    clock = (hour.cast("long") * 60 + minute.cast("long")) * 60 + second.cast("long")
    return days.cast("long") * DAY_MS + clock * 1000 + milli.cast("long")


def log_time_ms(ts: Column | str) -> Column:
    """For texts already known to read ``MM-DD HH:mm:ss.SSS``."""
    ts = col(ts)
    tail = F.right(ts, F.lit(12))
    return yearless_ms(
        F.substring(ts, 1, 2), F.substring(ts, 4, 2),
        F.substring(tail, 1, 2), F.substring(tail, 4, 2), F.substring(tail, 7, 2), F.substring(tail, 10, 3),
    )


def any_time_ms(ts: Column | str) -> Column:
    """The first ``MM-DD HH:mm:ss.SSS`` inside a text, else null."""
    ts = col(ts)
    found = F.regexp_extract(ts, r"\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}", 0)
    return F.when(found != "", log_time_ms(found))


def wall_text(ms: Column) -> Column:
    """Epoch milliseconds as ``MM-dd HH:mm:ss.SSS``, UTC whatever the session zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("MILLISECOND", ms.cast("long"), start), "MM-dd HH:mm:ss.SSS")


def display_time(ts: Column | str) -> Column:
    """``YYYY-MM-DD HH:mm:ss.fraction`` shortened to ``MM-DD HH:mm:ss.SSS``; other texts unchanged."""
    ts = col(ts)
    pattern = r"^\d{4}-(\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})(?:\.(\d+))?"
    milli = F.rpad(F.substring(F.regexp_extract(ts, pattern, 3), 1, 3), 3, "0")
    short = F.concat(F.regexp_extract(ts, pattern, 1), F.lit(" "), F.regexp_extract(ts, pattern, 2), F.lit("."), milli)
    return F.when(ts.rlike(pattern), short).otherwise(ts)


def fixed(number: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, rounded from its exact binary value, true ties upwards."""
    tie = (number * 2 ** (digits + 1)) % 2 == 1
    nudged = F.when(tie, number + 10.0 ** -(digits + 1)).otherwise(number)
    return F.regexp_replace(F.format_number(nudged, digits), ",", "")


def boot_text(boot_s: Column) -> Column:
    """Seconds since boot as ``boot+1.234s``."""
    return F.concat(F.lit("boot+"), fixed(boot_s.cast("double"), 3), F.lit("s"))


def exact_words(text: Column, words: list[str]) -> Column:
    """True when any of the words occurs."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found
