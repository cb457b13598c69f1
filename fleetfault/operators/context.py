"""Raw context for findings, and the text handed to a reviewing model.

Context is kept as rows ``insight_no, kind, ord, text``; kinds are ``log``,
``stack``, ``chain``, ``thread`` and ``temporal``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.functions.text import any_time_ms
from fleetfault.functions.wording import CATEGORY_TYPES
from fleetfault.operators.matching import containing_pairs
from fleetfault.operators.ordering import ordered_text, scan, top_rows, with_position
from fleetfault.operators.ranges import first_within
from fleetfault.session import materialize

KEYS = ("report_id",)
MAX_CHARS = 210_000  # fixed value: 60,000 tokens of 3.5 characters
# Rows kept per finding when over budget, in the order of cutting.
CUTS = [("temporal", 10), ("thread", 5), ("log", 10), ("chain", 3)]


def target_findings(insights: DataFrame) -> DataFrame:
    return insights.where("severity in ('critical', 'warning')").withColumn("_title", F.lower("title"))


def _phrases(types: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("type"), F.lit(t.replace("_", " ")).alias("words")) for t in types])


def _by_type(found: DataFrame, keys: Sequence[str], types: Sequence[str]) -> DataFrame:
    """Findings whose title names a type in plain words: ``insight_no, type``."""
    named = F.filter(_phrases(types), lambda p: F.col("_title").contains(p["words"]))
    return found.select(*keys, "insight_no", F.explode(named).alias("p")).select(*keys, "insight_no", "p.type")


def _by_summary(found: DataFrame, rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """First ``k`` rows whose summary holds the first thirty characters of the title."""
    heads = found.select(*keys, "insight_no", F.substring("_title", 1, 30).alias("_head"))
    low = rows.select(*keys, "entry_idx", F.lower("summary").alias("_low"))
    pairs = containing_pairs(low, heads, keys, "_low", "_head")
    firsts = top_rows(low, [*keys, "_low"], [F.col("entry_idx")], k, "_r").drop("_r")
    best = top_rows(pairs.join(firsts, [*keys, "_low"]), [*keys, "_head"], [F.col("entry_idx")], k, "_r")
    return heads.join(best, [*keys, "_head"]).select(*keys, "insight_no", "entry_idx")


def matching_anomalies(
    found: DataFrame, anomalies: DataFrame, types: Sequence[str], keys: Sequence[str] = KEYS, k: int = 3,
    match_missing_process: bool = True,
) -> DataFrame:
    """First ``k`` anomalies that fit each finding: ``insight_no, entry_idx, rank``.

    A title may name the type, hold the process name, or start like the summary.
    An anomaly without process fits every finding (``match_missing_process``).
    Findings that fit nothing take the anomalies of their category.
    """
    per_type = top_rows(anomalies.select(*keys, "type", "entry_idx"), [*keys, "type"], [F.col("entry_idx")], k, "_r")
    process = F.lower("process_name")
    named = anomalies.where("process_name is not null").select(*keys, process.alias("_process"), "entry_idx")
    per_process = top_rows(named, [*keys, "_process"], [F.col("entry_idx")], k, "_r")
    hits = _by_type(found, keys, types).join(per_type, [*keys, "type"]).select(*keys, "insight_no", "entry_idx")
    pairs = containing_pairs(found, named, keys, "_title", "_process")
    by_process = (
        top_rows(pairs.join(per_process.drop("_r"), [*keys, "_process"]), [*keys, "_title"], [F.col("entry_idx")], k * 4, "_r")
        .join(found.select(*keys, "_title", "insight_no"), [*keys, "_title"])
        .select(*keys, "insight_no", "entry_idx")
    )
    hits = hits.unionByName(by_process).unionByName(_by_summary(found, anomalies, keys, k))
    if match_missing_process:
        unnamed = anomalies.where("process_name is null").select(*keys, "entry_idx")
        few = top_rows(unnamed, keys, [F.col("entry_idx")], k, "_r").drop("_r")
        hits = hits.unionByName(found.select(*keys, "insight_no").join(few, list(keys)))
    fit = materialize(top_rows(hits.distinct(), [*keys, "insight_no"], [F.col("entry_idx")], k))

    groups = F.create_map(*[x for c, t in CATEGORY_TYPES.items() for x in (F.lit(c), F.array(*map(F.lit, t)))])
    spare = (
        found.join(fit.select(*keys, "insight_no").distinct(), [*keys, "insight_no"], "left_anti")
        .select(*keys, "insight_no", F.explode(F.try_element_at(groups, F.col("category"))).alias("type"))
        .join(per_type, [*keys, "type"])
        .select(*keys, "insight_no", "entry_idx")
    )
    return fit.unionByName(top_rows(spare, [*keys, "insight_no"], [F.col("entry_idx")], k))


def log_context(matches: DataFrame, anomaly_rows: DataFrame, keys: Sequence[str] = KEYS, k: int = 15) -> DataFrame:
    """``anomaly_rows``: numbered rows of ``anomaly_context``."""
    rows = anomaly_rows.where(F.col("ord") <= k).select(*keys, F.col("anomaly").alias("entry_idx"), "ord", "raw")
    return matches.join(rows, [*keys, "entry_idx"]).select(
        *keys, "insight_no", F.lit("log").alias("kind"), (F.col("rank") * 1000 + F.col("ord")).cast("long").alias("ord"),
        F.col("raw").alias("text"),
    )


def kernel_context(
    found: DataFrame, events: DataFrame, entries: DataFrame, types: Sequence[str], keys: Sequence[str] = KEYS,
    k: int = 3, radius_s: int = 5, around: int = 20,
) -> DataFrame:
    """Matching kernel events (else the first of equal severity) and entries within seconds of them."""
    kinds = top_rows(events.select(*keys, "type", "entry_idx"), [*keys, "type"], [F.col("entry_idx")], k, "_r")
    hits = (
        _by_type(found, keys, types).join(kinds, [*keys, "type"]).select(*keys, "insight_no", "entry_idx")
        .unionByName(_by_summary(found, events, keys, k)).distinct()
    )
    fit = materialize(top_rows(hits, [*keys, "insight_no"], [F.col("entry_idx")], k))
    levels = top_rows(events.select(*keys, "severity", "entry_idx"), [*keys, "severity"], [F.col("entry_idx")], k)
    spare = (
        found.join(fit.select(*keys, "insight_no").distinct(), [*keys, "insight_no"], "left_anti")
        .select(*keys, "insight_no", "severity")
        .join(levels, [*keys, "severity"])
        .select(*keys, "insight_no", "entry_idx", "rank")
    )
    micros = (F.col("boot_s") * 1_000_000).cast("long")
    told = events.select(*keys, "entry_idx", micros.alias("_at"), F.col("raw").alias("_own"))
    chosen = materialize(fit.unionByName(spare).join(told, [*keys, "entry_idx"]))
    near = first_within(
        chosen, entries.select(*keys, F.col("entry_idx").alias("_e"), "raw", micros.alias("_when")), keys,
        at="_at", when="_when", order="_e", radius=radius_s * 1_000_000, k=around,
    ).select(*keys, "_at", F.col("rank").alias("_near"), "raw")
    spot = (F.col("rank") * 1000).cast("long")
    own = chosen.select(*keys, "insight_no", (spot + 1_000_000).alias("ord"), F.col("_own").alias("text"))
    rest = chosen.join(near, [*keys, "_at"]).select(
        *keys, "insight_no", (spot + 1_000_000 + F.col("_near")).alias("ord"), F.col("raw").alias("text")
    )
    return own.unionByName(rest).withColumn("kind", F.lit("log"))


def distinct_lines(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each text once per finding, where it first stood."""
    return rows.groupBy(*keys, "insight_no", "kind", "text").agg(F.min("ord").alias("ord"))


def temporal_context(
    found: DataFrame, entries: DataFrame, keys: Sequence[str] = KEYS, radius_ms: int = 2000, k: int = 20
) -> DataFrame:
    """First warning, error and fatal entries within seconds of each critical finding."""
    at = found.where("severity = 'critical'").select(*keys, "insight_no", any_time_ms("ts_text").alias("_at"))
    at = at.where("_at is not null")
    loud = entries.where(F.col("level").isin("W", "E", "F")).select(*keys, "entry_idx", "ms", "raw")
    near = first_within(at, loud, keys, at="_at", when="ms", order="entry_idx", radius=radius_ms, k=k)
    return at.join(near, [*keys, "_at"]).select(
        *keys, "insight_no", F.lit("temporal").alias("kind"), F.col("rank").cast("long").alias("ord"),
        F.col("raw").alias("text"),
    )


def choose_trace(found: DataFrame, heads: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The trace each finding is about: named by process or ``pid N`` in the title, else the first."""
    words = F.array(F.lower("process_name"), F.concat(F.lit("pid "), F.col("pid").cast("string")))
    named = heads.select(*keys, "trace_id", "trace_idx", F.explode(words).alias("_word"))
    first = named.groupBy(*keys, "_word").agg(F.min_by(F.struct("trace_idx", "trace_id"), "trace_idx").alias("_t"))
    pairs = containing_pairs(found, named, keys, "_title", "_word").join(first, [*keys, "_word"])
    best = pairs.groupBy(*keys, "_title").agg(F.min("_t").alias("_t"))
    spare = heads.groupBy(*keys).agg(F.min(F.struct("trace_idx", "trace_id")).alias("_s"))
    return (
        found.join(best, [*keys, "_title"], "left")
        .join(spare, list(keys))
        .select(*keys, "insight_no", F.coalesce("_t.trace_id", "_s.trace_id").alias("trace_id"))
    )


def trace_context(
    chosen: DataFrame, primary: DataFrame, threads: DataFrame, frames: DataFrame, locks: DataFrame, chains: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Full stack of the primary thread, the threads it waits for, other stuck threads.

    ``primary``: one row per trace with ``thread_no, tid``.
    """
    trace = [*keys, "trace_id"]
    one = [*trace, "thread_no"]
    asked = chosen.select(*trace).distinct()
    main = primary.join(asked, trace, "left_semi").select(*trace, "thread_no", "tid")
    stack = frames.join(main, one, "left_semi").select(
        *trace, F.lit("stack").alias("kind"), F.col("frame_no").alias("ord"), F.col("raw").alias("text")
    )

    indent = F.concat(F.lit("    "), F.col("raw"))
    head = F.concat(F.lit('Thread "'), "name", F.lit('" tid='), F.col("tid").cast("string"), F.lit(" ("), "state", F.lit("):"))
    own = chains.join(main.select(*trace, F.col("tid").alias("start_tid")), [*trace, "start_tid"], "left_semi")
    links = own.select(*trace, "hop", "thread_no")
    known = threads.join(links.select(*one).distinct(), one, "left_semi")
    held = ordered_text(
        locks.join(known, one, "left_semi").withColumn("_l", F.concat("address", F.lit("("), "class_name", F.lit(")"))),
        one, "lock_no", "_l", "_held", ", ",
    )
    stacks = ordered_text(frames.join(known, one, "left_semi").withColumn("_f", indent), one, "frame_no", "_f", "_stack")
    holder = F.when(
        F.coalesce(F.col("wait_holder_tid"), F.lit(0)) != 0,
        F.concat(F.lit(" held by tid="), F.col("wait_holder_tid").cast("string")),
    ).otherwise("")
    waits = F.coalesce(
        F.concat(F.lit("  waiting on lock "), "wait_addr", F.lit(" ("), "wait_class", F.lit(")"), holder), F.lit("")
    )
    holds = F.coalesce(F.concat(F.lit("  holds locks: "), "_held"), F.lit(""))
    chain = (
        links.join(known, one).join(held, one, "left").join(stacks, one, "left")
        .select(*trace, F.lit("chain").alias("kind"), F.col("hop").alias("ord"),
                F.concat(head, waits, holds, F.lit("\n"), F.coalesce("_stack", F.lit(""))).alias("text"))
    )
    stuck = threads.where(F.col("state").isin("Blocked", "Native")).join(asked, trace, "left_semi")
    others = stuck.join(main.select(*trace, F.col("tid").alias("_tid")), trace, "left").where(
        "_tid is null or tid <> _tid"
    )
    few = top_rows(others, trace, [F.col("thread_no")], 10)
    tops = ordered_text(
        top_rows(frames.join(few, one, "left_semi"), one, [F.col("frame_no")], 5, "_r").withColumn("_f", indent),
        one, "frame_no", "_f", "_stack",
    )
    thread = few.join(tops, one, "left").select(
        *trace, F.lit("thread").alias("kind"), F.col("rank").cast("long").alias("ord"),
        F.concat(head, F.lit("\n"), F.coalesce("_stack", F.lit(""))).alias("text"),
    )
    parts = stack.unionByName(chain).unionByName(thread)
    return chosen.join(parts, trace).drop("trace_id")


def within_budget(
    parts: DataFrame, keys: Sequence[str] = KEYS, budget: int = MAX_CHARS, group: str = "insight_no",
    cuts: Sequence[tuple[str, int]] = CUTS,
) -> DataFrame:
    """Drop the tail of context lists, finding by finding, until a report fits.

    Each stage shortens one kind and walks the findings in order, stopping as
    soon as the rest fits.  The walk is a running sum: a finding is cut when
    what is saved before it still leaves the report over budget.
    """
    spot = _list_positions(parts, [*keys, group, "kind"])
    size = F.length("text")
    saved = [F.sum(F.when((F.col("kind") == k) & (F.col("_spot") > n), size).otherwise(0)).alias(f"_s{i}")
             for i, (k, n) in enumerate(cuts)]
    # A stack counts with the line breaks that join its frames.
    joined = size + F.when((F.col("kind") == "stack") & (F.col("_spot") > 1), 1).otherwise(0)
    each = spot.groupBy(*keys, group).agg(F.sum(joined).alias("_size"), *saved)
    sums = materialize(scan(each, keys, group, total={f"_p{i}": F.col(f"_s{i}") for i in range(len(cuts))}))

    def is_cut(i: int) -> Column:
        return F.col(f"_left{i}") - (F.col(f"_p{i}") - F.col(f"_s{i}")) > budget

    left = sums.groupBy(*keys).agg(F.sum("_size").alias("_left0"))
    for i in range(len(cuts)):
        gone = F.sum(F.when(is_cut(i), F.col(f"_s{i}")).otherwise(0))
        left = sums.join(left, list(keys)).groupBy(*keys).agg(
            *[F.max(f"_left{j}").alias(f"_left{j}") for j in range(i + 1)],
            (F.max(f"_left{i}") - gone).alias(f"_left{i + 1}"),
        )
    flagged = sums.join(left, list(keys))
    for i in range(len(cuts)):
        flagged = flagged.withColumn(f"_cut{i}", is_cut(i))
    dropped = F.lit(False)
    for i, (kind, keep) in enumerate(cuts):
        dropped = dropped | (F.col(f"_cut{i}") & (F.col("kind") == kind) & (F.col("_spot") > keep))
    flags = flagged.select(*keys, group, *[f"_cut{i}" for i in range(len(cuts))])
    return spot.join(flags, [*keys, group]).where(~dropped).select(*parts.columns)


def _list_positions(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Position of each context row in its list, however long.  Stacks and chains keep their
    own order, which is all a cut needs."""
    lists = parts.where("kind <> 'stack'").select("*", F.col("ord").alias("_o"))
    short = lists.where("kind <> 'chain'")
    ranked = with_position(short, by, [F.col("_o"), F.col("text")], "_spot").withColumn("_spot", (F.col("_spot") + 1).cast("int"))
    chained = lists.where("kind = 'chain'").withColumn("_spot", F.col("_o").cast("int"))
    stack = parts.where("kind = 'stack'")
    first = stack.groupBy(*by).agg(F.min("ord").alias("_o"))
    stacked = stack.join(first, list(by)).withColumn("_spot", F.when(F.col("ord") == F.col("_o"), 1).otherwise(2))
    return ranked.unionByName(chained).unionByName(stacked).drop("_o")


def hal_cross_reference(
    heads: DataFrame, primary: DataFrame, targets: DataFrame, suspects: DataFrame, families: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Each package that traces point at, with the state of its HAL family."""
    trace = [*keys, "trace_id"]
    order = heads.select(*trace, "trace_idx")
    direct = (
        targets.where("interface_name <> 'Unknown'").join(primary.select(*trace, "thread_no"), [*trace, "thread_no"], "left_semi")
        .join(order, trace).select(*keys, "trace_idx", F.lit(-1).cast("long").alias("o"), "package_name", "interface_name")
    )
    other = (
        suspects.join(primary.select(*trace, "role"), [*trace, "role"], "left_semi")
        .join(order, trace).select(*keys, "trace_idx", F.col("thread_no").alias("o"), "package_name", "interface_name")
    )
    seen = direct.unionByName(other).groupBy(*keys, "package_name").agg(
        F.min(F.struct("trace_idx", "o", "interface_name")).alias("_t")
    )
    return match_families(seen.select(*keys, "package_name", "_t.*"), families, keys)


def match_families(targets: DataFrame, families: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Joins targets to the first family of the same unversioned name."""
    name = F.lower(F.regexp_replace("package_name", r"@[\d.]+.*\z", ""))
    space = F.lower(F.regexp_replace(F.element_at(F.split("family", "::"), 1), r"^(.*?)@[\d.]+", "$1"))
    told = ["highest_status", "highest_version", "version_count", "is_oem"]
    first = families.groupBy(*keys, space.alias("_name")).agg(F.min_by(F.struct(*told), "first_seen").alias("_f"))
    return (
        targets.withColumn("_name", name).join(first, [*keys, "_name"], "left").drop("_name").select("*", "_f.*").drop("_f")
        .withColumn("text", F.concat(
            F.lit("- "), "interface_name", F.lit(" ("), "package_name", F.lit(") → "),
            F.coalesce(
                F.concat("highest_status", F.lit(", highest="), "highest_version", F.lit(", "),
                         F.col("version_count").cast("string"), F.lit(" version(s)"),
                         F.when(F.col("is_oem"), " [OEM]").otherwise("")),
                F.lit("status unknown (not found in lshal)"))))
    )


# Review text ---------------------------------------------------------------------------


def _part(df: DataFrame, keys: Sequence[str], section: int, order: Sequence[Column], text: Column) -> DataFrame:
    spots = [*order, F.lit(0), F.lit(0), F.lit(0)][:3]
    return df.select(
        *keys, F.lit(section).alias("section"), *[s.cast("long").alias(f"p{i}") for i, s in enumerate(spots)],
        text.alias("text"),
    )


def _titled(rows: DataFrame, keys: Sequence[str], section: int, title: str | Column) -> DataFrame:
    """A heading before the section, for reports that have rows in it."""
    heading = F.lit(title) if isinstance(title, str) else title
    return rows.unionByName(
        _part(rows.select(*keys).distinct(), keys, section, [F.lit(-1)], heading)
    )


# Headings of context lists inside a finding, with their order and indent.
CONTEXT_HEADS = [
    ("log", "Source anomaly logs:", "  "), ("stack", "Full stack trace (blocked thread):", ""),
    ("chain", "Blocking chain stacks:", ""), ("thread", "Relevant threads (Blocked/Native state):", ""),
    ("temporal", "Temporal context (W/E/F within ±2s):", "  "),
]


def review_parts(
    meta: DataFrame, health: DataFrame, insights: DataFrame, timeline: DataFrame, trace_texts: DataFrame,
    hal_summary: DataFrame, families: DataFrame, cross: DataFrame, context: DataFrame, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The review text as ordered rows (``section, p0, p1, p2, text``), never one string per report."""
    s = lambda c: F.col(c).cast("string")
    n_insights = insights.groupBy(*keys).agg(F.count(F.lit(1)).alias("_insights"))
    shown = top_rows(timeline, keys, [F.col("seq")], 50)
    n_events = shown.groupBy(*keys).agg(F.count(F.lit(1)).alias("_events"))
    base = meta.join(health, list(keys)).join(n_insights, list(keys), "left").join(n_events, list(keys), "left")
    base = base.fillna(0, ["_insights", "_events"])
    head = F.concat(
        F.lit("## Device Info\nModel: "), "device_model", F.lit(" ("), "manufacturer", F.lit(")\nAndroid: "),
        "android_version", F.lit(" (SDK "), s("sdk_level"), F.lit(")\nBuild: "), "build_fingerprint",
        F.lit("\n\n## Health Score: "), s("overall"), F.lit("/100\n- Stability: "), s("stability"),
        F.lit("\n- Memory: "), s("memory"), F.lit("\n- Responsiveness: "), s("responsiveness"),
        F.lit("\n- Kernel: "), s("kernel"),
    )
    parts = _part(base, keys, 0, [], head)
    parts = parts.unionByName(_part(base, keys, 1, [F.lit(-1)], F.concat(F.lit("\n## Insights ("), s("_insights"), F.lit(" total)"))))
    parts = parts.unionByName(_part(insights, keys, 1, [F.col("insight_no")], F.concat(
        F.lit("- ["), F.upper("severity"), F.lit("] ["), "source", F.lit("] "), "insight_id", F.lit(": "), "title")))
    parts = parts.unionByName(_part(base, keys, 2, [F.lit(-1)], F.concat(F.lit("\n## Timeline ("), s("_events"), F.lit(" events)"))))
    parts = parts.unionByName(_part(shown, keys, 2, [F.col("seq")], F.concat(
        F.lit("["), "ts_text", F.lit("] ["), "source", F.lit("] "), "label")))
    parts = parts.unionByName(_titled(
        _part(trace_texts, keys, 3, [F.col("trace_idx")], F.col("text")), keys, 3, "\n## ANR Trace Analysis"))

    bad = F.col("highest_status").isin("non-responsive", "declared")
    counts = families.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("highest_status") == "alive").alias("_alive"),
        F.count_if(F.col("is_vendor") & bad).alias("_issues"),
        F.count_if(F.col("is_vendor") & ~F.col("is_oem") & bad).alias("_chip"),
    )
    hal = counts.join(hal_summary.select(*keys, "truncated"), list(keys))
    cut = F.when(F.col("truncated"), "⚠ lshal output was truncated — data may be incomplete\n").otherwise("")
    parts = parts.unionByName(_part(hal, keys, 4, [], F.concat(
        F.lit("\n## HAL Status (from lshal)\n"), cut, F.lit("Families: "), s("_alive"), F.lit(" alive / "), s("_all"),
        F.lit(" total ("), s("_issues"), F.lit(" vendor issues)"))))
    parts = parts.unionByName(_titled(
        _part(cross.join(hal.select(*keys), list(keys), "left_semi"), keys, 5, [F.col("trace_idx"), F.col("o")], F.col("text")),
        keys, 5, "\n### ANR Binder Target → HAL Cross-Reference"))
    line = F.concat(F.lit("- "), "short_name", F.lit("@"), "highest_version", F.lit(" → "), "highest_status")
    parts = parts.unionByName(_titled(
        _part(families.where(F.col("is_oem") & bad), keys, 6, [F.col("first_seen")], line), keys, 6,
        "\n### Vendor HAL Issues (OEM)"))
    chip = top_rows(families.where(F.col("is_vendor") & ~F.col("is_oem") & bad), keys, [F.col("first_seen")], 10)
    parts = parts.unionByName(_part(hal.where("_chip > 0"), keys, 7, [F.lit(-1)], F.concat(
        F.lit("\n### Vendor HAL Issues (BSP, "), s("_chip"), F.lit(")"))))
    parts = parts.unionByName(_part(chip, keys, 7, [F.col("rank")], line))
    parts = parts.unionByName(_part(hal.where("_chip > 10"), keys, 7, [F.lit(99)], F.concat(
        F.lit("...and "), (F.col("_chip") - 10).cast("string"), F.lit(" more"))))

    asked = target_findings(insights)
    parts = parts.unionByName(_titled(
        _part(asked, keys, 8, [F.col("insight_no")], F.concat(F.lit("\n### "), "insight_id", F.lit(": "), "title")),
        keys, 8, "\n## Detailed Context Per Insight"))
    for i, (kind, heading, indent) in enumerate(CONTEXT_HEADS):
        mine = context.where(F.col("kind") == kind)
        heads = mine.select(*keys, "insight_no").distinct()
        parts = parts.unionByName(_part(heads, keys, 8, [F.col("insight_no"), F.lit(2 * i + 1)], F.lit(heading)))
        parts = parts.unionByName(
            _part(mine, keys, 8, [F.col("insight_no"), F.lit(2 * i + 2), F.col("ord")], F.concat(F.lit(indent), "text"))
        )
    return parts


def review_text(parts: DataFrame, keys: Sequence[str] = KEYS, instructions: str = "", problem: str | None = None) -> DataFrame:
    """One text per report, for callers that need it whole; pieces are joined in two steps."""
    order = [F.col(c) for c in ("section", "p0", "p1", "p2", "text")]
    whole = ordered_text(with_position(parts, keys, order), keys, "pos", "text", "review")
    tail = (f"\n\n## User's Problem Description\n{problem}" if problem else "") + (f"\n\n{instructions}" if instructions else "")
    return whole.withColumn("review", F.concat("review", F.lit(tail)))


def trace_summaries(
    heads: DataFrame, primary: DataFrame, targets: DataFrame, suspects: DataFrame, chains: DataFrame, cycles: DataFrame,
    pool: DataFrame, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """A short text per trace with a primary thread (``primary`` has reason and confidence)."""
    trace = [*keys, "trace_id"]
    own = chains.join(primary.select(*trace, F.col("tid").alias("start_tid")), [*trace, "start_tid"], "left_semi")
    chain = ordered_text(own, trace, "hop", "name", "_chain", " → ")
    call = F.concat("interface_name", F.lit("."), "method", F.lit('() on "'), "thread_name", F.lit('"'))
    mine = suspects.join(primary.select(*trace, "role"), [*trace, "role"], "left_semi").withColumn("_c", call)
    listed = ordered_text(mine, trace, "thread_no", "_c", "_suspects", ", ")
    dead = cycles.select(*trace).distinct().withColumn("_dead", F.lit(True))
    rows = heads.join(primary.select(*trace, "thread_no", "reason", "confidence"), trace)
    rows = rows.join(targets, [*trace, "thread_no"], "left").join(chain, trace, "left").join(listed, trace, "left")
    rows = rows.join(dead, trace, "left").join(pool.select(*trace, "busy", "total"), trace, "left")
    thread = F.coalesce("blocked_thread_name", F.lit("main"))
    method = F.when(F.col("method") != "", F.concat(F.lit("."), "method", F.lit("()"))).otherwise("")
    hit = (F.col("interface_name") != "Unknown") & (F.col("reason") == "slow_binder_call")
    text = F.concat(
        F.lit("Process: "), "process_name", F.lit(" (PID "), F.col("pid").cast("string"), F.lit(")"),
        F.coalesce(F.concat(F.lit("\n  Subject: "), F.nullif("subject", F.lit(""))), F.lit("")),
        F.lit('\n  Blocked Thread: "'), thread, F.lit('" — '), "reason", F.lit(" ("), "confidence", F.lit(")"),
        F.lit("\n  Blocking Chain: "), thread, F.lit(" → "), F.coalesce("_chain", F.lit("none")),
        F.coalesce(F.when(hit, F.concat(F.lit("\n  Binder Target: "), "interface_name", method, F.lit(" ("), "package_name", F.lit(")"))), F.lit("")),
        F.coalesce(F.concat(F.lit("\n  Suspected HAL targets: "), "_suspects"), F.lit("")),
        F.lit("\n  Binder Threads: "), F.coalesce("busy", F.lit(0)).cast("string"), F.lit("/"),
        F.coalesce("total", F.lit(0)).cast("string"), F.lit(" busy\n  Deadlock: "),
        F.when(F.col("_dead"), "YES").otherwise("no"),
    )
    return rows.select(*keys, "trace_idx", text.alias("text"))
