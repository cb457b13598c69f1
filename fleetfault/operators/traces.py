"""Thread-dump operators.

Input is one row per line: ``report_id, trace_id, line_no, raw``.  A thread is
named by the line number of its header (``thread_no``) and a frame by its own
line number (``frame_no``); both order as in the file and need no ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfault.functions import reasons
from fleetfault.functions.text import capture, exact_words, trimmed, whole
from fleetfault.operators import graph
from fleetfault.operators.ordering import ordered_text, scan, top_rows

KEYS = ("report_id", "trace_id")

# Line formats.
JAVA_HEAD = r"^\"(.+?)\"\s+(?:(daemon)\s+)?prio=(\d+)\s+tid=(\d+)\s+(\w+)"
NATIVE_HEAD = r"^\"(.+?)\"\s+sysTid=(\d+)"
WAITS = r"- waiting to lock <(0x[\da-fA-F]+)>\s+\(a (.+?)\)\s+held by thread (\d+)"
HOLDS = r"- locked <(0x[\da-fA-F]+)>\s+\(a (.+?)\)"
JAVA_FRAME = r"at\s+([\w$.<>]+)\.([\w$<>]+)\((.+?)(?::(\d+))?\)"
NATIVE_FRAME = r"(?:native:\s+)?#\d+\s+pc\s+"
OAT_FRAME = r"\.oat\s+\((\S+?)\.(\w+)[+)]"
PROCESS_HEAD = r"^----- (?:(?:Waiting Channels: )?pid|dumping pid:)\s+(\d+)\s+at\s+(.+?)(?:\s*-----)?\z"
CRITICAL_PID = r"^\s+pid:\s+(\d+)"
COMMAND = r"^Cmd line:\s+(.+)"
SUBJECT = r"^Subject:\s+(.+)"
SUBJECT_THREAD = r"thread\s+\(([^)]+)\)"


def trace_heads(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per trace: process, time and subject, read up to the first command line."""
    raw = F.col("raw")
    every = lines.groupBy(*keys).agg(F.min(F.when(raw.rlike(COMMAND), F.col("line_no"))).alias("_stop"))
    told = lines.where(raw.rlike(r"^(-----|Cmd line:|Subject:|\s+pid:)")).select(*keys, "line_no", "raw")
    subject = trimmed(capture(raw, SUBJECT))
    named = capture(subject, SUBJECT_THREAD)
    pid = whole(capture(raw, PROCESS_HEAD))
    spare = whole(capture(raw, CRITICAL_PID))

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))

    facts = (
        told.join(every, list(keys))
        .where(F.col("_stop").isNull() | (F.col("line_no") <= F.col("_stop")))
        .groupBy(*keys)
        .agg(
            last(pid).alias("_pid"),
            F.min_by(spare, F.when(spare > 0, F.col("line_no"))).alias("_spare"),
            last(F.when(pid.isNotNull(), F.regexp_extract(raw, PROCESS_HEAD, 2))).alias("ts_text"),
            last(subject).alias("subject"),
            last(named).alias("blocked_thread_name"),
            last(trimmed(capture(raw, COMMAND))).alias("_process"),
        )
    )
    return every.join(facts, list(keys), "left").select(
        *keys,
        F.coalesce(F.nullif("_pid", F.lit(0)), "_spare", F.lit(0)).alias("pid"),
        F.coalesce("_process", F.lit("unknown")).alias("process_name"),
        "ts_text", "subject", "blocked_thread_name",
    )


def thread_lines(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lines from the first thread header on, each with the ``thread_no`` it belongs to."""
    raw = F.col("raw")
    head = raw.rlike(JAVA_HEAD) | raw.rlike(NATIVE_HEAD)
    marked = lines.select(*keys, "line_no", "raw").withColumn("is_head", head)
    owned = scan(marked, keys, "line_no", last={"thread_no": F.when(F.col("is_head"), F.col("line_no"))})
    return owned.where("thread_no is not null")


def threads(owned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per thread, from ``thread_lines``."""
    raw, body = F.col("raw"), ~F.col("is_head")
    java = F.col("is_head") & raw.rlike(JAVA_HEAD)

    def head(value: Column) -> Column:
        return F.max(F.when(F.col("is_head"), value))

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(body & value.isNotNull(), F.col("line_no")))

    native_tid = whole(capture(raw, NATIVE_HEAD, 2))
    state = capture(raw, JAVA_HEAD, 5)
    waiting = F.when(
        raw.contains("- waiting to lock"),
        F.when(
            raw.rlike(WAITS),
            F.struct(
                capture(raw, WAITS, 1).alias("address"),
                capture(raw, WAITS, 2).alias("class_name"),
                whole(capture(raw, WAITS, 3)).alias("holder_tid"),
            ),
        ),
    )
    told = owned.where(F.col("is_head") | raw.contains("sysTid=") | raw.contains("- waiting to lock"))
    return (
        told.groupBy(*keys, "thread_no")
        .agg(
            head(F.when(java, capture(raw, JAVA_HEAD, 1)).otherwise(capture(raw, NATIVE_HEAD, 1))).alias("name"),
            head(java & (F.regexp_extract(raw, JAVA_HEAD, 2) == "daemon")).alias("daemon"),
            head(F.when(java, whole(capture(raw, JAVA_HEAD, 3))).otherwise(0)).alias("priority"),
            head(F.when(java, whole(capture(raw, JAVA_HEAD, 4))).otherwise(native_tid)).alias("tid"),
            head(
                F.when(java, F.when(state.isin(reasons.THREAD_STATES), state).otherwise("Unknown")).otherwise("Native")
            ).alias("state"),
            F.coalesce(last(whole(capture(raw, r"sysTid=(\d+)"))), head(F.when(~java, native_tid))).alias("sys_tid"),
            last(waiting).alias("_w"),
        )
        .select(
            *keys, "thread_no", "name", "daemon", "priority", "tid", "state", "sys_tid",
            F.col("_w.address").alias("wait_addr"),
            F.col("_w.class_name").alias("wait_class"),
            F.col("_w.holder_tid").alias("wait_holder_tid"),
        )
    )


def thread_text(owned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All lines of a thread as one text, as they stand in the file."""
    return ordered_text(owned, [*keys, "thread_no"], "line_no", "raw", "raw")


def frames(owned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Stack frames; a native frame inside an ``.oat`` file counts as Java.  Row-local."""
    raw = F.col("raw")
    java = raw.rlike(JAVA_FRAME)
    oat = ~java & raw.rlike(OAT_FRAME)
    line = whole(capture(raw, JAVA_FRAME, 4))
    return owned.where(~F.col("is_head") & (java | raw.rlike(NATIVE_FRAME))).select(
        *keys, "thread_no", F.col("line_no").alias("frame_no"),
        F.when(java, F.regexp_extract(raw, JAVA_FRAME, 1)).when(oat, F.regexp_extract(raw, OAT_FRAME, 1)).otherwise("").alias("class_name"),
        F.when(java, F.regexp_extract(raw, JAVA_FRAME, 2)).when(oat, F.regexp_extract(raw, OAT_FRAME, 2)).otherwise("").alias("method_name"),
        F.when(java, F.regexp_extract(raw, JAVA_FRAME, 3)).otherwise(trimmed(raw)).alias("file_name"),
        F.when(java, F.coalesce(line, F.lit(-1))).otherwise(-1).alias("line_number"),
        (~java & ~oat).alias("is_native"),
        trimmed(raw).alias("raw"),
    )


def held_locks(owned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Locks a thread holds, in line order (``lock_no``).  Row-local."""
    raw = F.col("raw")
    return owned.where(~F.col("is_head") & raw.contains("- locked") & raw.rlike(HOLDS)).select(
        *keys, "thread_no", F.col("line_no").alias("lock_no"),
        capture(raw, HOLDS, 1).alias("address"), capture(raw, HOLDS, 2).alias("class_name"),
    )


# Wait-for graph -------------------------------------------------------------


def first_by_tid(th: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Look-ups by tid take the first thread of a dump that pools several processes."""
    return th.groupBy(*keys, "tid").agg(
        F.min_by(F.struct("thread_no", "name", "state", "wait_holder_tid"), "thread_no").alias("_t")
    ).select(*keys, "tid", "_t.*")


def lock_edges(th: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return th.where("wait_holder_tid is not null").select(
        *keys, "thread_no", F.col("tid").alias("from_tid"), F.col("wait_holder_tid").alias("to_tid"),
        F.col("wait_addr").alias("address"), F.col("wait_class").alias("class_name"),
    )


def lock_nodes(th: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Threads on either end of a wait, with ``rank`` = order of first mention."""
    edges = lock_edges(th, keys)
    waiting = th.where("wait_holder_tid is not null").select(
        *keys, "tid", (F.col("thread_no") * 2).alias("rank"), F.col("name").alias("_own")
    )
    held = edges.select(*keys, F.col("to_tid").alias("tid"), (F.col("thread_no") * 2 + 1).alias("rank"), F.lit(None).cast("string").alias("_own"))
    mentioned = waiting.unionByName(held).groupBy(*keys, "tid").agg(
        F.min("rank").alias("rank"), F.min_by("_own", "rank").alias("_own")
    )
    known = first_by_tid(th, keys).select(*keys, "tid", F.col("name").alias("_known"))
    return mentioned.join(known, [*keys, "tid"], "left").select(
        *keys, "tid", "rank",
        F.coalesce("_own", "_known", F.concat(F.lit("thread-"), F.col("tid").cast("string"))).alias("thread_name"),
    )


def named_edges(th: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Waits with the names of both ends."""
    names = lock_nodes(th, keys)
    return (
        lock_edges(th, keys)
        .join(names.select(*keys, F.col("tid").alias("from_tid"), F.col("thread_name").alias("from_name")), [*keys, "from_tid"])
        .join(names.select(*keys, F.col("tid").alias("to_tid"), F.col("thread_name").alias("to_name")), [*keys, "to_tid"])
    )


def _waits(th: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges for walking: the first thread of each tid, to a tid that exists."""
    known = first_by_tid(th, keys)
    return (
        known.where("wait_holder_tid is not null")
        .select(*keys, F.col("tid").alias("node"), F.col("wait_holder_tid").alias("to"))
        .join(known.select(*keys, F.col("tid").alias("to")), [*keys, "to"], "left_semi")
        .select(*keys, "node", "to")
    )


def dropped_waits(th: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Waits not followed because an earlier thread has the same tid."""
    first = first_by_tid(th, keys).select(*keys, "tid", "thread_no")
    return th.where("wait_holder_tid is not null").join(first, [*keys, "tid", "thread_no"], "left_anti")


def deadlocks(th: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``cycle_id, cycle_rank, cycle_pos, tid`` and the awaited lock, for cycles of two or more."""
    edges = _waits(th, keys)
    order = lock_nodes(th, keys).select(*keys, F.col("tid").alias("node"), "rank")
    placed = graph.ordered_cycles(edges, order, keys)
    first = th.join(first_by_tid(th, keys).select(*keys, "tid", "thread_no"), [*keys, "tid", "thread_no"])
    return placed.withColumnRenamed("node", "tid").join(
        first.select(*keys, "tid", "name", "wait_addr", "wait_class"), [*keys, "tid"]
    )


def blocking_chains(th: DataFrame, starts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``start_tid, hop, tid, name``: whom each start waits for, transitively."""
    edges = _waits(th, keys)
    walked = graph.walks(edges, starts.select(*keys, F.col("tid").alias("node")), keys)
    names = first_by_tid(th, keys).select(*keys, "tid", "name", "thread_no")
    return walked.select(*keys, F.col("start").alias("start_tid"), "hop", F.col("node").alias("tid")).join(
        names, [*keys, "tid"]
    )


def binder_pool(th: DataFrame, fr: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Size and use of the binder thread pool; traces without such threads are absent."""
    polling = fr.where(exact_words(F.col("raw"), ["nativePollOnce", "IPCThreadState"])).select(*keys, "thread_no").distinct()
    pool = th.where(F.col("name").rlike(r"(?i)^binder[_:]"))
    idle = pool.where("state = 'Native'").join(polling, [*keys, "thread_no"], "left_semi").select(*keys, "thread_no")
    marked = pool.select(*keys, "thread_no").join(idle.withColumn("_idle", F.lit(1)), [*keys, "thread_no"], "left")
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_idle").isNull()).alias("busy"),
        F.count_if(F.col("_idle").isNotNull()).alias("idle"),
        (F.count("_idle") == 0).alias("exhausted"),
    )


# Primary threads and their block reason ----------------------------------------


def primary_threads(heads: DataFrame, th: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``role`` main and, where the subject names another thread, blocked."""
    named = th.join(heads.select(*keys, "process_name", "blocked_thread_name"), list(keys))
    main = F.col("name").eqNullSafe("main") | (F.col("tid") == 1)
    own = (F.col("process_name") != "unknown") & (F.col("name") == F.col("process_name"))
    asked = (F.col("blocked_thread_name") != "main") & (F.col("name") == F.col("blocked_thread_name"))

    def first(hit: Column) -> Column:
        return F.min(F.when(hit, F.col("thread_no")))

    picks = named.groupBy(*keys).agg(first(main).alias("_main"), first(own).alias("_own"), first(asked).alias("_asked"))
    roles = F.array(
        F.struct(F.lit("main").alias("role"), F.coalesce("_main", "_own").alias("thread_no")),
        F.struct(F.lit("blocked").alias("role"), F.col("_asked").alias("thread_no")),
    )
    chosen = picks.select(*keys, F.explode(roles).alias("r")).select(*keys, "r.*").where("thread_no is not null")
    return chosen.join(th, [*keys, "thread_no"])


def stack_evidence(fr: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per thread, what any of its frames shows.  Frames are never gathered into one text."""
    raw, cls = F.col("raw"), F.col("class_name")
    platform = F.lit(False)
    for prefix in reasons.PLATFORM_PREFIXES:
        platform = platform | cls.startswith(prefix)
    return fr.groupBy(*keys, "thread_no").agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.bool_or(exact_words(raw, words)).alias(f"_{reason}") for reason, words in reasons.EVIDENCE.items()],
        F.bool_or(exact_words(raw, reasons.IDLE_WORDS)).alias("_idle"),
        F.bool_or(~F.col("is_native") & ~platform).alias("_app"),
        F.bool_or(exact_words(raw, reasons.IN_BINDER_WORDS)).alias("_in_binder"),
    )


def block_reasons(
    primary: DataFrame, evidence: DataFrame, cycles: DataFrame, pool: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Primary threads with ``reason`` and ``frames``."""
    marks = [c for c in evidence.columns if c.startswith("_")]
    in_cycle = cycles.select(*keys, "tid").distinct().withColumn("_cycle", F.lit(True))
    rows = (
        primary.join(evidence, [*keys, "thread_no"], "left")
        .join(in_cycle, [*keys, "tid"], "left")
        .join(pool.select(*keys, F.col("exhausted").alias("_exhausted")), list(keys), "left")
        .fillna(False, [*marks, "_cycle", "_exhausted"])
        .fillna(0, ["frames"])
    )
    reason = reasons.block_reason(
        F.col("state"), F.col("wait_addr").isNotNull(), F.col("_cycle"),
        {r: F.col(f"_{r}") for r in reasons.EVIDENCE}, F.col("_idle"), F.col("_app"), F.col("frames"),
        F.col("_exhausted"),
    )
    return rows.withColumn("reason", reason).drop(*marks, "_cycle", "_exhausted")


# Binder and HAL targets ------------------------------------------------------------

# How proxies and HAL libraries look in frames.
HIDL_PROXY = r"at\s+([\w.]+\.V\d+_\d+)\.(I\w+)\.(getService|castFrom)"
AIDL_STUB = r"at\s+([\w.]+)\.(I\w+)\$Stub\.(asInterface|getService)"
HIDL_ANY = r"at\s+([\w.]+\.V\d+_\d+)\.(I\w+)\.(getService|castFrom|\w+)"
HIDL_LIB = r"\/(android\.hardware\.\w[\w.]*@[\d.]+)\.so\s+\(.*?::(?:BpHw)?(\w+?)::_hidl_(\w+)"
VENDOR_LIB = r"\/vendor\/lib(?:64)?\/(?:hw\/)?([\w.-]+)\.so"


def _hidl_package(text: Column) -> Column:
    versioned = F.regexp_replace(text, r"^(.*?)\.V", "$1@")
    return F.regexp_replace(versioned, r"^(.*?)_", "$1.")


def _last_part(cls: Column) -> Column:
    return F.regexp_extract(cls, r"([^.]*)\z", 1)


def _without_last(cls: Column) -> Column:
    return F.regexp_replace(cls, r"\.\w+\z", "")


def _hit(rank: int, when: Column, interface: Column, package: Column, method: Column, *skip: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(rank).alias("strategy"),
            F.col("frame_no").alias("frame_no"),
            interface.alias("interface_name"),
            package.alias("package_name"),
            method.alias("method"),
            (F.array(*skip) if skip else F.array().cast("array<string>")).alias("skip"),
        ),
    )


def _library_hits() -> list[Column]:
    """Native library frames, then Java proxies, then HAL-like Java callers (strategies 3-5)."""
    raw, cls, native = F.col("raw"), F.col("class_name"), F.col("is_native")
    vendor = F.regexp_extract(raw, VENDOR_LIB, 1)
    hidl_lib = native & raw.rlike(HIDL_LIB)
    vendor_lib = native & ~raw.rlike(HIDL_LIB) & (vendor != "") & ~vendor.contains("libbinder") & ~vendor.contains("libhidl")
    proxy = F.regexp_extract(raw, HIDL_ANY, 1)
    return [
        F.coalesce(
            _hit(3, hidl_lib, F.concat(F.lit("I"), F.regexp_extract(raw, HIDL_LIB, 2)), F.regexp_extract(raw, HIDL_LIB, 1),
                 F.regexp_extract(raw, HIDL_LIB, 3)),
            _hit(3, vendor_lib & F.col("_has_java"), vendor, F.lit("vendor"), F.lit("")),
        ),
        _hit(4, ~native & (proxy != ""), F.regexp_extract(raw, HIDL_ANY, 2), _hidl_package(proxy),
             F.regexp_extract(raw, HIDL_ANY, 3), F.concat(proxy, F.lit("."), F.regexp_extract(raw, HIDL_ANY, 2))),
        _hit(5, ~native & (cls.contains(".hal.") | cls.contains(".gnss.") | cls.contains("vendor.")),
             _last_part(cls), _without_last(cls), F.col("method_name")),
    ]


def _with_java(fr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames with whether their thread has a Java frame outside ``android.os``."""
    java = F.expr("not is_native and class_name <> '' and not startswith(class_name, 'android.os.')")
    has = F.max(java).over(Window.partitionBy(*keys, "thread_no"))
    return fr.withColumn("_has_java", F.coalesce(has, F.lit(False)))


def _caller_fits(hit: Column) -> Column:
    """Whether a frame made the call of a hit: later for proxies, anywhere in the stack for libraries."""
    cls, skip = F.col("class_name"), hit["skip"]
    plain = ~cls.startswith("android.os.")
    later = plain & ~cls.startswith("android.hidl.") & ~cls.contains("$Stub$Proxy") & ~cls.contains("HwBinder") & (
        F.col("f_no") > hit["frame_no"]
    ) & ~F.exists(skip, lambda s: (cls == s) | cls.startswith(F.concat(s, F.lit("$"))))
    anywhere = (cls != "") & plain & F.when(
        hit["strategy"] == 4,
        ~cls.startswith("android.hidl.") & (F.col("f_no") != hit["frame_no"]) & ~F.array_contains(skip, cls),
    ).otherwise(True)
    return F.when(hit["strategy"] <= 2, later).when(hit["strategy"] <= 4, anywhere).otherwise(F.col("f_no") == hit["frame_no"])


def _calls(fr: DataFrame, groups: Sequence[Sequence[Column]], keys: Sequence[str]) -> DataFrame:
    """Per thread with a hit, for the k-th group of strategies, ``h<k>``: the best hit (lowest strategy, then
    earliest frame) with ``_caller``, the frame that made the call.

    All groups share one aggregate and one join: a task sorts the frames twice, however many there are.
    """
    thread, at = [*keys, "thread_no"], range(len(groups))
    best = [F.array_min(F.array(*group)).alias(f"h{k}") for k, group in enumerate(groups)]
    hits = fr.select(*thread, *best).where(" or ".join(f"h{k} is not null" for k in at))
    hits = hits.groupBy(*thread).agg(*[F.min(f"h{k}").alias(f"h{k}") for k in at])
    java = fr.where("not is_native").select(*thread, F.col("frame_no").alias("f_no"), "class_name", "method_name")
    made = [F.min_by(F.struct("class_name", "method_name"), F.when(_caller_fits(F.col(f"h{k}")), F.col("f_no"))).alias(f"c{k}") for k in at]
    found = hits.join(java, thread, "left").groupBy(*thread).agg(*[F.first(f"h{k}").alias(f"h{k}") for k in at], *made)
    whole = [F.when(F.col(f"h{k}").isNotNull(), F.struct(f"h{k}.*", F.col(f"c{k}").alias("_caller"))).alias(f"h{k}") for k in at]
    return found.select(*thread, *whole)


def binder_targets(chosen: DataFrame, fr: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What a thread stuck in a binder call was calling, and from where."""
    raw, cls, native = F.col("raw"), F.col("class_name"), F.col("is_native")
    mine = _with_java(fr.join(chosen.select(*keys, "thread_no").distinct(), [*keys, "thread_no"], "left_semi"), keys)
    hidl, aidl = F.regexp_extract(raw, HIDL_PROXY, 1), F.regexp_extract(raw, AIDL_STUB, 1)
    stub = F.concat(aidl, F.lit("."), F.regexp_extract(raw, AIDL_STUB, 2))
    hits = [
        F.coalesce(
            _hit(1, ~native & (hidl != ""), F.regexp_extract(raw, HIDL_PROXY, 2), _hidl_package(hidl),
                 F.regexp_extract(raw, HIDL_PROXY, 3), F.concat(hidl, F.lit("."), F.regexp_extract(raw, HIDL_PROXY, 2))),
            _hit(1, ~native & (aidl != ""), F.regexp_extract(raw, AIDL_STUB, 2), aidl,
                 F.regexp_extract(raw, AIDL_STUB, 3), stub, F.concat(stub, F.lit("$Stub")),
                 F.concat(stub, F.lit("$Stub$Proxy"))),
        ),
        _hit(2, ~native & raw.contains("BinderProxy.transact"), F.lit(""), F.lit(""), F.lit("")),
        *_library_hits(),
        _hit(6, ~native & (cls != "") & ~cls.startswith("android.os.") & ~cls.startswith("android.hidl."),
             _last_part(cls), _without_last(cls), F.col("method_name")),
    ]
    # A transact frame without a caller yields to the next strategies, as does an unnamed library.
    calls = _calls(mine, [hits[:1], hits[1:2], hits[2:5], hits[5:]], keys)
    best = calls.select(*keys, "thread_no", F.coalesce(
        F.col("h0"), F.when(F.col("h1._caller").isNotNull(), F.col("h1")), F.when(F.col("h2.interface_name") != "Unknown", F.col("h2")), F.col("h3")
    ).alias("b"))
    caller, is_transact = F.col("b._caller"), F.col("b.strategy") == 2
    proxy = F.nullif(F.regexp_extract(caller["class_name"], r"\.(I\w+)\$Stub\$Proxy\z", 1), F.lit(""))
    rows = chosen.select(*keys, "thread_no").distinct().join(best, [*keys, "thread_no"], "left")
    return rows.select(
        *keys, "thread_no",
        F.coalesce(F.when(is_transact, F.coalesce(proxy, _last_part(caller["class_name"]))), F.col("b.interface_name"), F.lit("Unknown")).alias("interface_name"),
        F.coalesce(F.when(is_transact, _without_last(caller["class_name"])), F.col("b.package_name"), F.lit("")).alias("package_name"),
        F.coalesce(F.when(is_transact, caller["method_name"]), F.col("b.method"), F.lit("")).alias("method"),
        F.coalesce(caller["class_name"], F.lit("")).alias("caller_class"),
        F.coalesce(caller["method_name"], F.lit("")).alias("caller_method"),
    )


def suspected_targets(
    reasoned: DataFrame, th: DataFrame, fr: DataFrame, evidence: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Other threads stuck in binder calls, for primaries whose own stack explains nothing.

    One row per primary ``role`` and distinct ``interface:method``, in thread order.
    """
    asking = reasoned.where(F.col("reason").isin(reasons.SCANS_OTHERS)).select(
        *keys, "role", F.col("thread_no").alias("_self")
    )
    stuck = (
        th.where(~F.col("state").isin("Waiting", "Sleeping", "TimedWaiting"))
        .join(asking.select(*keys).distinct(), list(keys), "left_semi")
        .join(evidence.where("_in_binder").select(*keys, "thread_no"), [*keys, "thread_no"], "left_semi")
        .select(*keys, "thread_no", F.col("name").alias("thread_name"), F.col("state").alias("thread_state"))
    )
    mine = _with_java(fr.join(stuck, [*keys, "thread_no"], "left_semi"), keys)
    targets = _calls(mine, [_library_hits()], keys).select(*keys, "thread_no", "h0.*").where("interface_name <> 'Unknown'")
    told = stuck.join(targets, [*keys, "thread_no"]).select(
        *keys, "thread_no", "thread_name", "thread_state", "interface_name", "package_name", "method",
        F.coalesce("_caller.class_name", F.lit("")).alias("caller_class"),
        F.coalesce("_caller.method_name", F.lit("")).alias("caller_method"),
    )
    # At most two primaries a trace, so this is no pairing.
    seen = told.join(asking, list(keys)).where("thread_no <> _self").drop("_self")
    names = [c for c in seen.columns if c not in (*keys, "role", "interface_name", "method")]
    return (
        seen.groupBy(*keys, "role", "interface_name", "method")
        .agg(F.min_by(F.struct(*names), "thread_no").alias("_f"))
        .select(*keys, "role", "interface_name", "method", "_f.*")
    )


def thread_blocks(reasoned: DataFrame, suspects: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Primaries with ``confidence`` and whether they have suspects."""
    has = suspects.select(*keys, "role").distinct().withColumn("has_suspects", F.lit(True))
    return (
        reasoned.join(has, [*keys, "role"], "left")
        .fillna(False, ["has_suspects"])
        .withColumn("confidence", reasons.confidence(F.col("reason"), F.col("frames"), F.col("has_suspects")))
    )


# Frames for display and counting -------------------------------------------------------

# Display forms of frames.
SHOW_OAT = r"^(?:native:\s+)?#(\d+)\s+pc\s+[\da-f]+\s+(\S+\.(?:oat|jar))\s+\((\S+?)([+-]\d+)?\)\z"
SHOW_NATIVE = r"^(?:native:\s+)?#(\d+)\s+pc\s+[\da-f]+\s+(\S+\.so)\s*(?:\((.+?)\))?\s*(?:\(BuildId:.*\))?\z"
SHOW_JAVA = r"^at\s+([\w$.<>]+)\.([\w$<>]+)\((.+?)(?::(\d+))?\)\z"
FRAMEWORK_CLASSES = r"^(android\.os\.|android\.app\.|com\.android\.internal\.os\.|java\.lang\.reflect\.|dalvik\.|libcore\.)"
FRAMEWORK_FUNCTIONS = ["nterp_helper", "art_jni_trampoline", "art_quick_invoke_stub", "art_quick_invoke_static_stub"]
HAL_WORDS = ["IPCThreadState", "BpHwBinder", "_hidl_", "BinderProxy", "HwBinder"]


def frame_view(fr: DataFrame) -> DataFrame:
    """Frame kind, short names and the HAL and framework marks.  Row-local."""
    raw = trimmed("raw")
    oat, native, java = raw.rlike(SHOW_OAT), raw.rlike(SHOW_NATIVE), raw.rlike(SHOW_JAVA)
    kind = F.when(oat, "oat-java").when(native, "native").when(java, "java").otherwise("other")
    dotted = F.regexp_extract(raw, SHOW_OAT, 3)
    library = F.when(oat, F.regexp_extract(raw, SHOW_OAT, 2)).when(native, F.regexp_extract(raw, SHOW_NATIVE, 2))
    full = F.when(kind == "native", F.regexp_extract(raw, SHOW_NATIVE, 3))
    plain = F.regexp_replace(F.regexp_replace(full, r"\([\s\S]*\z", ""), r"\+[^+]*\z", "")
    shown = fr.withColumn("kind", kind).select(
        "*",
        F.when(oat, F.regexp_extract(raw, SHOW_OAT, 1)).when(native, F.regexp_extract(raw, SHOW_NATIVE, 1)).alias("frame_num"),
        F.regexp_extract(library, r"([^/]*)\z", 1).alias("lib_short"),
        full.alias("func_full"),
        F.when(plain.contains("::"), F.array_join(F.slice(F.split(plain, "::"), -2, 2), "::")).otherwise(plain).alias("func_name"),
        F.when(oat, F.regexp_replace(dotted, r"\.[^.]*\z", "")).when(kind == "java", F.regexp_extract(raw, SHOW_JAVA, 1)).alias("show_class"),
        F.when(oat, F.when(dotted.contains("."), _last_part(dotted)).otherwise("")).when(kind == "java", F.regexp_extract(raw, SHOW_JAVA, 2)).alias("show_method"),
        F.when(kind == "java", F.regexp_extract(raw, SHOW_JAVA, 3)).alias("show_file"),
        F.when(kind == "java", capture(raw, SHOW_JAVA, 4)).alias("show_line"),
    )
    text = F.coalesce("func_full", "show_class", raw)
    hal = exact_words(text, HAL_WORDS) | raw.rlike(r"android\.hardware\.|vendor\..*\.hardware")
    framework = (
        F.coalesce("show_class", F.lit("")).rlike(FRAMEWORK_CLASSES)
        | F.coalesce(F.col("lib_short") == "libart.so", F.lit(False))
        | F.coalesce(F.col("func_name").isin(FRAMEWORK_FUNCTIONS), F.lit(False))
    )
    return shown.withColumn("is_hal", hal).withColumn("is_framework", framework)


def hot_frames(view: DataFrame, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """How often each function stands in the stacks of a report."""
    func = F.coalesce(
        F.when(F.col("kind") == "native", F.col("func_name")),
        F.when(F.col("show_class").isNotNull(), F.concat_ws(".", "show_class", F.nullif("show_method", F.lit("")))),
        F.col("raw"),
    )
    return view.groupBy(*keys, func.alias("function")).agg(F.count(F.lit(1)).alias("count"))
