"""The same answers in plain SQL over the same tables, one text per query.

They start from the columns and never read rendered text, except where the text
itself is the answer.
"""

from __future__ import annotations

from fleetfault.functions.kernel_rules import KERNEL_RULES
from fleetfault.functions.log_rules import LOG_RULES
from fleetfault.functions.penalties import PENALTIES, WEIGHTS
from fleetfault.functions.reasons import LABELS
from fleetfault.functions.wording import CATEGORY_TYPES, KERNEL_COMMANDS, KERNEL_FINDINGS, LOG_COMMANDS, LOG_FINDINGS
from fleetfault.plans import bindings as b
from fleetfault.plans.queries import BUDGET, GAP_MS, NEAR_MS, NEAR_S, TITLES

ORACLES: dict[str, str] = {}


def sql(fragment: str) -> str:
    return fragment.replace(" DIV ", " // ")


def cols(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql(v)} AS {k}" for k, v in columns.items())


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], name: str, columns: str) -> str:
    def cell(x):
        return "NULL" if x is None else quoted(x) if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def oracle(name: str, *parts: str, recursive: bool = False) -> None:
    *ctes, final = parts
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" if ctes else ""
    ORACLES[name] = head + final


# Application log ------------------------------------------------------------------------

LOGS = f"logs AS (SELECT *, strftime(ts, '%m-%d %H:%M:%S.%g') AS ts_text, {cols(b.LOG)}, {sql(b.LOG_RAW)} AS raw FROM events)"
# An entry is its line and the continuation lines below it; the first of those that tells of a timeout decides
# where no rule before that one holds (kinds 0 to 8).
_MS = "epoch_ms(strptime('2000-' || ts_text, '%Y-%m-%d %H:%M:%S.%g')) AS ms"
ENTRIES = f"""owned AS (SELECT *, sum(CASE WHEN shape = 'entry' THEN 1 ELSE 0 END) OVER (PARTITION BY report_id ORDER BY line_no) AS g FROM logs),
  tails AS (SELECT report_id AS r, g AS of, string_agg(chr(10) || raw, '' ORDER BY line_no) AS tail, arg_min(v, line_no) FILTER (v % 4 = 1) AS tv
    FROM owned WHERE shape = 'tail' AND g > 0 GROUP BY 1, 2),
  entries AS (SELECT o.* REPLACE (message || coalesce(tail, '') AS message, raw || coalesce(tail, '') AS raw,
      CASE WHEN kind > 8 AND tv IS NOT NULL THEN 8 ELSE kind END AS kind), kind AS own_kind, tv,
    row_number() OVER (PARTITION BY report_id ORDER BY line_no) AS entry_idx, {_MS}
    FROM owned o LEFT JOIN tails t ON t.r = o.report_id AND t.of = o.g WHERE shape = 'entry')"""
LINE_ENTRIES = f"""entries AS (SELECT *, kind AS own_kind, NULL AS tv, row_number() OVER (PARTITION BY report_id ORDER BY line_no) AS entry_idx, {_MS}
  FROM logs WHERE shape = 'entry')"""
oracle("log_entries", LOGS, ENTRIES,
       "SELECT report_id, entry_idx, line_no, ts_text, ms, pid, tid, level, tag, message FROM entries")

GROUPED = "grouped AS (SELECT *, sum(CASE WHEN shape = 'entry' THEN 1 ELSE 0 END) OVER (PARTITION BY report_id ORDER BY line_no) AS g FROM logs)"
oracle("log_stitched", LOGS, GROUPED, """
SELECT report_id, CAST(g AS BIGINT) AS entry_idx,
  max(CASE WHEN shape = 'entry' THEN message END) || coalesce(string_agg(CASE WHEN shape = 'tail' THEN chr(10) || raw END, '' ORDER BY line_no), '') AS message,
  max(CASE WHEN shape = 'entry' THEN raw END) || coalesce(string_agg(CASE WHEN shape = 'tail' THEN chr(10) || raw END, '' ORDER BY line_no), '') AS raw
FROM grouped WHERE g > 0 GROUP BY 1, 2""")  # fmt: skip
oracle("log_stats", LOGS, GROUPED, """
SELECT report_id, count(*) AS total_lines, count(*) FILTER (shape = 'entry') AS parsed_lines,
  count(*) FILTER (shape = 'stray' OR (shape = 'tail' AND g = 0)) AS parse_errors FROM grouped GROUP BY 1""")  # fmt: skip

_KINDS = ["anr", "fatal_exception", "native_crash", "oom", "watchdog", "binder_timeout", "slow_operation", "strict_mode",
          "input_dispatching_timeout", "hal_service_death"]
_SEVERITY = {r[0]: r[1] for r in LOG_RULES}
KINDS = values([(i, k, _SEVERITY[k], *LOG_FINDINGS[k], "|".join(LOG_COMMANDS.get(k, [])) or None) for i, k in enumerate(_KINDS)],
               "kinds", "k, type, severity, category, template, commands")
_APP = "'com.app.u' || CAST(user_id % 9 AS VARCHAR)"
SUMMARY = f"""CASE kind WHEN 0 THEN 'ANR in ' || {_APP} WHEN 1 THEN 'Fatal Exception: main Process: ' || {_APP}
 WHEN 2 THEN 'Native crash detected' WHEN 3 THEN 'OOM kill: ' || {_APP} || ' (adj=' || v || ')'
 WHEN 4 THEN 'Watchdog: blocked in handler on ui thread' WHEN 5 THEN 'Binder transaction timeout'
 WHEN 6 THEN 'Slow operation: delivery' WHEN 7 THEN 'StrictMode violation (policy=' || v || ', violation=' || event_id % 5 || ')'
 WHEN 8 THEN 'Input dispatching timeout: com.app/' || CASE own_kind WHEN 8 THEN '.U' || user_id % 9 ELSE '.T' || tv END WHEN 9 THEN 'HAL service died: vendor.u' || user_id % 9 END"""
FOUND = f"""found AS (SELECT e.*, k.type, k.severity, k.category, k.template, k.commands, {SUMMARY} AS summary,
  CASE WHEN kind < 2 THEN {_APP} END AS process_name FROM entries e JOIN kinds k ON k.k = e.kind)"""
oracle("log_anomalies", LOGS, ENTRIES, KINDS, FOUND,
       "SELECT report_id, entry_idx, type, severity, summary, process_name FROM found")

ANCHORED = [
    """flagged AS (SELECT *, CASE WHEN type = lag(type) OVER w AND pid = lag(pid) OVER w THEN 0 ELSE 1 END AS opens
       FROM found WINDOW w AS (PARTITION BY report_id ORDER BY entry_idx))""",
    "runs AS (SELECT *, sum(opens) OVER (PARTITION BY report_id ORDER BY entry_idx) AS run FROM flagged)",
    f"""anchors AS (SELECT report_id, run, min(entry_idx) AS a, arg_min(ms, entry_idx) AS a_ms FROM runs GROUP BY 1, 2
       UNION ALL
       SELECT s.report_id, s.run, min(r.entry_idx), arg_min(r.ms, r.entry_idx) FROM anchors s
       JOIN runs r ON r.report_id = s.report_id AND r.run = s.run AND r.entry_idx > s.a AND r.ms - s.a_ms > {GAP_MS}
       GROUP BY s.report_id, s.run, s.a)""",
    """merged AS (SELECT r.*, x.anchor FROM runs r JOIN (SELECT r.report_id, r.entry_idx, max(s.a) AS anchor FROM runs r
       JOIN anchors s ON s.report_id = r.report_id AND s.run = r.run AND s.a <= r.entry_idx GROUP BY 1, 2) x USING (report_id, entry_idx))""",
]
_MERGE = [LOGS, ENTRIES, KINDS, FOUND, *ANCHORED]
oracle("log_dedup", *_MERGE, "SELECT report_id, entry_idx, anchor FROM merged", recursive=True)
NEAR = """near AS (SELECT m.report_id, m.anchor AS anomaly, m.entry_idx AS source, e.entry_idx, e.raw FROM merged m
  JOIN entries e ON e.report_id = m.report_id AND e.entry_idx BETWEEN m.entry_idx - 5 AND m.entry_idx + 5 AND e.pid = m.pid)"""
oracle("log_context", *_MERGE, NEAR, "SELECT * FROM near", recursive=True)

oracle("tag_classes", """SELECT CASE WHEN p_partkey % 5 IN (0, 4) THEN 'framework' WHEN p_partkey % 5 IN (1, 3) THEN 'vendor' ELSE 'app' END AS class,
  p_brand, count(*) AS n FROM part GROUP BY 1, 2""")  # fmt: skip
_CLASS = "CASE WHEN tag IN ('vendor.audio', 'my_qcom_app') THEN 'vendor' WHEN tag IN ('ActivityManager', 'AndroidRuntime', 'Watchdog', 'JavaBinder', 'Looper', 'StrictMode', 'InputDispatcher', 'Zygote') THEN 'framework' ELSE 'app' END"


def _tags(k: int) -> str:
    return f"""tags AS (SELECT *, {_CLASS} AS classification FROM (SELECT report_id, tag, n, row_number() OVER (PARTITION BY report_id ORDER BY n DESC, first) AS rank
      FROM (SELECT report_id, tag, count(*) AS n, min(entry_idx) AS first FROM entries WHERE level IN ('E', 'F') GROUP BY 1, 2)) WHERE rank <= {k})"""


oracle("tag_top", LOGS, ENTRIES, _tags(6), """SELECT report_id, CAST(rank AS INT) AS rank, tag, n AS count, classification,
  CAST(n * 100 AS DOUBLE) / max(n) OVER (PARTITION BY report_id) AS bar FROM tags""")  # fmt: skip
oracle("tag_share", LOGS, ENTRIES, _tags(20), """SELECT report_id, classification, CAST(n AS BIGINT) AS count, CAST(n * 100 AS DOUBLE) / sum(n) OVER (PARTITION BY report_id) AS percent
  FROM (SELECT report_id, classification, sum(n) AS n FROM tags GROUP BY 1, 2)""")  # fmt: skip

# Kernel log ----------------------------------------------------------------------------------

KLOGS = f"klogs AS (SELECT *, {cols(b.KERNEL)} FROM orders)"
KENTRIES = "kentries AS (SELECT *, line_no AS entry_idx, '<' || u || '>' AS level, CAST(boot_text AS DECIMAL(18,6)) AS boot_s FROM klogs WHERE o_orderkey % 37 <> 6)"
oracle("kernel_entries", KLOGS, KENTRIES,
       "SELECT report_id, entry_idx, CAST(boot_text AS DOUBLE) AS boot_s, level, message FROM kentries")
_KTYPE = ["kernel_panic", "oom_kill", "oom_kill", "lowmemory_killer", "kswapd_active", "driver_error", "gpu_error",
          "thermal_shutdown", "watchdog_reset", "thermal_throttling", "storage_io_error", "suspend_resume_error",
          "suspend_resume_error", "selinux_denial", "selinux_denial", "selinux_denial"]
_KSEV = {r[0]: r[1] for r in KERNEL_RULES}
KKINDS = values([(i, k, _KSEV[k], *KERNEL_FINDINGS[k], "|".join(KERNEL_COMMANDS[k])) for i, k in enumerate(_KTYPE)],
                "kkinds", "k, type, severity, category, template, commands")
KFOUND = """kfound AS (SELECT e.*, k.type, k.severity, k.category, k.template, k.commands, CASE kind
  WHEN 0 THEN 'Kernel panic: not syncing: fatal ' || u WHEN 1 THEN 'OOM killed: app' || u || ' (pid=' || o_custkey || ')'
  WHEN 2 THEN 'OOM kill event' WHEN 3 THEN 'LMK killed: app' || u WHEN 4 THEN 'kswapd active (memory pressure)'
  WHEN 5 THEN 'Driver error: ' || message WHEN 6 THEN 'GPU error: ' || message WHEN 7 THEN 'Thermal shutdown triggered'
  WHEN 8 THEN 'Watchdog reset triggered' WHEN 9 THEN 'Thermal throttling: cpu' || u WHEN 10 THEN 'Storage I/O error: ' || message
  WHEN 11 THEN 'Suspend aborted' WHEN 12 THEN 'Resume failed'
  WHEN 13 THEN 'SELinux denial: u:r:dom' || u || ':s0 → u:object_r:typ:s0' WHEN 14 THEN 'SELinux denial'
  WHEN 15 THEN 'SELinux denial: odd → u:object_r:typ:s0' END AS summary,
  CASE kind WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN '0' END AS victim_pid,
  CASE kind WHEN 1 THEN 'app' || u WHEN 2 THEN 'unknown' END AS victim,
  CASE kind WHEN 7 THEN CAST(90 + u AS VARCHAR) WHEN 9 THEN '85' END AS temperature,
  CASE kind WHEN 13 THEN 'read' WHEN 15 THEN 'ioctl' END AS permission,
  CASE WHEN kind IN (0, 3, 5, 6, 8, 10, 11, 12) THEN message END AS told,
  CASE kind WHEN 13 THEN 'allow dom' || u || ' typ:file { read };' END AS rule
  FROM kentries e JOIN kkinds k ON k.k = e.kind)"""
_KBASE = [KLOGS, KENTRIES, KKINDS, KFOUND]
oracle("kernel_events", *_KBASE, """SELECT report_id, entry_idx, type, severity, summary, victim_pid, victim, temperature, permission,
  told AS message FROM kfound""")  # fmt: skip
oracle("allow_rules", *_KBASE,
       "SELECT report_id, summary, rule, count(*) AS n FROM kfound WHERE type = 'selinux_denial' GROUP BY 1, 2, 3")

# Thread dumps -------------------------------------------------------------------------------------

TH = f"""th AS (SELECT *, {cols(b.TRACE)}, (t + c_custkey) % 16 AS x1, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey // 2) % 16 END AS x2,
  (c_custkey + t) % 5 < 2 AS w3, {sql(b.TRACE_PID)} AS pid, {sql(b.TRACE_PROCESS)} AS process_name,
  '2024-01-15 10:00:00.' || lpad(CAST(t % 1000 AS VARCHAR), 3, '0') AS ts_text FROM customer)"""
# (class, method, file, line, native, shown function, kind, HAL, framework); None marks the frame's own text.
_FACTS = {
    0: ("android.database.sqlite.SQLiteDatabase", "query", "SQLiteDatabase.java", 10, False, None, "java", False, False),
    1: ("java.net.Socket", "connect", "Socket.java", 20, False, None, "java", False, False),
    2: ("android.os.BinderProxy", "transact", "BinderProxy.java", 30, False, None, "java", True, True),
    3: ("android.view.View", "draw", "View.java", 40, False, None, "java", False, False),
    4: ("android.content.ContentProvider$Transport", "query", "ContentProvider.java", 50, False, None, "java", False, False),
    5: ("android.app.LoadedApk$ReceiverDispatcher", "performReceive", "LoadedApk.java", 60, False, None, "java", False, True),
    6: ("android.app.ActivityThread", "handleBindApplication", "ActivityThread.java", 70, False, None, "java", False, True),
    7: ("android.os.MessageQueue", "next", "MessageQueue.java", 80, False, None, "java", False, True),
    8: ("vendor.acme.hardware.pad.V1_0.IPad", "getService", "IPad.java", 90, False, None, "java", True, False),
    9: ("", "", None, -1, True, "IPCThreadState::transact", "native", True, False),
    10: ("", "", None, -1, True, "BpHwGnss::_hidl_start", "native", True, False),
    11: ("com.android.server.Gnss", "start", None, -1, False, None, "oat-java", False, False),
    12: ("java.lang.Object", "wait", "Native method", -1, False, None, "java", False, False),
    13: ("", "", None, -1, True, "art_quick_invoke_stub", "native", False, True),
    15: ("com.app.deep.Calc", "loop", "Calc.java", 99, False, None, "java", False, False),
}
FACTS = values(
    [(i, b.FRAMES[i].strip(), c, m, f if f is not None else b.FRAMES[i].strip(), n, nat, fn or f"{c}.{m}", kind, hal, fw)
     for i, (c, m, f, n, nat, fn, kind, hal, fw) in _FACTS.items()],
    "facts", "idx, raw, class_name, method_name, file_name, line_number, is_native, func, kind, is_hal, is_framework",
)
FR = """fr AS (
  SELECT th.report_id, th.trace_id, th.t, th.i, o.ord, f.* FROM th, (VALUES (1), (2)) o(ord) JOIN facts f ON f.idx = CASE o.ord WHEN 1 THEN th.x1 ELSE th.x2 END
  UNION ALL
  SELECT report_id, trace_id, t, i, 3, 99, 'at com.app.Work' || i || '.run(Work.java:' || i || ')', 'com.app.Work' || i, 'run', 'Work.java', i, false,
    'com.app.Work' || i || '.run', 'java', false, false FROM th WHERE w3)"""
oracle("trace_heads", TH, """SELECT report_id, trace_id, pid, process_name, ts_text, subject, CASE WHEN subject IS NOT NULL THEN 'android.fg' END AS blocked_thread_name
  FROM th WHERE i = 0""")  # fmt: skip
oracle("trace_threads", TH, """SELECT report_id, trace_id, name, i % 6 = 1 AS daemon, i % 10 AS priority, tid, state, c_custkey + 5000 AS sys_tid,
  '0x0' || holder AS wait_addr, CASE WHEN holder IS NOT NULL THEN 'com.app.Lock' || i % 3 END AS wait_class, holder AS wait_holder_tid FROM th""")  # fmt: skip
oracle("trace_frames", TH, FACTS, FR,
       "SELECT report_id, trace_id, class_name, method_name, file_name, CAST(line_number AS BIGINT) AS line_number, is_native, raw FROM fr")
oracle("trace_locks", TH,
       "SELECT report_id, trace_id, '0x0' || tid AS address, 'com.app.Lock' AS class_name FROM th WHERE i % 4 = 1")
oracle("thread_texts", TH, f"""SELECT report_id, trace_id, CAST(sum(length(concat_ws(chr(10), {', '.join(sql(x) for x in b.TRACE_LINES[3:])}))) AS BIGINT) AS chars,
  count(*) AS threads FROM th GROUP BY 1, 2""")  # fmt: skip
oracle("hot_frames", TH, FACTS, FR, "SELECT report_id, func AS function, count(*) AS count FROM fr GROUP BY 1, 2")
oracle("frame_kinds", TH, FACTS, FR,
       "SELECT report_id, kind, is_hal, is_framework, count(*) AS n FROM fr GROUP BY 1, 2, 3, 4")

WAITS = """waits AS (SELECT a.t, a.trace_id, a.report_id, a.tid, a.i, a.holder, a.name FROM th a JOIN th h ON h.t = a.t AND h.tid = a.holder)"""
WALK = """walk AS (SELECT t, tid AS start, holder AS cur, 1 AS step FROM waits UNION ALL
  SELECT walk.t, walk.start, waits.holder, step + 1 FROM walk JOIN waits ON waits.t = walk.t AND waits.tid = walk.cur WHERE step < 41)"""
RINGS = "rings AS (SELECT t, start AS tid, min(cur) AS cycle_id, count(DISTINCT cur) AS cycle_size FROM walk w WHERE EXISTS (SELECT 1 FROM walk v WHERE v.t = w.t AND v.start = w.start AND v.cur = w.start) GROUP BY 1, 2)"
oracle("lock_waits", TH, """SELECT a.report_id, a.trace_id, a.tid AS from_tid, a.holder AS to_tid, '0x0' || a.holder AS address, 'com.app.Lock' || a.i % 3 AS class_name,
  a.name AS from_name, coalesce(h.name, 'thread-' || a.holder) AS to_name FROM th a LEFT JOIN th h ON h.t = a.t AND h.tid = a.holder WHERE a.holder IS NOT NULL""")  # fmt: skip
ENTRY = [
    """ranks AS (SELECT t, tid, min(r) AS rank FROM (SELECT t, tid, 2 * i AS r FROM th WHERE holder IS NOT NULL UNION ALL
       SELECT t, holder, 2 * i + 1 FROM th WHERE holder IS NOT NULL) GROUP BY 1, 2)""",
    """reach AS (SELECT t, tid AS start, tid AS cur, 0 AS step FROM rings UNION ALL SELECT w.t, w.start, w.cur, w.step FROM walk w JOIN rings r ON r.t = w.t AND r.tid = w.cur)""",
    """entries0 AS (SELECT reach.t, start, arg_min(cur, step) AS entry FROM reach GROUP BY 1, 2)""",
    """entry AS (SELECT e.t, r.cycle_id, arg_min(e.entry, k.rank) AS entry, min(k.rank) AS first_rank FROM entries0 e JOIN rings r ON r.t = e.t AND r.tid = e.entry
       JOIN ranks k ON k.t = e.t AND k.tid = e.start GROUP BY 1, 2)""",
    """placed AS (SELECT r.*, CASE WHEN r.tid = e.entry THEN 0 ELSE (SELECT min(step) FROM walk w WHERE w.t = r.t AND w.start = e.entry AND w.cur = r.tid) END AS cycle_pos,
       e.first_rank FROM rings r JOIN entry e ON e.t = r.t AND e.cycle_id = r.cycle_id)""",
]
_CYCLE = [TH, WAITS, WALK, RINGS]
oracle("lock_cycles", *_CYCLE, *ENTRY, """SELECT th.report_id, th.trace_id, p.cycle_id, p.cycle_size, CAST(p.cycle_pos AS BIGINT) AS cycle_pos, p.tid, th.name, '0x0' || th.holder AS wait_addr
  FROM placed p JOIN th ON th.t = p.t AND th.tid = p.tid""", recursive=True)  # fmt: skip
POOL = """pool AS (SELECT report_id, trace_id, t, count(*) AS total, count(*) FILTER (NOT (state = 'Native' AND (x1 = 9 OR coalesce(x2 = 9, false)))) AS busy,
  count(*) FILTER (state = 'Native' AND (x1 = 9 OR coalesce(x2 = 9, false))) AS idle FROM th WHERE starts_with(name, 'Binder:') GROUP BY 1, 2, 3)"""
oracle("binder_pool", TH, POOL, "SELECT report_id, trace_id, total, busy, idle, idle = 0 AS exhausted FROM pool")

_HAS = {n: f"(x1 = {n} OR coalesce(x2 = {n}, false))" for n in range(16)}
PRIMARY = """prim AS (SELECT *, 'main' AS role FROM th WHERE i = 0 UNION ALL SELECT *, 'blocked' FROM th WHERE i = 8 AND t % 2 = 0)"""
REASON = f"""reasoned AS (SELECT p.*, (x1 <> 14)::INT + coalesce((x2 <> 14)::INT, 0) + w3::INT AS frames, CASE
  WHEN p.state = 'Blocked' AND r.tid IS NOT NULL THEN 'deadlock' WHEN p.state = 'Blocked' THEN 'lock_contention'
  WHEN {_HAS[0]} THEN 'io_on_main_thread' WHEN {_HAS[1]} THEN 'network_on_main_thread' WHEN {_HAS[2]} OR {_HAS[9]} THEN 'slow_binder_call'
  WHEN {_HAS[3]} THEN 'expensive_rendering' WHEN {_HAS[4]} THEN 'content_provider_slow' WHEN {_HAS[5]} THEN 'broadcast_blocking'
  WHEN {_HAS[6]} THEN 'slow_app_startup' WHEN q.idle = 0 THEN 'binder_pool_exhaustion' WHEN {_HAS[7]} THEN 'idle_main_thread'
  WHEN p.state = 'Runnable' AND ({_HAS[8]} OR {_HAS[15]} OR w3) THEN 'heavy_computation' WHEN p.state = 'Runnable' THEN 'system_overload_candidate'
  WHEN x1 = 14 AND coalesce(x2 = 14, true) AND NOT w3 THEN 'no_stack_frames' ELSE 'unknown' END AS reason
  FROM prim p LEFT JOIN rings r ON r.t = p.t AND r.tid = p.tid LEFT JOIN pool q ON q.t = p.t)"""
SUSPECTS = f"""stuck AS (SELECT t, i, name AS thread_name, CASE WHEN {_HAS[10]} THEN 'IGnss' ELSE 'IPad' END AS interface_name FROM th
    WHERE state <> 'Waiting' AND ({_HAS[2]} OR {_HAS[9]}) AND ({_HAS[10]} OR {_HAS[8]})),
  suspects AS (SELECT r.report_id, r.trace_id, r.t, r.role, s.interface_name, min(s.i) AS si FROM reasoned r JOIN stuck s ON s.t = r.t AND s.i <> r.i
    WHERE r.reason IN ('idle_main_thread', 'system_overload_candidate', 'unknown') GROUP BY ALL)"""
BLOCKS = """blocks AS (SELECT r.*, EXISTS (SELECT 1 FROM suspects s WHERE s.t = r.t AND s.role = r.role) AS has_suspects FROM reasoned r),
  sure AS (SELECT *, CASE WHEN has_suspects THEN 'medium' WHEN reason IN ('deadlock', 'lock_contention', 'network_on_main_thread', 'io_on_main_thread', 'slow_binder_call',
    'broadcast_blocking', 'binder_pool_exhaustion', 'content_provider_slow') THEN 'high' WHEN reason IN ('heavy_computation', 'expensive_rendering', 'slow_app_startup')
    THEN CASE WHEN frames > 3 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence FROM blocks)"""
_TRACED = [*_CYCLE, POOL, PRIMARY, REASON, SUSPECTS, BLOCKS]
oracle("block_reasons", *_TRACED, "SELECT report_id, trace_id, role, tid, reason, CAST(frames AS BIGINT) AS frames, confidence, has_suspects FROM sure", recursive=True)
CHAINS = """chain AS (SELECT w.report_id, w.trace_id, w.t, w.tid AS start_tid, w.holder AS cur, 1 AS hop, [w.tid] AS seen FROM waits w JOIN prim p ON p.t = w.t AND p.tid = w.tid
  UNION ALL SELECT c.report_id, c.trace_id, c.t, c.start_tid, w.holder, hop + 1, list_append(seen, cur) FROM chain c JOIN waits w ON w.t = c.t AND w.tid = c.cur
  WHERE NOT list_contains(seen, cur))"""
oracle("lock_chains", TH, WAITS, PRIMARY, CHAINS, """SELECT c.report_id, c.trace_id, c.start_tid, CAST(c.hop AS BIGINT) AS hop, c.cur AS tid, th.name
  FROM chain c JOIN th ON th.t = c.t AND th.tid = c.cur""", recursive=True)  # fmt: skip
_JAVA = "NOT f.is_native AND NOT starts_with(f.class_name, 'android.os.')"
SUSPECT_ROWS = f"""SELECT s.report_id, s.trace_id, s.role, s.interface_name,
  CASE s.interface_name WHEN 'IGnss' THEN 'android.hardware.gnss@1.0' ELSE 'vendor.acme.hardware.pad@1.0' END AS package_name,
  CASE s.interface_name WHEN 'IGnss' THEN 'start' ELSE 'getService' END AS method, th.name AS thread_name,
  coalesce((SELECT arg_min(f.class_name, f.ord) FROM fr f WHERE f.t = s.t AND f.i = s.si AND {_JAVA} AND (s.interface_name = 'IGnss' OR f.idx <> 8)), '') AS caller_class,
  coalesce((SELECT arg_min(f.method_name, f.ord) FROM fr f WHERE f.t = s.t AND f.i = s.si AND {_JAVA} AND (s.interface_name = 'IGnss' OR f.idx <> 8)), '') AS caller_method
  FROM suspects s JOIN th ON th.t = s.t AND th.i = s.si"""
oracle("suspected_targets", *_TRACED, FACTS, FR, SUSPECT_ROWS, recursive=True)
oracle("all_suspects", TH, PRIMARY, "reasoned AS (SELECT *, 'unknown' AS reason FROM prim)", SUSPECTS, FACTS, FR, SUSPECT_ROWS)
TARGETS = rf"""slow AS (SELECT DISTINCT report_id, trace_id, t, i, tid FROM reasoned WHERE reason = 'slow_binder_call'),
  marks AS (SELECT s.*, (SELECT min(ord) FROM fr f WHERE f.t = s.t AND f.i = s.i AND f.idx = 8) AS pad, (SELECT min(ord) FROM fr f WHERE f.t = s.t AND f.i = s.i AND f.idx = 2) AS trans,
    (SELECT min(ord) FROM fr f WHERE f.t = s.t AND f.i = s.i AND f.idx = 10) AS gnss FROM slow s),
  called AS (SELECT m.*,
    (SELECT arg_min(struct_pack(c := f.class_name, m := f.method_name), f.ord) FROM fr f WHERE f.t = m.t AND f.i = m.i AND {_JAVA} AND f.idx <> 8 AND f.ord > m.pad) AS pad_by,
    (SELECT arg_min(struct_pack(c := f.class_name, m := f.method_name), f.ord) FROM fr f WHERE f.t = m.t AND f.i = m.i AND {_JAVA} AND f.ord > m.trans) AS trans_by,
    (SELECT arg_min(struct_pack(c := f.class_name, m := f.method_name), f.ord) FROM fr f WHERE f.t = m.t AND f.i = m.i AND {_JAVA}) AS any_by FROM marks m),
  targets AS (SELECT report_id, trace_id, t, tid,
    CASE WHEN pad IS NOT NULL THEN 'IPad' WHEN trans_by IS NOT NULL THEN regexp_extract(trans_by.c, '[^.]*$') WHEN gnss IS NOT NULL THEN 'IGnss'
      WHEN any_by IS NOT NULL THEN regexp_extract(any_by.c, '[^.]*$') ELSE 'Unknown' END AS interface_name,
    CASE WHEN pad IS NOT NULL THEN 'vendor.acme.hardware.pad@1.0' WHEN trans_by IS NOT NULL THEN regexp_replace(trans_by.c, '\.\w+$', '') WHEN gnss IS NOT NULL THEN 'android.hardware.gnss@1.0'
      WHEN any_by IS NOT NULL THEN regexp_replace(any_by.c, '\.\w+$', '') ELSE '' END AS package_name,
    CASE WHEN pad IS NOT NULL THEN 'getService' WHEN trans_by IS NOT NULL THEN trans_by.m WHEN gnss IS NOT NULL THEN 'start' WHEN any_by IS NOT NULL THEN any_by.m ELSE '' END AS method,
    coalesce(CASE WHEN pad IS NOT NULL THEN pad_by.c WHEN trans_by IS NOT NULL THEN trans_by.c ELSE any_by.c END, '') AS caller_class,
    coalesce(CASE WHEN pad IS NOT NULL THEN pad_by.m WHEN trans_by IS NOT NULL THEN trans_by.m ELSE any_by.m END, '') AS caller_method FROM called)"""
oracle("binder_targets", *_TRACED, FACTS, FR, TARGETS, """SELECT report_id, trace_id, tid, interface_name, package_name, method, caller_class, caller_method
  FROM targets""", recursive=True)  # fmt: skip
_EVERY = TARGETS.replace("slow AS (SELECT DISTINCT report_id, trace_id, t, i, tid FROM reasoned WHERE reason = 'slow_binder_call')", "slow AS (SELECT report_id, trace_id, t, i, tid FROM th)")
oracle("stack_targets", TH, FACTS, FR, _EVERY, """SELECT report_id, trace_id, tid, interface_name, package_name, method, caller_class, caller_method
  FROM targets""")  # fmt: skip

LABEL_ROWS = values(list(LABELS.items()), "labels_of", "reason, label")
CHOSEN = "chosen AS (SELECT * FROM sure WHERE role = 'blocked' OR t % 2 = 1)"
oracle("trace_findings", *_TRACED, FACTS, FR, TARGETS, LABEL_ROWS, CHOSEN, """
SELECT c.report_id, c.t AS trace_idx, CAST(0 AS BIGINT) AS part,
  CASE WHEN c.reason = 'idle_main_thread' THEN CASE WHEN has_suspects THEN 'warning' ELSE 'info' END WHEN c.reason IN ('no_stack_frames', 'unknown') OR confidence = 'low' THEN 'warning' ELSE 'critical' END AS severity,
  'anr' AS category,
  CASE WHEN g.interface_name <> 'Unknown' THEN 'ANR: ' || l.label || ' to ' || g.interface_name || CASE WHEN c.t % 2 = 0 THEN ' on thread "android.fg"' ELSE '' END || ' in ' || process_name
    WHEN has_suspects THEN 'ANR: ' || l.label || ' in ' || process_name || ' (suspected: ' || (SELECT arg_min(s.interface_name, s.si) FROM suspects s WHERE s.t = c.t AND s.role = c.role) || ' HAL)'
    ELSE 'ANR: ' || l.label || CASE WHEN c.t % 2 = 0 THEN ' on thread "android.fg"' ELSE '' END || ' in ' || process_name END AS title,
  substr(ts_text, 6) AS ts_text
FROM chosen c JOIN labels_of l USING (reason) LEFT JOIN targets g ON g.t = c.t AND g.tid = c.tid
UNION ALL SELECT c.report_id, c.t, 1, 'critical', 'anr', 'Deadlock: ' || r.cycle_size || ' threads in circular wait', substr(ts_text, 6)
FROM chosen c JOIN (SELECT DISTINCT t, cycle_id, cycle_size FROM rings) r ON r.t = c.t
UNION ALL SELECT c.report_id, c.t, 2, 'warning', 'performance', 'Binder Pool Exhausted in ' || process_name, substr(ts_text, 6)
FROM chosen c JOIN pool q ON q.t = c.t WHERE q.idle = 0 AND c.reason <> 'binder_pool_exhaustion'""", recursive=True)  # fmt: skip

# Native-crash dumps ------------------------------------------------------------------------------------

CR = f"""cr AS (SELECT *, {cols(b.CRASH)} FROM supplier)"""
CRASHES = """crashes AS (SELECT *, CASE WHEN signo = 0 THEN 'UNKNOWN' WHEN signame IN ('SIGILL', 'SIGABRT', 'SIGSEGV') THEN signame WHEN signo = 7 THEN 'SIGBUS' ELSE 'UNKNOWN' END AS signal_name,
  CASE WHEN signo > 0 THEN 'CODE' || s_suppkey % 2 END AS signal_code, 'com.proc' || s_suppkey % 8 AS process_name FROM cr WHERE NOT ends_with(file, '.pb') AND (signo > 0 OR library IS NOT NULL)),
  crashed AS (SELECT *, CASE WHEN signal_name = 'SIGABRT' AND abort IS NOT NULL THEN 'Native crash (SIGABRT) in ' || process_name || ': ' || CASE WHEN length(abort) > 80 THEN substr(abort, 1, 80) || '...' ELSE abort END
    ELSE 'Native crash (' || signal_name || coalesce(' (' || signal_code || ')', '') || ') in ' || process_name || ' at ' || coalesce(regexp_extract(library, '[^/]*$'), 'unknown') END AS summary FROM crashes)"""
oracle("crash_dumps", CR, CRASHES, """SELECT report_id, file, s_suppkey + 100 AS pid, s_suppkey + 200 AS tid, process_name, 'thr' || s_nationkey AS thread_name, CAST(signo AS BIGINT) AS signal, signal_name, signal_code,
  CASE WHEN signo > 0 THEN '0x' || hexa END AS fault_addr, CASE WHEN s_suppkey % 5 <> 0 THEN 'arm64' END AS abi, 'brand/dev' || s_nationkey AS build_fingerprint,
  '2024-02-03 10:00:00.' || hexa || '+0000' AS ts_text, abort AS abort_message, library AS crashed_in_binary, coalesce(starts_with(library, '/vendor/') OR starts_with(library, '/odm/'), false) AS is_vendor_crash, summary
  FROM crashed""")  # fmt: skip
oracle("crash_frames", CR, """SELECT report_id, file, CAST(n AS BIGINT) AS frame_number, CASE n WHEN 0 THEN '000c01d4' ELSE '000c01d8' END AS pc, CASE n WHEN 0 THEN library ELSE '/system/lib64/libc.so' END AS binary,
  CASE n WHEN 0 THEN 'func' || s_suppkey ELSE 'abort' END AS function, CAST(CASE n WHEN 0 THEN 158 END AS BIGINT) AS "offset", CASE n WHEN 1 THEN 'abc' || hexa END AS build_id,
  CASE n WHEN 0 THEN '#00 pc 000c01d4  ' || library || ' (func' || s_suppkey || '+158)' ELSE '#01 pc 000c01d8  /system/lib64/libc.so (abort) (BuildId: abc' || hexa || ')' END AS raw
  FROM cr, (VALUES (0), (1)) v(n) WHERE library IS NOT NULL AND NOT ends_with(file, '.pb')""")  # fmt: skip
oracle("crash_registers", CR, """SELECT report_id, file, r AS register, CASE r WHEN 'x0' THEN hexa || '00000000' WHEN 'x1' THEN '00000000000000aa' WHEN 'lr' THEN '00000000000000bb' ELSE hexa || hexa END AS value
  FROM cr, (VALUES ('x0'), ('x1'), ('lr'), ('x2')) v(r) WHERE NOT ends_with(file, '.pb')""")  # fmt: skip
oracle("crash_files", CR, """SELECT report_id, count(*) AS total_files, count(*) FILTER (NOT ends_with(file, '.pb') AND (signo > 0 OR library IS NOT NULL)) AS parsed_files FROM cr GROUP BY 1""")
oracle("crash_findings", CR, CRASHES, """SELECT report_id, s_suppkey AS file_idx, 'Native Crash: ' || signal_name || CASE WHEN starts_with(library, '/vendor/') OR starts_with(library, '/odm/') THEN ' [Vendor]' ELSE '' END || ' in ' || process_name AS title,
  concat_ws(chr(10), summary, 'Crashed in: ' || library, CASE WHEN signo > 0 THEN 'Fault address: 0x' || hexa END, CASE WHEN s_suppkey % 5 <> 0 THEN 'ABI: arm64' END, 'Abort message: ' || abort) AS description,
  '#00 pc 000c01d4  ' || library || ' (func' || s_suppkey || '+158)' || chr(10) || '#01 pc 000c01d8  /system/lib64/libc.so (abort) (BuildId: abc' || hexa || ')' AS stack,
  '02-03 10:00:00.' || substr(hexa, 1, 3) AS ts_text FROM crashed""")  # fmt: skip

# Snapshots -----------------------------------------------------------------------------------------------

SN = f"sn AS (SELECT *, {cols(b.SNAPSHOT)} FROM customer)"
oracle("mem_summary", SN, "SELECT report_id, CAST(10000 AS BIGINT) AS total_kb, free AS free_kb, 10000 - free AS used_kb FROM sn WHERE i = 0")
MEMTOP = """memtop AS (SELECT report_id, report, row_number() OVER (PARTITION BY report_id ORDER BY i) AS rank, kb AS pss_kb, 'com.c' || c_custkey AS process_name, c_custkey + 10 AS pid FROM sn
  WHERE i % 7 <> 6 AND report IN (SELECT report FROM sn WHERE i = 49) QUALIFY rank <= 10)"""
oracle("mem_processes", SN, MEMTOP, "SELECT report_id, CAST(rank AS INT) AS rank, pss_kb, process_name, pid FROM memtop")
CPUSUM = "cpusum AS (SELECT report_id, report, busy, CASE WHEN report % 3 = 0 THEN 0 ELSE iowait END AS iowait FROM sn WHERE i = 0)"
oracle("cpu_summary", SN, CPUSUM, "SELECT report_id, CAST(busy AS DOUBLE) AS total_percent, 40.0::DOUBLE AS user_percent, 20.5::DOUBLE AS kernel_percent, CAST(iowait AS DOUBLE) AS iowait_percent FROM cpusum")
CPUTOP = "cputop AS (SELECT report_id, report, load + 0.5::DOUBLE AS cpu_percent, c_custkey + 10 AS pid, 'com.c' || c_custkey AS process_name, row_number() OVER (PARTITION BY report_id ORDER BY load DESC, i) AS rank FROM sn QUALIFY rank <= 10)"
oracle("cpu_processes", SN, CPUTOP, "SELECT report_id, cpu_percent, pid, process_name, CAST(rank AS INT) AS rank FROM cputop")
oracle("resource_findings", SN, MEMTOP, CPUSUM, CPUTOP, """
SELECT s.report_id, 'warning' AS severity, 'memory' AS category, 'Low available memory' AS title, 'Only ' || printf('%.1f', CASE WHEN ((free::DOUBLE / 10000) * 100 * 4) % 2 = 1 THEN (free::DOUBLE / 10000) * 100 + 0.01 ELSE (free::DOUBLE / 10000) * 100 END) || '% of RAM is free (0.0 GB used / 0.0 GB total). Top consumers: '
  || (SELECT string_agg(process_name || ' (' || printf('%.0f', CASE WHEN pss_kb % 1024 = 512 THEN pss_kb / 1024.0 + 0.1 ELSE pss_kb / 1024.0 END) || ' MB)', ', ' ORDER BY rank) FROM memtop m WHERE m.report = s.report AND rank <= 3) || '.' AS description FROM sn s WHERE i = 0 AND free < 1000
UNION ALL SELECT report_id, 'warning', 'performance', 'High CPU usage', 'Total CPU usage is ' || busy || '% (40% user + 20.5% kernel). Top consumers: '
  || (SELECT string_agg(process_name || ' (' || CAST(cpu_percent AS VARCHAR) || '%)', ', ' ORDER BY rank) FROM cputop m WHERE m.report = c.report AND rank <= 3) || '.' FROM cpusum c WHERE busy > 80
UNION ALL SELECT report_id, 'warning', 'performance', 'High I/O wait', 'I/O wait is ' || iowait || '%, indicating the CPU is frequently waiting for disk or storage operations.' FROM cpusum WHERE iowait > 20""")  # fmt: skip

HALS = f"""hals AS (SELECT *, {cols(b.HAL)} FROM part),
  services AS (SELECT *, starts_with(interface, 'vendor.') AS is_vendor FROM hals WHERE starts_with(raw, 'Y |') OR raw LIKE '% hwbinder %')"""
oracle("hal_services", HALS, "SELECT report_id, p_partkey AS line_no, interface, 'hwbinder' AS transport, status, is_vendor FROM services")
HALSUM = """halsum AS (SELECT h.report_id, bool_or(raw LIKE '%exit code%') AS truncated, any_value(n.total) AS total, any_value(n.alive) AS alive, any_value(n.non_responsive) AS non_responsive, any_value(n.declared) AS declared FROM hals h
  JOIN (SELECT report_id, count(*) AS total, count(*) FILTER (status = 'alive') AS alive, count(*) FILTER (status = 'non-responsive') AS non_responsive, count(*) FILTER (status = 'declared') AS declared FROM services GROUP BY 1) n ON n.report_id = h.report_id GROUP BY 1)"""
oracle("hal_summary", HALS, HALSUM, "SELECT * FROM halsum")
FAMILIES = """versions AS (SELECT *, base || '::IThing' || fam AS family, min(p_partkey) OVER (PARTITION BY report_id, base, fam) AS first_seen,
    row_number() OVER (PARTITION BY report_id, base, fam, version ORDER BY CASE status WHEN 'alive' THEN 2 WHEN 'non-responsive' THEN 1 ELSE 0 END DESC, p_partkey) AS best FROM services),
  families AS (SELECT report_id, family, version AS highest_version, status AS highest_status, is_vendor, count(*) OVER (PARTITION BY report_id, family) AS version_count, first_seen,
    regexp_extract(base, '[^.]*$') AS short_name, is_vendor AND (base LIKE 'vendor.acme%' OR base LIKE 'vendor.foo%') AS is_oem, report FROM versions WHERE best = 1
    QUALIFY row_number() OVER (PARTITION BY report_id, family ORDER BY p_size // 10 DESC, p_size % 10 DESC) = 1)"""
oracle("hal_families", HALS, FAMILIES, "SELECT report_id, family, highest_version, highest_status, is_vendor, version_count, first_seen, short_name, is_oem FROM families")
oracle("hal_board", HALS, FAMILIES, """SELECT report_id, count(*) FILTER (highest_status = 'alive') AS alive, count(*) AS families,
  count(*) FILTER (is_vendor AND is_oem AND highest_status = 'non-responsive') AS oem_non_responsive, count(*) FILTER (is_vendor AND is_oem AND highest_status = 'declared') AS oem_declared,
  count(*) FILTER (is_vendor AND NOT is_oem AND highest_status = 'non-responsive') AS chip_non_responsive, count(*) FILTER (is_vendor AND NOT is_oem AND highest_status = 'declared') AS chip_declared,
  count(*) FILTER (is_vendor AND highest_status <> 'alive') AS vendor_issues FROM families GROUP BY 1""")  # fmt: skip
oracle("hal_lists", HALS, FAMILIES, """SELECT report_id, is_oem, highest_status, first_seen, short_name || '@' || highest_version AS name, CASE WHEN is_oem THEN 0 ELSE greatest(n - 2, 0) END AS more FROM (
  SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY first_seen) AS k FROM families WHERE is_vendor AND highest_status <> 'alive' WINDOW w AS (PARTITION BY report_id, is_oem, highest_status)) WHERE is_oem OR k <= 2""")  # fmt: skip
oracle("hal_findings", HALS, HALSUM, FAMILIES, """SELECT report_id, 'info' AS severity, 'HAL status incomplete — lshal was killed by system' AS title,
  'The lshal command was killed before completing (exit code 136 or timeout). Services not yet pinged when lshal was terminated will appear as non-responsive or declared. BSP vendor HAL status is unreliable — only OEM HAL status should be trusted.' AS description FROM halsum WHERE truncated
UNION ALL SELECT report_id, CASE WHEN is_oem THEN 'warning' ELSE 'info' END, CASE WHEN is_oem THEN '[OEM] ' ELSE '[BSP] ' END || n || CASE highest_status WHEN 'declared' THEN ' vendor HAL family(s) declared but not running' ELSE ' vendor HAL family(s) non-responsive' END,
  'The following ' || CASE WHEN is_oem THEN 'OEM' ELSE 'BSP' END || ' vendor HAL families ' || CASE highest_status WHEN 'declared' THEN 'are declared in the VINTF manifest but not registered: ' ELSE 'have their highest version non-responsive: ' END || names || '. '
  || CASE WHEN NOT is_oem THEN 'These are typically chipset-bundled HALs.' WHEN highest_status = 'declared' THEN 'The corresponding hardware features may be unavailable.' ELSE 'These may cause hardware-related functionality to fail.' END
FROM (SELECT report_id, is_oem, highest_status, count(*) AS n, string_agg(short_name || '@' || highest_version, ', ' ORDER BY first_seen) AS names FROM families WHERE is_vendor AND highest_status <> 'alive' GROUP BY 1, 2, 3) f
  JOIN halsum USING (report_id) WHERE is_oem OR NOT truncated""")  # fmt: skip

BOOT = """boot AS (SELECT r AS report_id, r = 'r1' AS boot_completed,
  CASE WHEN r = 'r0' THEN 'cold,powerkey' ELSE (SELECT arg_min('watchdog' || u, entry_idx) FROM kentries k WHERE k.report_id = r AND kind = 16) END AS boot_reason,
  greatest((SELECT count(*) FROM entries e WHERE e.report_id = r AND own_kind = 11) - 1, 0) AS restarts,
  (SELECT arg_max(CAST(boot_text AS DOUBLE), entry_idx) FROM kentries k WHERE k.report_id = r) AS uptime_s FROM (VALUES ('r0'), ('r1'), ('r2'), ('r3')) v(r))"""
oracle("boot_status", LOGS, ENTRIES, KLOGS, KENTRIES, BOOT, "SELECT * FROM boot")
oracle("boot_findings", LOGS, ENTRIES, KLOGS, KENTRIES, BOOT, """SELECT report_id, 'warning' AS severity, 'Boot not completed' AS title, 'sys.boot_completed was not set. The device may not have finished booting successfully.' AS description FROM boot WHERE NOT boot_completed AND uptime_s IS NOT NULL
UNION ALL SELECT report_id, CASE WHEN restarts >= 3 THEN 'critical' ELSE 'warning' END, 'System server restarted ' || restarts || ' time(s)', 'system_server was restarted ' || restarts || ' time(s) since boot. Frequent restarts indicate serious system instability.' FROM boot WHERE restarts > 0
UNION ALL SELECT report_id, 'warning', 'Abnormal boot reason: ' || boot_reason, 'The device booted with reason "' || boot_reason || '", which may indicate a crash, watchdog reset, or power issue.' FROM boot WHERE boot_reason IS NOT NULL""")  # fmt: skip

# Archives and sections ----------------------------------------------------------------------------------------

DOCS = f"docs AS (SELECT *, {cols(b.DOCUMENT)}, len(string_split(text, chr(10))) AS n FROM documents)"
oracle("archive_members", DOCS, """SELECT report_id, 'FS/data/anr/anr_' || doc_id AS member, CAST(length('----- pid ' || doc_id || ' at x -----') + 1 AS BIGINT) AS length, false AS is_main, true AS is_trace, false AS is_crash FROM docs WHERE doc_id % 50 <> 49
UNION ALL SELECT report_id, 'bugreport-' || doc_id || '.txt', strlen(content), true, false, false FROM docs WHERE doc_id % 50 <> 49 AND doc_id % 6 <> 5
UNION ALL SELECT report_id, 'FS/data/tombstones/tombstone_' || doc_id, 6, false, false, true FROM docs WHERE doc_id % 50 <> 49 AND doc_id % 2 = 0""")  # fmt: skip
oracle("archive_rejects", DOCS, "SELECT report_id FROM docs WHERE doc_id % 50 = 49 OR doc_id % 6 = 5")
oracle("archive_lines", DOCS, """SELECT report_id, line_no, CAST(length(l[line_no + 1]) AS BIGINT) AS chars FROM (SELECT report_id, string_split(content, chr(10)) AS l, unnest(range(len(string_split(content, chr(10))))) AS line_no
  FROM docs WHERE doc_id % 50 <> 49 AND doc_id % 6 <> 5)""")  # fmt: skip
_NAMES = [x.replace("STRING", "VARCHAR") for x in (b.LANDED_DUMP, *b.LANDED_NAMES)]
LANDED = f"""members AS (SELECT report_id, doc_id, 0 AS k, {_NAMES[1]} AS member, {_NAMES[0]} AS whole FROM docs
    UNION ALL SELECT report_id, doc_id, 1, {_NAMES[2]}, content FROM docs WHERE doc_id % 6 <> 5),
  files AS (SELECT report_id, doc_id, CASE WHEN doc_id % 50 = 49 THEN 6 ELSE 22 + sum(76 + 2 * strlen(member) + strlen(whole)) END AS bytes FROM members GROUP BY 1, 2)"""
oracle("landed_members", DOCS, LANDED, f"""SELECT m.report_id, CAST(k AS INT) AS member_idx, member, CAST(strlen(whole) AS BIGINT) AS length, k = 1 AS is_main, k = 0 AS is_trace, md5(whole) AS digest
  FROM members m JOIN files f ON f.doc_id = m.doc_id WHERE bytes <= {b.LANDED_LIMIT} AND m.doc_id % 50 <> 49""")  # fmt: skip
oracle("landed_rejects", DOCS, LANDED, f"""SELECT report_id, CASE WHEN doc_id % 50 = 49 THEN 'broken' WHEN bytes > {b.LANDED_LIMIT} THEN 'oversize' ELSE 'no report' END AS kind
  FROM files WHERE doc_id % 50 = 49 OR bytes > {b.LANDED_LIMIT} OR doc_id % 6 = 5""")  # fmt: skip
SECTS = """spots AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 5 END AS s, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS k FROM docs),
  sects AS (SELECT report_id, doc_id, 1 AS o, 'SYSTEM PROPERTIES' AS name, 'getprop' AS command, 2 AS start_line, 4 AS end_line FROM spots
    UNION ALL SELECT report_id, doc_id, 2, 'EVENT LOG', 'logcat -b events', 5, 5 FROM spots WHERE doc_id % 3 = 0
    UNION ALL SELECT report_id, doc_id, 3, 'SYSTEM LOG', 'logcat -v threadtime', s, s + n FROM spots
    UNION ALL SELECT report_id, doc_id, 4, 'KERNEL LOG', 'dmesg', s + n + 1, s + n + 2 FROM spots WHERE doc_id % 4 = 0
    UNION ALL SELECT report_id, doc_id, 5, 'DUMPSYS HIGH', 'dumpsys', s + n + 1 + k, s + n + 2 + k FROM spots),
  sections AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY o) - 1 AS section_idx FROM sects)"""
oracle("report_sections", DOCS, SECTS, """SELECT report_id, section_idx, name, command, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line,
  name = 'DUMPSYS HIGH' AND doc_id % 5 = 0 AS shows_memory, false AS shows_cpu FROM sections""")  # fmt: skip
oracle("section_routes", DOCS, SECTS, """SELECT report_id, CAST(0 AS BIGINT) AS properties, max(CASE WHEN o = 4 THEN section_idx END) AS kernel, max(CASE WHEN o = 5 AND doc_id % 5 = 0 THEN section_idx END) AS memory,
  CAST(NULL AS BIGINT) AS cpu, CAST(NULL AS BIGINT) AS hals FROM sections GROUP BY 1""")  # fmt: skip
oracle("section_log_lines", DOCS, """SELECT report_id, p AS line_no, CAST(length(l[p]) AS BIGINT) AS chars, md5(l[p]) AS digest FROM (SELECT report_id, l, unnest(range(1, len(l) + 1)) AS p FROM (
  SELECT report_id, CASE WHEN doc_id % 3 = 0 THEN list_prepend('', string_split(text, chr(10))) ELSE string_split(text, chr(10)) END AS l FROM docs))""")  # fmt: skip
oracle("report_meta", DOCS, """SELECT report_id, 'M' || doc_id % 50 AS device_model, CAST(20 + doc_id % 15 AS INT) AS sdk_level, CASE WHEN doc_id % 4 = 0 THEN '5.' || doc_id ELSE 'unknown' END AS kernel_version,
  'unknown' AS manufacturer, 'unknown' AS android_version, 'unknown' AS build_fingerprint, 'unknown' AS build_date, '2024-01-15 10:00:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') AS report_time FROM docs""")  # fmt: skip

# Findings -------------------------------------------------------------------------------------------------------

SNIPPETS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY report_id, anomaly ORDER BY source, entry_idx) AS ord FROM near),
  snippets AS (SELECT report_id, anomaly, string_agg(raw, chr(10) ORDER BY ord) AS snippet FROM ranked WHERE ord <= 10 GROUP BY 1, 2)"""
LOGFIND = f"""logfind AS (SELECT m.report_id, m.entry_idx, m.severity, m.category, m.summary AS title,
  replace(replace(m.template, '{{process}}', coalesce(' in process ' || m.process_name, '')), '{{pid}}', ' (PID ' || m.pid || ')') AS description, s.snippet, m.commands
  FROM merged m JOIN snippets s ON s.report_id = m.report_id AND s.anomaly = m.entry_idx WHERE m.anchor = m.entry_idx)"""
_LF = [*_MERGE, NEAR, SNIPPETS, LOGFIND]
oracle("log_findings", *_LF, "SELECT * FROM logfind", recursive=True)
oracle("explained_logs", LOGS, ENTRIES, KINDS, FOUND, """SELECT report_id, summary AS title, count(*) AS n FROM found
  WHERE NOT (category = 'anr' AND report_id IN (SELECT 'r' || 2 * n_regionkey FROM nation)) GROUP BY 1, 2""")  # fmt: skip
oracle("tag_findings", LOGS, ENTRIES, _tags(20), """SELECT report_id, 'Top Error Tags (E/F level)' AS title,
  'Error/Fatal log distribution: vendor=' || CAST(coalesce(sum(n) FILTER (classification = 'vendor'), 0) AS BIGINT) || ', framework=' || CAST(coalesce(sum(n) FILTER (classification = 'framework'), 0) AS BIGINT)
  || ', app=' || CAST(coalesce(sum(n) FILTER (classification = 'app'), 0) AS BIGINT) || chr(10) || chr(10)
  || string_agg('  [' || classification || '] ' || tag || ': ' || n || ' errors', chr(10) ORDER BY rank) FILTER (rank <= 15) AS description FROM tags GROUP BY 1""")  # fmt: skip

KTIME = """uptimes AS (SELECT report_id, arg_max(boot_s, entry_idx) AS uptime_s FROM kentries GROUP BY 1),
  ktimed AS (SELECT f.*, CASE WHEN f.report_id IN ('r0', 'r1', 'r2') THEN strftime(make_timestamp_ms(CAST(floor(
      CAST(epoch_ms(TIMESTAMP '2024-02-01 00:00:00') AS DECIMAL(24,3)) + 86400000 * CAST(substr(f.report_id, 2) AS INT) - CAST(uptime_s * 1000 AS DECIMAL(24,3)) + CAST(boot_s * 1000 AS DECIMAL(24,3))) AS BIGINT)), '%m-%d %H:%M:%S.%g')
    ELSE 'boot+' || printf('%.3f', CAST(boot_text AS DOUBLE)) || 's' END AS happened FROM kfound f JOIN uptimes USING (report_id))"""
_SRC = "CASE kind WHEN 13 THEN 'u:r:dom' || u || ':s0' WHEN 15 THEN 'odd' ELSE 'unknown' END"
_TGT = "CASE WHEN kind IN (13, 15) THEN 'u:object_r:typ:s0' ELSE 'unknown' END"
KFIND = f"""kfind AS (SELECT report_id, entry_idx, severity, category, summary AS title,
  replace(replace(replace(replace(replace(replace(template, '{{name}}', coalesce(victim, '')), '{{pid}}', coalesce(victim_pid, '')), '{{message}}', message), '{{heat}}', coalesce(' Temperature: ' || temperature || '°C.', '')),
    '{{source}}', {_SRC}), '{{target}}', {_TGT}) || coalesce(chr(10) || 'Suggested allow rule: ' || rule, '') AS description, happened AS ts_text, rule AS allow_rule, commands FROM ktimed)"""
_KF = [*_KBASE, KTIME, KFIND]
oracle("kernel_findings", *_KF, "SELECT * FROM kfind")
DENIED = """denied AS (SELECT report_id, CAST(0 AS BIGINT) AS o1, entry_idx AS o2, severity, category, title, description FROM kfind WHERE NOT starts_with(title, 'SELinux denial:')
  UNION ALL SELECT report_id, 1, min(entry_idx), any_value(severity), any_value(category), title || CASE WHEN count(*) > 1 THEN ' (×' || count(*) || ')' ELSE '' END,
    arg_min(description, entry_idx) || CASE WHEN count(*) > 1 THEN chr(10) || 'Occurred ' || count(*) || ' times.' ELSE '' END FROM kfind WHERE starts_with(title, 'SELinux denial:') GROUP BY report_id, title)"""
oracle("denial_merge", *_KF, DENIED, "SELECT report_id, o1, o2, title, description FROM denied")
oracle("finding_order", *_LF, *_KF, DENIED, """SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, r, o1, o2) AS insight_no,
  'insight-' || row_number() OVER (PARTITION BY report_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, r, o1, o2) AS insight_id, severity, source,
  title || CASE WHEN n > 1 THEN ' (×' || n || ')' ELSE '' END AS title, n AS occurrences FROM (
  SELECT report_id, severity, category, source, title, count(*) AS n, min(r) AS r, min(o1) AS o1, min(o2) AS o2 FROM (
    SELECT report_id, severity, category, 'logcat' AS source, title, 0 AS r, entry_idx AS o1, 0 AS o2 FROM logfind UNION ALL SELECT report_id, severity, category, 'kernel', title, 2, o1, o2 FROM denied) GROUP BY 1, 2, 3, 4, 5)""", recursive=True)  # fmt: skip

# Timeline and health -----------------------------------------------------------------------------------------------


def _runs(source: str, order: str) -> str:
    return f"""marked AS (SELECT *, CASE WHEN label = lag(label) OVER w AND source = lag(source) OVER w AND severity = lag(severity) OVER w THEN 0 ELSE 1 END AS opens FROM {source} WINDOW w AS (PARTITION BY report_id ORDER BY {order})),
  islands AS (SELECT *, sum(opens) OVER (PARTITION BY report_id ORDER BY {order}) AS island FROM marked)"""


_RUNS = """SELECT report_id, min(pos) AS seq, arg_min(ts_text, pos) AS ts_text, any_value(source) AS source, any_value(severity) AS severity, any_value(label) AS label,
  arg_min(details, pos) FILTER (opens = 1) AS details, CASE WHEN count(*) > 1 THEN count(*) END AS count, CASE WHEN count(*) > 1 THEN arg_min(ts_text, pos) || ' ~ ' || arg_max(ts_text, pos) END AS time_range FROM islands GROUP BY report_id, island"""
ALLROWS = """allrows AS (SELECT report_id, 0 AS source_rank, entry_idx AS s, ts_text, 'logcat' AS source, severity, summary AS label, process_name AS details FROM found
  UNION ALL SELECT report_id, 1, entry_idx, happened, 'kernel', severity, summary, NULL FROM ktimed
  UNION ALL SELECT report_id, 2, t, substr(ts_text, 6), 'anr', CASE WHEN reason = 'idle_main_thread' THEN 'info' ELSE 'critical' END, 'ANR: ' || l.label || ' in ' || process_name, 'Confidence: ' || confidence FROM sure JOIN labels_of l USING (reason) WHERE role = 'main'
  UNION ALL SELECT report_id, 3, s_suppkey, '02-03 10:00:00.' || substr(hexa, 1, 3), 'tombstone', 'critical', summary, library FROM crashed),
  positioned AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY starts_with(ts_text, 'boot+'), ts_text, source_rank, s) - 1 AS pos FROM allrows)"""
oracle("timeline_merged", LOGS, ENTRIES, KINDS, FOUND, *_KBASE, KTIME, *_TRACED, LABEL_ROWS, CR, CRASHES, ALLROWS, _runs("positioned", "pos"), _RUNS, recursive=True)
EV = """ev AS (SELECT 'r' || CAST(user_id % 4 AS VARCHAR) AS report_id, event_id AS pos, strftime(ts, '%m-%d %H:%M:%S.%g') AS ts_text, CASE user_id % 3 WHEN 0 THEN 'logcat' WHEN 1 THEN 'kernel' ELSE 'anr' END AS source,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, event_type AS label, event_type AS details FROM events)"""
oracle("timeline_runs", EV, _runs("ev", "pos"), _RUNS)
oracle("timeline_counts", EV, "SELECT report_id, count(*) FILTER (severity <> 'info' AND source <> 'kernel') AS shown, count(*) AS total FROM ev GROUP BY 1")
oracle("timeline_filter", EV, "SELECT report_id, pos, ts_text, severity, source FROM ev WHERE severity = 'critical' AND source = 'kernel'")
oracle("severity_counts", EV, """SELECT report_id, count(*) AS "all", count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM ev GROUP BY 1""")

_ALL_KINDS = [r[0] for r in LOG_RULES] + [r[0] for r in KERNEL_RULES] + ["crash_dump", "trace_idle", "trace_deadlock", "trace_other"]
NAMES = values([(i, k) for i, k in enumerate(_ALL_KINDS)], "names", "idx, type")
POINTS = values([(d, t, base, cap) for d, types in PENALTIES.items() for t, (base, cap) in types.items()], "points", "dimension, type, base, cap")
_LOST = "least(cap, base * CASE WHEN n = 1 THEN 1 WHEN n = 2 THEN 1.5 WHEN n = 3 THEN 1.75 ELSE 1.75 + (n - 3) * 0.1 END)"
oracle("health_deductions", NAMES, POINTS, f"""SELECT report_id, dimension, type, n, CAST({_LOST} AS DOUBLE) AS points FROM (SELECT user_id AS report_id, type, count(*) AS n FROM events JOIN names ON idx = event_id % 11 GROUP BY 1, 2) JOIN points USING (type)""")
SCORES = f"""lost AS (SELECT report_id, dimension, sum({_LOST}) AS lost FROM (SELECT user_id AS report_id, type, count(*) AS n FROM events JOIN names ON idx = event_id % (user_id % {len(_ALL_KINDS)} + 1) GROUP BY 1, 2) JOIN points USING (type) GROUP BY 1, 2),
  base0 AS (SELECT c_custkey AS report_id, greatest(0, 100 - coalesce(max(lost) FILTER (dimension = 'stability'), 0)) AS a, greatest(0, 100 - coalesce(max(lost) FILTER (dimension = 'memory'), 0)) AS b,
    greatest(0, 100 - coalesce(max(lost) FILTER (dimension = 'responsiveness'), 0)) AS c, greatest(0, 100 - coalesce(max(lost) FILTER (dimension = 'kernel'), 0)) AS d,
    (c_custkey * 37) % 1500 AS free, c_custkey % 100 AS busy, c_custkey % 41 AS wait FROM customer LEFT JOIN lost ON lost.report_id = c_custkey GROUP BY c_custkey),
  scores AS (SELECT report_id, CAST(round(a) AS INT) AS stability, CAST(round(greatest(0, b - CASE WHEN free < 500 THEN 20 WHEN free < 1000 THEN 10 ELSE 0 END)) AS INT) AS memory,
    CAST(round(greatest(0, c - CASE WHEN busy > 90 THEN 15 WHEN busy > 80 THEN 8 ELSE 0 END - CASE WHEN wait > 30 THEN 10 WHEN wait > 20 THEN 5 ELSE 0 END)) AS INT) AS responsiveness, CAST(round(d) AS INT) AS kernel FROM base0),
  health AS (SELECT report_id, CAST(round(stability * {WEIGHTS['stability']} + memory * {WEIGHTS['memory']} + responsiveness * {WEIGHTS['responsiveness']} + kernel * {WEIGHTS['kernel']}) AS INT) AS overall, stability, memory, responsiveness, kernel FROM scores)"""
oracle("health_scores", NAMES, POINTS, SCORES, "SELECT * FROM health")
oracle("fleet_bands", NAMES, POINTS, SCORES, "SELECT CASE WHEN overall >= 80 THEN 'good' WHEN overall >= 50 THEN 'fair' ELSE 'poor' END AS band, count(*) AS reports FROM health GROUP BY 1")
oracle("overview_texts", """SELECT o_orderkey, printf('%.1f', (o_orderkey * 977)::DOUBLE / 1048576) AS gb, CASE WHEN o_orderkey * 13 >= 3600 THEN (o_orderkey * 13) // 3600 || 'h ' ELSE '' END || ((o_orderkey * 13) % 3600) // 60 || 'm' AS uptime,
  o_orderpriority || '/' || o_custkey AS build FROM orders""")  # fmt: skip
oracle("latest_results", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
  WHERE k = 1 AND ts >= TIMESTAMP '2024-01-29 00:00:00'""")  # fmt: skip

# Correlation and text -------------------------------------------------------------------------------------------------

INS = f"""ins AS (SELECT * FROM (SELECT 'r' || CAST(p_partkey % 4 AS VARCHAR) AS report_id, p_partkey AS insight_no, lower({sql(TITLES)}) AS title,
  CASE p_partkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, CASE p_partkey % 5 WHEN 0 THEN 'anr' WHEN 1 THEN 'crash' WHEN 2 THEN 'memory' WHEN 3 THEN 'performance' ELSE 'kernel' END AS category FROM part) WHERE severity <> 'info')"""
CATS = values([(c, t) for c, types in CATEGORY_TYPES.items() for t in types], "cats", "category, type")


def _match(any_process: bool) -> list[str]:
    extra = " OR a.process_name IS NULL" if any_process else ""
    return [LOGS, ENTRIES, KINDS, FOUND, INS, CATS, f"""hits AS (SELECT i.report_id, i.insight_no, a.entry_idx FROM ins i JOIN found a ON a.report_id = i.report_id AND
        (contains(i.title, replace(a.type, '_', ' ')) OR contains(i.title, lower(a.process_name)) OR contains(lower(a.summary), substr(i.title, 1, 30)){extra})),
      every AS (SELECT * FROM hits UNION ALL SELECT i.report_id, i.insight_no, a.entry_idx FROM ins i JOIN cats c ON c.category = i.category JOIN found a ON a.report_id = i.report_id AND a.type = c.type
        WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.report_id = i.report_id AND h.insight_no = i.insight_no))""",
      "SELECT report_id, insight_no, entry_idx, CAST(row_number() OVER (PARTITION BY report_id, insight_no ORDER BY entry_idx) AS INT) AS rank FROM every QUALIFY rank <= 3"]


oracle("matching_anomalies", *_match(False))
oracle("matching_anomalies_any_process", *_match(True))
oracle("kernel_context", *_KBASE, INS, f"""khits AS (SELECT i.report_id, i.insight_no, e.entry_idx, e.boot_s, e.raw FROM ins i JOIN kfound e ON e.report_id = i.report_id AND (contains(i.title, replace(e.type, '_', ' ')) OR contains(lower(e.summary), substr(i.title, 1, 30)))
      QUALIFY row_number() OVER (PARTITION BY i.report_id, i.insight_no ORDER BY e.entry_idx) <= 3),
  firsts AS (SELECT * FROM kfound QUALIFY row_number() OVER (PARTITION BY report_id, severity ORDER BY entry_idx) <= 3),
  kevery AS (SELECT * FROM khits UNION ALL SELECT i.report_id, i.insight_no, f.entry_idx, f.boot_s, f.raw FROM ins i JOIN firsts f ON f.report_id = i.report_id AND f.severity = i.severity
    WHERE NOT EXISTS (SELECT 1 FROM khits h WHERE h.report_id = i.report_id AND h.insight_no = i.insight_no)),
  moments AS (SELECT DISTINCT report_id, boot_s FROM kevery),
  around AS (SELECT m.report_id, m.boot_s, e.raw FROM moments m JOIN kentries e ON e.report_id = m.report_id AND abs(e.boot_s - m.boot_s) <= {NEAR_S} QUALIFY row_number() OVER (PARTITION BY m.report_id, m.boot_s ORDER BY e.entry_idx) <= 20)""",
  """SELECT DISTINCT report_id, insight_no, text, CAST(1 AS BIGINT) AS n FROM (SELECT report_id, insight_no, raw AS text FROM kevery UNION ALL SELECT k.report_id, k.insight_no, a.raw FROM kevery k JOIN around a ON a.report_id = k.report_id AND a.boot_s = k.boot_s)""")  # fmt: skip
oracle("temporal_context", LOGS, ENTRIES, f"""moments AS (SELECT 'r' || CAST(o_custkey % 4 AS VARCHAR) AS report_id, o_orderkey AS insight_no,
    epoch_ms(strptime('2000-01-' || lpad(CAST(1 + o_custkey % 30 AS VARCHAR), 2, '0') || ' 0' || o_orderkey % 10 || ':00:00', '%Y-%m-%d %H:%M:%S')) AS moment FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 30 <> 9),
  near AS (SELECT m.report_id, m.moment, e.entry_idx, e.raw, row_number() OVER (PARTITION BY m.report_id, m.moment ORDER BY e.entry_idx) AS ord FROM (SELECT DISTINCT report_id, moment FROM moments) m
    JOIN entries e ON e.report_id = m.report_id AND e.ms BETWEEN m.moment - {NEAR_MS} AND m.moment + {NEAR_MS} AND e.level IN ('W', 'E', 'F') QUALIFY ord <= 20)""",
  "SELECT report_id, insight_no, ord, raw AS text FROM moments JOIN near USING (report_id, moment)")
oracle("trace_choice", TH, INS, """heads AS (SELECT report_id, trace_id, t, process_name, pid FROM th WHERE i = 0)""", """SELECT i.report_id, i.insight_no,
  coalesce((SELECT arg_min(trace_id, t) FROM heads h WHERE h.report_id = i.report_id AND (contains(replace(i.title, '.u', '.p'), h.process_name) OR contains(replace(i.title, '.u', '.p'), 'pid ' || h.pid))),
    (SELECT arg_min(trace_id, t) FROM heads h WHERE h.report_id = i.report_id)) AS trace_id FROM ins i""")  # fmt: skip
_CUTS = [("temporal", 3), ("thread", 2), ("log", 1), ("chain", 1)]
_stages = [f"""lines AS (SELECT source AS report_id, doc_id AS insight_no, p, l[p + 1] AS text FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)),
  rows0 AS (SELECT report_id, insight_no, ['temporal', 'thread', 'log', 'chain'][p % 4 + 1] AS kind, p // 4 + 1 AS ord, text FROM lines),
  st AS (SELECT report_id, insight_no, sum(length(text)) AS size, {', '.join(f"coalesce(sum(length(text)) FILTER (kind = '{k}' AND ord > {n}), 0) AS s{i}" for i, (k, n) in enumerate(_CUTS))} FROM rows0 GROUP BY 1, 2),
  left0 AS (SELECT *, sum(size) OVER (PARTITION BY report_id) AS rest FROM st)"""]  # fmt: skip
for _i in range(4):
    _stages.append(f"""cut{_i} AS (SELECT *, rest - coalesce(sum(s{_i}) OVER (PARTITION BY report_id ORDER BY insight_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > {BUDGET} AS c{_i} FROM left{_i}),
  left{_i + 1} AS (SELECT * EXCLUDE (rest), rest - sum(CASE WHEN c{_i} THEN s{_i} ELSE 0 END) OVER (PARTITION BY report_id) AS rest FROM cut{_i})""")
oracle("budget_cut", *_stages, f"""SELECT r.report_id, r.insight_no, r.kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, md5(string_agg(text, chr(10) ORDER BY ord)) AS digest FROM rows0 r JOIN left4 c USING (report_id, insight_no)
  WHERE NOT ({' OR '.join(f"(c{i} AND kind = '{k}' AND ord > {n})" for i, (k, n) in enumerate(_CUTS))}) GROUP BY 1, 2, 3""")  # fmt: skip
oracle("family_match", HALS, FAMILIES, """wanted AS (SELECT 'h' || CAST(s_suppkey % 20 AS VARCHAR) AS report_id, CASE s_nationkey % 4 WHEN 0 THEN 'Vendor.Acme.Pad@1.0' WHEN 1 THEN 'vendor.qti.color@1.2::x' WHEN 2 THEN 'android.hardware.gnss' ELSE 'com.none@2.' || s_suppkey END AS package_name,
    'I' || s_suppkey AS interface_name FROM supplier)""", """SELECT w.report_id, w.interface_name, '- ' || w.interface_name || ' (' || package_name || ') → ' || coalesce(highest_status || ', highest=' || highest_version || ', ' || version_count || ' version(s)' || CASE WHEN is_oem THEN ' [OEM]' ELSE '' END, 'status unknown (not found in lshal)') AS text
  FROM wanted w LEFT JOIN families f ON f.report_id = w.report_id AND split_part(f.family, '::', 1) = lower(split_part(w.package_name, '@', 1))""")  # fmt: skip
oracle("chat_prompts", """SELECT conv_id, coalesce('Previous conversation:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) FILTER (turn < last) || chr(10) || chr(10), '')
  || arg_max(text, turn) AS prompt FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY 1""")  # fmt: skip
_K = "json_extract_string(props, '$.k')"
oracle("answer_parse", f"""SELECT event_id AS report_id, event_id % 6 IN (0, 1, 2, 5) AS read, CASE WHEN event_id % 6 IN (0, 1) THEN 'sum ' || {_K} WHEN event_id % 6 IN (2, 5) THEN '' END AS summary,
  CAST(CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 1 END AS INT) AS items, CASE WHEN event_id % 6 IN (0, 1, 2, 5) THEN 'cause ' || {_K} END AS cause FROM events""")  # fmt: skip
_HIT = "event_id % 6 IN (0, 1, 2, 5) AND event_id % 2 = event_id % 3"
oracle("answer_merge", f"""SELECT event_id AS report_id, 'insight-' || event_id % 2 AS insight_id, CASE WHEN {_HIT} THEN 'cause ' || {_K} END AS cause, CASE WHEN {_HIT} THEN 'a,b' END AS evidence,
  CASE WHEN {_HIT} THEN 'root_cause' END AS category FROM events""")  # fmt: skip
oracle("answer_overview", f"SELECT event_id AS report_id, 'sum ' || {_K} AS executive_summary, '' AS system_diagnosis FROM events WHERE event_id % 6 < 2")

# Generic helpers --------------------------------------------------------------------------------------------------------

oracle("newest_versions", """v AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'alive' WHEN 1 THEN 'non-responsive' ELSE 'declared' END AS status FROM part),
  best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY CASE status WHEN 'alive' THEN 2 WHEN 'non-responsive' THEN 1 ELSE 0 END DESC, p_partkey) = 1)""",
  """SELECT p_brand, p_type, arg_max(p_size // 10 || '.' || p_size % 10, p_size) AS highest_version, arg_max(status, p_size) AS highest_status, count(*) AS version_count,
  (SELECT min(p_partkey) FROM v x WHERE x.p_brand = best.p_brand AND x.p_type = best.p_type) AS first_seen FROM best GROUP BY p_brand, p_type""")  # fmt: skip
oracle("ordered_position", """SELECT l_returnflag, pos // 100 AS page, CAST(sum(l_orderkey) AS BIGINT) AS orders, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS first_day FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem) GROUP BY 1, 2""")  # fmt: skip
oracle("running_text_groups", """lines AS (SELECT doc_id, p, l[p + 1] AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents))""",
  """SELECT doc_id, head, count(*) AS lines, CAST(sum(length(raw)) AS BIGINT) AS chars FROM (SELECT doc_id, p, raw, max(CASE WHEN p = 0 OR regexp_matches(raw, '[0-9]') THEN p END) OVER (PARTITION BY doc_id ORDER BY p) AS head FROM lines) GROUP BY 1, 2""")  # fmt: skip

# Trace context, summaries and HAL cross-reference ---------------------------------------------------------------------

_WHO = "'Thread \"' || th.name || '\" tid=' || th.tid || ' (' || th.state || '):'"
BODIES = f"""bodies AS (SELECT t, i, coalesce(string_agg('    ' || raw, chr(10) ORDER BY ord), '') AS body, coalesce(string_agg('    ' || raw, chr(10) ORDER BY ord) FILTER (ord <= 5), '') AS top FROM fr GROUP BY 1, 2),
  texts AS (SELECT th.t, th.i, th.tid, th.state, {_WHO} || coalesce('  waiting on lock 0x0' || th.holder || ' (com.app.Lock' || th.i % 3 || ') held by tid=' || th.holder, '')
      || CASE WHEN th.i % 4 = 1 THEN '  holds locks: 0x0' || th.tid || '(com.app.Lock)' ELSE '' END || chr(10) || coalesce(b.body, '') AS full_text,
    {_WHO} || chr(10) || coalesce(b.top, '') AS short_text FROM th LEFT JOIN bodies b ON b.t = th.t AND b.i = th.i)"""
oracle("trace_context", *_TRACED, FACTS, FR, CHAINS, CHOSEN, BODIES, """pieces AS (
    SELECT c.report_id, c.t, 'stack' AS kind, f.raw AS text, f.ord AS ord FROM chosen c JOIN fr f ON f.t = c.t AND f.i = c.i
    UNION ALL SELECT c.report_id, c.t, 'chain', x.full_text, n.hop FROM chosen c JOIN chain n ON n.t = c.t AND n.start_tid = c.tid JOIN texts x ON x.t = n.t AND x.tid = n.cur
    UNION ALL SELECT report_id, t, 'thread', short_text, k FROM (SELECT c.report_id, c.t, x.short_text, row_number() OVER (PARTITION BY c.t ORDER BY x.i) AS k FROM chosen c
      JOIN texts x ON x.t = c.t AND x.tid <> c.tid AND x.state IN ('Blocked', 'Native')) WHERE k <= 10)""",
  "SELECT report_id, t AS insight_no, kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, md5(string_agg(text, chr(10) ORDER BY ord)) AS digest FROM pieces GROUP BY 1, 2, 3", recursive=True)
_THREAD = "CASE WHEN c.t % 2 = 0 THEN 'android.fg' ELSE 'main' END"
oracle("trace_summaries", *_TRACED, FACTS, FR, TARGETS, CHAINS, CHOSEN, f"""SELECT c.report_id, c.t AS trace_idx,
  'Process: ' || c.process_name || ' (PID ' || c.pid || ')' || coalesce(chr(10) || '  Subject: ' || c.subject, '') || chr(10) || '  Blocked Thread: "' || {_THREAD} || '" — ' || c.reason || ' (' || c.confidence || ')'
  || chr(10) || '  Blocking Chain: ' || {_THREAD} || ' → ' || coalesce((SELECT string_agg(h.name, ' → ' ORDER BY n.hop) FROM chain n JOIN th h ON h.t = n.t AND h.tid = n.cur WHERE n.t = c.t AND n.start_tid = c.tid), 'none')
  || coalesce(CASE WHEN g.interface_name <> 'Unknown' THEN chr(10) || '  Binder Target: ' || g.interface_name || CASE WHEN g.method <> '' THEN '.' || g.method || '()' ELSE '' END || ' (' || g.package_name || ')' END, '')
  || coalesce(chr(10) || '  Suspected HAL targets: ' || (SELECT string_agg(s.interface_name || CASE s.interface_name WHEN 'IGnss' THEN '.start() on "' ELSE '.getService() on "' END || h.name || '"', ', ' ORDER BY s.si)
      FROM suspects s JOIN th h ON h.t = s.t AND h.i = s.si WHERE s.t = c.t AND s.role = c.role), '')
  || chr(10) || '  Binder Threads: ' || coalesce(q.busy, 0) || '/' || coalesce(q.total, 0) || ' busy' || chr(10) || '  Deadlock: ' || CASE WHEN EXISTS (SELECT 1 FROM rings r WHERE r.t = c.t) THEN 'YES' ELSE 'no' END AS text
  FROM chosen c LEFT JOIN targets g ON g.t = c.t AND g.tid = c.tid LEFT JOIN pool q ON q.t = c.t""", recursive=True)  # fmt: skip
oracle("hal_cross_reference", *_TRACED, FACTS, FR, TARGETS, CHOSEN, HALS, FAMILIES, """aims AS (
    SELECT c.report_id, c.t, -1 AS o, g.package_name, g.interface_name FROM chosen c JOIN targets g ON g.t = c.t AND g.tid = c.tid WHERE g.interface_name <> 'Unknown'
    UNION ALL SELECT c.report_id, c.t, s.si, CASE s.interface_name WHEN 'IGnss' THEN 'android.hardware.gnss@1.0' ELSE 'vendor.acme.hardware.pad@1.0' END, s.interface_name
    FROM chosen c JOIN suspects s ON s.t = c.t AND s.role = c.role),
  firsts AS (SELECT * FROM aims QUALIFY row_number() OVER (PARTITION BY report_id, package_name ORDER BY t, o) = 1)""",
  """SELECT a.report_id, '- ' || a.interface_name || ' (' || a.package_name || ') → ' || coalesce(f.highest_status || ', highest=' || f.highest_version || ', ' || f.version_count || ' version(s)' || CASE WHEN f.is_oem THEN ' [OEM]' ELSE '' END,
  'status unknown (not found in lshal)') AS text FROM firsts a LEFT JOIN families f ON replace(f.report_id, 'h', 'r') = a.report_id AND split_part(f.family, '::', 1) = lower(split_part(a.package_name, '@', 1))""", recursive=True)  # fmt: skip
oracle("streamed_anomalies", LOGS, KINDS, LINE_ENTRIES, FOUND,
       f"SELECT report_id, line_no, type, summary, tag, {_CLASS} AS classification FROM found")
oracle("streamed_latest", """SELECT CAST(user_id AS VARCHAR) AS id, max(epoch_us(ts) // 1000) AS at, first(event_id || ':' || event_type ORDER BY ts DESC, event_id || ':' || event_type DESC) AS payload FROM events
  GROUP BY 1 HAVING max(epoch_us(ts) // 1000) >= (SELECT max(epoch_us(ts) // 1000) FROM events) - 86400000""")  # fmt: skip
_PAGED = [NAMES, POINTS, SCORES, EV.replace("event_type AS label", "'l' AS label"), _runs("ev", "pos"), f"runs AS ({_RUNS})"]
PAGE_ROWS = """SELECT report_id, 'insights' AS part, (pos + 1) // 100 AS page, CAST(count(*) AS INT) AS rows, arg_min(severity, pos) AS first_severity, CAST(NULL AS INT) AS overall FROM ev GROUP BY 1, 3
  UNION ALL SELECT report_id, 'timeline', seq // 100, CAST(count(*) AS INT), arg_min(severity, seq), NULL FROM runs GROUP BY 1, 3
  UNION ALL SELECT CAST(report_id AS VARCHAR), 'health', 0, NULL, NULL, overall FROM health"""
oracle("result_pages", *_PAGED, PAGE_ROWS)
_DAY = "ascii(right(CAST(report_id AS VARCHAR), 1)) % 5"
oracle("written_results", *_PAGED, f"SELECT *, CAST(DATE '2024-01-01' + CAST({_DAY} AS INT) AS VARCHAR) AS report_date FROM ({PAGE_ROWS.replace('// 100', f'// CASE WHEN {_DAY} = 2 THEN 40 ELSE 100 END')})")
