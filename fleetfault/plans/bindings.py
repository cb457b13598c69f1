"""Device texts rendered from plain tables.

The check tables hold no device logs, so each binding turns rows of one table
into log lines, dumps or snapshots, row by row and over the whole table; the
operators then read that text as they would read a report.  ``SQL`` fragments
are plain enough for any engine; `` DIV `` is whole-number division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Fragments may use the ones before them."""
    for name, sql in columns.items():
        df = df.withColumn(name, F.expr(sql))
    return df


def cases(on: str, *branches: tuple[str, str], other: str = "NULL") -> str:
    """``CASE on WHEN value THEN ...`` from (value, sql) pairs."""
    return f"CASE {on} " + " ".join(f"WHEN {w} THEN {t}" for w, t in branches) + f" ELSE {other} END"


# events -> application log ------------------------------------------------------------

LOG = {
    "report_id": "'r' || CAST(user_id % 4 AS STRING)",
    "line_no": "event_id + 1",
    "v": "CAST(floor(value) AS BIGINT)",
    "kind": "(event_id DIV 64) % 23",
    "pid": "1000 + (event_id DIV 16) % 3",
    "tid": "2000 + event_id % 7",
    "level": cases("event_type", ("'error'", "'E'"), ("'purchase'", "'W'"), ("'signup'", "'I'"), ("'click'", "'D'"), other="'V'"),
    "tag": cases(
        "kind", ("0", "'ActivityManager'"), ("1", "'AndroidRuntime'"), ("2", "'DEBUG'"), ("3", "'lowmemorykiller'"),
        ("4", "'Watchdog'"), ("5", "'JavaBinder'"), ("6", "'Looper'"), ("7", "'StrictMode'"), ("8", "'InputDispatcher'"),
        ("9", "'hwservicemanager'"), ("10", "'vendor.audio'"), ("11", "'Zygote'"), ("12", "'my_qcom_app'"),
        other="event_type",
    ),
    "message": cases(
        "kind",
        ("0", "'ANR in com.app.u' || CAST(user_id % 9 AS STRING) || ' (com.app.u' || CAST(user_id % 9 AS STRING) || '/.Main)'"),
        ("1", "'FATAL EXCEPTION: main Process: com.app.u' || CAST(user_id % 9 AS STRING)"),
        ("2", "'signal 11 (SIGSEGV)'"),
        ("3", "'kill com.app.u' || CAST(user_id % 9 AS STRING) || ' adj ' || CAST(v AS STRING)"),
        ("4", "'Blocked in handler on ui thread'"),
        ("5", "'Binder transaction timeout'"),
        ("6", "'Slow delivery took ' || CAST(v AS STRING) || 'ms'"),
        ("7", "'policy=' || CAST(v AS STRING) || ' violation=' || CAST(event_id % 5 AS STRING)"),
        ("8", "'Input dispatching timed out com.app/.U' || CAST(user_id % 9 AS STRING)"),
        ("9", "'service vendor.u' || CAST(user_id % 9 AS STRING) || ' has died'"),
        ("11", "'System server process ' || CAST(user_id AS STRING)"),
        other="'value ' || CAST(v AS STRING)",
    ),
    "shape": "CASE WHEN event_id % 11 = 5 THEN 'tail' WHEN event_id % 31 = 7 THEN 'stray' ELSE 'entry' END",
}
# A quarter of the continuation lines makes an anomaly of an entry that is none by its own line.
LOG_TAIL = "chr(9) || CASE WHEN v % 4 = 1 THEN 'Input dispatching timed out com.app/.T' ELSE 'at com.app.Frame' END || CAST(v AS STRING)"
LOG_STRAY = "'stray line ' || CAST(v AS STRING)"
LOG_ENTRY = "ts_text || '  ' || CAST(pid AS STRING) || '  ' || CAST(tid AS STRING) || ' ' || level || ' ' || tag || ': ' || message"
LOG_RAW = f"CASE shape WHEN 'tail' THEN {LOG_TAIL} WHEN 'stray' THEN {LOG_STRAY} ELSE {LOG_ENTRY} END"


def as_log_lines(events: DataFrame) -> DataFrame:
    timed = events.withColumn("ts_text", F.date_format("ts", "MM-dd HH:mm:ss.SSS"))
    return with_columns(timed, {**LOG, "raw": LOG_RAW}).select("report_id", "line_no", "raw")


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return as_log_lines(load(spark, folder, "events"))


# orders -> kernel log -----------------------------------------------------------------

KERNEL = {
    "report_id": "'r' || CAST(o_custkey % 4 AS STRING)",
    "line_no": "o_orderkey + 1",
    "u": "o_custkey % 7",
    "kind": "(o_orderkey DIV 3) % 29",
    "secs": "o_orderkey DIV 4",
    "micros": "(o_orderkey % 4) * 250000 + o_custkey % 1000",
    "message": cases(
        "kind",
        ("0", "'Kernel panic - not syncing: fatal ' || CAST(u AS STRING)"),
        ("1", "'Out of memory: Killed process ' || CAST(o_custkey AS STRING) || ' (app' || CAST(u AS STRING) || ')'"),
        ("2", "'oom-kill: constraint'"),
        ("3", "'lowmemorykiller: kill ''app' || CAST(u AS STRING) || ''''"),
        ("4", "'kswapd0: active'"),
        ("5", "'usb driver error ' || CAST(u AS STRING)"),
        ("6", "'GPU hang ' || CAST(u AS STRING)"),
        ("7", "'thermal emergency at ' || CAST(90 + u AS STRING) || ' C, throttling'"),
        ("8", "'watchdog: bark'"),
        ("9", "'thermal throttling zone cpu' || CAST(u AS STRING) || ' 85C'"),
        ("10", "'mmc0: error -' || CAST(u AS STRING)"),
        ("11", "'PM: suspend aborted by u' || CAST(u AS STRING)"),
        ("12", "'device resume failed'"),
        ("13", "'avc:  denied  { read } for scontext=u:r:dom' || CAST(u AS STRING) || ':s0 tcontext=u:object_r:typ:s0 tclass=file'"),
        ("14", "'SELinux: policy loaded'"),
        ("15", "'avc:  denied  { ioctl } for scontext=odd tcontext=u:object_r:typ:s0 tclass=file'"),
        ("16", "'androidboot.bootreason=watchdog' || CAST(u AS STRING)"),
        other="'eth0 link ' || CAST(u AS STRING)",
    ),
    "boot_text": "CAST(secs AS STRING) || '.' || lpad(CAST(micros AS STRING), 6, '0')",
    "raw": "CASE WHEN o_orderkey % 37 = 6 THEN 'noise' ELSE '<' || CAST(u AS STRING) || '>[' || lpad(boot_text, 14, ' ') || '] ' || message END",
}


def kernel_lines(spark: SparkSession, folder: str) -> DataFrame:
    return with_columns(load(spark, folder, "orders"), KERNEL).select("report_id", "line_no", "raw")


# customer -> thread dumps ---------------------------------------------------------------

# Forty customers in key order are one dump; the last dump may be short.
FRAMES = [
    "  at android.database.sqlite.SQLiteDatabase.query(SQLiteDatabase.java:10)",
    "  at java.net.Socket.connect(Socket.java:20)",
    "  at android.os.BinderProxy.transact(BinderProxy.java:30)",
    "  at android.view.View.draw(View.java:40)",
    "  at android.content.ContentProvider$Transport.query(ContentProvider.java:50)",
    "  at android.app.LoadedApk$ReceiverDispatcher.performReceive(LoadedApk.java:60)",
    "  at android.app.ActivityThread.handleBindApplication(ActivityThread.java:70)",
    "  at android.os.MessageQueue.next(MessageQueue.java:80)",
    "  at vendor.acme.hardware.pad.V1_0.IPad.getService(IPad.java:90)",
    "  #00 pc 0001a /system/lib64/libhwbinder.so (android::hardware::IPCThreadState::transact(int)+20)",
    "  #01 pc 0001b /system/lib64/android.hardware.gnss@1.0.so (android::hardware::gnss::V1_0::BpHwGnss::_hidl_start(x)+26)",
    "  #02 pc 0001c /system/framework/oat/arm64/services.oat (com.android.server.Gnss.start+100)",
    "  at java.lang.Object.wait(Native method)",
    "  native: #03 pc 0001d /apex/lib64/libart.so (art_quick_invoke_stub+10)",
    None,
    "  at com.app.deep.Calc.loop(Calc.java:99)",
]


def frame_case(index: str) -> str:
    return cases(f"({index})", *[(str(i), f"'{f}'") for i, f in enumerate(FRAMES) if f])


TRACE = {
    "t": "c_custkey DIV 40",
    "i": "c_custkey % 40",
    "report_id": "'r' || CAST(t % 4 AS STRING)",
    "trace_id": "'t' || CAST(t AS STRING)",
    "name": "CASE WHEN i = 0 THEN 'main' WHEN i < 5 AND t % 3 = 0 THEN 'Binder:' || CAST(t AS STRING) || '_' || CAST(i AS STRING) "
            "WHEN i = 8 THEN 'android.fg' ELSE 'worker-' || CAST(i AS STRING) END",
    "tid": "i + 1",
    "state": "CASE WHEN c_custkey % 3 <> 0 AND t % 5 <> 0 THEN 'Blocked' ELSE "
             + cases("c_mktsegment", ("'AUTOMOBILE'", "'Runnable'"), ("'BUILDING'", "'Native'"), ("'FURNITURE'", "'Waiting'"),
                     ("'HOUSEHOLD'", "'Native'"), other="'Runnable'") + " END",
    "holder": "CASE WHEN state = 'Blocked' THEN (i * 3 + 1) % 40 + 1 END",
    "f1": frame_case("(t + c_custkey) % 16"),
    "f2": "CASE WHEN c_custkey % 2 = 0 THEN " + frame_case("(c_custkey DIV 2) % 16") + " END",
    "f3": "CASE WHEN (c_custkey + t) % 5 < 2 THEN '  at com.app.Work' || CAST(i AS STRING) || '.run(Work.java:' || CAST(i AS STRING) || ')' END",
    "subject": "CASE WHEN t % 2 = 0 THEN 'Input dispatching timed out on thread (android.fg) for ' || CAST(t AS STRING) || 's' END",
}
TRACE_PID = "7000 + t"
TRACE_PROCESS = "'com.app.p' || CAST(t % 30 AS STRING)"
TRACE_LINES = [
    "CASE WHEN i = 0 AND subject IS NOT NULL THEN 'Subject: ' || subject END",
    f"CASE WHEN i = 0 THEN '----- pid ' || CAST({TRACE_PID} AS STRING) || ' at 2024-01-15 10:00:00.' || lpad(CAST(t % 1000 AS STRING), 3, '0') || ' -----' END",
    f"CASE WHEN i = 0 THEN 'Cmd line: ' || {TRACE_PROCESS} END",
    "'\"' || name || '\" ' || CASE WHEN i % 6 = 1 THEN 'daemon ' ELSE '' END || 'prio=' || CAST(i % 10 AS STRING) || ' tid=' || CAST(tid AS STRING) || ' ' || state",
    "'  | sysTid=' || CAST(c_custkey + 5000 AS STRING) || ' nice=0'",
    "CASE WHEN holder IS NOT NULL THEN '  - waiting to lock <0x0' || CAST(holder AS STRING) || '> (a com.app.Lock' || CAST(i % 3 AS STRING) || ') held by thread ' || CAST(holder AS STRING) END",
    "CASE WHEN i % 4 = 1 THEN '  - locked <0x0' || CAST(tid AS STRING) || '> (a com.app.Lock)' END",
    "f1", "f2", "f3", "''",
]


def trace_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_columns(load(spark, folder, "customer"), TRACE)
    text = F.filter(F.array(*[F.expr(x) for x in TRACE_LINES]), lambda x: x.isNotNull())
    return rows.select("report_id", "trace_id", "i", F.posexplode(text)).select(
        "report_id", "trace_id", (F.col("i") * 16 + F.col("pos")).alias("line_no"), F.col("col").alias("raw")
    )


# supplier -> native-crash dumps -----------------------------------------------------------

CRASH = {
    "report_id": "'r' || CAST(s_suppkey % 4 AS STRING)",
    "file": "'tombstone_' || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 17 = 5 THEN '.pb' ELSE '' END",
    "signo": cases("(s_suppkey % 6)", ("0", "4"), ("1", "6"), ("2", "7"), ("3", "11"), ("4", "35"), other="0"),
    "signame": cases("(s_suppkey % 6)", ("0", "'SIGILL'"), ("1", "'SIGABRT'"), ("2", "'ODD'"), ("3", "'SIGSEGV'"), other="'SIGRT'"),
    "library": cases("(s_nationkey % 4)", ("0", "'/vendor/lib64/hw/gpu.so'"), ("1", "'/system/lib64/libui.so'"), ("2", "'/odm/lib/cam.so'")),
    "abort": "CASE WHEN s_suppkey % 3 = 1 THEN rpad('message ' || CAST(s_suppkey AS STRING), CAST(60 + s_nationkey * 2 AS INT), 'x') END",
    "hexa": "lpad(CAST(s_suppkey AS STRING), 8, '0')",
}
CRASH_LINES = [
    "'*** *** ***'",
    "'Build fingerprint: ''brand/dev' || CAST(s_nationkey AS STRING) || ''''",
    "CASE WHEN s_suppkey % 5 <> 0 THEN 'ABI: ''arm64''' END",
    "'Timestamp: 2024-02-03 10:00:00.' || hexa || '+0000'",
    "'pid: ' || CAST(s_suppkey + 100 AS STRING) || ', tid: ' || CAST(s_suppkey + 200 AS STRING) || ', name: thr' || CAST(s_nationkey AS STRING) || '  >>> com.proc' || CAST(s_suppkey % 8 AS STRING) || ' <<<'",
    "CASE WHEN signo > 0 THEN 'signal ' || CAST(signo AS STRING) || ' (' || signame || '), code 1 (CODE' || CAST(s_suppkey % 2 AS STRING) || '), fault addr 0x' || hexa END",
    "CASE WHEN abort IS NOT NULL THEN 'Abort message: ''' || abort || '''' END",
    "'    x0  ' || hexa || hexa || '  x1  00000000000000aa'",
    "'    x0  ' || hexa || '00000000  lr  00000000000000bb'",
    "CASE WHEN library IS NOT NULL THEN 'backtrace:' END",
    "CASE WHEN library IS NOT NULL THEN '      #00 pc 000c01d4  ' || library || ' (func' || CAST(s_suppkey AS STRING) || '+158)' END",
    "CASE WHEN library IS NOT NULL THEN '      #01 pc 000c01d8  /system/lib64/libc.so (abort) (BuildId: abc' || hexa || ')' END",
    "CASE WHEN library IS NOT NULL THEN '    x9  0000000000000001' END",
    "'memory near pc:'",
    "'    x2  ' || hexa || hexa",
]


def crash_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_columns(load(spark, folder, "supplier"), CRASH)
    text = F.filter(F.array(*[F.expr(x) for x in CRASH_LINES]), lambda x: x.isNotNull())
    return rows.select("report_id", "file", F.posexplode(text)).select(
        "report_id", "file", F.col("pos").cast("long").alias("line_no"), F.col("col").alias("raw")
    )


# customer -> memory and CPU snapshots ----------------------------------------------------

# Fifty customers in key order are one report; a short last report has no block end.
SNAPSHOT = {
    "report": "c_custkey DIV 50",
    "i": "c_custkey % 50",
    "report_id": "'s' || CAST(report AS STRING)",
    "kb": "CAST(floor(abs(c_acctbal)) AS BIGINT) + 1000",
    "free": "(report * 37) % 3000",
    "iowait": "(report * 13) % 40",
    "busy": "60 + (report * 7) % 40",
    "load": "CAST(floor(abs(c_acctbal)) AS BIGINT) % 100",
}
MEM_LINES = [
    "CASE WHEN i = 0 THEN 'Total RAM: 10,000K (status normal)' END",
    "CASE WHEN i = 0 THEN ' Free RAM: ' || CAST(free AS STRING) || 'K' END",
    "CASE WHEN i = 0 THEN ' Used RAM: ' || CAST(10000 - free AS STRING) || 'K' END",
    "CASE WHEN i = 0 THEN 'Total PSS by process:' END",
    "CASE WHEN i % 7 = 6 THEN 'junk' ELSE '    ' || CAST(kb DIV 1000 AS STRING) || ',' || lpad(CAST(kb % 1000 AS STRING), 3, '0') || 'K: com.c' || CAST(c_custkey AS STRING) || ' (pid ' || CAST(c_custkey + 10 AS STRING) || ' / activities)' END",
    "CASE WHEN i = 49 THEN '' END",
    "CASE WHEN i = 49 THEN 'Total PSS by OOM adjustment:' END",
]
CPU_LINES = [
    "'  ' || CAST(load AS STRING) || '.5% ' || CAST(c_custkey + 10 AS STRING) || '/com.c' || CAST(c_custkey AS STRING) || ': 1% user + 2% kernel'",
    "CASE WHEN i = 0 THEN CAST(busy AS STRING) || '% TOTAL: 40% user + 20.5% kernel' || CASE WHEN report % 3 = 0 THEN '' ELSE ' + ' || CAST(iowait AS STRING) || '% iowait' END END",
]


def snapshot_lines(spark: SparkSession, folder: str, templates: list[str]) -> DataFrame:
    rows = with_columns(load(spark, folder, "customer"), SNAPSHOT)
    text = F.filter(F.array(*[F.expr(x) for x in templates]), lambda x: x.isNotNull())
    return rows.select("report_id", "i", F.posexplode(text)).select(
        "report_id", (F.col("i") * 8 + F.col("pos")).alias("line_no"), F.col("col").alias("raw")
    )


# part -> HAL listing ------------------------------------------------------------------------

# A hundred parts in key order are one report.
HAL = {
    "report": "p_partkey DIV 100",
    "report_id": "'h' || CAST(report AS STRING)",
    "fam": "p_partkey % 9",
    "base": cases("fam", ("0", "'vendor.acme.pad'"), ("1", "'vendor.qti.color'"), ("2", "'android.hardware.audio'"),
                  ("3", "'vendor.acme.nfc'"), ("4", "'vendor.mtk.cam'"), ("5", "'vendor.samsung.sec'"),
                  ("6", "'android.hardware.gnss'"), ("7", "'vendor.foo.bar'"), other="'vendor.google.edge'"),
    "version": "CAST(p_size DIV 10 AS STRING) || '.' || CAST(p_size % 10 AS STRING)",
    "status": cases("(p_partkey % 5)", ("0", "'declared'"), ("1", "'non-responsive'"), ("2", "'declared'"), other="'alive'"),
    "shown": cases("(p_partkey % 5)", ("0", "'N/A'"), ("1", "'non-responsive'"), ("2", "'declared'"), ("3", "'alive'"), other="'1234'"),
    "interface": "base || '@' || version || '::IThing' || CAST(fam AS STRING) || '/inst' || CAST(p_partkey % 2 AS STRING)",
    "raw": "CASE WHEN p_partkey % 23 = 11 THEN 'VINTF R | Interface | Transport' WHEN p_partkey % 29 = 3 THEN 'a | b' "
           "WHEN p_partkey % 100 = 50 AND report % 4 = 1 THEN 'lshal failed: exit code 136' "
           "WHEN p_partkey % 2 = 0 THEN 'Y | ' || interface || ' | HwBinder | 64 | ' || shown || ' | ' "
           "ELSE interface || ' hwbinder ' || shown END",
    "maker": "CASE WHEN report % 2 = 0 THEN 'Acme' ELSE 'unknown' END",
}


def hal_lines(spark: SparkSession, folder: str) -> DataFrame:
    return with_columns(load(spark, folder, "part"), HAL).select(
        "report_id", F.col("p_partkey").alias("line_no"), "raw"
    )


def hal_makers(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_columns(load(spark, folder, "part"), {k: HAL[k] for k in ("report", "report_id", "maker")})
    return rows.select("report_id", F.col("maker").alias("manufacturer")).distinct()


# documents -> report texts and archives ------------------------------------------------------

DOCUMENT = {
    "report_id": "'d' || CAST(doc_id AS STRING)",
    "content": "'== dumpstate: 2024-01-15 10:00:' || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || chr(10) || 'before' || chr(10) || "
               "'------ SYSTEM PROPERTIES (getprop) ------' || chr(10) || '[ro.product.model]: [M' || CAST(doc_id % 50 AS STRING) || ']' || chr(10) || "
               "'[ro.build.version.sdk]: [' || CAST(20 + doc_id % 15 AS STRING) || ']' || chr(10) || "
               "CASE WHEN doc_id % 3 = 0 THEN '------ EVENT LOG (logcat -b events) ------' || chr(10) ELSE '' END || "
               "'------ SYSTEM LOG (logcat -v threadtime) ------' || chr(10) || text || chr(10) || "
               "CASE WHEN doc_id % 4 = 0 THEN '------ KERNEL LOG (dmesg) ------' || chr(10) || 'Linux version 5.' || CAST(doc_id AS STRING) || ' x' || chr(10) ELSE '' END || "
               "'------ DUMPSYS HIGH (dumpsys) ------' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'Total RAM: 5K' ELSE 'nothing' END",
}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return with_columns(load(spark, folder, "documents"), DOCUMENT)


def document_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One zip per document, built in the tasks that hold it: ``path, content``."""
    import io
    import zipfile

    def pack(batches):
        for pdf in batches:
            packed = []
            for ident, content in zip(pdf["doc_id"], pdf["content"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("FS/", b"")
                    z.writestr(f"FS/data/anr/anr_{ident}", f"----- pid {ident} at x -----\n")
                    if ident % 6 != 5:
                        z.writestr(f"bugreport-{ident}.txt", content)
                    if ident % 2 == 0:
                        z.writestr(f"FS/data/tombstones/tombstone_{ident}", "signal")
                packed.append(out.getvalue() if ident % 50 != 49 else b"broken")
            yield pdf[["report_id"]].assign(content=packed).assign(path=lambda d: "/in/" + d["report_id"] + ".zip")[["path", "content"]]

    rows = documents(spark, folder).select("doc_id", "report_id", "content")
    return rows.mapInPandas(pack, "path string, content binary")


# A landed archive holds a dump and the report as they are (not packed), so its size is known: LANDED_BYTES.
# Every fiftieth file is no archive, and every sixth archive has no report.
LANDED_LIMIT = 4096
LANDED_FOLDERS = 256
LANDED_DUMP = "'----- pid ' || CAST(doc_id AS STRING) || ' at x -----' || chr(10)"
LANDED_NAMES = ("'FS/data/anr/anr_' || CAST(doc_id AS STRING)", "'bugreport-' || CAST(doc_id AS STRING) || '.txt'")


def landed_archives(spark: SparkSession, folder: str, place: str) -> None:
    """One zip file per document in the folders of ``place``, which Spark lists in parallel; written by the tasks
    that hold it."""
    import io
    import zipfile
    import zlib

    from fleetfault.sources.members import put

    def land(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                    z.writestr(row.dump_name, row.dump)
                    if row.doc_id % 6 != 5:
                        z.writestr(row.main_name, row.content)
                at = f"{place}/{zlib.crc32(str(row.report_id).encode()) % LANDED_FOLDERS:03d}"
                put(f"{at}/{row.report_id}.zip", out.getvalue() if row.doc_id % 50 != 49 else b"broken")
            yield pdf[["doc_id"]]

    rows = documents(spark, folder).select(
        "doc_id", "report_id", "content", F.expr(LANDED_DUMP).alias("dump"),
        F.expr(LANDED_NAMES[0]).alias("dump_name"), F.expr(LANDED_NAMES[1]).alias("main_name"),
    )
    rows.mapInPandas(land, "doc_id long").write.format("noop").mode("overwrite").save()
