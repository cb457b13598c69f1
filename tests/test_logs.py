from pyspark.sql import functions as F

from fleetfault.operators import kernel, logs


def lines(spark, *texts, report="r"):
    return spark.createDataFrame([(report, i + 1, t) for i, t in enumerate(texts)], "report_id string, line_no long, raw string")


def at(tag, message, level="E", time="01-15 10:30:45.123", pid=1234):
    return f"{time}  {pid}  5678 {level} {tag}: {message}"


def test_entries_and_stitching(spark):
    df = lines(
        spark,
        "--------- beginning of main",
        "  indented before any entry",
        at("AndroidRuntime", "FATAL EXCEPTION: main"),
        "\tat com.example.App.run(App.java:1)",
        "not a log line",
        "  more of the same",
        "",
        "01-15 10:30:46.000  1000  1234  5678 I ActivityManager : hello: world",
    )
    got = logs.parse_log(df).orderBy("entry_idx").collect()
    assert [r.entry_idx for r in got] == [1, 2]
    assert got[0].message == "FATAL EXCEPTION: main\n\tat com.example.App.run(App.java:1)\n  more of the same"
    assert got[0].line_no == 3
    assert (got[1].pid, got[1].tid, got[1].tag, got[1].message) == (1234, 5678, "ActivityManager", "hello: world")
    stats = logs.log_stats(df).first()
    assert (stats.total_lines, stats.parsed_lines, stats.parse_errors) == (8, 2, 3)


def test_rules(spark):
    cases = [
        ("ActivityManager", "ANR in com.example.app (com.example.app/.Main)", "anr", "ANR in com.example.app"),
        ("AndroidRuntime", "FATAL EXCEPTION: main", "fatal_exception", "Fatal Exception: main"),
        ("AndroidRuntime", "FATAL EXCEPTION: x system_server", "fatal_exception", "Fatal Exception: x system_server"),
        ("DEBUG", "signal 11 (SIGSEGV)", "native_crash", "Native crash detected"),
        ("lowmemorykiller", "kill com.app adj 900", "oom", "OOM kill: com.app (adj=900)"),
        ("ActivityManager", "Low on memory", "oom", "Out of memory event"),
        ("Watchdog", "Blocked in handler on ui", "watchdog", "Watchdog: blocked in handler on ui"),
        ("MyBinderThing", "call TIMEOUT now", "binder_timeout", "Binder transaction timeout"),
        ("Looper", "Slow delivery took 400ms", "slow_operation", "Slow operation: delivery"),
        ("StrictMode", "policy=31 violation=4", "strict_mode", "StrictMode violation (policy=31, violation=4)"),
        ("Any", "input dispatching timed out", "input_dispatching_timeout", "Input dispatching timeout"),
        ("InputDispatcher", "Window timed out com.a/.B timeout", "input_dispatching_timeout", "Input dispatching timeout: com.a/.B"),
        ("hwservicemanager", "service 'vendor.foo' has died", "hal_service_death", "HAL service died: vendor.foo"),
        ("Other", "nothing", None, None),
    ]
    df = lines(spark, *[at(t, m) for t, m, _, _ in cases])
    got = {r.entry_idx: (r.type, r.summary) for r in logs.detect_anomalies(logs.parse_log(df)).collect()}
    for i, (tag, message, kind, summary) in enumerate(cases):
        assert got.get(i + 1, (None, None)) == (kind, summary), (tag, message)
    one = logs.detect_anomalies(logs.parse_log(lines(spark, at("ActivityManager", "ANR in a.b.c (a.b.c/.M)")))).first()
    assert one.process_name == "a.b.c"


def test_merge_is_anchored(spark):
    df = lines(spark, *[at("Looper", "Slow x", time=f"01-15 10:30:4{t}") for t in ("5.000", "5.900", "6.800", "6.900")])
    entries = logs.parse_log(df)
    merged = logs.merge_anomalies(logs.detect_anomalies(entries))
    assert [r.anchor for r in merged.orderBy("entry_idx").collect()] == [1, 1, 3, 3]
    assert logs.kept_anomalies(merged).count() == 2
    rows = logs.anomaly_context(entries, merged, limit=15).where("anomaly = 1").orderBy("ord").collect()
    assert [(r.source, r.entry_idx) for r in rows] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4)]


def test_tags(spark):
    df = lines(spark, *[at("Zygote", "x")] * 2, *[at("vendor.x", "x")] * 3, at("foo_qcom", "x", "F"), at("app", "x", "I"), at("b", "x"))
    stats = logs.tag_stats(logs.parse_log(df)).orderBy("rank").collect()
    assert [(r.tag, r["count"], r.classification) for r in stats] == [
        ("vendor.x", 3, "vendor"), ("Zygote", 2, "framework"), ("foo_qcom", 1, "vendor"), ("b", 1, "app"),
    ]
    share = {r.classification: (r["count"], r.percent) for r in logs.tag_share(logs.tag_stats(logs.parse_log(df))).collect()}
    assert share["vendor"][0] == 4 and abs(share["vendor"][1] - 400 / 7) < 1e-9


def test_kernel(spark):
    cases = [
        ("<6>[    1.234567] Linux version 5", None, None, None),
        ("[ 2.5][T123] Kernel panic - not syncing: x", "kernel_panic", "Kernel panic: not syncing: x", {"message": "Kernel panic - not syncing: x"}),
        ("<3>[3.0] Out of memory: Killed process 123 (foo)", "oom_kill", "OOM killed: foo (pid=123)", {"pid": "123", "processName": "foo"}),
        ("<3>[3.0] oom-kill: gfp", "oom_kill", "OOM kill event", {"pid": "0", "processName": "unknown"}),
        ("<3>[3.0] lowmemorykiller: kill 'a.b'", "lowmemory_killer", "LMK killed: a.b", None),
        ("<3>[3.0] kswapd0: running", "kswapd_active", "kswapd active (memory pressure)", {}),
        ("<3>[3.0] GPU driver error", "driver_error", "Driver error: GPU driver error", None),
        ("<3>[3.0] gpu hang", "gpu_error", "GPU error: gpu hang", None),
        ("<3>[3.0] thermal critical throttling 95 C", "thermal_shutdown", "Thermal shutdown triggered", {"temperature": "95"}),
        ("<3>[3.0] watchdog bite", "watchdog_reset", "Watchdog reset triggered", None),
        ("<3>[3.0] thermal throttling zone cpu0 85°C", "thermal_throttling", "Thermal throttling: cpu0", {"temperature": "85"}),
        ("<3>[3.0] mmc0: error -110", "storage_io_error", "Storage I/O error: mmc0: error -110", None),
        ("<3>[3.0] PM: suspend entry error", "suspend_resume_error", "Suspend/resume error", None),
        ("<3>[3.0] suspend aborted", "suspend_resume_error", "Suspend aborted", None),
        ("<3>[3.0] avc:  denied  { read } for scontext=u:r:foo:s0 tcontext=u:object_r:bar:s0 tclass=file", "selinux_denial",
         "SELinux denial: u:r:foo:s0 → u:object_r:bar:s0",
         {"scontext": "u:r:foo:s0", "tcontext": "u:object_r:bar:s0", "tclass": "file", "permission": "read"}),
        ("garbage", None, None, None),
    ]
    entries = kernel.parse_kernel(lines(spark, *[c[0] for c in cases]))
    assert entries.count() == len(cases) - 1
    got = {r.entry_idx: r for r in kernel.detect_events(entries).collect()}
    for i, (text, kind, summary, details) in enumerate(cases):
        row = got.get(i + 1)
        assert (row.type if row else None, row.summary if row else None) == (kind, summary), text
        if details is not None:
            assert row.details == details
    from fleetfault.functions.kernel_rules import allow_rule

    rule = kernel.detect_events(entries).where("type = 'selinux_denial'").select(allow_rule(F.col("details"))).first()[0]
    assert rule == "allow foo bar:file { read };"


def test_control_characters_are_text(spark):
    df = lines(
        spark,
        "\x01\x0101-15 10:30:45.123\x011\x012\x01E\x01DEBUG\x01signal 11",
        at("Ta\x01g", "hello\x01 world"),
        at("Plain", "x", time="01-15 10:30:45.124").replace("  1234", "  10057  1234", 1),
    )
    got = logs.parse_log(df).orderBy("entry_idx").collect()
    assert [(r.tag, r.message, r.pid) for r in got] == [("Ta\x01g", "hello\x01 world", 1234), ("Plain", "x", 1234)]
    assert logs.log_stats(df).first().parsed_lines == 2
