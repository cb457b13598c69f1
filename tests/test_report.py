"""One archive through the whole analysis."""

import io
import json
import zipfile

import pytest

from fleetfault.operators import context as ctx
from fleetfault.operators import views
from fleetfault.plans import report
from fleetfault.sources import archives, sinks
from test_sources import SEGV
from test_traces import APP, dump, main

LOGS = """01-15 10:29:50.000  100  100 E ActivityManager: ANR in com.example.app (com.example.app/.Main)
01-15 10:29:50.100  100  100 W Other: near
01-15 10:29:51.000  200  200 E AndroidRuntime: FATAL EXCEPTION: main
	at com.example.App.run(App.java:1)
01-15 10:29:51.400  200  200 E AndroidRuntime: FATAL EXCEPTION: main
01-15 10:29:55.000  300  300 W Looper: Slow delivery took 300ms
01-15 10:29:57.000  300  300 W Looper: Slow delivery took 310ms
01-15 10:29:58.000  1  1 I Zygote: System server process 1
01-15 10:29:58.500  1  1 I Zygote: System server process 2"""
DENIED = "avc:  denied  { read } for scontext=u:r:foo:s0 tcontext=u:object_r:bar:s0 tclass=file"
KERNEL = f"""<6>[  10.000000] Linux version 5.15
<3>[  90.000000] Kernel panic - not syncing: x
<3>[  94.000000] something near
<3>[  95.000000] {DENIED}
<3>[  96.000000] {DENIED}
<3>[ 100.000000] last"""
MEM = "Total RAM: 10,000,000K\n Free RAM: 300,000K\nUsed RAM: 9,000,000K\nTotal PSS by process:\n   512,000K: com.big (pid 5)\n\nend"
CPU = "95% 12/system_server: 12% user + 6% kernel\n95.5% TOTAL: 60% user + 30% kernel + 25% iowait"
HALS = "Y | vendor.otterco.hardware.ottrbeacon@1.0::IOttrBeacon/default | hwbinder | | N/A | N/A |\nY | vendor.qti.color@1.0::IColor/default | hwbinder | | non-responsive |"


def body():
    parts = [
        ("SYSTEM PROPERTIES", "getprop", "[ro.product.manufacturer]: [Otterco]\n[ro.product.model]: [Q12]\n[sys.boot.reason]: [watchdog]"),
        ("SYSTEM LOG", "logcat -v threadtime", LOGS), ("KERNEL LOG", "dmesg", KERNEL),
        ("MEMINFO", "dumpsys meminfo", MEM), ("DUMPSYS CPU", "dumpsys", CPU), ("HARDWARE HALS", "lshal --all", HALS),
    ]
    return "== dumpstate: 2024-01-15 10:30:00\n" + "\n".join(f"------ {n} ({c}) ------\n{t}" for n, c, t in parts)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zips")
    trace = dump(
        [main("Native", ["android.os.BinderProxy.transact(BinderProxy.java:1)",
                         "vendor.otterco.hardware.ottrbeacon.V1_0.IOttrBeacon.getService(I.java:1)",
                         "com.example.app.K.init(K.java:2)"]),
         dict(name="a", tid=5, state="Blocked", wait=6, stack=APP), dict(name="b", tid=6, state="Blocked", wait=5, held=["0xff"])],
    )
    for name in ("r1", "r2"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("bugreport-x.txt", body() if name == "r1" else "== dumpstate: 2024-01-15 10:30:00\nempty")
            if name == "r1":
                z.writestr("FS/data/anr/anr_1", trace)
                z.writestr("FS/data/tombstones/tombstone_00", SEGV)
        (folder / f"{name}.zip").write_bytes(out.getvalue())
    blocks = archives.expand_archives(archives.read_archives(spark, str(folder)))
    done = report.review(report.analyse(report.typed_tables(blocks)))
    return {k: v.cache() if k in ("insights", "timeline", "health", "contexts", "review_parts") else v for k, v in done.items()}


def test_insights(tables):
    rows = tables["insights"].where("report_id = 'r1'").orderBy("insight_no").collect()
    titles = [(r.severity, r.source, r.title) for r in rows]
    assert titles == [
        ("critical", "logcat", "Fatal Exception: main"),
        ("critical", "anr", "ANR: Slow Binder Call to IOttrBeacon in com.example.app"),
        ("critical", "anr", "Deadlock: 2 threads in circular wait"),
        ("critical", "kernel", "Kernel panic: not syncing: x"),
        ("critical", "tombstone", "Native Crash: SIGSEGV [Vendor] in org.otter.maps"),
        ("warning", "logcat", "Slow operation: delivery (×2)"),
        ("warning", "cross", "Low available memory"),
        ("warning", "cross", "High CPU usage"),
        ("warning", "cross", "High I/O wait"),
        ("warning", "cross", "Boot not completed"),
        ("warning", "cross", "System server restarted 1 time(s)"),
        ("warning", "cross", "Abnormal boot reason: watchdog"),
        ("warning", "cross", "[OEM] 1 vendor HAL family(s) declared but not running"),
        ("info", "kernel", "SELinux denial: u:r:foo:s0 → u:object_r:bar:s0 (×2)"),
        ("info", "cross", "[BSP] 1 vendor HAL family(s) non-responsive"),
        ("info", "logcat", "Top Error Tags (E/F level)"),
    ]
    by = {r.title: r for r in rows}
    fatal = by["Fatal Exception: main"]
    assert fatal.description == "A fatal exception occurred (PID 200), causing the application to crash."
    assert fatal.snippet.count("FATAL EXCEPTION") == 4 and fatal.debug_commands[0] == "adb logcat -b crash -d"
    anr = by["ANR: Slow Binder Call to IOttrBeacon in com.example.app"]
    assert anr.description.split("\n") == [
        "ANR in com.example.app: Slow Binder Call (confidence: high)",
        "Target HAL: IOttrBeacon (vendor.otterco.hardware.ottrbeacon@1.0) → IOttrBeacon.getService() called from com.example.app.K.init()",
    ]
    assert anr.stack.startswith("at android.os.BinderProxy") and anr.ts_text == "01-15 10:00:00.000"
    assert by["Deadlock: 2 threads in circular wait"].description.startswith('Deadlock cycle involving: "a" (tid=5), "b" (tid=6).')
    denial = by["SELinux denial: u:r:foo:s0 → u:object_r:bar:s0 (×2)"]
    assert denial.description.endswith("Suggested allow rule: allow foo bar:file { read };\nOccurred 2 times.")
    assert denial.ts_text == "01-15 10:29:55.000"
    mem = by["Low available memory"].description
    assert mem == "Only 3.0% of RAM is free (8.6 GB used / 9.5 GB total). Top consumers: com.big (500 MB)."
    assert by["High CPU usage"].description == "Total CPU usage is 95.5% (60% user + 30% kernel). Top consumers: system_server (95%)."
    assert "  [framework] AndroidRuntime: 2 errors" in by["Top Error Tags (E/F level)"].description


def test_timeline_and_health(tables):
    rows = tables["timeline"].where("report_id = 'r1'").orderBy("seq").collect()
    assert [(r.source, r["count"]) for r in rows] == [
        ("anr", None), ("logcat", None), ("kernel", None), ("logcat", None), ("logcat", None), ("kernel", 2),
        ("logcat", None), ("tombstone", None),
    ]
    assert next(r.time_range for r in rows if r["count"]) == "01-15 10:29:55.000 ~ 01-15 10:29:56.000"
    labels = [r.label for r in rows]
    assert labels.index("ANR: Slow Binder Call in com.example.app") == 0
    slow = next(r for r in rows if r.label.startswith("Slow operation"))
    assert slow.ts_text == "01-15 10:29:55.000"
    got = {r.report_id: r for r in tables["health"].collect()}
    assert got["r2"].overall == 100
    # stability: panic 40 + fatal 10 + dump 15; memory: 20; responsiveness: anr 20 + slow 5 + 2.5 + trace 15 + cpu 15 + wait 5
    assert (got["r1"].stability, got["r1"].memory, got["r1"].responsiveness, got["r1"].kernel) == (35, 80, 38, 57)
    counts = views.timeline_counts(tables["timeline"]).where("report_id = 'r1'").first()
    assert counts.total == len(rows) and counts.shown == sum(r.severity != "info" for r in rows)


def test_contexts(tables):
    rows = tables["contexts"].where("report_id = 'r1'").collect()
    get = lambda no, kind: [r.text for r in sorted(rows, key=lambda r: r.ord) if (r.insight_no, r.kind) == (no, kind)]
    assert len(get(1, "temporal")) == 4
    assert get(2, "stack")[0].startswith("at android.os.BinderProxy")
    assert [t.split("\n")[0] for t in get(2, "thread")] == ['Thread "a" tid=5 (Blocked):', 'Thread "b" tid=6 (Blocked):']
    panic = get(4, "log")
    assert [t[:16] for t in panic] == ["<3>[  90.000000]", "<3>[  94.000000]", "<3>[  95.000000]"]
    assert tables["hal_cross_reference"].first().text == (
        "- IOttrBeacon (vendor.otterco.hardware.ottrbeacon@1.0) → declared, highest=1.0, 1 version(s) [OEM]"
    )
    text = {r.report_id: r.review for r in ctx.review_text(tables["review_parts"], problem="slow").collect()}
    assert "Model: Q12 (Otterco)" in text["r1"] and "## Insights (16 total)" in text["r1"]
    assert "### insight-2: ANR: Slow Binder Call" in text["r1"] and text["r1"].endswith("slow")
    assert text["r2"].count("\n") < 25


def test_budget(spark):
    rows = [("r", i, "temporal", j, "x" * 10) for i in range(1, 6) for j in range(1, 16)]
    parts = spark.createDataFrame(rows, "report_id string, insight_no long, kind string, ord long, text string")
    kept = ctx.within_budget(parts, budget=640)
    got = {r.insight_no: r["count"] for r in kept.groupBy("insight_no").count().collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 15, 5: 15}


def test_sinks(tables, tmp_path):
    pages = sinks.result_pages(tables["health"], tables["insights"], tables["timeline"], page_rows=10).collect()
    mine = [json.loads(r.result) for r in sorted(pages, key=lambda r: r.page) if r.report_id == "r1" and r.part == "insights"]
    assert len(mine) == 2 and sum(map(len, mine)) == 16
    small = {k: tables[k] for k in ("health", "insights")}
    sinks.write_tables(small, str(tmp_path), sinks.report_dates(tables["report_meta"]))
    assert (tmp_path / "health" / "report_date=2024-01-15").exists()
