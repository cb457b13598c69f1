import pytest
from pyspark.sql import functions as F

from fleetfault.operators import traces


def dump(threads, pid=1234, process="com.example.app", subject=None):
    out = [f"Subject: {subject}"] if subject else []
    out += [f"----- pid {pid} at 2024-01-15 10:00:00.000 -----", f"Cmd line: {process}", ""]
    for t in threads:
        out.append(f'"{t["name"]}" {"daemon " if t.get("daemon") else ""}prio=5 tid={t["tid"]} {t["state"]}')
        out.append('  | group="main" sCount=1 flags=1')
        if "sys" in t:
            out.append(f"  | sysTid={t['sys']} nice=0")
        if "wait" in t:
            out.append(f"  - waiting to lock <0x0{t['tid']}> (a java.lang.Object) held by thread {t['wait']}")
        for lock in t.get("held", []):
            out.append(f"  - locked <{lock}> (a java.lang.Object)")
        out += [f"  {f}" if f.startswith("#") or f.startswith("native") else f"  at {f}" for f in t.get("stack", [])]
        out.append("")
    return "\n".join(out)


class Parsed:
    def __init__(self, spark, **dumps):
        rows = [("r", k, i, line) for k, v in dumps.items() for i, line in enumerate(v.split("\n"))]
        lines = spark.createDataFrame(rows, "report_id string, trace_id string, line_no long, raw string")
        self.heads = traces.trace_heads(lines)
        self.owned = traces.thread_lines(lines).cache()
        self.th, self.fr = traces.threads(self.owned), traces.frames(self.owned)
        self.cycles = traces.deadlocks(self.th)
        self.pool = traces.binder_pool(self.th, self.fr)
        self.ev = traces.stack_evidence(self.fr)
        self.primary = traces.primary_threads(self.heads, self.th)
        self.reasoned = traces.block_reasons(self.primary, self.ev, self.cycles, self.pool).cache()
        self.suspects = traces.suspected_targets(self.reasoned, self.th, self.fr, self.ev)
        self.blocks = traces.thread_blocks(self.reasoned, self.suspects)


def main(state="Runnable", stack=(), **more):
    return dict(name="main", tid=1, state=state, stack=list(stack), **more)


APP = ["com.example.app.A.a(A.java:1)", "com.example.app.B.b(B.java:2)", "com.example.app.C.c(C.java)", "com.x.D.d(D.java:4)"]
REASONS = {
    "io": (main(stack=["android.database.sqlite.SQLiteDatabase.query(SQLiteDatabase.java:1)"]), "io_on_main_thread", "high"),
    "net": (main(stack=["java.net.Socket.connect(Socket.java:1)"]), "network_on_main_thread", "high"),
    "binder": (main("Native", ["android.os.BinderProxy.transact(BinderProxy.java:1)", APP[0]]), "slow_binder_call", "high"),
    "draw": (main(stack=["android.view.View.draw(View.java:1)"]), "expensive_rendering", "medium"),
    "prov": (main(stack=["android.content.ContentProvider$Transport.query(X.java:1)"]), "content_provider_slow", "high"),
    "bcast": (main(stack=["android.app.LoadedApk$ReceiverDispatcher.x(X.java:1)"]), "broadcast_blocking", "high"),
    "start": (main(stack=["android.app.ActivityThread.handleBindApplication(X.java:1)"]), "slow_app_startup", "medium"),
    "idle": (main("Native", ["android.os.MessageQueue.nativePollOnce(Native method)"]), "idle_main_thread", "low"),
    "heavy": (main(stack=APP), "heavy_computation", "high"),
    "load": (main(stack=["java.lang.X.y(X.java:1)"]), "system_overload_candidate", "low"),
    "none": (main("Native"), "no_stack_frames", "low"),
    "odd": (main("Wondering", ["java.lang.X.y(X.java:1)"]), "unknown", "low"),
    "lock": (main("Blocked", APP[:1], wait=7), "lock_contention", "high"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    dumps = {k: dump([v[0]]) for k, v in REASONS.items()}
    dumps["dead"] = dump(
        [
            dict(name="tail", tid=30, state="Blocked", wait=12),
            main("Blocked", APP, wait=12, held=["0x0a", "0x0b"]),
            dict(name="w2", tid=12, state="Blocked", wait=13),
            dict(name="w3", tid=13, state="Blocked", wait=1, daemon=True, sys=77),
            dict(name="self", tid=40, state="Blocked", wait=40),
        ],
        pid=5678, process="com.test",
    )
    dumps["pool"] = dump([main("Waiting", ["java.lang.Object.wait(Object.java)"]),
                          dict(name="Binder:1_1", tid=5, state="Native", stack=["com.x.Y.z(Y.java:1)"])])
    dumps["susp"] = dump(
        [
            main("Native", ["android.os.MessageQueue.nativePollOnce(Native method)"]),
            dict(name="Binder:1_1", tid=5, state="Native", stack=["x.y.z(IPCThreadState.java:1)"]),
            dict(name="gnss", tid=6, state="Native", stack=[
                "#00 pc 000a /system/lib64/libhwbinder.so (android::hardware::IPCThreadState::transact(int)+20)",
                "#01 pc 000b /system/lib64/android.hardware.gnss@1.0.so (android::hardware::gnss::V1_0::BpHwGnss::_hidl_start(x)+260)",
                "#02 pc 000c /system/framework/oat/arm64/services.oat (com.android.server.Gnss.start+100)"]),
            dict(name="dup", tid=8, state="Runnable", stack=[
                "#00 pc 000a /system/lib64/libhwbinder.so (android::hardware::IPCThreadState::transact(int)+20)",
                "#01 pc 000b /system/lib64/android.hardware.gnss@1.0.so (android::hardware::gnss::V1_0::BpHwGnss::_hidl_start(x)+260)"]),
            dict(name="w", tid=9, state="Waiting", stack=["android.os.BinderProxy.transact(B.java:1)"]),
        ]
    )
    dumps["subj"] = dump(
        [main(stack=APP), dict(name="android.fg", tid=17, state="Native", stack=[
            "vendor.otterco.hardware.ottrbeacon.V1_0.IOttrBeacon.getService(IOttrBeacon.java:57)",
            "vendor.otterco.hardware.ottrbeacon.V1_0.IOttrBeacon.getService(IOttrBeacon.java:60)",
            "com.android.server.Keypad.init(Keypad.java:9)", "android.os.BinderProxy.transact(B.java:1)"])],
        subject="Blocked in handler on foreground thread (android.fg) for 15s", process="system_server",
    )
    return Parsed(spark, **dumps)


def test_heads_and_threads(parsed):
    heads = {r.trace_id: r for r in parsed.heads.collect()}
    assert (heads["dead"].pid, heads["dead"].process_name, heads["dead"].ts_text) == (5678, "com.test", "2024-01-15 10:00:00.000")
    assert heads["subj"].blocked_thread_name == "android.fg"
    th = {r.name: r for r in parsed.th.where("trace_id = 'dead'").collect()}
    assert th["w3"].daemon and th["w3"].sys_tid == 77 and th["w3"].wait_holder_tid == 1
    assert th["main"].wait_class == "java.lang.Object"
    assert [r.address for r in traces.held_locks(parsed.owned).orderBy("lock_no").collect()] == ["0x0a", "0x0b"]
    assert {r.state for r in parsed.th.where("trace_id = 'odd'").collect()} == {"Unknown"}


def test_reasons(parsed):
    got = {r.trace_id: (r.reason, r.confidence) for r in parsed.blocks.where("role = 'main'").collect()}
    for key, (_, reason, sure) in REASONS.items():
        assert got[key] == (reason, sure), key
    assert got["dead"] == ("deadlock", "high")
    assert got["pool"] == ("binder_pool_exhaustion", "high")
    assert got["susp"] == ("idle_main_thread", "medium")


def test_graph(parsed):
    rows = parsed.cycles.orderBy("trace_id", "cycle_rank", "cycle_pos").collect()
    assert [(r.trace_id, r.name) for r in rows] == [("dead", "w2"), ("dead", "w3"), ("dead", "main")]
    chains = traces.blocking_chains(parsed.th, parsed.primary)
    dead = [r.name for r in chains.where("trace_id = 'dead'").orderBy("hop").collect()]
    assert dead == ["w2", "w3", "main"]
    assert chains.where("trace_id = 'lock'").count() == 0
    nodes = {r.tid: r.thread_name for r in traces.lock_nodes(parsed.th).where("trace_id = 'lock'").collect()}
    assert nodes == {1: "main", 7: "thread-7"}
    pool = {r.trace_id: (r.total, r.busy, r.idle, r.exhausted) for r in parsed.pool.collect()}
    assert pool == {"pool": (1, 1, 0, True), "susp": (1, 0, 1, False)}


def test_targets(parsed):
    rows = parsed.suspects.collect()
    assert [(r.interface_name, r.package_name, r.method, r.thread_name, r.caller_class) for r in rows] == [
        ("IGnss", "android.hardware.gnss@1.0", "start", "gnss", "com.android.server.Gnss")
    ]
    chosen = parsed.reasoned.where("reason = 'slow_binder_call'")
    got = {r.trace_id: r for r in traces.binder_targets(chosen, parsed.fr).collect()}
    assert (got["binder"].interface_name, got["binder"].package_name, got["binder"].method) == ("A", "com.example.app", "a")
    assert (got["subj"].interface_name, got["subj"].package_name, got["subj"].method, got["subj"].caller_class) == (
        "IOttrBeacon", "vendor.otterco.hardware.ottrbeacon@1.0", "getService", "com.android.server.Keypad",
    )


def test_all_strategies_share_their_joins(spark):
    """A task sorts the frames for each join, so the strategies must not join them one by one."""
    rows = [
        ("r", "t", 1, 1, "", "", True, "native: #00 pc 01 /lib64/libbinder.so"),
        ("r", "t", 1, 2, "android.os.BinderProxy", "transact", False, "at android.os.BinderProxy.transact(BinderProxy.java:5)"),
        ("r", "t", 1, 3, "com.x.IThing$Stub$Proxy", "ask", False, "at com.x.IThing$Stub$Proxy.ask(IThing.java:7)"),
        ("r", "t", 1, 4, "com.x.App", "run", False, "at com.x.App.run(App.java:9)"),
        ("r", "t", 2, 5, "com.y.Calc", "loop", False, "at com.y.Calc.loop(Calc.java:9)"),
    ]
    fr = spark.createDataFrame(rows, "report_id string, trace_id string, thread_no long, frame_no long, class_name string, "
                                     "method_name string, is_native boolean, raw string")  # fmt: skip
    chosen = spark.createDataFrame([("r", "t", k) for k in (1, 2, 3)], "report_id string, trace_id string, thread_no long")
    found = traces.binder_targets(chosen, fr)
    assert 0 < found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4
    got = {r.thread_no: (r.interface_name, r.method, r.caller_class, r.caller_method) for r in found.collect()}
    assert got[2] == ("Calc", "loop", "com.y.Calc", "loop") and got[3] == ("Unknown", "", "", "")
    assert got[1][2:] == ("com.x.App", "run")


def test_frame_view(spark):
    raws = [
        "#01 pc 000b /system/lib64/libui.so (android::A::b(int, long)+26) (BuildId: ab)",
        "#02 pc 000c /system/framework/oat/arm64/services.oat (com.android.server.Gnss.start+100)",
        "at android.os.Looper.loop(Looper.java:12)",
        "native: #03 pc 00ab /apex/lib64/libart.so (art_quick_invoke_stub+10)",
        "something",
    ]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(raws)], "report_id string, frame_no long, raw string")
    rows = traces.frame_view(df).orderBy("frame_no").collect()
    assert [r.kind for r in rows] == ["native", "oat-java", "java", "native", "other"]
    assert rows[0].func_name == "A::b" and rows[1].show_class == "com.android.server.Gnss" and rows[1].show_method == "start"
    assert [r.is_framework for r in rows] == [False, False, True, True, False]
    assert traces.hot_frames(traces.frame_view(df)).where(F.col("function") == "android.os.Looper.loop").count() == 1


def test_lines_of_dumps_are_made_once(spark, tmp_path):
    """What many steps read comes from written tables, not from the source again."""
    from fleetfault.plans import queries

    rows = [(k, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")[k % 5]) for k in range(120)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    t = queries._reasoned(queries._dumps(spark, str(tmp_path)))
    assert t["heads"].count() == 3 and t["threads"].count() == 120
    for name in ("heads", "owned"):
        assert t[name].inputFiles() and not any("customer.parquet" in f for f in t[name].inputFiles())
