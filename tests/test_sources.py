import io
import zipfile

from pyspark.sql import functions as F

from fleetfault.operators import crashes, kernel, logs, snapshots
from fleetfault.sources import archives, members, sections

TEXT = """== dumpstate: 2024-01-15 10:30:00
preamble
------ SYSTEM PROPERTIES (getprop) ------
[ro.build.version.release]: [14]
[ro.build.version.sdk]: [34]
[ro.product.manufacturer]: [Otterco]
[sys.boot_completed]: [1]
------ EMPTY LOG (logcat -b empty) ------
------ SYSTEM LOG (logcat -v threadtime) ------
01-15 10:29:58.000  1  2 I Zygote: System server process 1
01-15 10:29:59.000  1  2 I Zygote: System server process 2
------ KERNEL LOG (dmesg) ------
<6>[    1.000000] Linux version 5.15.1 foo
<6>[  100.500000] androidboot.bootreason=watchdog
------ DUMPSYS HIGH (dumpsys) ------
Total RAM: 1,000K
bad ----- line"""


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.mkdir("FS") if hasattr(z, "mkdir") else None
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_archives_and_sections(spark, tmp_path):
    (tmp_path / "r1.zip").write_bytes(
        zipped(**{"bugreport-x.txt": TEXT, "bugreport-mini.txt": "no", "FS/data/anr/anr_1": "a\nb\n",
                  "FS/data/tombstones/tombstone_00": "t", "x/anr_7": "q", "other.bin": "\x00\x01"})
    )
    (tmp_path / "r2.zip").write_bytes(zipped(**{"readme.txt": "x"}))
    (tmp_path / "r3.zip").write_bytes(b"broken")
    (tmp_path / "r4.txt").write_bytes(b"ignored")
    for size in (7, 1 << 20):
        blocks = archives.expand_archives(archives.read_archives(spark, str(tmp_path)), block_bytes=size).cache()
        kinds = {r.member: (r.is_main, r.is_trace, r.is_crash) for r in archives.members(blocks).where("report_id = 'r1'").collect()}
        assert kinds["bugreport-x.txt"] == (True, False, False) and kinds["x/anr_7"] == (False, True, False)
        assert kinds["bugreport-mini.txt"] == (False, False, False) and kinds["FS/data/tombstones/tombstone_00"][2]
        assert {r.report_id for r in archives.rejects(blocks).collect()} == {"r2", "r3"}
        lines = archives.main_lines(blocks)
        assert [r.raw for r in lines.orderBy("line_no").collect()] == TEXT.split("\n")
        assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(len(TEXT.split("\n"))))
        dumps = archives.dump_lines(blocks, "is_trace", "trace_id").orderBy("trace_id", "line_no").collect()
        assert [(r.trace_id, r.raw) for r in dumps] == [("FS/data/anr/anr_1", "a"), ("FS/data/anr/anr_1", "b"), ("FS/data/anr/anr_1", ""), ("x/anr_7", "q")]
    assert archives.read_archives(spark, str(tmp_path), max_bytes=50).count() == 1
    large = archives.oversize_archives(spark, str(tmp_path), max_bytes=50)
    assert large.count() + 1 == archives.read_archives(spark, str(tmp_path)).count()
    assert all(r.error == "larger than 50 bytes" and "/" not in r.report_id for r in large.collect())

    marked = sections.mark_sections(lines).cache()
    found = sections.sections(marked)
    rows = found.orderBy("section_idx").collect()
    assert [(r.name, r.start_line, r.end_line) for r in rows] == [
        ("SYSTEM PROPERTIES", 2, 6), ("EMPTY LOG", 7, 7), ("SYSTEM LOG", 8, 10), ("KERNEL LOG", 11, 13), ("DUMPSYS HIGH", 14, 16),
    ]
    routed = sections.routes(found)
    assert routed.first()[1:] == (0, 3, 4, None, None)
    meta = sections.report_meta(marked, routed).first()
    assert (meta.android_version, meta.sdk_level, meta.manufacturer, meta.device_model) == ("14", 34, "Otterco", "unknown")
    assert meta.kernel_version == "5.15.1" and str(meta.report_ts) == "2024-01-15 10:30:00"
    log = sections.log_lines(marked)
    assert [(r.line_no, r.raw[-1:]) for r in log.orderBy("line_no").collect()] == [(1, ""), (2, "1"), (3, "2")]
    boot = snapshots.boot_status(
        logs.parse_log(log), kernel.parse_kernel(sections.routed_lines(marked, routed, "kernel")),
        sections.routed_lines(marked, routed, "properties"),
    ).first()
    assert (boot.boot_completed, boot.boot_reason, boot.restarts, float(boot.uptime_s)) == (True, "watchdog", 1, 100.5)


SEGV = """*** *** ***
Build fingerprint: 'acme/otter/otter:15/ZQ9X:eng/local'
ABI: 'arm64'
Timestamp: 2031-07-19 21:04:52.600000001+0100
pid: 4210, tid: 4377, name: TileWorker  >>> org.otter.maps <<<
signal 11 (SIGSEGV), code 1 (SEGV_MAPERR), fault addr 0x00000000000000e4
    x0  0000000000000000  x1  00000000000000c1
    x0  00000000000000aa  lr  00000071d0a4e2f8
backtrace:
      #00 pc 000b1c20  /vendor/lib64/libottergpu.so (tile_upload+92)
      #01 pc 00008e11  /system/lib64/libotter.so (otter::M::d) (BuildId: 77fe01)
    x9  0000000000000000
"""
ABORT = """signal 6 (ODD), code -1 (SI_QUEUE)
Abort message: '{}'
registers:
    r1 12
  ab 34

  cd 56
memory near:
    r2  0000000000000001
"""


def test_crashes(spark):
    files = {"a": SEGV, "b": ABORT.format("x" * 90), "c": "nothing here", "d.pb": SEGV}
    rows = [("r", f, i, t) for f, text in files.items() for i, t in enumerate(text.split("\n"))]
    every = spark.createDataFrame(rows, "report_id string, file string, line_no long, raw string")
    lines = crashes.usable_dumps(every)
    got = {r.file: r for r in crashes.crash_dumps(lines).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.pid, a.tid, a.thread_name, a.process_name, a.signal, a.signal_code) == (4210, 4377, "TileWorker", "org.otter.maps", 11, "SEGV_MAPERR")
    assert a.fault_addr == "0x00000000000000e4" and a.is_vendor_crash and a.ts_text.startswith("2031-07-19")
    assert a.summary == "Native crash (SIGSEGV (SEGV_MAPERR)) in org.otter.maps at libottergpu.so"
    assert b.signal_name == "SIGABRT" and b.summary == "Native crash (SIGABRT) in unknown: " + "x" * 80 + "..."
    frames = crashes.crash_frames(lines).orderBy("line_no").collect()
    assert [(f.frame_number, f.function, f.offset, f.build_id) for f in frames] == [(0, "tile_upload", 92, None), (1, "otter::M::d", None, "77fe01")]
    regs = {(r.file, r.register): r.value for r in crashes.registers(lines).collect()}
    assert regs == {("a", "x0"): "00000000000000aa", ("a", "x1"): "00000000000000c1", ("a", "lr"): "00000071d0a4e2f8",
                    ("b", "r1"): "12", ("b", "ab"): "34", ("b", "r2"): "0000000000000001"}
    assert crashes.dump_counts(every, crashes.crash_dumps(lines)).first()[1:] == (4, 2)
    assert {r.file for r in crashes.unreadable_dumps(lines, crashes.crash_dumps(lines)).collect()} == {"c"}


def section(spark, text):
    rows = [("r", i, t) for i, t in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "report_id string, line_no long, raw string")


def test_memory_and_cpu(spark):
    mem = section(spark, "Total RAM: 7,410,232K (ok)\n Free RAM: 100,000K\nUsed RAM: 5,000,000K\nTotal PSS by process:\n"
                  + "\n".join(f"    {i},456K: com.p{i} (pid {i} / activities)" for i in range(12)) + "\n\nTotal PSS by OOM adjustment:\n  9K: z (pid 1)")
    assert snapshots.mem_summary(mem).first()[1:] == (7410232, 100000, 5000000)
    top = snapshots.mem_processes(mem).orderBy("rank").collect()
    assert len(top) == 10 and (top[1].pss_kb, top[1].process_name, top[1].pid) == (1456, "com.p1", 1)
    assert snapshots.mem_processes(section(spark, "Total PSS by process:\n 5K: a (pid 1)")).count() == 0
    cpu = section(spark, "  18% 12/system_server: 12% user + 6% kernel\n 20.5% 13/b: 1% user + 2% kernel\n18% 9/c: 1% user + 1% kernel\n34% TOTAL: 18% user + 12% kernel + 2.1% iowait")
    assert snapshots.cpu_summary(cpu).first()[1:] == (34.0, 18.0, 12.0, 2.1)
    assert [r.pid for r in snapshots.cpu_processes(cpu).orderBy("rank").collect()] == [13, 12, 9]


def test_hals(spark):
    lines = section(spark, """VINTF R | Interface | Transport
Y | android.hardware.tuner@3.0::IFrontend/main | hwbinder | 64 | 2/4 | 3051 | 88
Y | vendor.otterco.hardware.ottrbeacon@1.0::IBeacon/main | hwbinder | | N/A | N/A |
vendor.qti.color@1.4::IColor/default hwbinder non-responsive
vendor.qti.color@1.10::IColor/default hwbinder declared
vendor.qti.color@1.10::IColor/other hwbinder non-responsive
vendor.qti.color@1.4::IColor/x hwbinder 64 1234
a | b
lshal failed: exit code 136""")
    services = snapshots.hal_services(lines).cache()
    assert snapshots.hal_summary(lines, services).first()[1:] == (True, 6, 2, 2, 2)
    meta = spark.createDataFrame([("r", "Otterco")], "report_id string, manufacturer string")
    fam = {r.short_name: r for r in snapshots.hal_families(services, meta).collect()}
    assert (fam["color"].highest_version, fam["color"].highest_status, fam["color"].version_count, fam["color"].is_oem) == ("1.10", "non-responsive", 2, False)
    assert fam["ottrbeacon"].is_oem and not fam["tuner"].is_oem
    assert snapshots.vendor_issues(snapshots.hal_families(services, meta)).first().vendor_issues == 2
    versions = spark.createDataFrame([("1.0",), ("1",), ("1.0.1",), ("0",)], "v string")
    keys = {r.v: r.k for r in versions.select("v", snapshots.version_key(F.col("v")).alias("k")).collect()}
    assert keys["1.0"] == keys["1"] == [1] and keys["1.0.1"] == [1, 0, 1] and keys["0"] == []


def test_archives_by_member(spark, tmp_path):
    """Members of one archive are read in many tasks; blocks are those of whole archives; faults are rows."""
    import zipfile

    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("FS/", b"")
        for k in range(40):
            z.writestr(f"FS/data/anr/anr_{k}", f"line {k}\n" * (k + 1))
        z.writestr("bugreport-a.txt", "".join(f"row {k}\n" for k in range(3000)))
        z.writestr("picture.bin", bytes(range(256)) * 20)
    with zipfile.ZipFile(tmp_path / "bad.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bugreport-b.txt", "good line\n" * 50)
        z.writestr("FS/data/anr/anr_1", "to be broken\n" * 50)
    raw = bytearray((tmp_path / "bad.zip").read_bytes())
    at = raw.find(b"anr_1") + 8
    raw[at : at + 4] = b"\xff\xff\xff\xff"
    (tmp_path / "bad.zip").write_bytes(raw)
    (tmp_path / "none.zip").write_bytes(b"no archive")
    (tmp_path / "huge.zip").write_bytes(b"x" * 100_000)
    path = f"file:{tmp_path}"
    table = members.member_table(members.archive_files(spark, path), max_bytes=50_000)
    found = table.collect()
    assert {r.report_id: r.error is None for r in found if r.member_idx in (None, 0)} == {"big": True, "bad": True, "none": False, "huge": False}
    assert [r.member_idx for r in sorted(found, key=lambda r: r.member_idx or 0) if r.report_id == "big"] == list(range(42))
    blocks = members.read_members(table, block_bytes=4096)
    tasks = blocks.where("report_id = 'big'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
    want = archives.expand_archives(archives.read_archives(spark, path, 50_000).where("path like '%big.zip'"), block_bytes=4096)
    assert sorted(map(str, blocks.where("report_id = 'big'").collect())) == sorted(map(str, want.collect()))
    assert blocks.where("report_id = 'bad' and member = 'bugreport-b.txt'").count() == 1
    assert {r.report_id for r in archives.rejects(blocks).collect()} == {"bad", "none", "huge"}
    assert members.member_table(members.archive_files(spark, path).where("false")).count() == 0


def test_small_archives_are_opened_once(spark, tmp_path):
    """All members of a small archive are read by one task; few tasks list many files; folders are searched."""
    for k in range(300):
        (tmp_path / f"f{k % 7}").mkdir(exist_ok=True)
        (tmp_path / f"f{k % 7}" / f"a{k}.zip").write_bytes(zipped(**{"bugreport-x.txt": "a\nb", "FS/data/anr/anr_1": "c", "o": "d"}))
    files = members.archive_files(spark, f"file:{tmp_path}")
    assert files.count() == 300 and files.rdd.getNumPartitions() <= 8
    assert spark.conf.get("spark.sql.files.openCostInBytes").rstrip("b") == str(4 << 20)
    blocks = members.read_members(members.member_table(files))
    placed = blocks.select("report_id", F.spark_partition_id().alias("task"))
    read = placed.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks")).collect()
    assert len(read) == 300 and {(r.n, r.tasks) for r in read} == {(3, 1)}


def test_tasks_list_the_files(spark, tmp_path):
    """The files are those of Spark's listing: odd and hidden names, links, folders of any depth."""
    names = ["a.zip", "_a.zip", "_k=1.zip", ".h.zip", "_metadata.zip", "b.ZIP", "c.zip._COPYING_", "e f.zip", "p%20q.zip", "s+t.zip", "#h.zip",
             "n\nl.zip", "_d/in.zip", "_metadata/in.zip", "_k=2/in.zip", ".d/in.zip", "d.zip/in.zip", "w._COPYING_/in.zip", "k=3/y.zip", "deep/er/st/x.zip"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "empty.zip").touch()
    (tmp_path / "nothing").mkdir()
    for link, to in (("link.zip", "a.zip"), ("more", "deep"), ("dead.zip", "gone")):
        (tmp_path / link).symlink_to(tmp_path / to)
    for path in (f"file:{tmp_path}", f"{tmp_path}/deep//er/", f"{tmp_path}/nothing", f"{tmp_path}/.d", f"{tmp_path}/a.zip", f"{tmp_path}/d*"):
        got, want = members.archive_files(spark, path), archives.zip_files(spark, path).select("path", "length")
        assert sorted(got.collect()) == sorted(want.collect())
    assert members.archive_files(spark, str(tmp_path)).count() == 14
    local, by_arrow = (sorted(str(x) for x in members._entries(root, "") if members._taken(x)) for root in (f"file:{tmp_path}", str(tmp_path)))
    assert local == by_arrow and "{'name': '/deep', 'length': None}" in local and len(local) == 15


def test_the_driver_does_not_list_archives(spark, tmp_path, monkeypatch):
    (tmp_path / "f").mkdir()
    for k in range(30):
        (tmp_path / "f" / f"a{k}.zip").write_bytes(zipped(**{"bugreport-x.txt": "a\nb"}))
    monkeypatch.setattr(members, "zip_files", None)
    assert members.read_reports(spark, str(tmp_path)).where("error is null").count() == 30


def test_directories_are_read_in_many_tasks(spark, tmp_path):
    """However few bytes the paths have, not one task opens all archives."""
    for k in range(60):
        (tmp_path / f"a{k}.zip").write_bytes(zipped(**{"bugreport-x.txt": "a\nb"}))
    table = members.member_table(members.archive_files(spark, str(tmp_path)))
    assert table.where("error is null").select(F.spark_partition_id()).distinct().count() == 4


def test_python_workers_get_few_bytes_at_once(spark):
    """A batch of archives or texts is bounded by its bytes, not only by its rows."""
    big = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("content"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    assert 0 < max(r.n for r in big.mapInArrow(sizes, "n long").collect()) <= 8 << 20
