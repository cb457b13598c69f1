from pyspark.sql import functions as F

from fleetfault.operators import logs
from fleetfault.streaming import arrivals
from test_logs import at, lines


def test_classified_lines_match_batch(spark, tmp_path):
    batch = lines(
        spark, at("ActivityManager", "ANR in a.b (x)"), at("vendor.x", "fine"), "noise", at("Looper", "Slow x"),
        at("MyBinder", "timeout"),
    )
    for part in (0, 1):
        batch.where(f"line_no % 2 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    arrivals.append_anomalies(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.line_no, r.type, r.classification) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "anr", "framework"), (4, "slow_operation", "framework"), (5, "binder_timeout", "app")}
    want = {(r.entry_idx, r.type) for r in logs.detect_anomalies(logs.parse_log(batch)).collect()}
    assert len(want) == len(got)
    arrivals.append_anomalies(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


RESULTS = "id string, at long, payload string"


def keep(spark, folder, rows, **options):
    """Land one file, let the stream take it and stop; the next call restarts it."""
    spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(RESULTS).parquet(str(folder / "in"))
    query = arrivals.keep_latest(stream, str(folder / "out"), str(folder / "cp"), **options)
    assert query.awaitTermination(120)
    return {(r.id, r.at, r.payload) for r in arrivals.newest(spark, str(folder / "out"), **options).collect()}


def changes(spark, folder):
    return [(r.batch, r.id, r.at, r.gone) for r in spark.read.parquet(str(folder / "out" / "changes")).orderBy("batch", "id").collect()]


def test_latest_results(spark, tmp_path):
    assert keep(spark, tmp_path, [("a", 1_000, "old"), ("b", 2_000, "only")]) == {("a", 1_000, "old"), ("b", 2_000, "only")}
    assert keep(spark, tmp_path, [("a", 5_000, "new"), ("a", 4_000, "mid")]) == {("a", 5_000, "new"), ("b", 2_000, "only")}
    late = [("c", 3_700_000, "late"), (None, 3_700_000, None), ("d", None, "no time")]
    assert keep(spark, tmp_path, late) == {("c", 3_700_000, "late"), (None, 3_700_000, None)}
    # Only touched ids are written, and those that ran out, once each.
    written = changes(spark, tmp_path)
    assert [w[1:] for w in written if not w[3]].count(("b", 2_000, False)) == 1
    assert sorted(w[1:3] for w in written if w[3]) == [("a", 5_000), ("b", 2_000)]
    # A row beyond the time to live is late; one inside it, of a new id, is not; an older row of a known id changes nothing.
    assert keep(spark, tmp_path, [("e", 99_999, "late"), ("f", 100_000, "in time"), ("c", 3_000_000, "older")]) == {
        ("c", 3_700_000, "late"), (None, 3_700_000, None), ("f", 100_000, "in time"),
    }


def test_merged_changes(spark, tmp_path):
    keep(spark, tmp_path, [("a", 10, "x"), ("b", 20, "y")], ttl_ms=100)
    before = keep(spark, tmp_path, [("a", 30, "z")], ttl_ms=100)
    arrivals.compact(spark, str(tmp_path / "out"), ttl_ms=100)
    arrivals.compact(spark, str(tmp_path / "out"), ttl_ms=100)
    assert not [p for p in (tmp_path / "out" / "changes").iterdir() if p.name.startswith("batch=")]
    assert before == {("a", 30, "z"), ("b", 20, "y")}
    assert keep(spark, tmp_path, [("b", 125, "new")], ttl_ms=100) == {("a", 30, "z"), ("b", 125, "new")}
    assert keep(spark, tmp_path, [("c", 131, "end")], ttl_ms=100) == {("b", 125, "new"), ("c", 131, "end")}


def test_batch_latest(spark):
    from fleetfault.operators.views import latest_results

    rows = [("a", 10, "x"), ("a", 90, "y"), ("b", 5, "z")]
    df = spark.createDataFrame(rows, "id string, at long, payload string")
    got = latest_results(df, ["id"], "at", F.lit(100), F.lit(60)).collect()
    assert [(r.id, r.payload) for r in got] == [("a", "y")]


def test_ties_of_one_moment(spark, tmp_path):
    for payload in ("x", "z", "y"):
        found = keep(spark, tmp_path, [("a", 5, payload), ("a", 5, None)])
    assert found == {("a", 5, "z")}


def test_stream_queries_on_part_files(spark, tmp_path):
    from fleetfault.plans.queries import QUERIES

    source = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{source}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("streamed_anomalies", "streamed_latest"):
        one, several = (sorted(map(str, QUERIES[name](spark, folder).collect())) for folder in (source, str(tmp_path)))
        assert one == several and one


def test_arrivals_with_restart_and_limit(spark, tmp_path):
    import io
    import zipfile

    def land(name, text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("bugreport-x.txt", text)
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.zip").write_bytes(out.getvalue())

    log = "== dumpstate: 2024-01-15 10:30:00\n------ SYSTEM LOG (logcat) ------\n" + at("ActivityManager", "ANR in a.b (x)")
    for wave in ({"r1": log}, {"r2": log, "big": "".join(chr(33 + k * k % 90) for k in range(9000))}):
        for name, text in wave.items():
            land(name, text)
        arrivals.analyse_arrivals(
            spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), max_bytes=700
        ).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "insights")).select("report_id").distinct().collect()
    assert {r.report_id for r in found} == {"r1", "r2"}
    bad = spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()
    assert [(r.report_id, r.error) for r in bad] == [("big", "larger than 700 bytes")]
