"""Streams: log lines classified as they come, archives analysed as they land, latest results kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetfault.functions.log_rules import tag_class
from fleetfault.operators.logs import detect_anomalies, with_entry
from fleetfault.plans import report
from fleetfault.sources import archives


def classify_lines(lines: DataFrame) -> DataFrame:
    """Anomalies of arriving lines ``report_id, line_no, raw``, with the class of their tag.

    Everything here looks at one row, so the stream needs no state.  A line is
    named by its number; stitching and merging need whole reports (see
    ``analyse_arrivals``).
    """
    entries = with_entry(lines).where("e is not null").select(
        "report_id", F.col("line_no").cast("long").alias("entry_idx"), "e.*"
    )
    found = detect_anomalies(entries, ("report_id", "tag"))
    return found.withColumn("classification", tag_class(F.col("tag"))).withColumnRenamed("entry_idx", "line_no")


def append_anomalies(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Reads what is there, appends to parquet and stops; restarts go on where it ended."""
    return (
        classify_lines(lines)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def analyse_arrivals(
    spark: SparkSession, source: str, path: str, checkpoint: str, max_bytes: int = archives.MAX_ARCHIVE_BYTES
) -> StreamingQuery:
    """Analyses archives that land in ``source``; a micro-batch holds whole reports.

    A batch writes ``path/<table>/batch=<n>`` and overwrites it when repeated, so
    a restart neither loses nor doubles reports.  An archive above the size limit is not
    opened and has its row in ``rejects``.
    """
    stream = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.zip")
        .load(source)
    )

    def run(batch: DataFrame, number: int) -> None:
        small = batch.where(F.col("length") <= max_bytes)
        tables = report.analyse(report.typed_tables(archives.expand_archives(small)))
        large = archives.oversize_rows(batch, max_bytes).select("report_id", "error")
        tables["rejects"] = tables["rejects"].unionByName(large)
        for name in ("insights", "timeline", "health", "rejects"):
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class _Newest(StatefulProcessor):
    """Per id the newest ``(at, payload)``, and a timer that ends with it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at long, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tuple(self.kept.get()) if self.kept.exists() else None
        found = max(((row.at, row.payload) for row in rows), key=_rank)
        if before is None or _rank(found) > _rank(before):
            if before is None or before[0] != found[0]:
                if before is not None:
                    self.handle.deleteTimer(before[0] - 1)
                self.handle.registerTimer(found[0] - 1)
            self.kept.update(found)
            yield Row(id=key[0], at=found[0], payload=found[1], gone=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.kept.get()
        if kept is not None and kept[0] - 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
            yield Row(id=key[0], at=kept[0], payload=kept[1], gone=True)

    def close(self) -> None:
        pass


def _rank(value: tuple) -> tuple:
    at, payload = value
    return at, payload is not None, payload or ""


def _newest_of_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per id and Arrow batch, so that a busy id sends few rows to its state."""
    for frame in frames:
        order = ["at", "payload"]
        yield frame.sort_values(order, na_position="first", kind="stable").drop_duplicates("id", keep="last")


RESULTS = "id string, at long, payload string"


def keep_latest(results: DataFrame, path: str, checkpoint: str, ttl_ms: int = 3_600_000) -> StreamingQuery:
    """Streaming ``id, at, payload`` (``at`` in epoch ms) -> changes of the newest row per id.

    The newest row of an id is keyed state on local disk with a change log in the checkpoint folder.  A
    micro-batch touches and writes only the ids that come in it, or whose time has run out: it adds
    ``path/changes/batch=<n>`` with the new row of an id, or the row that is ``gone``; a repeated
    batch overwrites what it wrote.  Rows more than ``ttl_ms`` older than the newest ``at`` of earlier
    batches are late and dropped, and by the same watermark, an id not refreshed leaves the state.  Of
    rows with the same ``at`` the one with the greatest payload stays; rows without ``at`` are dropped.
    ``newest`` reads the result, ``compact`` merges the changes.
    """
    spark = results.sparkSession
    rows = results.where("at is not null").select(F.col("id").cast("string"), F.col("at").cast("long"), F.col("payload").cast("string"))
    keyed = (
        rows.mapInPandas(_newest_of_batch, RESULTS)
        .withColumn("moment", F.timestamp_millis("at"))
        # The watermark trails by one more, for Spark drops rows at the watermark itself.
        .withWatermark("moment", f"{ttl_ms + 1} milliseconds")
        .groupBy("id")
        .transformWithState(_Newest(), f"{RESULTS}, gone boolean", "Update", "EventTime")
    )

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # a query takes its settings along when it starts
        return (
            keyed.writeStream.foreachBatch(run)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(provider, before)


def _changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes with their batch; the merged ones count as older than any batch that is left."""
    schema = f"{RESULTS}, gone boolean"
    found = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/changes").parquet(f"{path}/changes")
    merged = _merged(spark, path)
    if merged is None:
        return found
    rows = spark.read.schema(schema).parquet(f"{path}/merged={merged}").withColumn("batch", F.lit(merged).cast("long"))
    return found.where(F.col("batch") > merged).unionByName(rows)


def newest(spark: SparkSession, path: str, ttl_ms: int = 3_600_000) -> DataFrame:
    """``id, at, payload``: the last change of every id that is not gone and not older than ``ttl_ms``
    before the newest of all.  One aggregation with map-side combine."""
    last = F.max_by(F.struct("at", "payload", "gone"), F.struct("batch", ~F.col("gone"), "at"))
    changes = _changes(spark, path)
    now = changes.agg(F.max("at")).first()[0]
    kept = changes.groupBy("id").agg(last.alias("last")).select("id", "last.*")
    return kept.where(~F.col("gone") & (F.col("at") >= F.lit(now) - ttl_ms)).select("id", "at", "payload")


def compact(spark: SparkSession, path: str, ttl_ms: int = 3_600_000) -> None:
    """Merge all changes into one table and remove them.  To be called while no stream writes."""
    last = _changes(spark, path).agg(F.max("batch")).first()[0]
    before = _merged(spark, path)
    if last is None or last == before:
        return
    newest(spark, path, ttl_ms).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{path}/merged={last}")
    for number in _numbers(spark, f"{path}/changes", "batch"):
        if number <= last:
            _remove(spark, f"{path}/changes/batch={number}")
    if before is not None:
        _remove(spark, f"{path}/merged={before}")


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}="))


def _merged(spark: SparkSession, path: str) -> int | None:
    """The last table of merged changes that was written to its end."""
    numbers = _numbers(spark, path, "merged")
    place = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/merged={n}/_SUCCESS")
    whole = [n for n in numbers if place(n).getFileSystem(spark._jsc.hadoopConfiguration()).exists(place(n))]
    return whole[-1] if whole else None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
