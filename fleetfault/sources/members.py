"""Archives opened by member: directories are read first, then each member is a row that any task can read.

``archives.expand_archives`` holds an archive's bytes in one task.  Here the size of an archive
does not matter: a task reads the central directory at the end of the file, and the members become
rows that are dealt out by their size; a task seeks to its member and streams it in blocks of whole
lines.  Files are reached through Arrow's file systems by the path that Spark's listing gives
(local, HDFS, S3, GCS); where those can not reach a store, ``archives`` works through Spark's reader.
"""

from __future__ import annotations

import itertools
import os
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetfault.session import scratch_folder, written
from fleetfault.sources.archives import BLOCK_BYTES, BLOCKS, MAX_ARCHIVE_BYTES, member_class, member_blocks, oversize_rows, zip_files

MEMBERS = (
    "report_id string, path string, member_idx int, member string, length long, packed long, is_main boolean, "
    "is_trace boolean, is_crash boolean, error string"
)
SPLIT_BYTES = 64 * 1024 * 1024
RUN_BYTES = 4 * 1024 * 1024  # packed members of an archive that one task reads in a row,
RUN_MEMBERS = 4  # and how many of them
BATCH_ROWS = 1024
LISTED = "64k"  # what a file weighs when only its name and length are read: some 2,000 a task
ENTRIES = "name string, length long"  # of a folder, below the root; a folder's length is null
TASK_ARCHIVES = 20_000  # whose directories one task reads
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError, KeyError, pa.ArrowInvalid)


def _schema(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in columns.split(", "))])


def _batches(rows: Iterator[dict], columns: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``BLOCK_BYTES`` of text and content."""
    schema, held, size = _schema(columns), [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + len(row.get("content") or b"")
        if size >= BLOCK_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def opened(path: str) -> pa.NativeFile:
    """A file that can be read from any place.  ``file:/x`` and ``file:///x`` are the same."""
    path = re.sub(r"^file:/+", "file:///", path)
    system, place = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def put(path: str, content: bytes) -> None:
    """Write one file, as ``opened`` finds it."""
    path = re.sub(r"^file:/+", "file:///", path)
    system, place = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    system.create_dir(place.rpartition("/")[0])
    with system.open_output_stream(place) as out:
        out.write(content)


def _entries(root: str, below: str) -> Iterator[dict]:
    """``ENTRIES`` of one folder; a local one is streamed."""
    if local := re.match(r"file:/+", root):
        with os.scandir("/" + root[local.end() :] + below) as found:
            for entry in found:
                try:
                    entry.name.encode()
                    yield {"name": f"{below}/{entry.name}", "length": None if entry.is_dir() else entry.stat().st_size}
                except (OSError, UnicodeEncodeError):  # a link to nothing or in a circle, a name that no path can hold
                    continue
    else:
        system, place = fs.FileSystem.from_uri(root)
        for info in system.get_file_info(fs.FileSelector(place + below)):
            if info.type in (fs.FileType.Directory, fs.FileType.File):
                yield {"name": f"{below}/{info.base_name}", "length": info.size}


def _taken(entry: dict) -> bool:
    """Folders, and zip files that are not empty, without the hidden names that Spark's listing leaves out."""
    name = entry["name"].rpartition("/")[2]
    hidden = name.startswith(".") or name.startswith("_") and "=" not in name
    if entry["length"] is None:
        return name.startswith(("_metadata", "_common_metadata")) or not (hidden or name.endswith("._COPYING_"))
    return name.endswith(".zip") and entry["length"] > 0 and not hidden


def _root(spark: SparkSession, path: str) -> str | None:
    """The whole path of one folder, null where only Spark can list: a pattern, a file, a store unknown to Arrow."""
    if re.search(r"[{}\[\]*?\\]", path):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(place) or not store.getFileStatus(place).isDirectory():
        return None
    root = store.makeQualified(place).toString().rstrip("/")
    try:
        return root if root.startswith("file:") or fs.FileSystem.from_uri(root) else None
    except (OSError, pa.ArrowException):
        return None


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of all zip files below ``path``, written once; no content is read.

    Tasks list the folders, one level of them after the other, so the driver holds no names: Spark's own
    listing keeps every file in its memory.  It is left to Spark only where Arrow does not know the store.
    """
    root = _root(spark, path)
    if root is None:
        weight = "spark.sql.files.openCostInBytes"
        before = spark.conf.get(weight)
        spark.conf.set(weight, LISTED)
        try:
            return written(zip_files(spark, path).select("path", "length"))
        finally:
            spark.conf.set(weight, before)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = (name for batch in batches for name in batch.column(0).to_pylist())
        return _batches((row for name in folders for row in _entries(root, name) if _taken(row)), ENTRIES)

    tasks, levels = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    folders = spark.range(1).select(F.lit("").alias("name"))
    while not levels or not folders.isEmpty():
        levels.append(scratch_folder(spark))
        folders.repartition(tasks, F.xxhash64("name")).mapInArrow(listed, ENTRIES).write.parquet(levels[-1])
        folders = spark.read.schema(ENTRIES).parquet(levels[-1]).where("length is null").select("name")
    files = spark.read.schema(ENTRIES).parquet(*levels).where("length is not null")
    return files.select(F.concat(F.lit(root), "name").alias("path"), "length")


def member_table(files: DataFrame, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """``MEMBERS`` of all ``(path, length)`` archives, from their directories alone.

    An archive without a readable directory, and one above ``max_bytes``, which is not opened, has one
    row with an ``error``.
    """

    def directory(path: str) -> list[dict]:
        told = {"report_id": path.rsplit("/", 1)[-1].removesuffix(".zip"), "path": path}
        rows = []
        try:
            with opened(path) as file, zipfile.ZipFile(file) as archive:
                for idx, info in enumerate(i for i in archive.infolist() if not i.is_dir()):
                    main, trace, crash = member_class(info.filename)
                    rows.append(told | dict(
                        member_idx=idx, member=info.filename, length=info.file_size, packed=info.compress_size,
                        is_main=main, is_trace=trace, is_crash=crash,
                    ))
        except _BROKEN as problem:
            rows = [told | {"error": str(problem) or type(problem).__name__}]
        return rows

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (path for batch in batches for path in batch.column(0).to_pylist())
        return _batches((row for path in paths for row in directory(path)), MEMBERS)

    # A directory costs a seek, whatever the archive's size: deal archives out evenly.  The number of tasks is
    # given, for by the few bytes of the paths Spark would make one task of them.
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // TASK_ARCHIVES))
    small = files.where(F.col("length") <= max_bytes).select("path").repartition(tasks, F.xxhash64("path"))
    large = oversize_rows(files, max_bytes, "path").select("report_id", "path", "error")
    return small.mapInArrow(listed, MEMBERS).unionByName(large, allowMissingColumns=True)


def read_members(members: DataFrame, block_bytes: int = BLOCK_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``archives.BLOCKS`` of the members, each read once; error rows stay as they are.

    Runs of up to ``RUN_MEMBERS`` members of an archive, of about ``RUN_BYTES``, are dealt out at random, in as many tasks as the packed
    sizes fill ``split_bytes`` (one pass over the small table of members tells): a large archive is read in
    many tasks, and a small one is opened once.  A member whose bytes turn out broken gives one error row
    in place of the blocks that follow.
    """

    def broken(row: dict, problem: Exception) -> dict:
        return {"report_id": row["report_id"], "error": str(problem) or type(problem).__name__}

    def blocks_of(path: str, rows: Iterator[dict]) -> Iterator[dict]:
        try:
            file = opened(path)
        except _BROKEN as problem:
            yield from (broken(row, problem) for row in rows)
            return
        with file:
            try:
                archive = zipfile.ZipFile(file)
                infos = [i for i in archive.infolist() if not i.is_dir()]
            except _BROKEN as problem:
                yield from (broken(row, problem) for row in rows)
                return
            for row in rows:
                told = {name: row[name] for name in ("report_id", "member_idx", "member", "length", "is_main", "is_trace", "is_crash")}
                try:
                    with archive.open(infos[row["member_idx"]]) as stream:
                        yield from member_blocks(stream, told, block_bytes)
                except _BROKEN as problem:
                    yield broken(row, problem)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for (path, failed), own in itertools.groupby(rows, lambda row: (row["path"], row["error"] is not None)):
            if failed:
                yield from ({"report_id": row["report_id"], "error": row["error"]} for row in own)
            else:
                yield from blocks_of(path, own)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows_of(batches), BLOCKS)

    total = members.agg(F.sum("packed")).first()[0] or 0
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // split_bytes))
    before = F.sum("packed").over(Window.partitionBy("path").orderBy("member_idx").rowsBetween(Window.unboundedPreceding, -1))
    runs = members.withColumn("_run", F.floor(F.coalesce(before, F.lit(0)) / RUN_BYTES))
    place = F.xxhash64("path", "_run", F.floor(F.col("member_idx") / RUN_MEMBERS))
    dealt = runs.repartition(tasks, place).sortWithinPartitions("path", "member_idx")
    return dealt.drop("_run").mapInArrow(read, BLOCKS)


def read_reports(
    spark: SparkSession, path: str, max_bytes: int = MAX_ARCHIVE_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Blocks of all archives below ``path``; oversize and broken ones are error rows (``archives.rejects`` lists them)."""
    return read_members(written(member_table(archive_files(spark, path), max_bytes)), block_bytes)
