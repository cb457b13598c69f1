"""Report archives: read, open in tasks, turn members into line-aligned blocks and lines."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ARCHIVE_BYTES = 200 * 1024 * 1024
BLOCK_BYTES = 4 * 1024 * 1024

BLOCKS = (
    "report_id string, member_idx int, member string, length long, is_main boolean, is_trace boolean, "
    "is_crash boolean, block_no int, first_line long, text string, content binary, error string"
)


def read_archives(spark: SparkSession, path: str, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """Zip files of at most ``max_bytes``; the size test reaches the scan.  ``oversize_archives``
    lists the others."""
    return zip_files(spark, path).where(F.col("length") <= max_bytes)


def zip_files(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
    return reader.load(path)


def report_of_path(path: Column) -> Column:
    """The file name without ``.zip``."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.zip\z", "")


def oversize_archives(spark: SparkSession, path: str, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """``(report_id, length, error)`` of the archives that ``read_archives`` leaves out.  Their
    content is not read."""
    return oversize_rows(zip_files(spark, path), max_bytes)


def oversize_rows(archives: DataFrame, max_bytes: int = MAX_ARCHIVE_BYTES, *more: str) -> DataFrame:
    return archives.where(F.col("length") > max_bytes).select(
        report_of_path(F.col("path")).alias("report_id"), "length", F.lit(f"larger than {max_bytes} bytes").alias("error"), *more
    )


def member_class(member: str) -> tuple[bool, bool, bool]:
    """(main report text, thread dump, native-crash dump); a member may be several."""
    import re

    base, low = member.rsplit("/", 1)[-1], member.lower()
    main = re.match(r"bugreport.*\.txt\Z", base) is not None and "mini" not in base
    trace = "data/anr/" in low or re.search(r"anr_\d+", member) is not None
    return main, trace, "data/tombstones/" in low


def _blocks(stream, size: int) -> Iterator[bytes]:
    """Pieces that end at a line end; the last piece is what follows the last cut."""
    rest = b""
    while chunk := stream.read(size):
        rest += chunk
        cut = rest.rfind(b"\n")
        if cut >= 0 and len(rest) >= size:
            yield rest[:cut]
            rest = rest[cut + 1 :]
    yield rest


def member_blocks(stream, told: dict, size: int) -> Iterator[dict]:
    """Rows of ``BLOCKS`` of one open member; ``told`` are the columns that all its blocks share."""
    line, as_text = 0, told["is_main"] or told["is_trace"] or told["is_crash"]
    for no, block in enumerate(_blocks(stream, size)):
        text = block.decode("utf-8", "replace") if as_text else None
        yield dict(told, block_no=no, first_line=line, text=text, content=None if as_text else block)
        line += block.count(b"\n") + 1


def _open(report: str, content: bytes, size: int) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for idx, info in enumerate(i for i in archive.infolist() if not i.is_dir()):
            main, trace, crash = member_class(info.filename)
            told = dict(
                report_id=report, member_idx=idx, member=info.filename, length=info.file_size,
                is_main=main, is_trace=trace, is_crash=crash, error=None,
            )
            with archive.open(info) as stream:
                yield from member_blocks(stream, told, size)


def expand_archives(archives: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every member of every archive as blocks of whole lines.

    Columns of ``binaryFile`` in; the file name without ``.zip`` is the report.
    Archives spread over tasks and a member streams out in blocks, so memory is
    bounded by one archive plus one block.  A broken archive gives one ``error`` row.
    """
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                report = path.rsplit("/", 1)[-1].removesuffix(".zip")
                try:
                    yield from _open(report, bytes(content), block_bytes)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError) as problem:
                    yield dict.fromkeys(names) | {"report_id": report, "error": str(problem) or type(problem).__name__}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row["text"] or "") + len(row["content"] or b"")
            if size >= BLOCK_BYTES or len(held) >= 1024:
                yield pd.DataFrame(held, columns=names)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    return archives.select("path", "content").mapInPandas(run, BLOCKS)


def members(blocks: DataFrame) -> DataFrame:
    """One row per member."""
    return blocks.where("block_no = 0").select(
        "report_id", "member_idx", "member", "length", "is_main", "is_trace", "is_crash"
    )


def rejects(blocks: DataFrame) -> DataFrame:
    """Archives that cannot be used: broken, or without a main text."""
    return (
        blocks.groupBy("report_id")
        .agg(
            F.max("error").alias("error"),
            F.max_by("length", F.when(F.col("is_main") & (F.col("block_no") == 0), F.col("member_idx"))).alias("_main"),
        )
        .where("error is not null or coalesce(_main, 0) = 0")
        .select("report_id", F.coalesce("error", F.lit("no main report text")).alias("error"))
    )


def _lines(blocks: DataFrame, *names: str) -> DataFrame:
    return blocks.select(*names, "first_line", F.posexplode(F.split("text", "\n"))).select(
        *names, (F.col("first_line") + F.col("pos")).alias("line_no"), F.col("col").alias("raw")
    )


def main_lines(blocks: DataFrame) -> DataFrame:
    """Lines of the main text, numbered from 0; the last main member of an archive wins."""
    last = blocks.where("is_main and block_no = 0").groupBy("report_id").agg(F.max("member_idx").alias("member_idx"))
    return _lines(blocks.where("is_main").join(last, ["report_id", "member_idx"], "left_semi"), "report_id")


def dump_lines(blocks: DataFrame, which: str, name: str) -> DataFrame:
    """Lines of thread dumps (``is_trace``) or crash dumps (``is_crash``), file name as ``name``."""
    return _lines(blocks.where(which).withColumnRenamed("member", name), "report_id", name)


def text_lines(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Lines of whole-text rows, numbered from 0."""
    return texts.select(*keys, F.posexplode(F.split(text, "\n"))).select(
        *keys, F.col("pos").cast("long").alias("line_no"), F.col("col").alias("raw")
    )
