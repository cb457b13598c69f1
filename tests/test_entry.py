"""The driver contract, and quick queries beside their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "log_entries", "log_stats", "tag_classes", "kernel_entries", "trace_frames", "crash_dumps", "crash_registers",
    "cpu_processes", "hal_families", "report_sections", "severity_counts", "timeline_runs", "health_deductions",
    "latest_results", "chat_prompts", "answer_parse", "newest_versions", "ordered_position",
]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(entry.ORACLES) == set(entry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_quick_query(spark, tables, name):
    said = compare(spark, tables, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert said.startswith("ok") and "types" not in said, said
