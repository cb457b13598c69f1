"""Queries of the operators beside their SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import TABLES, compare  # noqa: E402

from fleetfault.llm.oracles import ORACLES  # noqa: E402
from fleetfault.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_beside_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    said = compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER)
    assert said.startswith("ok") and "types" not in said, said
