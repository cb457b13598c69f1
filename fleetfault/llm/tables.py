"""How the operators read a table: named columns only, whatever else it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetfault.session import prepare


# Texts are long: batches of fewer rows keep Python workers small.
BATCH_ROWS = 4000
BATCH_BYTES = "64m"  # what Spark takes by itself; numpy works on larger batches than archives need


def set_up(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    set_up(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
