"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import fleetfault


# A report may hold a third of all rows.  Rows grouped by (report, chunk) must spread by
# both, though a join may have placed them by report alone; and a join skewed by one
# report is split even where that costs one more shuffle.  Texts and archives go to Python workers
# in batches of few bytes: a worker holds a batch several times over, and a task has two workers.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators count on; safe to repeat, leaves everything else alone.

    The functions run in tasks travel with the plan, so workers need no copy of the package.
    """
    cloudpickle.register_pickle_by_value(fleetfault)
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "fleetfault") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.  Only a local session, whose
    executors share the machine, may do without: a temporary folder stands in."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="fleetfault-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def scratch_folder(spark: SparkSession) -> str:
    """A new place for written tables in the checkpoint folder."""
    return f"{_checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and read it from there.

    Used where a later step must see the same row placement twice, or reads it
    several times; the loss of an executor cannot change it.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the checkpoint folder and read it from there: later readers take only
    the columns and row groups they need.  For tables whose placement does not matter."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
