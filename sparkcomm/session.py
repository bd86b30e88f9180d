"""Session helpers: default settings and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "sparkcomm", *, master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    One of our own is made only where none is named and the session is local (as in tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set `spark.checkpoint.dir` to a folder all executors share.")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def honest_sizes(spark: SparkSession) -> None:
    """Let the planner take Parquet files for several times their packed size, unless the session names a factor.

    Repeated values pack so well that a file of 10 MB may hold millions of rows; taken for 10 MB they would be broadcast through the driver.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key, "1.0")) == 1.0:
        spark.conf.set(key, "8.0")


def materialize(df: DataFrame) -> DataFrame:
    """Write a (small, reused) table to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the true size, so later
    joins pick broadcast or shuffle from facts.
    """
    spark = df.sparkSession
    honest_sizes(spark)
    path = f"{shared_folder(spark).rstrip('/')}/sparkcomm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
