"""The folder that the driver and all executors share, and tables there that cut a plan's lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where that is unset and all executors are threads of this process."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "docstrata-shared")


def deleted(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for this application, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/docstrata-work-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        if spark.sparkContext._jsc is not None:
            deleted(spark, path)

    atexit.register(clean)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: later plans start here, and a lost executor loses nothing of it."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
