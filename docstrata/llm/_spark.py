"""Shared-storage helpers: intermediate results live where every executor can read them."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship


BATCH_BYTES = 4 << 20
#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where that is unset and all executors are threads of this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "docstrata-shared")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _own_dir(spark: SparkSession) -> str:
    """This application's folder, deleted when the driver's Python ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/docstrata-{context.applicationId}"
    known = getattr(context, "_docstrata_dirs", set())
    if path not in known:
        context._docstrata_dirs = known | {path}

        def clean() -> None:
            if context._jsc is not None:
                _delete(spark, path)

        atexit.register(clean)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor, and unlike ``checkpoint()`` they are
    columnar and compressed.  ``dropped`` deletes them.  Shuffles of the write go when it ends, not only
    when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._docstrata_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no plan needs any longer."""
    for df in tables:
        _delete(df.sparkSession, df._docstrata_path)


def prepared(spark: SparkSession) -> None:
    """Make Python workers ready: the package's sources, and Arrow batches of bounded bytes, since by rows alone one of long texts may be huge.

    A bound that the session sets itself stays.
    """
    ship(spark)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """The two columns that every text operator reads, under names that no extra column can clash with."""
    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
