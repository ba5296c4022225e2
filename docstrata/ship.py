"""Make this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once per Spark context.

    Python functions in plans are pickled by reference.  The archive is served by the driver; no
    executor reads the driver's disk.
    """
    context = spark.sparkContext
    if getattr(context, "_docstrata_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="docstrata-"), "docstrata.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("docstrata", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._docstrata_shipped = True
