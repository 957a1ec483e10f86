"""The package's own code on executors that have no copy of it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Hand the package to the session's executors, once per context; Spark serves the archive from the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_attestra_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="attestra-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "attestra.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for below, _, files in os.walk(ROOT):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(below, name)
                    z.write(full, os.path.join("attestra", os.path.relpath(full, ROOT)))
    sc.addPyFile(path)
    sc._attestra_shipped = True
