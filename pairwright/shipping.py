"""Sending this package to executors that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors the package as a zip, once for each application; Spark serves the file from the driver."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pairwright-"), "pairwright.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("pairwright", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
