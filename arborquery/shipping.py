"""Gives the workers this package: a zip that Spark hands to every executor, whatever their import path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(package):
        return  # run from an archive that is on the workers' path already
    folder = os.path.realpath(tempfile.mkdtemp(prefix="arborquery-"))
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "arborquery.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    archive.write(full, os.path.join("arborquery", os.path.relpath(full, package)))
    context.addPyFile(path)
