"""The package on the executors.

Functions that run in Python workers are looked up there by module. Where executors see no copy of the package, it must come with the session; so it is added to
the session once, as a zip archive that the driver serves.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="seqloom-ship-")  # on the driver, which serves it while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "seqloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("seqloom", os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(archive)
    _DONE.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with the package on the executors first."""

    @functools.wraps(query)
    def run(spark: SparkSession, directory: str) -> DataFrame:
        ship(spark)
        return query(spark, directory)

    return run
