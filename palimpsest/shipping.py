"""Makes the package importable in Python workers that were not started with it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application as a zip, once; nothing if workers inherit its folder."""
    package = Path(__file__).resolve().parent
    root = str(package.parent)
    paths = [os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    app = spark.sparkContext.applicationId
    if root in paths or app in _done:
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", root, package.name)
    spark.sparkContext.addPyFile(made)
    _done.add(app)
