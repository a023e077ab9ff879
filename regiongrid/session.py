"""Ships this package to executors that do not have it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application.

    Nothing is done where ``PYTHONPATH`` already leads to it.
    """
    top = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="regiongrid-src-")
    name = shutil.make_archive(f"{folder}/regiongrid", "zip", root_dir=top, base_dir="regiongrid")
    spark.sparkContext.addPyFile(name)
