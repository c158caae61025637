"""Gives executors this package when they can't import it from their own path."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_simgrove_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="simgrove-code-")
    stage = os.path.join(folder, "stage")
    shutil.copytree(here, os.path.join(stage, "simgrove"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "simgrove"), "zip", stage))
    sc._simgrove_shipped = True
