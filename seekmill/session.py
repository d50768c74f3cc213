"""Spark session factory and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import SparkSession


def get_session(app: str = "seekmill", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """The running session; else a new one, in which what spark-submit set stands and the settings below fill the rest.
    conf and cpus are the caller's wish for a new session."""
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    submitted = SparkConf()  # what the submitter set
    base = {
        "spark.master": f"local[{cpus or os.environ.get('BENCH_CPUS') or 8}]",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if not submitted.contains("spark.master"):
        base["spark.sql.shuffle.partitions"] = "8"  # a single machine
    builder = SparkSession.builder.appName(app)
    for key, value in {**{k: v for k, v in base.items() if not submitted.contains(k)}, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Put this package on the path of the Python workers, wherever they run; once a session."""
    context = spark.sparkContext
    if getattr(context, "_seekmill_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="seekmill-ship-")  # the driver serves the file to the executors
    package = Path(__file__).resolve().parent
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    context._seekmill_shipped = True
