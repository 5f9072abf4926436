"""Spark sessions for this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def create(master: str = "local[*]", shuffle_partitions: int = 8, **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys have ``__`` for dots."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return prepare(builder.getOrCreate())


#: Rows of documents that go to a Python worker at a time, where the session has Spark's own default.
BATCH_ROWS, USUAL_ROWS = "1000", "10000"


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package, whatever the driver's working directory.

    Elsewhere the package has to be installed or sent along (``--py-files``). Batches for Python are made smaller, as
    rows are whole documents.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == USUAL_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    env = spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    return spark
