"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(master: str = "local[*]", app: str = "partloom", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with this library's settings; a cluster's own submit-time settings still win where they are given."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, which import the page readers by module name.

    Not needed where the package is installed on every node; Spark distributes the archive from the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_partloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="partloom-zip-"), "partloom")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
    context._partloom_shipped = True


@contextmanager
def small_batches(spark: SparkSession, limit: int) -> Iterator[None]:
    """Jobs that run meanwhile hand rows to Python workers in Arrow batches of about ``limit`` bytes, or of one row. Spark counts rows otherwise, however long they are."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(limit))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local path would be lost with its
    machine, so the setting is required there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="partloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        configured = f"file:{folder}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
