"""Folders for results that a later step reads again."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="followgraph-")


def shared_folder(configured: str | None, master: str) -> str:
    """The configured folder. Without one, a temporary one if all tasks run in this process, else an error."""
    if configured:
        return configured
    if master == "local" or master.startswith("local["):
        return _temporary()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that all executors share."""
    base = shared_folder(spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master)
    return f"{base}/followgraph-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside have their shuffle files removed when they end.

    Without that they stay until the driver's garbage collector finds the
    query, so those of all steps of a job add up. A step that needed some
    again would make them anew.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
